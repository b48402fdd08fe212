"""Registration of this subpackage's queries, and the column helpers its operators share."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = ["token_counts", "secrets", "pii", "decontaminate", "substrings", "quality", "jaccard", "search",
           "toxicity", "packing", "collocations", "mixing", "spelling", "pipeline_query"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"seriescast.llm.{m}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text being empty; other columns never meet those an operator makes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def digest(text: Column | str = "text") -> Column:
    """Tells apart rows of one ``doc_id`` that differ in text."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def held_out() -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    found = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(found, lambda w: w != "")
