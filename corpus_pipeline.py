"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written to the shared folder and read back
as the next one's documents: toxic documents go, one document of each group of near copies stays, documents that
hold a benchmark item go, personal data is masked, and what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriescast.llm.decontaminate import stage_decontaminate
from seriescast.llm.jaccard import stage_jaccard
from seriescast.llm.packing import stage_packing
from seriescast.llm.pii import stage_pii
from seriescast.llm.toxicity import stage_toxicity
from seriescast.sources.storage import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", stage_toxicity),
    ("ngram_jaccard", stage_jaccard),
    ("decontamination", stage_decontaminate),
    ("pii", stage_pii),
    ("packing", stage_packing),
]

#: A classifier and a tokenizer are no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
