"""Price-like series derived from the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescast.sources.bars import UNIVERSE, daily_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five long series: one per order priority."""
    return daily_bars(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate",
                      "o_totalprice", "o_orderkey")


def symbol_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """110 short series: customers spread over the known symbols and four unknown ones."""
    slot = (F.col("o_custkey") % 110).cast("int")
    known = F.array(*[F.lit(s) for s in UNIVERSE])
    symbol = F.when(slot < len(UNIVERSE), F.get(known, slot)).otherwise(
        F.concat(F.lit("X"), slot.cast("string")))
    return daily_bars(table(spark, sf_dir, "orders"), symbol, "o_orderdate", "o_totalprice",
                      "o_orderkey")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five 30-row series: one per event type."""
    return daily_bars(table(spark, sf_dir, "events"), "event_type", "ts", "value", "event_id")
