"""Running totals over whole series, without gathering a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriescast.operators.layout import BLOCK, blocks, in_order, index_series, with_series_values


def running_sum(df: DataFrame, column: str, name: str, size: int = BLOCK) -> DataFrame:
    """Cumulative sum in series order: a window per block plus the totals of earlier blocks."""
    framed = blocks(df, 0, size)
    earlier = Window.partitionBy("ticker").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = framed.groupBy("ticker", "blk").agg(F.sum(column).alias("_sum")).select(
        "ticker", "blk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_before"))
    within = in_order().rowsBetween(Window.unboundedPreceding, 0)
    return framed.join(totals, ["ticker", "blk"]).withColumn(
        name, F.col("_before") + F.sum(column).over(within)).drop("blk", "own", "_before")


def price_path(df: DataFrame, log_return: str, price: str, name: str = "price",
               size: int = BLOCK) -> DataFrame:
    """Prices rebuilt from the first price and the log returns after it."""
    indexed = index_series(df)
    start = indexed.where("pos = 0").select("ticker", F.col(price).alias("_p0"), "n_rows")
    summed = running_sum(indexed, log_return, "_sum_r", size)
    return with_series_values(summed, start, size).withColumn(
        name, F.col("_p0") * F.exp("_sum_r")).drop("_p0", "_sum_r")
