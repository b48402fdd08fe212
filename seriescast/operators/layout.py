"""Physical layout of a panel of series.

A *series frame* has ``ticker`` and ``ds`` columns, unique together.  Rolling
operators need neighbouring rows, but nothing here ever gathers a whole series:

``index_series``  gives every row its position ``pos`` and the length ``n_rows``
                  of its series.  Rows are ranked inside calendar buckets and
                  shifted by the row counts of the earlier buckets, so the only
                  per-series state is one row per calendar bucket.
``blocks``        cuts every series into runs of ``size`` rows keyed by ``blk``
                  and repeats the last ``lookback`` rows of a run at the head of
                  the next one.  Windows are then partitioned by
                  ``(ticker, blk)``: one huge series spreads over all executors
                  and a task never holds more than ``size + lookback`` rows of it.
``own_rows``      drops the repeated rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 2048


def _bucket(df: DataFrame) -> Column:
    """Calendar bucket that bounds how many rows are ranked together."""
    if isinstance(df.schema["ds"].dataType, T.DateType):
        return F.year("ds")
    return F.to_date("ds")


def index_series(df: DataFrame) -> DataFrame:
    """Add ``pos`` (0-based) and ``n_rows``; a frame that has both is returned as is."""
    if {"pos", "n_rows"} <= set(df.columns):
        return df
    keyed = df.withColumn("_bucket", _bucket(df))
    per_series = Window.partitionBy("ticker")
    before = per_series.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("ticker", "_bucket")
        .agg(F.count(F.lit(1)).alias("_cnt"))
        .select(
            "ticker",
            "_bucket",
            F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_offset"),
            F.sum("_cnt").over(per_series).alias("n_rows"),
        )
    )
    rank = F.row_number().over(Window.partitionBy("ticker", "_bucket").orderBy("ds"))
    return (
        keyed.join(offsets, ["ticker", "_bucket"])
        .withColumn("pos", F.col("_offset") + rank - 1)
        .drop("_bucket", "_offset")
    )


def block_size(lookback: int, size: int = BLOCK) -> int:
    """Rows per block: never shorter than the rows repeated in front of it."""
    while size < lookback:
        size *= 2
    return size


def block_of(size: int, pos: str = "pos") -> Column:
    return F.expr(f"{pos} div {size}")


def blocks(df: DataFrame, lookback: int, size: int = BLOCK) -> DataFrame:
    """Block a series frame for windows that reach back ``lookback`` rows."""
    size = block_size(lookback, size)
    df = index_series(df)
    home = block_of(size)
    if lookback == 0:
        return spread_blocks(df.withColumn("blk", home).withColumn("own", F.lit(True)))
    feeds_next = (F.col("pos") % size >= size - lookback) & ((home + 1) * size < F.col("n_rows"))
    return spread_blocks(df.withColumn(
        "blk", F.explode(F.when(feeds_next, F.array(home, home + 1)).otherwise(F.array(home)))
    ).withColumn("own", F.col("blk") == home))


def spread_blocks(df: DataFrame) -> DataFrame:
    """The one exchange all windows of a frame share.

    Dozens of windows per row make a block dear in time but small in bytes, so the number
    of partitions is fixed here: adaptive coalescing goes by bytes and would leave the work
    of many executors to a few tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "ticker", "blk")


def with_series_values(df: DataFrame, per_series: DataFrame, size: int = BLOCK,
                       keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Add the columns of a one-row-per-series frame to every row.

    The small side is repeated once per block, so the join runs on ``(ticker, blk)`` and a
    huge series does not meet in one task.  An ``n_rows`` column of ``per_series`` says how
    long its series are in ``df``; without one the lengths are read from ``df``.
    """
    df = index_series(df)
    if "n_rows" not in per_series.columns:
        lengths = df.groupBy(*keys).agg(F.max("n_rows").alias("n_rows"))
        per_series = per_series.join(lengths, list(keys))
    spread = per_series.withColumn(
        "blk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_rows - 1) div {size}")))
    ).drop("n_rows")
    return df.withColumn("blk", block_of(size)).join(spread, [*keys, "blk"]).drop("blk")


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("own").drop("own")


def unblocked(df: DataFrame) -> DataFrame:
    """Drop every layout column."""
    return df.drop("own", "blk", "pos", "n_rows")


def in_order() -> WindowSpec:
    return Window.partitionBy("ticker", "blk").orderBy("pos")
