"""Forward fill, then backward fill, then zero, without gathering a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriescast.operators.layout import BLOCK, blocks, in_order


def gap_fill(df: DataFrame, columns: list[str], size: int = BLOCK) -> DataFrame:
    """Fill NULLs of ``columns`` from the row before, else the row after, else with 0.

    Inside a block the last seen value is a window; across blocks one row per block
    carries the last value on and the first value of the series back.
    """
    base = blocks(df, 0, size)
    def dated(c: str):
        return F.when(F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("v")))

    per_block = base.groupBy("ticker", "blk").agg(
        *[F.max(dated(c)).alias(f"_last_{c}") for c in columns],
        *[F.min(dated(c)).alias(f"_head_{c}") for c in columns],
    )
    by_block = Window.partitionBy("ticker").orderBy("blk")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("ticker")
    carried = per_block.select(
        "ticker", "blk",
        *[F.last(F.col(f"_last_{c}"), True).over(earlier)["v"].alias(f"_prev_{c}") for c in columns],
        *[F.min(F.col(f"_head_{c}")).over(whole)["v"].alias(f"_first_{c}") for c in columns],
    )
    seen = in_order().rowsBetween(Window.unboundedPreceding, 0)
    return (
        base.join(carried, ["ticker", "blk"], "left")
        .withColumns({
            c: F.coalesce(F.last(c, True).over(seen), F.col(f"_prev_{c}"), F.col(f"_first_{c}"),
                          F.lit(0).cast(df.schema[c].dataType))
            for c in columns
        })
        .drop("own", "blk", *[f"_{p}_{c}" for c in columns for p in ("prev", "first")])
    )
