"""Exponential moving averages as a two-level scan.

y_0 = x_0 and y_t = d * y_{t-1} + (1 - d) * x_t is a geometric sum.  Each series is
cut into segments; inside one the sum is a running window sum of x * d**-j, and what
the earlier segments add is d**(j+1) times their combined tail.  The tail of a segment
needs no order, so it is a plain aggregate, and it reaches only the next few segments:
beyond them d**distance is 0.0 in double precision, so leaving them out changes nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriescast.operators.layout import BLOCK, block_of

# exp(575) leaves room for prices inside a double; exp(-745.2) is below the smallest double
_SCALE_LIMIT = 575.0
_VANISHES = 745.2


@dataclass(frozen=True)
class Ema:
    column: str
    name: str
    alpha: float

    @staticmethod
    def span(column: str, name: str, span: int) -> Ema:
        return Ema(column, name, 2.0 / (span + 1))

    @property
    def decay(self) -> float:
        return 1.0 - self.alpha

    def input(self, first: Column) -> Column:
        x = F.col(self.column).cast("double")
        return F.when(first, x).otherwise(x * self.alpha)


def segment_rows(specs: list[Ema], block: int = BLOCK) -> int:
    rows = block
    steepest = max(-math.log(s.decay) for s in specs)
    while rows > 1 and rows * steepest > _SCALE_LIMIT:
        rows //= 2
    return rows


def emas(df: DataFrame, specs: list[Ema], source: DataFrame | None = None,
         start: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Add one column per spec to a blocked frame.

    Rows repeated from the block before count as 0, and their averages are meaningless:
    drop them with ``own_rows`` before anything looks back at an average.

    ``source`` supplies ``ticker, pos`` and the inputs for the carried tails (a narrower
    way to the same rows than ``df``); ``start`` is the position of the first row.
    """
    rows = segment_rows(specs, block)
    first = F.col("pos") == (F.lit(0) if start is None else start)
    seg = block_of(rows)
    j = F.col("pos") % rows
    reach = max(math.ceil(_VANISHES / (rows * -math.log(s.decay))) for s in specs)

    tails = (
        (source if source is not None else df)
        .groupBy("ticker", seg.alias("_seg"))
        .agg(*[
            F.sum(s.input(first) * F.pow(F.lit(s.decay), F.lit(rows - 1) - j)).alias(f"_t_{s.name}")
            for s in specs
        ])
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(reach))))
        .groupBy("ticker", (F.col("_seg") + F.col("_k") + 1).alias("_seg"))
        .agg(*[
            F.sum(F.col(f"_t_{s.name}") * F.pow(F.lit(s.decay), rows * F.col("_k"))).alias(f"_c_{s.name}")
            for s in specs
        ])
    )
    # a segment that is a whole block needs no sort beyond the one the other windows share
    keys = ["ticker", "blk"] if rows == block else ["ticker", "blk", "_seg"]
    run = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("own") if "own" in df.columns else F.lit(True)
    local = df.withColumn("_seg", seg).withColumns({
        f"_l_{s.name}": F.sum(F.when(own, s.input(first)).otherwise(0.0) * F.pow(F.lit(s.decay), -j)).over(run)
        * F.pow(F.lit(s.decay), j)
        for s in specs
    })
    if rows == block:
        tails = tails.withColumnRenamed("_seg", "blk")
        local = local.drop("_seg")
    return (
        local.join(tails, ["ticker", "blk" if rows == block else "_seg"], "left")
        .withColumns({
            s.name: F.col(f"_l_{s.name}")
            + F.coalesce(F.col(f"_c_{s.name}"), F.lit(0.0)) * F.pow(F.lit(s.decay), j + 1)
            for s in specs
        })
        .drop("_seg", *[f"_{p}_{s.name}" for s in specs for p in "lc"])
    )


def seeded_emas(df: DataFrame, specs: list[Ema], start: Column | None = None) -> DataFrame:
    """As ``emas`` for short tails of series kept in one block each.

    ``<name>_seed`` holds the average one row before the tail, or NULL where the tail
    begins with the series; ``tail_start`` is the position of the first row of the tail.
    """
    begin = F.lit(0) if start is None else start
    run = Window.partitionBy("ticker", "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    j = F.col("pos") - F.col("tail_start")
    columns = {}
    for s in specs:
        first = F.col(f"{s.name}_seed").isNull() & (F.col("pos") == begin)
        local = F.sum(s.input(first) * F.pow(F.lit(s.decay), -j)).over(run) * F.pow(F.lit(s.decay), j)
        columns[s.name] = local + F.coalesce(f"{s.name}_seed", F.lit(0.0)) * F.pow(F.lit(s.decay), j + 1)
    return df.withColumns(columns)
