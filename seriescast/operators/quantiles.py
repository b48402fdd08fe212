"""Exact interpolated quantiles of groups of any size.

Built-in ``percentile`` keeps every distinct value of a group in one task.  Here a
mergeable sketch only proposes cut points; values are counted between them, and just
the slices that hold a wanted rank are ranked.  Equal values are counted before
anything is shuffled by slice, so a value held by a third of the rows is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float],
                    slices: int = SLICES, cut_by: str | None = None) -> DataFrame:
    """One row per group: ``keys`` and ``q`` (the quantiles, linear interpolation).

    The cut points are shared by all groups, so slicing needs no join on the group and a
    huge group, which shapes them most, falls into many slices.  ``cut_by`` names a key
    with few values (such as a column name) that gets cut points of its own.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    grid = [i / slices for i in range(1, slices)]
    sample = df.groupBy(cut_by) if cut_by else df.groupBy()
    cuts = {r[0] if cut_by else None: r["_cuts"] for r in sample.agg(
        F.percentile_approx(F.col(value).cast("double"), grid, 1000).alias("_cuts")).collect()}

    def slice_of(points: list[float] | None):
        return F.size(F.filter(F.lit(sorted(set(points or []))).cast("array<double>"), lambda c: c < F.col("_v")))

    if cut_by:
        number = F.lit(0)
        for name, points in cuts.items():
            number = F.when(F.col(cut_by) == name, slice_of(points)).otherwise(number)
    else:
        number = slice_of(cuts[None])
    sliced = counts.withColumn("_s", number)
    per_group = Window.partitionBy(*keys)
    earlier = per_group.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    # a group has at most as many rows here as there are slices
    offsets = sliced.groupBy(*keys, "_s").agg(F.sum("_c").alias("_in")).withColumns({
        "_before": F.coalesce(F.sum("_in").over(earlier), F.lit(0)), "_n": F.sum("_in").over(per_group)})

    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor((F.col("_n") - 1) * p), F.ceil((F.col("_n") - 1) * p)) for p in probabilities
    ])))
    wanted = sliced.join(offsets, [*keys, "_s"]).where(F.exists(
        ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_in"))))
    running = Window.partitionBy(*keys, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        wanted.withColumn("_to", F.col("_before") + F.sum("_c").over(running))
        .withColumn("_from", F.col("_to") - F.col("_c"))
        .withColumn("_rank", F.explode(F.filter(
            ranks, lambda r: (r >= F.col("_from")) & (r < F.col("_to")))))
    )
    found = hits.groupBy(*keys, "_n").agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def interpolated(p: float):
        x = (F.col("_n") - 1) * F.lit(p)
        lo, hi = F.element_at("_at", F.floor(x)), F.element_at("_at", F.ceil(x))
        return lo + (hi - lo) * (x - F.floor(x))

    return found.select(*keys, F.array(*[interpolated(p) for p in probabilities]).alias("q"))
