"""Ordered splits, folds, tails and sequences.

Everything here is arithmetic on ``pos`` and ``n_rows``; only sequences look at other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriescast.operators.layout import BLOCK, blocks, index_series, own_rows, with_series_values


def share(n: Column, ratio: float) -> Column:
    """int(n * ratio)"""
    return F.floor(n * F.lit(ratio))


def split_two(df: DataFrame, ratio: float = 0.8) -> DataFrame:
    """The first ``int(n * ratio)`` rows of a series are train, the rest test."""
    return index_series(df).withColumn(
        "split", F.when(F.col("pos") < share(F.col("n_rows"), ratio), "train").otherwise("test"))


def split_three(df: DataFrame, ratio: float = 0.8, validation: float = 0.1) -> DataFrame:
    """Train and validation share the head of a series, test is the tail."""
    head = share(F.col("n_rows"), ratio)
    train = share(head, 1 - validation)
    return index_series(df).withColumn(
        "split",
        F.when(F.col("pos") < train, "train").when(F.col("pos") < head, "validation").otherwise("test"))


def split_start(ratio: float = 0.8, validation: float | None = 0.1) -> Column:
    """Position of the first row of the split a row is in."""
    head = share(F.col("n_rows"), ratio)
    if validation is None:
        return F.when(F.col("split") == "train", 0).otherwise(head)
    return (F.when(F.col("split") == "train", 0)
            .when(F.col("split") == "validation", share(head, 1 - validation)).otherwise(head))


def ts_folds(df: DataFrame, n_splits: int = 5) -> DataFrame:
    """Expanding-window folds: one row per fold a row plays a ``role`` in.

    Fold i tests one of the last ``n_splits`` blocks of ``n // (n_splits + 1)`` rows and
    trains on everything before it.
    """
    df = index_series(df)
    size = F.expr(f"n_rows div {n_splits + 1}")
    fold = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
    start = F.col("n_rows") - (F.lit(n_splits) - F.col("fold")) * size
    return (
        df.withColumn("fold", fold)
        .withColumn("role", F.when(F.col("pos") < start, "train")
                    .when(F.col("pos") < start + size, "test"))
        .where(F.col("role").isNotNull())
    )


def rolling_origin(df: DataFrame, least_initial: int = 365) -> DataFrame:
    """Cut-off dates going back from the end of a series, rows labelled train or test.

    In days: initial = max(n/2, ``least_initial``), period = n/10, horizon = n/5.  The last
    cut-off lies one horizon before the end, the earliest one at least ``initial`` after
    the start.  A row is repeated for every cut-off it is used with (at most a handful).
    """
    df = index_series(df)
    ends = df.groupBy("ticker").agg(F.min("ds").alias("_first"), F.max("ds").alias("_last"),
                                    F.max("n_rows").alias("n_rows"))
    n = F.col("n_rows")
    initial = F.greatest(share(n, 0.5), F.lit(least_initial), F.lit(5)).cast("int")
    period = F.greatest(share(n, 0.1), F.lit(1)).cast("int")
    horizon = F.greatest(share(n, 0.2), F.lit(1)).cast("int")
    newest = F.date_sub(F.col("_last"), horizon)
    steps = F.floor(F.date_diff(newest, F.date_add(F.col("_first"), initial)) / period).cast("int")
    cutoffs = ends.where(steps >= 0).select(
        "ticker", "n_rows", horizon.alias("_h"),
        F.transform(F.sequence(F.lit(0), steps), lambda k: F.date_sub(newest, (k * period).cast("int")))
        .alias("_cutoffs"))
    return (
        with_series_values(df, cutoffs)
        .withColumn("cutoff", F.explode("_cutoffs"))
        .where(F.col("ds") <= F.date_add("cutoff", F.col("_h")))
        .withColumn("role", F.when(F.col("ds") <= F.col("cutoff"), "train").otherwise("test"))
        .drop("_h", "_cutoffs")
    )


def tail(df: DataFrame, rows: int) -> DataFrame:
    return index_series(df).where(F.col("pos") >= F.col("n_rows") - rows)


def last_row(df: DataFrame) -> DataFrame:
    return tail(df, 1)


def last_actual(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker").agg(F.max("ds").alias("last_ds"),
                                    F.max_by("close", "ds").alias("last_value"))


def sequences(df: DataFrame, features: list[str], label: str, length: int, start: Column | None = None,
              block: int = BLOCK) -> DataFrame:
    """For every row with ``length`` rows before it in its split: those rows and its label.

    ``start`` is the position of the first row of the split (0 when there is one split).
    """
    before = Window.partitionBy("ticker", "blk").orderBy("pos").rowsBetween(-length, -1)
    start = F.lit(0) if start is None else start
    framed = blocks(df, length, block).withColumn(
        "sequence", F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(before))
    return own_rows(framed).where(F.col("pos") - start >= length).select(
        *[c for c in ("ticker", "ds", "pos", "n_rows", "split") if c in framed.columns],
        "sequence", F.col(label).alias("label"))
