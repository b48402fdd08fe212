"""Autocorrelation and partial autocorrelation of residual series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriescast.operators.layout import (
    BLOCK,
    blocks,
    index_series,
    own_rows,
    with_series_values,
)
from seriescast.operators.windows import add, lag

Z95 = 1.959963984540054  # the 97.5 % point of the normal distribution
LAGS = 40


def lag_limit(n: Column, lags: int) -> Column:
    """min(lags, n // 2 - 1), not below 0: the clamp for short series."""
    return F.greatest(F.lit(0), F.least(F.lit(lags), F.floor(n / 2).cast("int") - 1))


def autocovariances(df: DataFrame, value: str, lags: int = LAGS, clamp: bool = False,
                    block: int = BLOCK) -> DataFrame:
    """Per series: ``n_rows`` and ``cov``, the lagged products of the centred values."""
    df = index_series(df)
    means = df.groupBy("ticker").agg(F.avg(value).alias("_mean"), F.count(F.lit(1)).alias("n_rows"))
    centred = with_series_values(df.select("ticker", "pos", "n_rows", value), means).withColumn(
        "_x", F.col(value) - F.col("_mean"))
    framed = add(blocks(centred, lags, block), {f"_x{k}": lag("_x", k) for k in range(1, lags + 1)})
    products = ", ".join(f"coalesce(sum(_x * _x{k or ''}), 0D)" for k in range(lags + 1))
    sums = own_rows(framed).groupBy("ticker").agg(
        F.max("n_rows").alias("n_rows"), F.expr(f"array({products})").alias("cov"))
    if clamp:
        sums = sums.withColumn("cov", F.slice("cov", 1, lag_limit(F.col("n_rows"), lags) + 1))
    return sums


def acf(df: DataFrame, value: str = "residual", lags: int = LAGS, clamp: bool = False,
        block: int = BLOCK) -> DataFrame:
    """Rows ``(ticker, lag, value, lower, upper)`` with Bartlett's 95 % band."""
    cov = autocovariances(df, value, lags, clamp, block)
    rows = cov.select("ticker", "n_rows", F.posexplode(
        F.transform("cov", lambda c: F.try_divide(c, F.col("cov")[0]))).alias("lag", "value"))
    earlier = Window.partitionBy("ticker").orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    squares = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("value") ** 2)).over(earlier), F.lit(0.0))
    half = F.when(F.col("lag") == 0, 0.0).otherwise(Z95 * F.sqrt((1 + 2 * squares) / F.col("n_rows")))
    return rows.withColumn("_half", half).select(
        "ticker", "lag", "value", (F.col("value") - F.col("_half")).alias("lower"),
        (F.col("value") + F.col("_half")).alias("upper"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _levinson(cov: pd.Series) -> pd.Series:
    """Partial autocorrelations from autocovariances (at most a few dozen per series)."""
    def solve(r: np.ndarray) -> list[float]:
        out, phi, err = [1.0], np.zeros(0), r[0]
        for k in range(1, len(r)):
            if err == 0:
                out.append(float("nan"))
                continue
            ref = (r[k] - phi @ r[k - 1:0:-1]) / err
            phi = np.append(phi - ref * phi[::-1], ref)
            err *= 1 - ref * ref
            out.append(float(ref))
        return out

    return cov.map(lambda r: solve(np.asarray(r, dtype=float)))


def pacf(df: DataFrame, value: str = "residual", lags: int = LAGS, adjusted: bool = True,
         clamp: bool = False, block: int = BLOCK) -> DataFrame:
    """Rows ``(ticker, lag, value, lower, upper)`` from the Yule-Walker equations.

    ``adjusted`` divides the lag-k product sum by n - k instead of n.
    """
    cov = autocovariances(df, value, lags, clamp, block)
    scaled = F.transform(
        "cov", lambda c, k: c / (F.col("n_rows") - k if adjusted else F.col("n_rows")).cast("double"))
    usable = cov.where(F.col("n_rows") > F.size("cov") - 1) if adjusted else cov
    rows = usable.select("ticker", "n_rows", F.posexplode(_levinson(scaled)).alias("lag", "value"))
    half = F.when(F.col("lag") == 0, 0.0).otherwise(Z95 / F.sqrt("n_rows"))
    return rows.select("ticker", "lag", "value", (F.col("value") - half).alias("lower"),
                       (F.col("value") + half).alias("upper"))


def correlogram(rows: DataFrame) -> DataFrame:
    """Nested form: per ticker one struct of ``values, confint_lower, confint_upper``."""
    packed = F.array_sort(F.collect_list(F.struct("lag", "value", "lower", "upper")))

    def column(c: str) -> Column:
        return F.transform("_p", lambda r: r[c])

    return rows.groupBy("ticker").agg(packed.alias("_p")).select(
        "ticker", F.struct(column("value").alias("values"), column("lower").alias("confint_lower"),
                           column("upper").alias("confint_upper")).alias("correlogram"))
