"""Forecast error metrics and summaries; group by any columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriescast.operators.layout import blocks, in_order, own_rows
from seriescast.operators.windows import add, change

TINY = 2.220446049250313e-16
# Upper bounds of the mean absolute percentage error and their labels.
BANDS = [(0.05, "success"), (0.10, "processing"), (0.15, "warning")]


def regression_metrics(df: DataFrame, keys: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """MSE, RMSE, MAE and MAPE (a fraction) per group."""
    e = F.col(y) - F.col(yhat)
    return df.groupBy(*keys).agg(
        F.count(e).alias("n"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.abs(e) / F.greatest(F.abs(F.col(y)), F.lit(TINY))).alias("mape"),
    )


def r_squared(df: DataFrame, keys: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """1 - SSE/SST; the spread of y comes from a mergeable central moment, not from sum(y^2)."""
    e = F.col(y) - F.col(yhat)
    known = df.where(e.isNotNull())
    sst = F.var_pop(y) * F.count(F.lit(1))
    return known.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.sum(e * e), sst)).alias("r2"))


def price_metrics(df: DataFrame, keys: list[str], previous: str, actual_return: str,
                  predicted_return: str) -> DataFrame:
    """Metrics on prices rebuilt from log returns and the price before."""
    rebuilt = df.withColumns({
        "y": F.col(previous) * F.exp(actual_return),
        "yhat": F.col(previous) * F.exp(predicted_return),
    })
    return regression_metrics(rebuilt, keys)


def residual_summary(df: DataFrame, keys: list[str], residual: str = "residual") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(residual).alias("n"), F.avg(residual).alias("mean"),
        F.stddev_pop(residual).alias("std"))


def error_band(mape: Column) -> Column:
    label = F.when(mape < BANDS[0][0], BANDS[0][1])
    for bound, name in BANDS[1:]:
        label = label.when(mape < bound, name)
    return label.otherwise("error")


def historical_volatility(bars: DataFrame, price: str = "close") -> DataFrame:
    """Sample deviation of one-step changes and the daily range derived from it."""
    moves = own_rows(add(blocks(bars, 1), {"_r": f"CASE WHEN pos > 0 THEN {change(price)} END"}))
    return moves.groupBy("ticker").agg(F.stddev_samp("_r").alias("volatility")).withColumn(
        "daily_range", F.greatest(F.lit(0.005), F.coalesce(0.5 * F.col("volatility"), F.lit(0.005))))


def sampling_interval(bars: DataFrame) -> DataFrame:
    """Average and most frequent distance between bars, in days."""
    gaps = own_rows(blocks(bars, 1).withColumn(
        "gap", F.date_diff("ds", F.lag("ds").over(in_order()))))
    # few distinct gaps exist, so counting them first leaves little to choose from
    by_gap = gaps.where(F.col("gap").isNotNull()).groupBy("ticker", "gap").agg(
        F.count(F.lit(1)).alias("n"))
    usual = by_gap.groupBy("ticker").agg(
        F.max(F.struct("n", (-F.col("gap")).alias("g"))).alias("m")).select(
        "ticker", (-F.col("m.g")).alias("usual_gap"))
    ends = bars.groupBy("ticker").agg(
        F.try_divide(F.date_diff(F.max("ds"), F.min("ds")).cast("double"),
                     (F.count(F.lit(1)) - 1).cast("double")).alias("mean_gap"))
    return ends.join(usual, "ticker", "left")


def draws_interval(draws: Column) -> dict[str, Column]:
    """Mean and 95 % interval of an array of draws, within the row."""
    ordered = F.array_sort(draws)
    size = F.size(draws)

    def quantile(p: float) -> Column:
        at = (size - 1) * F.lit(p)
        lo, hi = (F.element_at(ordered, f(at).cast("int") + 1) for f in (F.floor, F.ceil))
        return lo + (hi - lo) * (at - F.floor(at))

    return {
        "prediction": F.aggregate(draws, F.lit(0.0), lambda s, v: s + v, lambda s: s / size),
        "lower_bound": quantile(0.025),
        "upper_bound": quantile(0.975),
    }


def interval_from_draws(draws: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean and 95 % interval over the draws of each point; draws per point are few."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return draws.groupBy(*keys).agg(F.avg(value).alias("prediction"), q.alias("_q")).select(
        *keys, "prediction", F.col("_q")[0].alias("lower_bound"), F.col("_q")[1].alias("upper_bound"))
