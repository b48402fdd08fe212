"""Error metrics, residual diagnostics and intervals on a naive forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriescast.operators import diagnostics, metrics
from seriescast.operators.align import previous_price, residuals
from seriescast.operators.layout import blocks, in_order, own_rows
from seriescast.operators.windows import add, lag, log_return
from seriescast.queries.registry import over, price, query, rnd, sql_price, sql_rnd, sql_series
from seriescast.sources import fixtures as fx

SQL_NAIVE = f"""{sql_series()},
nv AS (SELECT ticker, ds, close AS y, lag(close) {over()} AS yhat FROM s),
p AS MATERIALIZED (SELECT *, y - yhat AS residual, row_number() OVER (PARTITION BY ticker ORDER BY ds) - 1 AS pos,
             count(*) OVER (PARTITION BY ticker) AS n FROM nv WHERE yhat IS NOT NULL)"""


def naive(spark, sf):
    """Actuals with yesterday's close as the prediction, still an indexed series."""
    frame = previous_price(fx.bars(spark, sf)).where("pos > 0")
    return frame.select("ticker", "ds", (F.col("pos") - 1).alias("pos"), (F.col("n_rows") - 1).alias("n_rows"),
                        F.col("close").alias("y"), F.col("previous").alias("yhat")).withColumn(
        "residual", F.col("y") - F.col("yhat"))


@query("residuals", f"WITH {SQL_NAIVE} SELECT ticker, ds, y, yhat, {sql_rnd('residual', 3)} AS residual FROM p")
def residual_rows(spark, sf):
    frame = previous_price(fx.bars(spark, sf)).where("pos > 0")
    actual = fx.bars(spark, sf).select("ticker", "ds", F.col("close").alias("y"))
    predicted = frame.select("ticker", "ds", F.col("previous").alias("yhat"))
    return residuals(actual, predicted).select("ticker", "ds", "y", "yhat", rnd("residual", 3).alias("residual"))


SQL_ERR = "avg(residual * residual)"


@query("metrics", f"""WITH {SQL_NAIVE}
SELECT ticker, count(*) AS n, {sql_rnd(SQL_ERR, 0)} AS mse, {sql_rnd(f'sqrt({SQL_ERR})', 3)} AS rmse,
       {sql_rnd('avg(abs(residual))', 3)} AS mae,
       {sql_rnd('avg(abs(residual) / greatest(abs(y), 2.220446049250313e-16))')} AS mape FROM p GROUP BY 1""")
def regression(spark, sf):
    m = metrics.regression_metrics(naive(spark, sf), ["ticker"])
    return m.select("ticker", "n", rnd("mse", 0).alias("mse"), rnd("rmse", 3).alias("rmse"),
                    rnd("mae", 3).alias("mae"), rnd("mape").alias("mape"))


@query("metrics_r2", f"""WITH {SQL_NAIVE}
SELECT ticker, {sql_rnd(SQL_ERR, 0)} AS mse, {sql_rnd(f'sqrt({SQL_ERR})', 3)} AS rmse,
       {sql_rnd('avg(abs(residual))', 3)} AS mae,
       {sql_rnd('1 - sum(residual * residual) / (var_pop(y) * count(*))')} AS r2 FROM p GROUP BY 1""")
def r2(spark, sf):
    m = metrics.r_squared(naive(spark, sf), ["ticker"])
    return m.select("ticker", rnd("mse", 0).alias("mse"), rnd("rmse", 3).alias("rmse"),
                    rnd("mae", 3).alias("mae"), rnd("r2").alias("r2"))


@query("metrics_from_returns", f"""WITH {sql_series()},
r AS (SELECT *, coalesce(ln(close / lag(close) {over()}), 0) AS r, lag(close) {over()} AS prev FROM s),
q AS (SELECT *, prev * exp(r) AS y, prev * exp(lag(r) {over()}) AS yhat FROM r),
k AS (SELECT * FROM q WHERE pos > 1)
SELECT ticker, count(*) AS n, {sql_rnd('sqrt(avg((y - yhat) * (y - yhat)))', 2)} AS rmse,
       {sql_rnd('avg(abs(y - yhat))', 2)} AS mae, {sql_rnd('avg(abs(y - yhat) / abs(y))', 5)} AS mape
FROM k GROUP BY 1""")
def from_returns(spark, sf):
    frame = add(blocks(fx.bars(spark, sf), 2), {"r": log_return(), "previous": lag("close")})
    frame = own_rows(frame.withColumn("r_hat", F.lag("r").over(in_order()))).where("pos > 1")
    m = metrics.price_metrics(frame, ["ticker"], "previous", "r", "r_hat")
    return m.select("ticker", "n", rnd("rmse", 2).alias("rmse"), rnd("mae", 2).alias("mae"),
                    rnd("mape", 5).alias("mape"))


@query("residual_summary", f"""WITH {SQL_NAIVE}
SELECT ticker, count(*) AS n, {sql_rnd('avg(residual)', 3)} AS mean, {sql_rnd('stddev_pop(residual)', 3)} AS std
FROM p GROUP BY 1""")
def summary(spark, sf):
    m = metrics.residual_summary(naive(spark, sf), ["ticker"])
    return m.select("ticker", "n", rnd("mean", 3).alias("mean"), rnd("std", 3).alias("std"))


Z = diagnostics.Z95
SQL_COV = f"""{SQL_NAIVE},
x AS MATERIALIZED (SELECT ticker, pos, n, residual - avg(residual) OVER (PARTITION BY ticker) AS x FROM p),
cov AS (SELECT a.ticker, CAST(k AS INTEGER) AS lag, any_value(a.n) AS n, sum(a.x * b.x) AS c
        FROM range(41) t(k) JOIN x a ON true JOIN x b ON a.ticker = b.ticker AND b.pos = a.pos - k GROUP BY 1, 2)"""


def correlogram_columns(df):
    return df.select("ticker", "lag", rnd("value", 8).alias("value"), rnd("lower", 8).alias("lower"),
                     rnd("upper", 8).alias("upper"))


@query("acf", f"""WITH {SQL_COV},
r AS (SELECT ticker, lag, n, c / first_value(c) OVER (PARTITION BY ticker ORDER BY lag) AS v FROM cov),
b AS (SELECT *, CASE WHEN lag = 0 THEN 0 ELSE {Z}::DOUBLE * sqrt((1 + 2 * coalesce(
        sum(CASE WHEN lag > 0 THEN v * v END) OVER (PARTITION BY ticker ORDER BY lag
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END AS h FROM r)
SELECT ticker, lag, {sql_rnd('v', 8)} AS value, {sql_rnd('v - h', 8)} AS lower, {sql_rnd('v + h', 8)} AS upper FROM b""")
def acf(spark, sf):
    return correlogram_columns(diagnostics.acf(naive(spark, sf)))


def sql_pacf(denominator):
    """Durbin-Levinson over lists: phi holds the coefficients of the order before."""
    return f"""WITH RECURSIVE {SQL_COV},
g AS MATERIALIZED (SELECT ticker, any_value(n) AS n, list(c / {denominator} ORDER BY lag) AS r FROM cov GROUP BY 1),
d(ticker, n, r, k, phi, err, ref) AS (
  SELECT ticker, n, r, 0, CAST([] AS DOUBLE[]), r[1], 1.0::DOUBLE FROM g
  UNION ALL
  SELECT ticker, n, r, k + 1,
         list_append(list_transform(phi, lambda v, i: v - q * phi[len(phi) + 1 - i]), q), err * (1 - q * q), q
  FROM (SELECT *, (r[k + 2] - coalesce(list_sum(list_transform(phi, lambda v, i: v * r[k + 2 - i])), 0)) / err AS q
        FROM d WHERE k < 40) z)
SELECT ticker, CAST(k AS INTEGER) AS lag, {sql_rnd('ref', 8)} AS value,
       {sql_rnd(f'ref - CASE WHEN k = 0 THEN 0 ELSE {Z}::DOUBLE / sqrt(n) END', 8)} AS lower,
       {sql_rnd(f'ref + CASE WHEN k = 0 THEN 0 ELSE {Z}::DOUBLE / sqrt(n) END', 8)} AS upper FROM d"""


@query("pacf", sql_pacf("(n - lag)"))
def pacf(spark, sf):
    return correlogram_columns(diagnostics.pacf(naive(spark, sf)))


@query("pacf_unadjusted", sql_pacf("n"))
def pacf_unadjusted(spark, sf):
    return correlogram_columns(diagnostics.pacf(naive(spark, sf), adjusted=False))


@query("correlogram", f"""WITH {sql_series()}
SELECT ticker, CAST(41 AS INTEGER) AS n_values, 1.0::DOUBLE AS first_value FROM s WHERE pos = 0""")
def nested(spark, sf):
    c = diagnostics.correlogram(diagnostics.acf(naive(spark, sf), clamp=True))
    return c.select("ticker", F.size("correlogram.values").alias("n_values"),
                    F.col("correlogram.values")[0].alias("first_value"))


@query("interval_from_draws", f"""WITH {sql_series()},
d AS (SELECT a.ticker, a.ds, b.close AS value FROM s a JOIN s b
      ON a.ticker = b.ticker AND b.pos BETWEEN a.pos - 20 AND a.pos - 1)
SELECT ticker, ds, {sql_price('avg(value)')} AS prediction,
       {sql_price('quantile_cont(value, 0.025)')} AS lower_bound,
       {sql_price('quantile_cont(value, 0.975)')} AS upper_bound FROM d GROUP BY 1, 2""")
def interval(spark, sf):
    framed = blocks(fx.bars(spark, sf), 20).withColumn(
        "_draws", F.array(*[F.lag("close", k).over(in_order()) for k in range(1, 21)]))
    draws = own_rows(framed).select("ticker", "ds", F.posexplode("_draws").alias("draw_id", "value")).where(
        "value IS NOT NULL")
    q = metrics.interval_from_draws(draws, ["ticker", "ds"])
    return q.select("ticker", "ds", *[price(c).alias(c) for c in ("prediction", "lower_bound", "upper_bound")])


@query("interval_from_arrays", f"""WITH {sql_series()},
d AS (SELECT a.ticker, a.ds, b.close AS value FROM s a JOIN s b
      ON a.ticker = b.ticker AND b.pos BETWEEN a.pos - 20 AND a.pos - 1)
SELECT ticker, ds, {sql_price('avg(value)')} AS prediction,
       {sql_price('quantile_cont(value, 0.025)')} AS lower_bound,
       {sql_price('quantile_cont(value, 0.975)')} AS upper_bound FROM d GROUP BY 1, 2""")
def interval_arrays(spark, sf):
    """The same interval with the draws of a point in an array: no shuffle by point."""
    draws = "array_compact(array(" + ", ".join(lag("close", k) for k in range(1, 21)) + "))"
    framed = own_rows(add(blocks(fx.bars(spark, sf), 20), {"draws": draws})).where("size(draws) > 0")
    columns = metrics.draws_interval(F.col("draws"))
    return framed.select("ticker", "ds", *[price(c).alias(n) for n, c in columns.items()])


@query("hist_volatility", f"""WITH {sql_series()},
r AS (SELECT ticker, close / lag(close) {over()} - 1 AS r FROM s)
SELECT ticker, {sql_rnd('stddev_samp(r)')} AS volatility,
       {sql_rnd('greatest(0.005, 0.5 * stddev_samp(r))')} AS daily_range FROM r GROUP BY 1""")
def volatility(spark, sf):
    return metrics.historical_volatility(fx.bars(spark, sf)).select(
        "ticker", rnd("volatility").alias("volatility"), rnd("daily_range").alias("daily_range"))


@query("sampling_interval", f"""WITH {sql_series()},
g AS (SELECT ticker, CAST(ds - lag(ds) {over()} AS INTEGER) AS gap FROM s),
c AS (SELECT ticker, gap, count(*) AS k FROM g WHERE gap IS NOT NULL GROUP BY 1, 2),
u AS (SELECT ticker, gap AS usual_gap FROM c QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY k DESC, gap) = 1)
SELECT ticker, {sql_rnd('(max(ds) - min(ds)) / (count(*) - 1)')} AS mean_gap, any_value(usual_gap) AS usual_gap
FROM s JOIN u USING (ticker) GROUP BY 1""")
def interval_days(spark, sf):
    return metrics.sampling_interval(fx.bars(spark, sf)).select(
        "ticker", rnd("mean_gap").alias("mean_gap"), "usual_gap")
