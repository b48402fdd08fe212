"""Splits, folds, tails, sequences and scalers."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriescast.operators import scale, split
from seriescast.operators.align import previous_price
from seriescast.plans import recipes as R
from seriescast.queries.registry import SQL_EVENT_BARS, over, query, rnd, sql_bars, sql_rnd, sql_series
from seriescast.sources import fixtures as fx


def counted(df, keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ds").alias("first_ds"),
                                 F.max("ds").alias("last_ds"))


SQL_COUNTED = "count(*) AS n, min(ds) AS first_ds, max(ds) AS last_ds"
SQL_SPLIT3 = """CASE WHEN pos < CAST(floor(CAST(floor(n * 0.8) AS BIGINT) * 0.9) AS BIGINT) THEN 'train'
  WHEN pos < floor(n * 0.8) THEN 'validation' ELSE 'test' END"""


@query("split_two", f"""WITH {sql_series()}
SELECT ticker, ds, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM s""")
def split_two(spark, sf):
    return split.split_two(fx.bars(spark, sf), 0.8).select("ticker", "ds", "split")


@query("split_three", f"""WITH {sql_series()} SELECT ticker, ds, {SQL_SPLIT3} AS split FROM s""")
def split_three(spark, sf):
    return split.split_three(fx.bars(spark, sf)).select("ticker", "ds", "split")


@query("ts_folds", f"""WITH {sql_series()}, f AS (
  SELECT ticker, ds, CAST(fold AS INTEGER) AS fold, pos, n - (5 - fold) * (n // 6) AS start, n // 6 AS size
  FROM s, range(5) t(fold))
SELECT ticker, fold, CASE WHEN pos < start THEN 'train' ELSE 'test' END AS role, {SQL_COUNTED}
FROM f WHERE pos < start + size GROUP BY 1, 2, 3""")
def ts_folds(spark, sf):
    return counted(split.ts_folds(fx.bars(spark, sf), 5), ["ticker", "fold", "role"])


@query("rolling_origin", f"""WITH {sql_bars()},
e AS (SELECT ticker, min(ds) AS lo, max(ds) AS hi, count(*) AS n FROM bars GROUP BY 1),
p AS (SELECT *, CAST(greatest(floor(n * 0.5), 365) AS INTEGER) AS ini, CAST(floor(n * 0.1) AS INTEGER) AS per,
             CAST(floor(n * 0.2) AS INTEGER) AS hor FROM e),
c AS (SELECT ticker, hor, hi - hor - CAST(k AS INTEGER) * per AS cutoff
      FROM p, range(100) t(k) WHERE hi - hor - CAST(k AS INTEGER) * per >= lo + ini)
SELECT c.ticker, cutoff, CASE WHEN ds <= cutoff THEN 'train' ELSE 'test' END AS role, {SQL_COUNTED}
FROM c JOIN bars ON bars.ticker = c.ticker AND ds <= cutoff + hor GROUP BY 1, 2, 3""")
def rolling_origin(spark, sf):
    return counted(split.rolling_origin(fx.bars(spark, sf)), ["ticker", "cutoff", "role"])


@query("history_tail", f"""WITH {sql_series()} SELECT ticker, ds, close FROM s WHERE pos >= n - 252""")
def history_tail(spark, sf):
    return split.tail(fx.bars(spark, sf), 252).select("ticker", "ds", "close")


@query("last_actual", f"""WITH {sql_bars()}
SELECT ticker, max(ds) AS last_ds, arg_max(close, ds) AS last_value FROM bars GROUP BY 1""")
def last_actual(spark, sf):
    return split.last_actual(fx.bars(spark, sf))


@query("prev_price_test", f"""WITH {sql_series()}, p AS (SELECT *, lag(close) {over()} AS previous FROM s)
SELECT ticker, ds, close, previous FROM p WHERE pos >= floor(n * 0.8)""")
def prev_price_test(spark, sf):
    full = previous_price(fx.bars(spark, sf))
    return split.split_two(full, 0.8).where("split = 'test'").select("ticker", "ds", "close", "previous")


# L = 10 rows of (close, volume) per sample, restarted in each of the three splits
@query("sequences", f"""WITH {sql_series()}, t AS (SELECT *, {SQL_SPLIT3} AS split FROM s),
w AS (SELECT ticker, ds, split, close AS label, row_number() OVER p - 1 AS i,
             lag(close, 10) OVER p AS first_close, lag(close) OVER p AS last_close,
             sum(volume) OVER (PARTITION BY ticker, split ORDER BY ds ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS sum_volume
      FROM t WINDOW p AS (PARTITION BY ticker, split ORDER BY ds))
SELECT ticker, ds, split, label, first_close, last_close, sum_volume, CAST(10 AS INTEGER) AS length
FROM w WHERE i >= 10""")
def sequences(spark, sf):
    parts = split.split_three(fx.bars(spark, sf))
    seq = split.sequences(parts, ["close", "volume"], "close", 10, start=split.split_start())
    return seq.select(
        "ticker", "ds", "split", "label", F.col("sequence")[0][0].alias("first_close"),
        F.col("sequence")[9][0].alias("last_close"),
        F.aggregate("sequence", F.lit(0.0), lambda a, r: a + r[1]).alias("sum_volume"),
        F.size("sequence").alias("length"))


SCALED = ["close", "volume", "high"]


def sql_params(kind, train="floor(n * 0.8)"):
    e = {
        "minmax": lambda c: (f"min({c})", f"max({c}) - min({c})"),
        "standard": lambda c: (f"avg({c})", f"stddev_pop({c})"),
        "robust": lambda c: (f"quantile_cont({c}, 0.5)", f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    }[kind]
    cols = ", ".join(f"CAST({e(c)[0]} AS DOUBLE) AS c_{c}, CAST({e(c)[1]} AS DOUBLE) AS s_{c}" for c in SCALED)
    return f"q AS (SELECT ticker, {cols} FROM s WHERE pos < {train} GROUP BY 1)"


def sql_scaled(kind):
    cols = ", ".join(
        f"{sql_rnd(f'({c} - c_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END')} AS {c}" for c in SCALED)
    return f"WITH {sql_series()}, {sql_params(kind)} SELECT ticker, ds, {cols} FROM s JOIN q USING (ticker)"


def train_rows(df):
    return df.where(F.col("pos") < split.share(F.col("n_rows"), 0.8))


def scaled(spark, sf, kind):
    frame = split.index_series(fx.bars(spark, sf))
    params = scale.fit(train_rows(frame), SCALED, kind)
    return scale.apply(frame, params, SCALED, same=True).select("ticker", "ds", *[rnd(c).alias(c) for c in SCALED])


@query("scale_minmax", sql_scaled("minmax"))
def scale_minmax(spark, sf):
    return scaled(spark, sf, "minmax")


@query("scale_robust", sql_scaled("robust"))
def scale_robust(spark, sf):
    return scaled(spark, sf, "robust")


@query("scale_standard", sql_scaled("standard"))
def scale_standard(spark, sf):
    return scaled(spark, sf, "standard")


@query("scale_roundtrip", f"""WITH {sql_series()}
SELECT ticker, ds, {sql_rnd('close', 3)} AS close, {sql_rnd('close', 3)} AS back_minmax,
       {sql_rnd('close', 3)} AS back_standard FROM s""")
def scale_roundtrip(spark, sf):
    frame = split.index_series(fx.bars(spark, sf)).select("ticker", "ds", "pos", "n_rows", "close")
    for kind in ("minmax", "standard"):
        params = scale.fit(train_rows(frame), ["close"], kind)
        frame = scale.apply(frame, params, ["close"], suffix=f"_{kind}", same=True)
        frame = scale.invert(frame, params, {f"close_{kind}": "close"}, same=True)
    return frame.select("ticker", "ds", rnd("close", 3).alias("close"),
                        rnd("close_minmax", 3).alias("back_minmax"),
                        rnd("close_standard", 3).alias("back_standard"))


@query("recent_volume", f"""WITH {sql_series(SQL_EVENT_BARS)}
SELECT ticker, {sql_rnd('avg(volume)')} AS volume FROM s WHERE pos >= n - 5 GROUP BY 1""")
def recent_volume(spark, sf):
    return split.tail(fx.event_bars(spark, sf), 5).groupBy("ticker").agg(
        rnd(F.avg("volume")).alias("volume"))


@query("sample_tail", f"""WITH {sql_series()}, p AS (SELECT *, lag(close) {over()} AS y_pred FROM s)
SELECT ticker, ds, close AS y, y_pred FROM p WHERE pos >= n - 5""")
def sample_tail(spark, sf):
    return split.tail(previous_price(fx.bars(spark, sf)), 5).select(
        "ticker", "ds", F.col("close").alias("y"), F.col("previous").alias("y_pred"))


@query("rf_scaled_features", f"""WITH {sql_series()},
a AS (SELECT *, avg(close) {over(20)} AS sma_20 FROM s),
q AS (SELECT ticker, min(sma_20) AS lo, max(sma_20) - min(sma_20) AS sp FROM a
      WHERE pos >= 10 AND pos - 10 < floor((n - 10) * 0.8) GROUP BY 1)
SELECT ticker, ds, {sql_rnd('(sma_20 - lo) / sp')} AS sma_20 FROM a JOIN q USING (ticker) WHERE pos >= 10""")
def rf_scaled_features(spark, sf):
    frame = R.features_rf(fx.bars(spark, sf)).select("ticker", "ds", "pos", "n_rows", "sma_20")
    params = scale.fit(train_rows(frame), ["sma_20"], "minmax")
    return scale.apply(frame, params, ["sma_20"], same=True).select("ticker", "ds", rnd("sma_20").alias("sma_20"))
