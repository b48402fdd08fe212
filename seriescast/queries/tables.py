"""Alignments, registry look-ups, rankings, parameter grids and run status."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriescast.operators import align, split
from seriescast.operators import windows as W
from seriescast.operators.layout import blocks, own_rows
from seriescast.operators.metrics import regression_metrics
from seriescast.plans import draws, report, search
from seriescast.queries.diagnosis import naive
from seriescast.queries.indicators import SQL_LAST
from seriescast.queries.registry import (
    SQL_EVENT_BARS,
    over,
    price,
    query,
    rnd,
    sql_price,
    sql_rnd,
    sql_series,
)
from seriescast.plans.models import SEED
from seriescast.queries.scans import SYMBOL_BARS, SYMBOLS
from seriescast.sources import fixtures as fx
from seriescast.sources.bars import UNIVERSE
from seriescast.sources.storage import fresh_path
from seriescast.streaming import runlog

SQL_FUTURE = """fut AS (
  SELECT ticker, CAST(step AS INTEGER) AS step, ds FROM (
    SELECT ticker, ds, row_number() OVER (PARTITION BY ticker ORDER BY ds) AS step FROM (
      SELECT ticker, CAST(unnest(generate_series(last_ds + 1, last_ds + 30, INTERVAL 1 DAY)) AS DATE) AS ds FROM l) d
    WHERE isodow(ds) < 6) r WHERE step <= {h})"""


@query("history_forecast_align", f"""WITH {SQL_LAST}, {SQL_FUTURE.format(h=10)},
h AS (SELECT ticker, ds, close AS actual FROM s WHERE pos >= n - 30),
v AS (SELECT ticker, arg_max(close, ds) AS prediction FROM bars GROUP BY 1),
f AS (SELECT ticker, ds, prediction FROM fut JOIN v USING (ticker)
      UNION ALL SELECT ticker, ds, open FROM s WHERE pos >= n - 5)
SELECT coalesce(h.ticker, f.ticker) AS ticker, coalesce(h.ds, f.ds) AS ds, actual, prediction
FROM h FULL JOIN f ON h.ticker = f.ticker AND h.ds = f.ds""")
def history_forecast_align(spark, sf):
    bars = fx.bars(spark, sf)
    history = split.tail(bars, 30).select("ticker", "ds", F.col("close").alias("actual"))
    ahead = report.naive_forecast(bars, 10).select("ticker", "ds", "prediction")
    back = split.tail(bars, 5).select("ticker", "ds", F.col("open").alias("prediction"))
    return align.align_history(history, ahead.unionByName(back))


TYPES = "['rf', 'xgb', 'lstm', 'prophet']"
SQL_REGISTRY = f"""reg AS (
  SELECT model_type || '_model_' || coalesce(ticker, 'generic') || '_' || CAST(p_partkey AS VARCHAR) AS model_name, * FROM (
    SELECT p_partkey, ({TYPES})[CAST(p_partkey % 4 AS INTEGER) + 1] AS model_type,
           CASE WHEN p_partkey % 4 NOT IN (1, 2) AND p_partkey % 50 IN (0, 3) THEN NULL
                ELSE ({SYMBOLS})[CAST(p_partkey % 90 AS INTEGER) + 1] END AS ticker,
           TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * p_size AS created_at FROM part) q),
req AS (SELECT DISTINCT ({TYPES})[CAST(c_custkey // {len(UNIVERSE)} % 4 AS INTEGER) + 1] AS model_type,
               ({SYMBOLS})[CAST(c_custkey % {len(UNIVERSE)} AS INTEGER) + 1] AS ticker FROM customer)"""


def registry(spark, sf):
    types = F.array(*[F.lit(t) for t in ("rf", "xgb", "lstm", "prophet")])
    symbols = F.array(*[F.lit(s) for s in UNIVERSE])
    generic = ~(F.col("p_partkey") % 4).isin(1, 2) & (F.col("p_partkey") % 50).isin(0, 3)
    return fx.table(spark, sf, "part").select(
        "p_partkey", F.get(types, (F.col("p_partkey") % 4).cast("int")).alias("model_type"),
        F.when(~generic, F.get(symbols, (F.col("p_partkey") % 90).cast("int"))).alias("ticker"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.col("p_size"))).alias("created_at"),
    ).withColumn("model_name", F.concat(
        "model_type", F.lit("_model_"), F.coalesce("ticker", F.lit("generic")), F.lit("_"),
        F.col("p_partkey").cast("string")))


def requests(spark, sf):
    types = F.array(*[F.lit(t) for t in ("rf", "xgb", "lstm", "prophet")])
    symbols = F.array(*[F.lit(s) for s in UNIVERSE])
    return fx.table(spark, sf, "customer").select(
        F.get(types, (F.expr(f"c_custkey div {len(UNIVERSE)}") % 4).cast("int")).alias("model_type"),
        F.get(symbols, (F.col("c_custkey") % len(UNIVERSE)).cast("int")).alias("ticker")).distinct()


@query("model_resolve", f"""WITH {SQL_REGISTRY},
c AS (SELECT req.*, reg.model_name, created_at,
             CASE WHEN reg.ticker = req.ticker THEN 1 WHEN reg.ticker IS NULL THEN 2
                  WHEN req.model_type <> 'lstm' THEN 3 END AS r
      FROM req JOIN reg USING (model_type)),
b AS (SELECT * FROM c WHERE r IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY model_type, ticker ORDER BY r, created_at DESC, model_name) = 1)
SELECT req.model_type, req.ticker, model_name,
       CASE r WHEN 1 THEN 'specific' WHEN 2 THEN 'generic' WHEN 3 THEN 'any' ELSE 'none' END AS resolution
FROM req LEFT JOIN b ON b.model_type = req.model_type AND b.ticker = req.ticker""")
def model_resolve(spark, sf):
    return align.resolve_models(requests(spark, sf), registry(spark, sf))


# the absolute correlation of the close with its lags stands in for importances
K = 12
SQL_IMPORTANCE = f"""{sql_series()},
lg AS (SELECT ticker, close, {', '.join(f'lag(close, {k}) {over()} AS l{k}' for k in range(1, K + 1))} FROM s),
imp AS (SELECT ticker, unnest([{', '.join(f"{{'idx': {k - 1}, 'name': 'close_lag_{k}', 'importance': abs(corr(close, l{k}))}}" for k in range(1, K + 1))}], recursive := true)
        FROM lg GROUP BY ticker)"""


def importances(spark, sf):
    framed = own_rows(W.add(blocks(fx.bars(spark, sf), K), {f"l{k}": W.lag("close", k) for k in range(1, K + 1)}))
    sums = framed.groupBy("ticker").agg(*[
        F.abs(F.corr("close", f"l{k}")).alias(f"c{k}") for k in range(1, K + 1)])
    rows = F.array(*[F.struct(F.lit(k - 1).alias("idx"), F.lit(f"close_lag_{k}").alias("name"),
                              F.col(f"c{k}").alias("importance")) for k in range(1, K + 1)])
    return sums.select("ticker", F.inline(rows))


@query("select_features", f"""WITH {SQL_IMPORTANCE},
t AS (SELECT *, avg(importance) OVER (PARTITION BY ticker) AS bound,
             row_number() OVER (PARTITION BY ticker ORDER BY importance DESC, idx) AS rank FROM imp)
SELECT ticker, idx, name, {sql_rnd('importance')} AS importance, CAST(rank AS INTEGER) AS rank
FROM t WHERE importance >= bound AND rank <= 5""")
def select_features(spark, sf):
    kept = align.select_features(importances(spark, sf), "mean", 5)
    return kept.withColumn("importance", rnd("importance"))


@query("select_features_median", f"""WITH {SQL_IMPORTANCE},
t AS (SELECT *, quantile_cont(importance, 0.5) OVER (PARTITION BY ticker) AS bound,
             row_number() OVER (PARTITION BY ticker ORDER BY importance DESC, idx) AS rank FROM imp)
SELECT ticker, idx, name, {sql_rnd('importance')} AS importance, CAST(rank AS INTEGER) AS rank
FROM t WHERE importance >= bound""")
def select_features_median(spark, sf):
    kept = align.select_features(importances(spark, sf), "median")
    return kept.withColumn("importance", rnd("importance"))


@query("selected_features", f"""WITH {SQL_IMPORTANCE},
t AS (SELECT ticker, idx, name FROM imp QUALIFY importance >= avg(importance) OVER (PARTITION BY ticker)),
u AS (SELECT * FROM t UNION ALL SELECT DISTINCT ticker, 99, 'invalid index: 99' FROM t)
SELECT ticker, string_agg(name, ', ' ORDER BY idx) AS names FROM u GROUP BY 1""")
def selected_features(spark, sf):
    table = importances(spark, sf)
    indices = align.select_features(table, "mean").groupBy("ticker").agg(
        F.array_append(F.array_sort(F.collect_list("idx")), F.lit(99)).alias("features_index"))
    names = table.groupBy("ticker").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda r: r["name"]).alias("names"))
    return indices.join(names, "ticker").select("ticker", F.array_join(
        align.names_at(F.col("features_index"), F.col("names")), ", ").alias("names"))


@query("importance_map", f"""WITH {SQL_IMPORTANCE}
SELECT ticker, name, {sql_rnd('importance')} AS importance FROM imp""")
def importance_map(spark, sf):
    lists = importances(spark, sf).groupBy("ticker").agg(
        F.array_sort(F.collect_list(F.struct("idx", "name", "importance"))).alias("r"))
    mapped = lists.select("ticker", align.importance_map(F.col("r.name"), F.col("r.importance")).alias("m"))
    return mapped.select("ticker", F.explode("m").alias("name", "importance")).withColumn(
        "importance", rnd("importance"))


@query("future_regressors", f"""WITH {SQL_EVENT_BARS},
l AS (SELECT ticker, max(ds) AS last_ds, arg_max(open, ds) AS open, arg_max(volume, ds) AS volume FROM bars GROUP BY 1)
SELECT ticker, CAST(unnest(range(1, 6)) AS INTEGER) AS step,
       CAST(unnest(generate_series(last_ds + 1, last_ds + 5, INTERVAL 1 DAY)) AS DATE) AS ds,
       open, volume, 0.0::DOUBLE AS vix FROM l""")
def future_regressors(spark, sf):
    return align.future_regressors(fx.event_bars(spark, sf), ["open", "volume", "vix"], 5)


# moving averages of k days are the candidates: scored on expanding-window folds
MAS = (1, 5, 10, 20, 50)
SQL_CANDIDATES = f"""{sql_series()},
m AS (SELECT ticker, ds, close AS y, pos, n, {', '.join(f'avg(close) OVER (PARTITION BY ticker ORDER BY pos ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS m{k}' for k in MAS)} FROM s),
c AS (SELECT ticker, ds, pos, n, y, unnest([{', '.join(str(k) for k in MAS)}]) AS candidate,
             unnest([{', '.join(f'm{k}' for k in MAS)}]) AS yhat FROM m)"""


def candidates(spark, sf):
    framed = blocks(fx.bars(spark, sf), max(MAS))
    framed = W.add(framed, {
        f"m{k}": f"avg(close) OVER ({W.ORDER} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in MAS})
    rows = F.array(*[F.struct(F.lit(k).alias("candidate"), F.col(f"m{k}").alias("yhat")) for k in MAS])
    return own_rows(framed).select("ticker", "ds", "pos", "n_rows", F.col("close").alias("y"), F.inline(rows))


@query("cv_leaderboard", f"""WITH {SQL_CANDIDATES},
f AS (SELECT *, fold, n - (3 - fold) * (n // 4) AS start FROM c, range(3) t(fold)),
e AS (SELECT candidate, fold, avg((y - yhat) * (y - yhat)) AS mse FROM f
      WHERE pos >= start AND pos < start + n // 4 GROUP BY 1, 2),
b AS (SELECT candidate, avg(mse) AS mse, count(*) AS n_folds FROM e GROUP BY 1)
SELECT candidate, {sql_rnd('mse', 0)} AS mean_mse, n_folds,
       CAST(row_number() OVER (ORDER BY mse, candidate) AS INTEGER) AS rank FROM b""")
def cv_leaderboard(spark, sf):
    folded = split.ts_folds(candidates(spark, sf), 3).where("role = 'test'")
    scores = regression_metrics(folded, ["candidate", "fold"]).select("candidate", "fold", "mse")
    return search.leaderboard(scores).withColumn("mean_mse", rnd("mean_mse", 0))


SQL_RUNS = f"""{SQL_CANDIDATES},
runs AS (SELECT 'ma_' || CAST(candidate AS VARCHAR) AS model_type, ticker, max(ds) AS ts,
                {sql_rnd('sqrt(avg((y - yhat) * (y - yhat)))', 3)} AS rmse,
                {sql_rnd('avg(abs(y - yhat) / abs(y))')} AS mape
         FROM c WHERE yhat IS NOT NULL GROUP BY candidate, ticker)"""


def runs(spark, sf):
    rows = candidates(spark, sf).where("yhat IS NOT NULL").withColumn(
        "model_type", F.concat(F.lit("ma_"), F.col("candidate").cast("string")))
    scored = regression_metrics(rows, ["model_type", "ticker"]).join(
        rows.groupBy("model_type", "ticker").agg(F.max("ds").alias("ts")), ["model_type", "ticker"])
    return scored.select("model_type", "ticker", "ts", rnd("rmse", 3).alias("rmse"), rnd("mape").alias("mape"))


@query("model_comparison", f"""WITH {SQL_RUNS}
SELECT * FROM runs ORDER BY mape NULLS LAST, model_type, ticker LIMIT 5""")
def model_comparison(spark, sf):
    return align.compare_runs(runs(spark, sf), "mape")


SQL_LOG = """log AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS job_id,
         'U' || CAST(user_id AS VARCHAR) AS ticker, (['rf', 'xgb', 'lstm', 'prophet'])[CAST(user_id % 4 AS INTEGER) + 1] AS model_type,
         CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILURE'
              ELSE 'PROGRESS' END AS state,
         CAST(floor(value) AS INTEGER) % 100 AS progress, ts, event_id FROM events)"""
SQL_STATUS = """CASE state WHEN 'PENDING' THEN 'queued' WHEN 'PROGRESS' THEN 'running'
  WHEN 'SUCCESS' THEN 'completed' WHEN 'FAILURE' THEN 'failed' END"""


def log(spark, sf):
    types = F.array(*[F.lit(t) for t in ("rf", "xgb", "lstm", "prophet")])
    user = F.col("user_id").cast("string")
    return fx.table(spark, sf, "events").select(
        F.concat_ws("-", user, F.to_date("ts").cast("string")).alias("job_id"),
        F.concat(F.lit("U"), user).alias("ticker"),
        F.get(types, (F.col("user_id") % 4).cast("int")).alias("model_type"),
        F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "purchase", "SUCCESS")
        .when(F.col("event_type") == "error", "FAILURE").otherwise("PROGRESS").alias("state"),
        (F.floor("value") % 100).cast("int").alias("progress"), "ts", "event_id")


@query("run_status", f"""WITH {SQL_LOG}
SELECT ticker, model_type, arg_max(job_id, (ts, event_id)) AS job_id, arg_max(progress, (ts, event_id)) AS progress,
       max(ts) AS ts, count(*) AS n_events, arg_max({SQL_STATUS}, (ts, event_id)) AS status FROM log GROUP BY 1, 2""")
def run_status(spark, sf):
    latest = runlog.latest_status(log(spark, sf), order=["event_id"])
    return latest.select("ticker", "model_type", "job_id", "progress", "ts", "n_events", "status")


@query("run_timeouts", f"""WITH {SQL_LOG},
j AS (SELECT job_id, min(ts) AS started, arg_max({SQL_STATUS}, (ts, event_id)) AS status FROM log GROUP BY 1)
SELECT job_id, started, CASE WHEN (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE > started
       AND status NOT IN ('completed', 'failed') THEN 'timeout' ELSE status END AS status FROM j""")
def run_timeouts(spark, sf):
    jobs = runlog.latest_status(log(spark, sf), ["job_id"], ["event_id"])
    latest = fx.table(spark, sf, "events").agg(F.max("ts")).first()[0]
    as_of = F.lit(latest).cast("timestamp_ntz")
    return runlog.with_timeouts(jobs, as_of).select("job_id", "started", "status")


@query("latest_run", f"""WITH {SQL_LOG}
SELECT ticker, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(state, (ts, event_id)) AS state
FROM log GROUP BY 1""")
def latest_run(spark, sf):
    return align.latest_run(log(spark, sf).select("ticker", "ts", "event_id", "state"), ["ticker"])


@query("param_grid", f"""WITH {SYMBOL_BARS}, e AS (SELECT DISTINCT ticker FROM bars)
SELECT ticker, 864 AS n_combinations, 432 AS n_100_trees, 216 AS n_unlimited_depth FROM e""")
def param_grid(spark, sf):
    plan = search.search_plan(fx.symbol_bars(spark, sf).select("ticker").distinct(), search.FOREST_SPACE)
    return plan.groupBy("ticker").agg(
        F.count(F.lit(1)).cast("int").alias("n_combinations"),
        F.count_if(F.col("n_estimators") == "100").cast("int").alias("n_100_trees"),
        F.count_if(F.col("max_depth").isNull()).cast("int").alias("n_unlimited_depth"))


def sql_options(name: str, values: list) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"(SELECT unnest([{listed}]::VARCHAR[]) AS {name}) AS o_{name}"


@query("param_sample", f"""WITH {SYMBOL_BARS}, s AS (SELECT DISTINCT ticker FROM bars),
g AS (SELECT *, md5(concat_ws('|', '{SEED}', ticker, {', '.join(f"coalesce({c}, 'None')" for c in search.FOREST_SPACE)})) AS h
      FROM s, {', '.join(sql_options(c, v) for c, v in search.FOREST_SPACE.items())})
SELECT ticker, {', '.join(search.FOREST_SPACE)}, CAST(row_number() OVER (PARTITION BY ticker ORDER BY h) AS INTEGER) AS draw
FROM g QUALIFY draw <= 10""")
def param_sample(spark, sf):
    """Ten distinct draws of the grid per series, by the smallest seeded hashes."""
    series = fx.symbol_bars(spark, sf).select("ticker").distinct()
    return search.sample_per_series(series, search.FOREST_SPACE, 10)


@query("param_draws", f"""WITH {SYMBOL_BARS}
{draws.draws_sql("SELECT DISTINCT ticker FROM bars", search.FOREST_SPACE, 10, SEED)}""")
def param_draws(spark, sf):
    """Ten distinct draws of the forest space per series by a keyed permutation of grid indices: ten rows each."""
    series = fx.symbol_bars(spark, sf).select("ticker").distinct()
    return draws.draws(series, search.FOREST_SPACE, 10, SEED)


@query("forecast_export", f"""WITH {SQL_LAST}, {SQL_FUTURE.format(h=5)},
v AS (SELECT ticker, arg_max(close, ds) AS p FROM bars GROUP BY 1)
SELECT ticker, 'naive' AS model_used, strftime(ds, '%Y-%m-%d') AS "Fecha", printf('%.4f', p) AS "Prediccion",
       printf('%.4f', p) AS "Inferior", printf('%.4f', p) AS "Superior" FROM fut JOIN v USING (ticker)""")
def forecast_export(spark, sf):
    """Exported as CSV and read back."""
    path = fresh_path(spark, "export")
    report.export_csv(report.naive_forecast(fx.bars(spark, sf), 5), path)
    return spark.read.option("header", True).schema(
        "Fecha string, Prediccion string, Inferior string, Superior string, ticker string, model_used string"
    ).csv(path).select("ticker", "model_used", "Fecha", "Prediccion", "Inferior", "Superior")


@query("forecast_report", f"""WITH {SQL_LAST}, {SQL_FUTURE.format(h=5)},
v AS (SELECT ticker, max(ds) AS d, arg_max(close, ds) AS p FROM bars GROUP BY 1)
SELECT ticker, 'success' AS status, CAST(5 AS INTEGER) AS horizon, CAST(least(n, 252) AS INTEGER) AS n_history,
       strftime(d, '%Y-%m-%d') AS last_actual_date, p AS last_actual_value,
       (SELECT strftime(min(ds), '%Y-%m-%d') FROM fut WHERE fut.ticker = v.ticker) AS first_date
FROM v JOIN (SELECT ticker, count(*) AS n FROM bars GROUP BY 1) c USING (ticker)""")
def forecast_report(spark, sf):
    bars = fx.bars(spark, sf)
    doc = report.forecast_report(bars, report.naive_forecast(bars, 5))
    got = F.from_json("report", "status string, forecast_horizon int, historical_values array<double>, "
                      "last_actual_date string, last_actual_value double, predictions array<struct<date string>>")
    return doc.withColumn("d", got).select(
        "ticker", "d.status", F.col("d.forecast_horizon").alias("horizon"),
        F.size("d.historical_values").alias("n_history"), "d.last_actual_date", "d.last_actual_value",
        F.col("d.predictions")[0]["date"].alias("first_date"))


@query("residual_pages", f"""WITH {sql_series()},
p AS (SELECT ticker, close - lag(close) {over()} AS residual, pos - 1 AS i FROM s)
SELECT ticker, i // 500 AS page, count(*) AS n, {sql_price('sum(residual)')} AS total
FROM p WHERE i >= 0 GROUP BY 1, 2""")
def residual_pages(spark, sf):
    pages = report.residual_pages(naive(spark, sf), 500)
    total = F.aggregate("residuals", F.lit(0.0), lambda a, v: a + v)
    return pages.select("ticker", "page", F.size("residuals").cast("long").alias("n"), price(total).alias("total"))
