"""Scans, ranges, validation and other row-count style checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriescast.functions.text import python_to_json, ticker_from_name
from seriescast.operators import metrics
from seriescast.operators.align import previous_price
from seriescast.operators.layout import blocks, own_rows
from seriescast.operators.windows import add, lag, quotient
from seriescast.queries.registry import (
    SQL_EVENT_BARS,
    over,
    query,
    rnd,
    sql_bars,
    sql_rnd,
    sql_series,
)
from seriescast.sources import bars as B
from seriescast.sources import fixtures as fx


@query("bars_scan", f"""
WITH {sql_bars()}
SELECT ticker, ds, open, high, low, close FROM bars
WHERE ticker IN ('1-URGENT', '2-HIGH', '5-LOW') AND ds >= DATE '1996-01-01' AND ds < DATE '1998-12-31'""")
def bars_scan(spark, sf):
    lo, hi = B.default_range("1996-01-01", None, as_of="1998-12-31")
    return B.select_bars(fx.bars(spark, sf), ["1-URGENT", "2-HIGH", "5-LOW"], lo, hi)


@query("bars_period_3y", f"""
WITH {sql_bars()}
SELECT ticker, count(*) AS n, min(ds) AS first_ds, max(ds) AS last_ds FROM bars
WHERE ds >= DATE '1998-08-02' AND ds < DATE '2001-08-01' GROUP BY 1""")
def bars_period_3y(spark, sf):
    lo, hi = B.resolve_range(period="3_years", as_of="2001-08-01")
    return B.select_bars(fx.bars(spark, sf), None, lo, hi).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))


SYMBOLS = "[" + ", ".join(f"'{s}'" for s in B.UNIVERSE) + "]"
SYMBOL_BARS = sql_bars(
    "bars", f"CASE WHEN o_custkey % 110 < {len(B.UNIVERSE)} THEN ({SYMBOLS})[CAST(o_custkey % 110 AS INTEGER) + 1] "
    "ELSE 'X' || CAST(o_custkey % 110 AS VARCHAR) END")


@query("universe_scan", f"""
WITH {SYMBOL_BARS}
SELECT ticker, count(*) AS n, max(close) AS top_close FROM bars
WHERE list_contains({SYMBOLS}, ticker) GROUP BY 1""")
def universe_scan(spark, sf):
    bars = B.select_bars(fx.symbol_bars(spark, sf), B.UNIVERSE)
    return bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max("close").alias("top_close"))


@query("missing_tickers", f"""
WITH {SYMBOL_BARS}
SELECT DISTINCT ticker FROM (
  SELECT 'X' || CAST(c_custkey % 200 AS VARCHAR) AS ticker FROM customer) r
WHERE ticker NOT IN (SELECT ticker FROM bars)""")
def missing_tickers(spark, sf):
    requested = fx.table(spark, sf, "customer").select(
        F.concat(F.lit("X"), (F.col("c_custkey") % 200).cast("string")).alias("ticker"))
    return B.missing_tickers(requested, fx.symbol_bars(spark, sf))


@query("green_day", f"""
WITH {sql_series()}
SELECT ticker, ds, close, CASE WHEN close > lag(close) {over()} THEN 1 ELSE 0 END AS green_day FROM s""")
def green_day(spark, sf):
    return B.with_green_day(fx.bars(spark, sf)).select("ticker", "ds", "close", "green_day")


@query("eligible_series", f"""
WITH {SYMBOL_BARS}
SELECT ticker, count(*) AS n_rows, count(*) >= 252 AS can_train, count(*) >= 21 AS can_predict,
       CASE WHEN count(*) < 252 THEN 'has ' || CAST(count(*) AS VARCHAR) || ' rows, needs 252' END AS reason
FROM bars GROUP BY 1""")
def eligible_series(spark, sf):
    need = B.minimum_rows("rf")
    return B.eligible_series(fx.symbol_bars(spark, sf), need["train"], need["predict"])


# a price relative to a day without movement is undefined or infinite
_CHECKED = ["close", "gain", "close_to_gain"]


@query("invalid_columns", f"""
WITH {sql_series()},
g AS (SELECT close, close - lag(close) {over()} AS gain,
             CASE WHEN close >= open THEN close / nullif(high - low, 0) END AS rel,
             high = low AND close >= open AS inf FROM s)
SELECT 'close' AS column_name, count(*) FILTER (close IS NULL) AS n_null, CAST(0 AS BIGINT) AS n_inf FROM g
UNION ALL SELECT 'gain', count(*) FILTER (gain IS NULL), 0 FROM g
UNION ALL SELECT 'close_to_gain', count(*) FILTER (rel IS NULL AND NOT inf), count(*) FILTER (inf) FROM g""")
def invalid_columns(spark, sf):
    frame = own_rows(add(blocks(fx.bars(spark, sf), 1), {"gain": f"close - {lag('close')}"}))
    frame = add(frame, {"close_to_gain": f"CASE WHEN close >= open THEN {quotient('close', '(high - low)')} END"})
    return B.invalid_columns(frame, _CHECKED)


@query("span_check", f"""
WITH {SQL_EVENT_BARS}, e AS (
  SELECT ticker, min(ds) AS start_ds, max(ds) AS end_ds FROM bars GROUP BY 1
  UNION ALL
  SELECT o_orderpriority, CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE) FROM orders GROUP BY 1)
SELECT ticker, start_ds, end_ds, CAST(end_ds - start_ds AS INTEGER) AS days,
       CASE WHEN end_ds <= start_ds THEN 'empty' WHEN end_ds - start_ds < 760 THEN 'short' ELSE 'ok' END AS warning
FROM e""")
def span_check(spark, sf):
    return B.span_check(fx.event_bars(spark, sf).unionByName(fx.bars(spark, sf)))


NAIVE = f"""{sql_series()},
p AS (SELECT *, lag(close) {over()} AS yhat FROM s)"""


@query("mape_band", f"""
WITH {NAIVE}, m AS (SELECT ticker, avg(abs(close - yhat) / greatest(abs(close), 2.220446049250313e-16)) / 40 AS mape
  FROM p WHERE yhat IS NOT NULL GROUP BY ticker)
SELECT ticker, {sql_rnd('mape')} AS mape,
       CASE WHEN mape < 0.05 THEN 'success' WHEN mape < 0.10 THEN 'processing'
            WHEN mape < 0.15 THEN 'warning' ELSE 'error' END AS band FROM m""")
def mape_band(spark, sf):
    naive = previous_price(fx.bars(spark, sf)).where("previous IS NOT NULL")
    scored = metrics.regression_metrics(naive, ["ticker"], "close", "previous")
    # a fortieth, so that the noise of the sample series falls into the bands
    return scored.select("ticker", (F.col("mape") / 40).alias("mape")).select(
        "ticker", rnd("mape").alias("mape"), metrics.error_band(F.col("mape")).alias("band"))


_NAMED = """
SELECT p_partkey, CASE p_partkey % 11
  WHEN 0 THEN 'lstm_model_' || w WHEN 1 THEN 'rf_model_' || w || '.joblib'
  WHEN 2 THEN 'xgb_model_' || w || '.pkl' WHEN 3 THEN 'model_' || w || '_20231201.h5'
  WHEN 4 THEN 'lstm_model_generic' WHEN 5 THEN w WHEN 6 THEN 'lstm_model'
  WHEN 7 THEN 'xgb_model_' || w WHEN 8 THEN '12345' WHEN 9 THEN lower(w) || '_model' ELSE 'best_' || w END AS model_name
FROM (SELECT p_partkey, upper(substr(p_type, 1, 1 + CAST(p_partkey % 6 AS INTEGER))) AS w FROM part) q"""

# The patterns of stored names, as in functions/text.py.
_SQL_PATTERNS = ", ".join(
    f"nullif(regexp_extract(model_name, '{p}', 1, 'i'), '')" for p in [
        r"^lstm_model_([A-Z]{1,5})$", r"_([A-Z]{1,5})\.(?:keras|joblib|pkl|h5)$",
        r"_([A-Z]{1,5})_\d+\.(?:keras|joblib|pkl|h5)$", r"([A-Z]{1,5})_model", r"_([A-Z]{1,5})$",
        r"([A-Z]{2,5})(?:_|\.|$)"])


@query("ticker_from_name", f"""
WITH named AS ({_NAMED})
SELECT p_partkey, model_name, upper(coalesce({_SQL_PATTERNS})) AS ticker FROM named""")
def ticker_name(spark, sf):
    w = F.upper(F.substr("p_type", F.lit(1), (1 + F.col("p_partkey") % 6).cast("int")))
    forms = [
        F.concat(F.lit("lstm_model_"), w), F.concat(F.lit("rf_model_"), w, F.lit(".joblib")),
        F.concat(F.lit("xgb_model_"), w, F.lit(".pkl")), F.concat(F.lit("model_"), w, F.lit("_20231201.h5")),
        F.lit("lstm_model_generic"), w, F.lit("lstm_model"), F.concat(F.lit("xgb_model_"), w),
        F.lit("12345"), F.concat(F.lower(w), F.lit("_model")), F.concat(F.lit("best_"), w)]
    named = fx.table(spark, sf, "part").select(
        "p_partkey", F.get(F.array(*forms), (F.col("p_partkey") % 11).cast("int")).alias("model_name"))
    return named.withColumn("ticker", ticker_from_name(F.col("model_name")))


@query("pyrepr_to_json", """
SELECT p_partkey, CAST(p_size AS BIGINT) AS depth, p_retailprice AS price, p_size % 2 = 0 AS even,
       p_type AS label, CAST(NULL AS VARCHAR) AS missing, len([p_size, p_size + 1]) AS n_index,
       CAST(p_size + 1 AS BIGINT) AS last_index, p_partkey % 5 <> 0 AS parsed
FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false FROM part WHERE p_partkey % 5 = 0""")
def pyrepr_to_json(spark, sf):
    s = F.col("p_size").cast("string")
    literal = F.concat(
        F.lit("{'depth': "), s, F.lit(", 'price': "), F.col("p_retailprice").cast("string"),
        F.lit(", 'even': "), F.when(F.col("p_size") % 2 == 0, "True").otherwise("False"),
        F.lit(", 'label': '"), F.col("p_type"), F.lit("', 'missing': None, 'index': ("), s, F.lit(", "),
        (F.col("p_size") + 1).cast("string"), F.lit(")}"))
    text = F.when(F.col("p_partkey") % 5 == 0, F.lit("no parameters")).otherwise(literal)
    schema = ("depth bigint, price double, even boolean, label string, missing string, "
              "index array<bigint>, _corrupt string")
    parsed = F.from_json(python_to_json(text), schema, {"columnNameOfCorruptRecord": "_corrupt"})
    return fx.table(spark, sf, "part").withColumn("_text", text).withColumn("r", parsed).select(
        "p_partkey", "r.depth", "r.price", "r.even", "r.label", "r.missing",
        F.when(F.col("r.index").isNotNull(), F.size("r.index")).cast("long").alias("n_index"),
        F.element_at("r.index", -1).alias("last_index"), F.col("r._corrupt").isNull().alias("parsed"))
