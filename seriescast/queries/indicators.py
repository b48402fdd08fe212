"""One query per window indicator."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriescast.functions.calendar import (
    CYCLE_NAMES,
    ONE_HOT_NAMES,
    PART_NAMES,
    calendar_cycles,
    calendar_parts,
    future_dates,
    one_hot_calendar,
)
from seriescast.operators import windows as W
from seriescast.operators.cumulate import price_path
from seriescast.operators.ema import Ema, emas
from seriescast.operators.fill import gap_fill
from seriescast.operators.layout import BLOCK, blocks, index_series, own_rows
from seriescast.operators.split import last_actual
from seriescast.plans import recipes as R
from seriescast.queries.registry import (
    EPS,
    SQL_EVENT_BARS,
    over,
    price,
    query,
    shaped,
    sql_change,
    sql_price,
    sql_series,
    sql_shaped,
)
from seriescast.sources import fixtures as fx

LOOKBACK = 64


def bars_frame(spark, sf, lookback=LOOKBACK):
    return blocks(fx.bars(spark, sf), lookback)


def finish(frame, names):
    return shaped(own_rows(frame), ["ticker", "ds", *names])


def sql(names, ctes, source):
    return f"WITH RECURSIVE {ctes} SELECT {sql_shaped(['ticker', 'ds', *names])} FROM {source}"


def simple(names, columns, extra=None):
    """SQL over the series CTE with one expression per name."""
    body = ", ".join(f"{e} AS {n}" for n, e in zip(names, columns))
    middle = f", m AS (SELECT *, {extra} FROM s)" if extra else ""
    src = "m" if extra else "s"
    return sql(names, f"{sql_series()}{middle}, r AS (SELECT ticker, ds, {body} FROM {src})", "r")


LAGS = [f"close_lag_{k}" for k in range(1, 6)]


@query("lags", sql(LAGS, f"{sql_series()}, r AS (SELECT ticker, ds, pos, "
                   + ", ".join(f"lag(close, {k}) {over()} AS close_lag_{k}" for k in range(1, 6))
                   + " FROM s)", "r WHERE pos >= 5"))
def lags(spark, sf):
    return finish(R.trim_to_lags(bars_frame(spark, sf), "close", 5), LAGS)


SMAS = [f"sma_{k}" for k in R.SMA_WINDOWS]


@query("sma", simple(SMAS, [f"CASE WHEN n >= {k} THEN avg(close) {over(k)} END" for k in R.SMA_WINDOWS]))
def sma(spark, sf):
    return finish(W.add(bars_frame(spark, sf), {f"sma_{k}": W.sma(k) for k in R.SMA_WINDOWS}), SMAS)


def sql_recursion(name, start, step, source="s"):
    """A recursive CTE walking each series by position."""
    cols = ", ".join(start)
    return f"""{name}(ticker, pos, {cols}) AS (
      SELECT ticker, pos, {', '.join(start.values())} FROM {source} WHERE pos = 0
      UNION ALL
      SELECT x.ticker, x.pos, {', '.join(step.values())}
      FROM {name} e JOIN {source} x ON x.ticker = e.ticker AND x.pos = e.pos + 1)"""


def sql_ema_step(prev, x, alpha):
    return f"e.{prev} * (1 - {alpha}::DOUBLE) + x.{x} * {alpha}::DOUBLE"


A12, A26, A9 = "(2.0::DOUBLE/13)", "(2.0::DOUBLE/27)", "(2.0::DOUBLE/10)"
SQL_EMAS = sql_recursion(
    "ema", {"ema_12": "close", "ema_26": "close"},
    {"ema_12": sql_ema_step("ema_12", "close", A12), "ema_26": sql_ema_step("ema_26", "close", A26)})


@query("ema", sql(["ema_12", "ema_26"], f"""{sql_series()}, {SQL_EMAS},
r AS (SELECT s.ticker, s.ds, ema_12, ema_26 FROM s JOIN ema USING (ticker, pos))""", "r"))
def ema(spark, sf):
    indexed = index_series(fx.bars(spark, sf))
    return finish(emas(blocks(indexed, 0), R.CLOSE_EMAS, indexed), ["ema_12", "ema_26"])


def sql_moves(price="close"):
    diff = f"{price} - lag({price}) {over()}"
    return (f"coalesce(greatest({diff}, 0), 0) AS up_, coalesce(greatest(-({diff}), 0), 0) AS down_")


SQL_RSI = f"100 - 100 / (1 + avg(up_) {over(14)} / (avg(down_) {over(14)} + {EPS}))"


@query("rsi", simple(["rsi"], [f"CASE WHEN n >= 14 THEN {SQL_RSI} ELSE 50 END"], sql_moves()))
def rsi(spark, sf):
    frame = W.add(bars_frame(spark, sf), {"_up": W.up_move(), "_down": W.down_move()})
    return finish(W.add(frame, {"rsi": W.rsi()}), ["rsi"])


SQL_VOL20 = f"CASE WHEN n >= 20 THEN stddev_samp(close) {over(20)} / (avg(close) {over(20)} + {EPS}) END"


@query("volatility_20d", simple(["volatility_20d"], [SQL_VOL20]))
def volatility(spark, sf):
    return finish(W.add(bars_frame(spark, sf), {"volatility_20d": W.relative_volatility()}),
                  ["volatility_20d"])


CHANGES = [f"price_change_{k}d" for k in R.CHANGE_PERIODS]


@query("price_change", simple(CHANGES, [sql_change("close", k) for k in R.CHANGE_PERIODS]))
def price_change(spark, sf):
    return finish(W.add(bars_frame(spark, sf), 
        {f"price_change_{k}d": W.price_change(k) for k in R.CHANGE_PERIODS}), CHANGES)


@query("gap_fill", f"""WITH {sql_series()},
g AS (SELECT ticker, ds, pos, CASE WHEN CAST(floor(close) AS BIGINT) % 3 = 0 THEN close END AS close,
             CASE WHEN volume > 1 THEN volume END AS volume FROM s)
SELECT ticker, ds,
  coalesce(last_value(close IGNORE NULLS) OVER w, first_value(close IGNORE NULLS) OVER a, 0) AS close,
  coalesce(last_value(volume IGNORE NULLS) OVER w, first_value(volume IGNORE NULLS) OVER a, 0) AS volume
FROM g WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
              a AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def fill(spark, sf):
    holes = fx.bars(spark, sf).withColumns({
        "close": F.when(F.floor("close") % 3 == 0, F.col("close")),
        "volume": F.when(F.col("volume") > 1, F.col("volume"))})
    return gap_fill(holes, ["close", "volume"]).select("ticker", "ds", "close", "volume")


RF_H = R.RF_HORIZONS
RATIOS = [f"close_ratio_{h}d_ma" for h in RF_H]


@query("rf_ratio", simple(RATIOS, [
    f"CASE WHEN n > {h} THEN close / (avg(close) {over(h)} + {EPS}) END" for h in RF_H]))
def rf_ratio(spark, sf):
    return finish(W.add(bars_frame(spark, sf), 
        {f"close_ratio_{h}d_ma": W.ratio_to_mean("close", h, h + 1) for h in RF_H}), RATIOS)


TRENDS = [f"trend_{h}d_ma" for h in RF_H]
SQL_GREEN = f"CASE WHEN close > lag(close) {over()} THEN 1 ELSE 0 END"


@query("rf_trend", sql(TRENDS, f"""{sql_series()},
g AS (SELECT *, {SQL_GREEN} AS green_day FROM s),
q AS (SELECT *, lag(green_day) {over()} AS prev FROM g),
r AS (SELECT ticker, ds, {', '.join(f'CASE WHEN n > {h} THEN sum(prev) {over(h)} END AS trend_{h}d_ma' for h in RF_H)} FROM q)""", "r"))
def rf_trend(spark, sf):
    frame = W.add(bars_frame(spark, sf), {"green_day": W.green_day()})
    frame = W.add(frame, {"_prev": W.lag("green_day")})
    return finish(W.add(frame, {f"trend_{h}d_ma": W.trend("_prev", h) for h in RF_H}), TRENDS)


MOMENTA = [f"momentum_{h}d" for h in RF_H]


@query("rf_momentum", simple(MOMENTA, [
    f"CASE WHEN n > {h} THEN close / lag(close, {h}) {over()} - 1 END" for h in RF_H]))
def rf_momentum(spark, sf):
    return finish(W.add(bars_frame(spark, sf), {f"momentum_{h}d": W.momentum(h) for h in RF_H}), MOMENTA)


BANDS = ["bb_upper", "bb_lower", "bb_position"]
SQL_BANDS = f"""m AS (SELECT *, avg(close) {over(20)} AS mid, stddev_samp(close) {over(20)} AS sd FROM s),
r AS (SELECT ticker, ds, mid + 2 * sd AS bb_upper, mid - 2 * sd AS bb_lower,
             (close - (mid - 2 * sd)) / (4 * sd + {EPS}) AS bb_position FROM m)"""


@query("bollinger", sql(BANDS, f"{sql_series()}, {SQL_BANDS}", "r"))
def bollinger(spark, sf):
    frame = W.add(bars_frame(spark, sf), {"_mid": W.sma(20), "_sd": W.std("close", 20)})
    return finish(W.add(frame, W.bollinger("_mid", "_sd")), BANDS)


MACD = ["macd", "macd_signal", "macd_histogram"]


@query("macd", sql(MACD, f"""{sql_series()}, {SQL_EMAS},
m AS MATERIALIZED (SELECT ticker, pos, ema_12 - ema_26 AS macd FROM ema),
{sql_recursion('sig', {'macd': 'macd', 'macd_signal': 'macd'},
               {'macd': 'x.macd', 'macd_signal': sql_ema_step('macd_signal', 'macd', A9)}, 'm')},
r AS (SELECT s.ticker, s.ds, macd, macd_signal, macd - macd_signal AS macd_histogram
      FROM s JOIN sig USING (ticker, pos))""", "r"))
def macd(spark, sf):
    indexed = index_series(fx.bars(spark, sf)).withColumn("lag_depth", F.lit(0))
    source = indexed.select("ticker", "pos", "n_rows", "close", "lag_depth")
    framed = emas(blocks(indexed, 0), R.CLOSE_EMAS, source)
    return finish(R.add_macd(framed, source, BLOCK), MACD)


VOLS = ["volume_change", *[f"volume_ratio_{k}d" for k in R.VOLUME_WINDOWS]]


@query("rf_volume", simple(VOLS, [sql_change("volume"), *[
    f"CASE WHEN n >= {k} THEN volume / (avg(volume) {over(k)} + {EPS}) END" for k in R.VOLUME_WINDOWS]]))
def rf_volume(spark, sf):
    cols = {"volume_change": W.change("volume")} | {
        f"volume_ratio_{k}d": W.ratio_to_mean("volume", k, k) for k in R.VOLUME_WINDOWS}
    return finish(W.add(bars_frame(spark, sf), cols), VOLS)


SQL_LOGRET = f"coalesce(ln(close / lag(close) {over()}), 0)"


@query("returns", simple(["returns", "log_returns"], [sql_change("close"), SQL_LOGRET]))
def returns(spark, sf):
    return finish(W.add(bars_frame(spark, sf, 1), 
        {"returns": W.change("close"), "log_returns": W.log_return()}), ["returns", "log_returns"])


RVOLS = [f"volatility_{k}" for k in R.VOLATILITY_WINDOWS]


@query("ret_volatility", simple(RVOLS, [
    f"CASE WHEN n >= {k} THEN stddev_samp(ret) {over(k)} END" for k in R.VOLATILITY_WINDOWS],
    f"{sql_change('close')} AS ret"))
def ret_volatility(spark, sf):
    frame = W.add(bars_frame(spark, sf), {"_r": W.change("close")})
    return finish(W.add(frame, {
        f"volatility_{k}": W.at_least(k, W.std("_r", k)) for k in R.VOLATILITY_WINDOWS}), RVOLS)


SQL_WIDTH = f"CASE WHEN n >= 20 THEN 4 * stddev_samp(close) {over(20)} / (avg(close) {over(20)} + {EPS}) END"


@query("bb_width", simple(["bb_width"], [SQL_WIDTH]))
def bb_width(spark, sf):
    return finish(W.add(bars_frame(spark, sf), {"bb_width": W.band_width()}), ["bb_width"])


SQL_TR = (f"greatest(high - low, coalesce(abs(high - lag(close) {over()}), high - low), "
          f"coalesce(abs(low - lag(close) {over()}), high - low))")
SQL_ATR = f"""tr AS MATERIALIZED (SELECT ticker, pos, {SQL_TR} AS tr FROM s),
{sql_recursion('atr', {'atr_14': 'tr'}, {'atr_14': sql_ema_step('atr_14', 'tr', '(1.0::DOUBLE/14)')}, 'tr')}"""


@query("atr", sql(["atr_14"], f"""{sql_series()}, {SQL_ATR},
r AS (SELECT s.ticker, s.ds, atr_14 FROM s JOIN atr USING (ticker, pos))""", "r"))
def atr(spark, sf):
    ranged = own_rows(W.add(bars_frame(spark, sf, 1), {"true_range": W.true_range()}))
    return shaped(emas(ranged, [Ema("true_range", "atr_14", 1 / 14)]), ["ticker", "ds", "atr_14"])


NVOL = ["volume_returns", "volume_normalized"]


@query("lstm_volume", simple(NVOL, [
    sql_change("volume"), f"volume / (avg(volume) {over(20)} + {EPS})"]))
def lstm_volume(spark, sf):
    return finish(W.add(bars_frame(spark, sf), {
        "volume_returns": W.change("volume"),
        "volume_normalized": W.ratio_to_mean("volume", 20)}), NVOL)


XGB_H = R.XGB_HORIZONS
XGB_NAMES = [f"{k}_{h}" for h in XGB_H for k in ("close_to_mean", "close_to_max", "close_to_min", "range_ratio")]


def sql_xgb(n="n"):
    out = []
    for h in XGB_H:
        w = over(h)
        for e in (f"close / (avg(close) {w} + {EPS})", f"close / (max(close) {w} + {EPS})",
                  f"close / (min(close) {w} + {EPS})",
                  f"(max(close) {w} - min(close) {w}) / (avg(close) {w} + {EPS})"):
            out.append(f"CASE WHEN {n} > {h} THEN {e} END")
    return out


@query("xgb_horizons", simple(XGB_NAMES, sql_xgb()))
def xgb_horizons(spark, sf):
    frame = R.xgb_columns(bars_frame(spark, sf).withColumn("lag_depth", F.lit(0)), XGB_H)
    return finish(frame, XGB_NAMES)


def sql_range(expr, n="n"):
    lo, hi = f"min(low) {over(14)}", f"max(high) {over(14)}"
    return f"CASE WHEN {n} >= 14 THEN {expr.format(lo=lo, hi=hi, eps=EPS)} END"


SQL_STOCH = sql_range("100 * (close - {lo}) / ({hi} - {lo} + {eps})")
SQL_WILL = sql_range("-100 * ({hi} - close) / ({hi} - {lo} + {eps})")


@query("stoch_k", simple(["stoch_k"], [SQL_STOCH]))
def stoch_k(spark, sf):
    return finish(W.add(bars_frame(spark, sf), {"stoch_k": W.stochastic()}), ["stoch_k"])


@query("williams_r", simple(["williams_r"], [SQL_WILL]))
def williams_r(spark, sf):
    return finish(W.add(bars_frame(spark, sf), {"williams_r": W.williams()}), ["williams_r"])


REGRESSORS = ["rsi", "price_to_ma", "volume_ma", "volume_trend"]
SQL_REGRESSORS = [f"CASE WHEN n >= 14 THEN {SQL_RSI} END",
                  f"CASE WHEN n >= 20 THEN close / (avg(close) {over(20)} + {EPS}) END",
                  f"avg(volume) {over(7)}", sql_change("volume")]


@query("additive_regressors", sql(REGRESSORS, f"""{sql_series(SQL_EVENT_BARS)},
m AS (SELECT *, {sql_moves()} FROM s),
r AS (SELECT ticker, ds, {', '.join(f'{e} AS {c}' for c, e in zip(REGRESSORS, SQL_REGRESSORS))} FROM m)""", "r"))
def additive_regressors(spark, sf):
    return shaped(R.features_additive(fx.event_bars(spark, sf)), ["ticker", "ds", *REGRESSORS])


SQL_PARTS = {"day_of_week": "CAST(isodow(ds) - 1 AS INTEGER)", "month": "CAST(month(ds) AS INTEGER)",
             "quarter": "CAST(quarter(ds) AS INTEGER)", "day_of_month": "CAST(day(ds) AS INTEGER)"}
SQL_CYCLES = {"day_of_week_sin": "sin(2 * pi() * (isodow(ds) - 1) / 7)",
              "day_of_week_cos": "cos(2 * pi() * (isodow(ds) - 1) / 7)",
              "month_sin": "sin(2 * pi() * month(ds) / 12)", "month_cos": "cos(2 * pi() * month(ds) / 12)"}
SQL_HOT = {f"month_{m}": f"CAST(month(ds) = {m} AS INTEGER)" for m in range(1, 13)} | {
    f"dow_{d}": f"CAST(isodow(ds) = {d + 1} AS INTEGER)" for d in range(7)}


@query("calendar", simple(PART_NAMES, SQL_PARTS.values()))
def calendar(spark, sf):
    return shaped(W.add(fx.bars(spark, sf), calendar_parts()), ["ticker", "ds", *PART_NAMES])


@query("calendar_cyclic", simple(CYCLE_NAMES, SQL_CYCLES.values()))
def calendar_cyclic(spark, sf):
    return shaped(W.add(fx.bars(spark, sf), calendar_cycles()), ["ticker", "ds", *CYCLE_NAMES])


@query("one_hot_calendar", simple(ONE_HOT_NAMES, SQL_HOT.values()))
def hot(spark, sf):
    return shaped(W.add(fx.bars(spark, sf), one_hot_calendar()), ["ticker", "ds", *ONE_HOT_NAMES])


SQL_LAST = f"{sql_series()}, l AS (SELECT ticker, max(ds) AS last_ds FROM bars GROUP BY 1)"


@query("business_days", f"""WITH {SQL_LAST},
d AS (SELECT ticker, CAST(unnest(generate_series(last_ds + 1, last_ds + 67, INTERVAL 1 DAY)) AS DATE) AS ds FROM l),
r AS (SELECT ticker, ds, row_number() OVER (PARTITION BY ticker ORDER BY ds) AS step FROM d WHERE isodow(ds) < 6)
SELECT ticker, CAST(step AS INTEGER) AS step, ds FROM r WHERE step <= 30""")
def business(spark, sf):
    return future_dates(last_actual(fx.bars(spark, sf)), 30, "business")


@query("calendar_days", f"""WITH {SQL_LAST}
SELECT ticker, CAST(unnest(range(1, 31)) AS INTEGER) AS step,
       CAST(unnest(generate_series(last_ds + 1, last_ds + 30, INTERVAL 1 DAY)) AS DATE) AS ds FROM l""")
def days(spark, sf):
    return future_dates(last_actual(fx.bars(spark, sf)), 30, "day")


@query("price_from_returns", f"""WITH {sql_series()},
r AS (SELECT *, {SQL_LOGRET} AS r FROM s)
SELECT ticker, ds, {sql_price(f'first_value(close) {over()} * exp(sum(r) {over()})')} AS price FROM r""")
def price_from_returns(spark, sf):
    frame = own_rows(W.add(bars_frame(spark, sf, 1), {"_r": W.log_return()}))
    return price_path(frame.drop("blk"), "_r", "close").select("ticker", "ds", price("price").alias("price"))
