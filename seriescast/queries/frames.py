"""The complete feature recipes."""

from __future__ import annotations

from seriescast.operators.align import attach_regressors
from seriescast.operators.split import last_row
from seriescast.plans import recipes as R
from seriescast.queries import indicators as I
from seriescast.queries.registry import EPS, SQL_EVENT_BARS, over, query, shaped, sql_series, sql_shaped
from seriescast.sources import fixtures as fx


def sql_base(bars: str | None = None) -> str:
    """CTEs up to ``base``: every shared indicator, gaps as the windows leave them."""
    cols = {f"sma_{k}": f"CASE WHEN n >= {k} THEN avg(close) {over(k)} END" for k in R.SMA_WINDOWS}
    cols |= {"rsi": f"CASE WHEN n >= 14 THEN {I.SQL_RSI} ELSE 50 END", "volatility_20d": I.SQL_VOL20}
    cols |= {f"price_change_{k}d": f"CASE WHEN n > {k} THEN {I.sql_change('close', k)} END" for k in R.CHANGE_PERIODS}
    cols |= I.SQL_PARTS | I.SQL_CYCLES
    return f"""{sql_series(bars)}, {I.SQL_EMAS},
    moved AS (SELECT s.*, ema_12, ema_26, {I.SQL_GREEN} AS green_day, {I.sql_moves()}
              FROM s JOIN ema USING (ticker, pos)),
    base AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM moved)"""


def sql_lags(n_lags: int, source: str = "base", name: str = "trimmed") -> str:
    """Lag columns on the full frame, then the first rows cut off."""
    depth = f"CASE WHEN n <= {n_lags} THEN greatest(1, n - 1) ELSE {n_lags} END"
    cols = ", ".join(f"CASE WHEN {k} <= {depth} THEN lag(close, {k}) {over()} END AS close_lag_{k}"
                     for k in range(1, n_lags + 1))
    return f"""lagged AS (SELECT *, {depth} AS lag_depth, {cols} FROM {source}),
    {name} AS MATERIALIZED (SELECT *, n - lag_depth AS m FROM lagged WHERE pos >= lag_depth)"""


RF_NAMES = R.rf_names(10, ["open", "high", "low", "close", "volume"])


def _sql_rf() -> str:
    cols = {}
    for h in R.RF_HORIZONS:
        cols[f"close_ratio_{h}d_ma"] = f"CASE WHEN m > {h} THEN close / (avg(close) {over(h)} + {EPS}) END"
        cols[f"trend_{h}d_ma"] = f"CASE WHEN m > {h} THEN sum(prev) {over(h)} END"
        cols[f"momentum_{h}d"] = f"CASE WHEN m > {h} THEN close / lag(close, {h}) {over()} - 1 END"
    cols["sd"] = f"stddev_samp(close) {over(20)}"
    cols["volume_change"] = I.sql_change("volume")
    for k in R.VOLUME_WINDOWS:
        cols[f"volume_ratio_{k}d"] = f"CASE WHEN m >= {k} THEN volume / (avg(volume) {over(k)} + {EPS}) END"
    return f"""{sql_base()}, {sql_lags(10)},
    prevs AS (SELECT *, lag(green_day) {over()} AS prev FROM trimmed),
    rf AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in cols.items())},
           ema_12 - ema_26 AS macd FROM prevs),
    mm AS MATERIALIZED (SELECT ticker, pos - lag_depth AS pos, macd FROM rf),
    {I.sql_recursion('sig', {'macd_signal': 'macd'}, {'macd_signal': I.sql_ema_step('macd_signal', 'macd', I.A9)}, 'mm')},
    r AS (SELECT rf.*, macd_signal, macd - macd_signal AS macd_histogram,
                 sma_20 + 2 * sd AS bb_upper, sma_20 - 2 * sd AS bb_lower,
                 (close - (sma_20 - 2 * sd)) / (4 * sd + {EPS}) AS bb_position
          FROM rf JOIN sig ON sig.ticker = rf.ticker AND sig.pos = rf.pos - lag_depth)"""


SQL_RF = _sql_rf()


@query("features_rf", f"WITH RECURSIVE {SQL_RF} SELECT {sql_shaped(['ticker', 'ds', 'close', *RF_NAMES])} FROM r")
def features_rf(spark, sf):
    return shaped(R.features_rf(fx.bars(spark, sf)), ["ticker", "ds", "close", *RF_NAMES])


LATEST = ["ticker", "ds", "close", "sma_20", "rsi", "ema_12", "price_change_1d", "green_day", "momentum_5d",
          "macd_signal"]


@query("latest_features", f"""WITH RECURSIVE {SQL_RF}
SELECT {sql_shaped(LATEST)} FROM r WHERE pos = n - 1""")
def latest_features(spark, sf):
    return shaped(last_row(R.features_rf(fx.bars(spark, sf))), LATEST)


XGB_NAMES = R.xgb_names(15, ["open", "high", "low", "close", "volume"])


def _sql_xgb() -> str:
    cols = dict(zip(I.XGB_NAMES, I.sql_xgb("m")))
    cols["stoch_k"] = I.sql_range("100 * (close - {lo}) / ({hi} - {lo} + {eps})", "m")
    cols["williams_r"] = I.sql_range("-100 * ({hi} - close) / ({hi} - {lo} + {eps})", "m")
    cols |= I.SQL_HOT
    return f"""{sql_base()}, {sql_lags(15)},
    r AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM trimmed)"""


@query("features_xgb", f"WITH RECURSIVE {_sql_xgb()} SELECT {sql_shaped(['ticker', 'ds', 'close', *XGB_NAMES])} FROM r")
def features_xgb(spark, sf):
    return shaped(R.features_xgb(fx.bars(spark, sf)), ["ticker", "ds", "close", *XGB_NAMES])


SEQ_NAMES = R.seq_names(5, ["open", "high", "low", "close", "volume"])


def _sql_seq(bars: str | None = None) -> str:
    cols = {f"price_ma_ratio_{k}": f"CASE WHEN n >= {k} THEN close / (avg(close) {over(k)} + {EPS}) END"
            for k in R.RATIO_WINDOWS}
    cols |= {f"volatility_{k}": f"CASE WHEN n >= {k} THEN stddev_samp(ret) {over(k)} END"
             for k in R.VOLATILITY_WINDOWS}
    cols |= {"bb_width": I.SQL_WIDTH, "volume_returns": I.sql_change("volume"),
             "volume_normalized": f"volume / (avg(volume) {over(20)} + {EPS})"}
    return f"""{sql_base(bars)}, {I.SQL_ATR},
    rets AS (SELECT base.*, atr_14, {I.sql_change('close')} AS ret, {I.SQL_LOGRET} AS target
             FROM base JOIN atr USING (ticker, pos)),
    seq AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM rets),
    {sql_lags(5, 'seq', 'r')}"""


SQL_SEQ = _sql_seq()


@query("features_seq", f"WITH RECURSIVE {SQL_SEQ} SELECT {sql_shaped(['ticker', 'ds', 'target', *SEQ_NAMES])} FROM r")
def features_seq(spark, sf):
    return shaped(R.features_seq(fx.bars(spark, sf)), ["ticker", "ds", "target", *SEQ_NAMES])


# thirty-row series: several columns fall below their minimum length
@query("features_seq_short", f"""WITH RECURSIVE {_sql_seq(SQL_EVENT_BARS)}
SELECT {sql_shaped(['ticker', 'ds', 'target', *SEQ_NAMES])} FROM r""")
def features_seq_short(spark, sf):
    return shaped(R.features_seq(fx.event_bars(spark, sf)), ["ticker", "ds", "target", *SEQ_NAMES])


BASE = [c for c in R.BASE_NAMES]


@query("features_base", f"""WITH RECURSIVE {sql_base()},
r AS (SELECT * REPLACE (coalesce(volatility_20d, lead(volatility_20d) {over()}) AS volatility_20d) FROM base)
SELECT {sql_shaped(['ticker', 'ds', 'close', *BASE])} FROM r""")
def features_base(spark, sf):
    return shaped(R.features_base(fx.bars(spark, sf)), ["ticker", "ds", "close", *BASE])


ADDITIVE = ["ticker", "ds", "y", *I.REGRESSORS]


@query("additive_frame", I.sql(["y", *I.REGRESSORS, "close"], f"""{sql_series()},
m AS (SELECT *, {I.sql_moves()} FROM s),
r AS (SELECT ticker, ds, close AS y, close, {', '.join(f'{e} AS {c}' for c, e in zip(I.REGRESSORS, I.SQL_REGRESSORS))}
      FROM m)""", "r"))
def additive_frame(spark, sf):
    bars = fx.bars(spark, sf)
    return shaped(attach_regressors(R.features_additive(bars), bars, ["close"]), [*ADDITIVE, "close"])
