"""Feature recipes: bars in, one row of features per usable bar out.

A recipe returns a series frame again: ``pos`` and ``n_rows`` count the rows that are
left after the first ``n_lags`` were dropped.  Columns a series is too short for are
NULL.  Closing prices must not be NULL; run ``gap_fill`` first where they may be.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriescast.functions.calendar import (
    CYCLE_NAMES,
    ONE_HOT_NAMES,
    PART_NAMES,
    calendar_cycles,
    calendar_parts,
    one_hot_calendar,
)
from seriescast.operators import windows as W
from seriescast.operators.ema import Ema, emas
from seriescast.operators.layout import BLOCK, blocks, index_series, own_rows
from seriescast.sources.bars import require_columns
from seriescast.sources.storage import materialize

SMA_WINDOWS = (5, 10, 20, 50)
EMA_SPANS = (12, 26)
CHANGE_PERIODS = (1, 5, 10)
RF_HORIZONS = (2, 5, 10, 20, 60)
XGB_HORIZONS = (1, 3, 5, 10, 20, 50)
VOLUME_WINDOWS = (5, 10, 20)
VOLATILITY_WINDOWS = (5, 10, 20)
RATIO_WINDOWS = (5, 20)

CALENDAR = [*PART_NAMES, *CYCLE_NAMES]
BASE_NAMES = [
    "green_day",
    *[f"sma_{k}" for k in SMA_WINDOWS],
    *[f"ema_{k}" for k in EMA_SPANS],
    "rsi", "volatility_20d",
    *[f"price_change_{k}d" for k in CHANGE_PERIODS],
    *CALENDAR,
]
CLOSE_EMAS = [Ema.span("close", f"ema_{k}", k) for k in EMA_SPANS]


def base_columns(frame: DataFrame) -> DataFrame:
    """Indicators every recipe starts from, except the exponential averages."""
    moves = {"_up": W.up_move(), "_down": W.down_move()}
    if "green_day" not in frame.columns:
        moves["green_day"] = W.green_day()
    indicators = (
        {f"sma_{k}": W.sma(k) for k in SMA_WINDOWS}
        | {"rsi": W.rsi(), "volatility_20d": W.relative_volatility()}
        | {f"price_change_{k}d": W.price_change(k) for k in CHANGE_PERIODS}
        | calendar_parts() | calendar_cycles()
    )
    return W.add(W.add(frame, moves), indicators).drop("_up", "_down")


def trim_to_lags(frame: DataFrame, price: str, n_lags: int) -> DataFrame:
    """Add the lag columns and drop the rows that have not all of them."""
    deep = W.add(frame, {"lag_depth": W.lag_depth(n_lags)})
    return W.add(deep, W.lag_columns(price, n_lags)).where("pos >= lag_depth")


def recount(frame: DataFrame) -> DataFrame:
    """Renumber a trimmed frame from 0."""
    return W.add(frame, {"pos": "pos - lag_depth", "n_rows": "n_rows - lag_depth"}).drop("lag_depth", "blk")


TRIMMED = "(n_rows - lag_depth)"


def rf_columns(frame: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Ratio, trend, momentum, band and volume columns on the trimmed frame."""
    cols = {"_std": W.std("close", 20)}
    for h in horizons:
        cols[f"close_ratio_{h}d_ma"] = W.ratio_to_mean("close", h, h + 1, TRIMMED)
        cols[f"trend_{h}d_ma"] = W.trend("_prev_green", h, TRIMMED)
        cols[f"momentum_{h}d"] = W.momentum(h, n=TRIMMED)
    if "volume" in frame.columns:
        cols["volume_change"] = W.change("volume")
        for k in VOLUME_WINDOWS:
            cols[f"volume_ratio_{k}d"] = W.ratio_to_mean("volume", k, k, TRIMMED)
    rolled = W.add(W.add(frame, {"_prev_green": W.lag("green_day")}), cols)
    return W.add(rolled, W.bollinger("sma_20", "_std")).drop("_prev_green", "_std")


def xgb_columns(frame: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Distances to rolling means and extremes, oscillators and one-hot dates."""
    ranged = {"high": "high", "low": "low"} if {"high", "low"} <= set(frame.columns) else {
        "high": "close", "low": "close"}
    cols: dict[str, str] = {}
    for h in horizons:
        avg, hi, lo = W.mean("close", h), W.highest("close", h), W.lowest("close", h)
        for name, text in (
            ("close_to_mean", f"close / ({avg} + {W.EPS})"),
            ("close_to_max", f"close / ({hi} + {W.EPS})"),
            ("close_to_min", f"close / ({lo} + {W.EPS})"),
            ("range_ratio", f"({hi} - {lo}) / ({avg} + {W.EPS})"),
        ):
            cols[f"{name}_{h}"] = W.at_least(h + 1, text, TRIMMED)
    cols["stoch_k"] = W.stochastic(n=TRIMMED, **ranged)
    cols["williams_r"] = W.williams(n=TRIMMED, **ranged)
    return W.add(frame, cols | one_hot_calendar())


def seq_columns(frame: DataFrame, price: str) -> DataFrame:
    """Returns and other near-stationary columns; ``target`` is the log return."""
    cols = {"target": W.log_return(price), "bb_width": W.band_width(price=price)}
    for k in RATIO_WINDOWS:
        cols[f"price_ma_ratio_{k}"] = W.ratio_to_mean(price, k, k)
    for k in VOLATILITY_WINDOWS:
        cols[f"volatility_{k}"] = W.at_least(k, W.std("_returns", k))
    if "volume" in frame.columns:
        cols["volume_returns"] = W.change("volume")
        cols["volume_normalized"] = W.ratio_to_mean("volume", 20)
    return W.add(W.add(frame, {"_returns": W.change(price)}), cols).drop("_returns")


def add_macd(frame: DataFrame, source: DataFrame, block: int) -> DataFrame:
    """MACD, its signal restarted at the first kept row, and their difference."""
    macd = F.col("ema_12") - F.col("ema_26")
    narrow = (
        emas(blocks(source, 0, block), CLOSE_EMAS, source, block=block)
        .select("ticker", "pos", "lag_depth", macd.alias("macd"))
        .where("pos >= lag_depth")
    )
    return emas(
        frame.withColumn("macd", macd), [Ema.span("macd", "macd_signal", 9)], narrow,
        start=F.col("lag_depth"), block=block,
    ).withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def settled(bars: DataFrame, columns: list[str]) -> DataFrame:
    """Indexed bars, stored unless they come indexed: a recipe reads them several times.

    The averages carried between blocks are a second look at the closes, and bars are often
    an aggregate of far larger ticks; stored, those are read once.
    """
    require_columns(bars, columns)
    indexed = index_series(bars)
    return indexed if indexed is bars else materialize(indexed, "bars")


def _framed(bars: DataFrame, columns: list[str], lookback: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The blocked frame with exponential averages of the close, and its narrow source."""
    indexed = settled(bars, columns)
    source = indexed.select("ticker", "pos", "n_rows", "close")
    return emas(blocks(indexed, lookback, block), CLOSE_EMAS, source, block=block), source


def features_base(bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """The shared indicators on every bar, gaps filled."""
    frame, _ = _framed(bars, ["close"], 52, block)
    filled = base_columns(frame)
    # only the spread of a single row is undefined, and the row after it is in the same block
    later = f"lead(volatility_20d) {W.over()}"
    return own_rows(W.add(filled, {"volatility_20d": f"coalesce(volatility_20d, {later})"})).drop("blk")


def features_rf(bars: DataFrame, n_lags: int = 10, horizons: tuple[int, ...] = RF_HORIZONS,
                block: int = BLOCK) -> DataFrame:
    lookback = max(52, n_lags, max(horizons) + 2)
    frame, source = _framed(bars, ["open", "high", "low", "close"], lookback, block)
    kept = rf_columns(trim_to_lags(base_columns(frame), "close", n_lags), horizons)
    source = W.add(source, {"lag_depth": W.lag_depth(n_lags)})
    return recount(add_macd(own_rows(kept), source, block))


def features_xgb(bars: DataFrame, n_lags: int = 15, horizons: tuple[int, ...] = XGB_HORIZONS,
                 block: int = BLOCK) -> DataFrame:
    lookback = max(52, n_lags, max(horizons))
    frame, _ = _framed(bars, ["close"], lookback, block)
    kept = xgb_columns(trim_to_lags(base_columns(frame), "close", n_lags), horizons)
    return recount(own_rows(kept))


def features_seq(bars: DataFrame, n_lags: int = 5, price: str = "close",
                 block: int = BLOCK) -> DataFrame:
    bars = settled(bars, ["close", price])
    frame, _ = _framed(bars, ["close", price], max(52, n_lags), block)
    if {"high", "low"} <= set(bars.columns):
        reach = {"true_range": W.true_range(price=price)}
        ranged = own_rows(W.add(blocks(bars, 1, block), reach))
        frame = emas(W.add(frame, reach), [Ema("true_range", "atr_14", 1 / 14)], ranged,
                     block=block).drop("true_range")
    kept = own_rows(trim_to_lags(seq_columns(base_columns(frame), price), price, n_lags))
    names = seq_names(n_lags, bars.columns, price)
    guards, lags = seq_guards(), {f"{price}_lag_{k}": k for k in range(1, n_lags + 1)}
    usable = []
    for c in [*names, "target"]:
        present = f"({c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) <> double('Infinity'))"
        if c in guards:
            present = f"(n_rows < {guards[c]} OR {present})"
        elif c in lags:
            present = f"(lag_depth < {lags[c]} OR {present})"
        usable.append(present)
    # a dropped infinity may leave a hole anywhere, so the old positions are not handed on
    return kept.where(" AND ".join(usable)).select("ticker", "ds", *names, "target", F.col(price).alias("price"))


def features_additive(bars: DataFrame, target: str = "close", block: int = BLOCK) -> DataFrame:
    """``ds, y`` and the extra regressors."""
    require_columns(bars, [target])
    frame = W.add(blocks(bars, 22, block), {"_up": W.up_move(), "_down": W.down_move()})
    cols = {"rsi": W.rsi(short="CAST(NULL AS DOUBLE)"), "price_to_ma": W.ratio_to_mean("close", 20, 20)}
    if "volume" in bars.columns:
        cols["volume_ma"] = W.mean("volume", 7)
        cols["volume_trend"] = W.change("volume")
    return own_rows(W.add(frame, cols)).select(
        "ticker", F.col("ds").cast("date").alias("ds"), "pos", "n_rows", F.col(target).alias("y"), *cols)


def _bar_names(columns: list[str]) -> list[str]:
    return [c for c in ("open", "high", "low", "close", "volume") if c in columns]


def rf_names(n_lags: int, columns: list[str], horizons: tuple[int, ...] = RF_HORIZONS) -> list[str]:
    names = [c for c in _bar_names(columns) if c != "close"] + BASE_NAMES
    names += [f"close_lag_{k}" for k in range(1, n_lags + 1)]
    for h in horizons:
        names += [f"close_ratio_{h}d_ma", f"trend_{h}d_ma", f"momentum_{h}d"]
    names += ["bb_upper", "bb_lower", "bb_position", "macd", "macd_signal", "macd_histogram"]
    if "volume" in columns:
        names += ["volume_change", *[f"volume_ratio_{k}d" for k in VOLUME_WINDOWS]]
    return names


def xgb_names(n_lags: int, columns: list[str], horizons: tuple[int, ...] = XGB_HORIZONS) -> list[str]:
    names = [c for c in _bar_names(columns) if c != "close"] + BASE_NAMES
    names += [f"close_lag_{k}" for k in range(1, n_lags + 1)]
    for h in horizons:
        names += [f"{kind}_{h}" for kind in ("close_to_mean", "close_to_max", "close_to_min", "range_ratio")]
    return names + ["stoch_k", "williams_r", *ONE_HOT_NAMES]


def seq_names(n_lags: int, columns: list[str], price: str = "close") -> list[str]:
    names = [c for c in _bar_names(columns) if c != price] + BASE_NAMES
    names += [f"price_ma_ratio_{k}" for k in RATIO_WINDOWS]
    names += [f"volatility_{k}" for k in VOLATILITY_WINDOWS] + ["bb_width"]
    if {"high", "low"} <= set(columns):
        names.append("atr_14")
    if "volume" in columns:
        names += ["volume_returns", "volume_normalized"]
    return names + [f"{price}_lag_{k}" for k in range(1, n_lags + 1)]


def seq_guards() -> dict[str, int]:
    """Shortest series each column exists for."""
    return (
        {f"sma_{k}": k for k in SMA_WINDOWS}
        | {f"price_change_{k}d": k + 1 for k in CHANGE_PERIODS}
        | {f"price_ma_ratio_{k}": k for k in RATIO_WINDOWS}
        | {f"volatility_{k}": k for k in VOLATILITY_WINDOWS}
        | {"volatility_20d": 20, "bb_width": 20}
    )


def additive_names(n_lags: int, columns: list[str]) -> list[str]:
    return ["rsi", "price_to_ma"] + (["volume_ma", "volume_trend"] if "volume" in columns else [])


@dataclass(frozen=True)
class Recipe:
    name: str
    build: Callable[..., DataFrame]
    names: Callable[..., list[str]]
    label: str
    n_lags: int
    scaler: str | None
    train_ratio: float


RF = Recipe("rf", features_rf, rf_names, "close", 10, "minmax", 0.8)
XGB = Recipe("xgb", features_xgb, xgb_names, "close", 15, None, 0.7)
SEQ = Recipe("seq", features_seq, seq_names, "target", 5, "standard", 0.8)
ADDITIVE = Recipe("additive", features_additive, additive_names, "y", 0, None, 0.8)

RECIPES: dict[str, Recipe] = {
    "rf": RF, "random_forest": RF, "xgb": XGB, "xgboost": XGB, "lstm": SEQ, "seq": SEQ,
    "prophet": ADDITIVE, "additive": ADDITIVE,
}


def recipe(name: str) -> Recipe:
    try:
        return RECIPES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown model type {name!r}, available: {sorted(RECIPES)}") from None
