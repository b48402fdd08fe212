"""Registration of queries with their SQL, and the rounding both sides share."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = ["scans", "indicators", "frames", "splits", "diagnosis", "tables", "learning"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"seriescast.queries.{m}")


# --- rounding ---------------------------------------------------------------------------
# Engines add doubles in different orders, so values are compared rounded.  Prices have two
# decimals and their averages can fall exactly between two roundings; a relative shift of
# 1e-9 moves them off that edge on both sides alike.

NUDGE = "1.000000001"


def rnd(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def price(x: Column | str) -> Column:
    return F.round((F.col(x) if isinstance(x, str) else x) * float(NUDGE), 2)


def sql_rnd(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0)"


def sql_price(x: str) -> str:
    return f"(round(({x}) * {NUDGE}::DOUBLE, 2) + 0.0)"


PRICES = ("sma_", "ema_", "close_lag_", "bb_upper", "bb_lower", "macd", "atr_", "volume_ma", "y", "price")
PERCENT = ("rsi", "stoch_k", "williams_r")
EXACT = ("ticker", "ds", "pos", "open", "high", "low", "close", "volume", "green_day", "split")
WHOLE = ("day_of_week", "month", "quarter", "day_of_month")


def kind(name: str) -> str:
    if name in EXACT or name in WHOLE or name.startswith("dow_") or (
            name.startswith("month_") and name[6:].isdigit()):
        return "exact"
    if name.startswith("trend_"):
        return "count"
    if name in PERCENT:
        return "percent"
    if name.startswith(PRICES) and not name.startswith("price_"):
        return "price"
    return "ratio"


def shaped(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns, rounded by what they hold."""
    make = {"exact": F.col, "count": lambda c: F.col(c).cast("int").alias(c), "price": price,
            "percent": lambda c: rnd(c, 5), "ratio": rnd}
    return df.select(*[make[kind(c)](c).alias(c) for c in names])


def sql_shaped(names: list[str]) -> str:
    make = {"exact": lambda c: c, "count": lambda c: f"CAST({c} AS INTEGER)", "price": sql_price,
            "percent": lambda c: sql_rnd(c, 5), "ratio": sql_rnd}
    return ", ".join(f"{make[kind(c)](c)} AS {c}" for c in names)


# --- SQL shared by the oracles ----------------------------------------------------------

def sql_bars(name: str = "bars", ticker: str = "o_orderpriority", ts: str = "o_orderdate",
             value: str = "o_totalprice", order: str = "o_orderkey", source: str = "orders") -> str:
    return f"""{name} AS (
      SELECT {ticker} AS ticker, CAST({ts} AS DATE) AS ds,
             arg_min({value}, {order}) AS open, max({value}) AS high, min({value}) AS low,
             arg_max({value}, {order}) AS close, CAST(count(*) AS DOUBLE) AS volume
      FROM {source} GROUP BY 1, 2)"""


SQL_EVENT_BARS = sql_bars("bars", "event_type", "ts", "value", "event_id", "events")


def sql_series(bars: str | None = None) -> str:
    """CTEs ``bars`` and ``s`` (bars with pos and n)."""
    return f"""{bars or sql_bars()},
    s AS MATERIALIZED (
      SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ds) - 1 AS pos,
             count(*) OVER (PARTITION BY ticker) AS n FROM bars)"""


def over(k: int | None = None) -> str:
    frame = "" if k is None else f" ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW"
    return f"OVER (PARTITION BY ticker ORDER BY pos{frame})"


EPS = "1e-10::DOUBLE"


def sql_change(c: str, k: int = 1) -> str:
    return f"coalesce({c} / lag({c}, {k}) {over()} - 1, 0)"
