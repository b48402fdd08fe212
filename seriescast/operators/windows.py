"""Rolling indicators over a blocked series frame, as Spark SQL expressions.

Every builder returns expression text: a recipe adds dozens of columns at once, and text
is parsed on the JVM in one go (``add``) where Column objects would be put together call
by call.  ``n`` is the length of the series a window runs on; a column guarded by a
minimum length is NULL for shorter series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = "1e-10D"
INF = float("inf")
ORDER = "PARTITION BY ticker, blk ORDER BY pos"


def add(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add or replace columns given as expression text."""
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def over(k: int | None = None) -> str:
    """The rows so far, or only the last ``k`` of them (fewer at the head of a series)."""
    frame = "" if k is None else f" ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW"
    return f"OVER ({ORDER}{frame})"


def at_least(rows: int, text: str, n: str = "n_rows") -> str:
    return f"CASE WHEN {n} >= {rows} THEN {text} END"


def lag(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) {over()}"


def quotient(a: str, b: str) -> str:
    """IEEE division without an ANSI error: x/0 is a signed infinity, 0/0 is NULL."""
    at_zero = f"CASE WHEN {a} <> 0 THEN signum({a}) * double('Infinity') END"
    return f"CASE WHEN {b} = 0 THEN {at_zero} ELSE try_divide({a}, {b}) END"


def mean(c: str, k: int) -> str:
    return f"avg({c}) {over(k)}"


def std(c: str, k: int) -> str:
    return f"stddev_samp({c}) {over(k)}"


def highest(c: str, k: int) -> str:
    return f"max({c}) {over(k)}"


def lowest(c: str, k: int) -> str:
    return f"min({c}) {over(k)}"


def sma(k: int, price: str = "close", n: str = "n_rows") -> str:
    return at_least(k, mean(price, k), n)


def change(c: str, k: int = 1) -> str:
    """Relative change over ``k`` rows, 0 where there is no earlier row."""
    return f"coalesce({quotient(c, lag(c, k))} - 1, 0D)"


def price_change(k: int, price: str = "close", n: str = "n_rows") -> str:
    return at_least(k + 1, change(price, k), n)


def log_return(price: str = "close") -> str:
    """ln(p_t / p_{t-1}); 0 where undefined, NULL where it would be infinite."""
    ratio = quotient(price, lag(price))
    return (f"CASE WHEN {ratio} = 0 OR abs({ratio}) = double('Infinity') THEN CAST(NULL AS DOUBLE) "
            f"ELSE coalesce(CASE WHEN {ratio} > 0 THEN ln({ratio}) END, 0D) END")


def up_move(price: str = "close") -> str:
    return f"coalesce(greatest({price} - {lag(price)}, 0D), 0D)"


def down_move(price: str = "close") -> str:
    return f"coalesce(greatest({lag(price)} - {price}, 0D), 0D)"


def rsi(up: str = "_up", down: str = "_down", k: int = 14, n: str = "n_rows", short: str = "50D") -> str:
    """Relative strength from up/down moves; ``short`` for series shorter than ``k``."""
    strength = f"{mean(up, k)} / ({mean(down, k)} + {EPS})"
    return f"CASE WHEN {n} >= {k} THEN 100 - 100 / (1 + {strength}) ELSE {short} END"


def relative_volatility(k: int = 20, price: str = "close", n: str = "n_rows") -> str:
    return at_least(k, f"{std(price, k)} / ({mean(price, k)} + {EPS})", n)


def ratio_to_mean(c: str, k: int, least: int = 1, n: str = "n_rows") -> str:
    return at_least(least, f"{c} / ({mean(c, k)} + {EPS})", n)


def trend(previous_up: str, k: int, n: str = "n_rows") -> str:
    return at_least(k + 1, f"sum({previous_up}) {over(k)}", n)


def momentum(k: int, price: str = "close", n: str = "n_rows") -> str:
    return at_least(k + 1, f"{quotient(price, lag(price, k))} - 1", n)


def band_width(k: int = 20, price: str = "close", n: str = "n_rows") -> str:
    return at_least(k, f"4 * {std(price, k)} / ({mean(price, k)} + {EPS})", n)


def true_range(high: str = "high", low: str = "low", price: str = "close") -> str:
    """Largest of the three ranges; the first row has only high - low."""
    return f"greatest({high} - {low}, abs({high} - {lag(price)}), abs({low} - {lag(price)}))"


def stochastic(k: int = 14, high: str = "high", low: str = "low", price: str = "close",
               n: str = "n_rows") -> str:
    lo, hi = lowest(low, k), highest(high, k)
    return at_least(k, f"100 * ({price} - {lo}) / ({hi} - {lo} + {EPS})", n)


def williams(k: int = 14, high: str = "high", low: str = "low", price: str = "close",
             n: str = "n_rows") -> str:
    lo, hi = lowest(low, k), highest(high, k)
    return at_least(k, f"-100 * ({hi} - {price}) / ({hi} - {lo} + {EPS})", n)


def green_day(price: str = "close") -> str:
    return f"coalesce(CAST({price} > {lag(price)} AS INT), 0)"


def lag_depth(n_lags: int, n: str = "n_rows") -> str:
    """Usable lags: ``n_lags``, or one less than the length of a series too short for them."""
    return f"CASE WHEN {n} <= {n_lags} THEN greatest(1L, {n} - 1) ELSE {n_lags}L END"


def lag_columns(c: str, n_lags: int) -> dict[str, str]:
    return {f"{c}_lag_{k}": f"CASE WHEN lag_depth >= {k} THEN {lag(c, k)} END" for k in range(1, n_lags + 1)}


def bollinger(mid: str, spread: str, price: str = "close") -> dict[str, str]:
    upper, lower = f"({mid} + 2 * {spread})", f"({mid} - 2 * {spread})"
    return {
        "bb_upper": upper,
        "bb_lower": lower,
        "bb_position": f"({price} - {lower}) / ({upper} - {lower} + {EPS})",
    }
