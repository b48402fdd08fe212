"""Parameter draws without the grid: a keyed permutation of grid indices, unranked into parameters.

Draw i (from 0) of a series is grid index perm(i), read in mixed radix with the last parameter fastest, so a series
gets n distinct combinations from n rows, whatever the size of the space (up to 2^40, about 10^12).  perm is a
four-round Feistel network on 2h bits (4^h >= size) keyed by the md5 of (seed, ticker), with cycle walking: an
output at or past the size is sent through the network again, which keeps it a permutation of 0..size-1.  Walks
are unrolled ``WALKS`` times; one still out of range raises an error (chance below (3/4)^256 per draw), so a result
is never a repeat.  Round functions are integer arithmetic modulo a prime, so the same expression is written for
Spark and for DuckDB (``permutation_sql``), and the SQL oracle computes the very same draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 2147483647
MUL_A = 48271
MUL_B = 69621
ROUNDS = 4
WALKS = 256
LARGEST = 1 << 40


def half_bits(size: int) -> int:
    """h such that the network's domain 4^h is the least power of four at or above ``size``."""
    h = 1
    while 4 ** h < size:
        h += 1
    return h


def _network(x: str, key: str, h: int, div: str, xor: str) -> str:
    """SQL of one pass of ``x`` through the network; ``div`` and ``xor`` spell integer division and exclusive or."""
    half = 1 << h
    left, right = f"({x} {div} {half})", f"({x} % {half})"
    for r in range(ROUNDS):
        mixed = f"(((({right} * {MUL_A} + ({key} + {r * 1000003}) % {PRIME}) % {PRIME}) * {MUL_B}) % {PRIME}) % {half}"
        left, right = right, xor.format(left, mixed)
    return f"({left} * {half} + {right})"


def permutation_sql(index: str, key: str, size: int, dialect: str = "spark") -> str:
    """SQL of perm(index) over 0..size-1 keyed by ``key`` (bigint SQL expressions)."""
    if not 1 <= size <= LARGEST:
        raise ValueError(f"a space of {size} points is not supported")
    h = half_bits(size)
    div, xor = ("div", "({0} ^ {1})") if dialect == "spark" else ("//", "xor({0}, {1})")
    first = _network(f"CAST({index} AS BIGINT)", key, h, div, xor)
    again = _network("acc", key, h, div, xor)
    step = f"CASE WHEN acc >= {size} THEN {again} ELSE acc END"
    if dialect == "spark":
        return f"aggregate(sequence(1, {WALKS}), {first}, (acc, j) -> {step})"
    return f"list_reduce(range({WALKS}), lambda acc, j: {step}, {first})"


def key_sql(seed: int, ticker: str = "ticker", dialect: str = "spark") -> str:
    """A 32-bit key of the series: the first 8 hex digits of md5('seed|ticker')."""
    digest = f"substr(md5(concat_ws('|', '{seed}', {ticker})), 1, 8)"
    if dialect == "spark":
        return f"CAST(conv({digest}, 16, 10) AS BIGINT)"
    return f"CAST('0x' || {digest} AS BIGINT)"


def _sizes(space: dict[str, list]) -> list[int]:
    return [len(v) for v in space.values()]


def unrank_sql(index: str, space: dict[str, list], dialect: str = "spark") -> dict[str, str]:
    """SQL of each parameter's value (text, null for None) at grid index ``index``, last parameter fastest."""
    sizes = _sizes(space)
    out = {}
    div = "div" if dialect == "spark" else "//"
    for j, (name, values) in enumerate(space.items()):
        below = 1
        for s in sizes[j + 1:]:
            below *= s
        digit = f"(({index}) {div} {below}) % {sizes[j]}"
        options = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
        out[name] = (f"element_at(array({options}), CAST({digit} AS INT) + 1)" if dialect == "spark"
                     else f"list_extract([{options}]::VARCHAR[], {digit} + 1)")
    return out


def draws(series: DataFrame, space: dict[str, list], n: int, seed: int) -> DataFrame:
    """(ticker, draw, point, parameters...): ``n`` distinct points of the grid for every series (all if fewer)."""
    size = 1
    for s in _sizes(space):
        size *= s
    count = min(n, size)
    rows = series.select("ticker", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"))
    point = F.expr(permutation_sql("i", key_sql(seed), size))
    rows = rows.withColumn("point", point).withColumn(
        "point", F.when(F.col("point") < size, F.col("point")).otherwise(F.raise_error(F.lit("walk too long"))).cast("long"))
    params: dict[str, Column] = {k: F.expr(v) for k, v in unrank_sql("point", space).items()}
    return rows.select("ticker", (F.col("i") + 1).cast("int").alias("draw"), "point",
                       *[params[k].cast("string").alias(k) for k in space])


def draws_sql(series_sql: str, space: dict[str, list], n: int, seed: int) -> str:
    """DuckDB SQL of ``draws`` over a query that gives the distinct tickers."""
    size = 1
    for s in _sizes(space):
        size *= s
    point = permutation_sql("i", key_sql(seed, dialect="duckdb"), size, "duckdb")
    params = unrank_sql("point", space, "duckdb")
    columns = ", ".join(f"{v} AS {k}" for k, v in params.items())
    return (f"SELECT ticker, CAST(i + 1 AS INTEGER) AS draw, point, {columns} FROM ("
            f"SELECT ticker, i, CAST({point} AS BIGINT) AS point FROM ({series_sql}) s, range({min(n, size)}) t(i))")
