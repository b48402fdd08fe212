"""Parameter draws by a keyed permutation of grid indices."""

import hashlib

import pytest
from pyspark.sql import functions as F

from seriescast.plans import draws


def network(x, key, h):
    half = 1 << h
    left, right = x // half, x % half
    for r in range(draws.ROUNDS):
        mixed = ((((right * draws.MUL_A + (key + r * 1000003) % draws.PRIME) % draws.PRIME) * draws.MUL_B) % draws.PRIME) % half
        left, right = right, left ^ mixed
    return left * half + right


def permute(i, key, size):
    h = draws.half_bits(size)
    x = network(i, key, h)
    while x >= size:
        x = network(x, key, h)
    return x


def key_of(seed, ticker):
    return int(hashlib.md5(f"{seed}|{ticker}".encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("size", [1, 2, 3, 17, 864, 1000])
def test_permutation_is_a_bijection_in_spark(spark, size):
    sql = draws.permutation_sql("id", draws.key_sql(7, "'T'"), size)
    got = [r.p for r in spark.range(size).select(F.expr(sql).alias("p")).collect()]
    assert sorted(got) == list(range(size))
    assert got == [permute(i, key_of(7, "T"), size) for i in range(size)]


def test_draws_against_brute_force_and_huge_spaces(spark):
    space = {f"p{j}": [str(v) for v in range(16)] for j in range(10)}  # 16^10, about 1.1e12 points
    series = spark.createDataFrame([("AAA",), ("BBB",), (None,)], "ticker string")
    got = draws.draws(series, space, 50, 42).collect()
    for ticker in ("AAA", "BBB"):
        mine = sorted((r.draw, r.point) for r in got if r.ticker == ticker)
        assert [p for _, p in mine] == [permute(i, key_of(42, ticker), 16 ** 10) for i in range(50)]
        assert len({p for _, p in mine}) == 50
    row = got[0]
    digits = [(row.point // 16 ** (9 - j)) % 16 for j in range(10)]
    assert [row[f"p{j}"] for j in range(10)] == [str(d) for d in digits]
    # a null ticker has no key: md5 of concat_ws skips it, so it is drawn like the empty name
    assert len([r for r in got if r.ticker is None]) == 50


def test_small_spaces_give_every_point_once(spark):
    space = {"a": [1, 2], "b": [None, "x", "y"]}
    got = draws.draws(spark.createDataFrame([("S",)], "ticker string"), space, 10, 1).collect()
    assert sorted((r.a, r.b or "") for r in got) == sorted((a, b) for a in ("1", "2") for b in ("", "x", "y"))
