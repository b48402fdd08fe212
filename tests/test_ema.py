import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from seriescast.operators.ema import Ema, emas, segment_rows
from seriescast.operators.layout import blocks, index_series


def frame(spark, values):
    days = pd.date_range("2000-01-01", periods=len(values)).date
    return spark.createDataFrame(pd.DataFrame({"ticker": "T", "ds": days, "close": values}),
                                 "ticker string, ds date, close double")


def ema_of(spark, values, alpha, block):
    indexed = index_series(frame(spark, values))
    df = emas(blocks(indexed, 0, block), [Ema("close", "e", alpha)], indexed, block=block)
    return df.orderBy("pos").toPandas()["e"].to_numpy()


@pytest.mark.parametrize("alpha", [2 / 13, 2 / 27, 1 / 14, 0.5, 0.9, 0.01])
@pytest.mark.parametrize("block", [8, 256, 2048])
def test_matches_the_recursion(spark, alpha, block):
    values = np.random.default_rng(1).lognormal(0, 1, 700)
    want = pd.Series(values).ewm(alpha=alpha, adjust=False).mean()
    np.testing.assert_allclose(ema_of(spark, values, alpha, block), want, rtol=1e-11)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(1e-3, 1e6), min_size=1, max_size=60))
def test_random_series(spark, values):
    want = pd.Series(values).ewm(span=12, adjust=False).mean()
    np.testing.assert_allclose(ema_of(spark, values, 2 / 13, 8), want, rtol=1e-10)


def test_a_huge_early_value_is_not_forgotten(spark):
    values = np.ones(600)
    values[0] = 1e200
    want = pd.Series(values).ewm(alpha=0.5, adjust=False).mean()
    np.testing.assert_allclose(ema_of(spark, values, 0.5, 64), want, rtol=1e-10)


def test_segments_stay_inside_a_double():
    assert segment_rows([Ema("c", "e", 0.9)]) == 128
    assert segment_rows([Ema.span("c", "e", 26)]) == 2048
