import numpy as np
import pytest
from conftest import BARS_DDL, make_bars
from pyspark.sql import functions as F

from seriescast.operators.cumulate import price_path, running_sum
from seriescast.operators.fill import gap_fill
from seriescast.operators.layout import blocks, index_series, own_rows, with_series_values
from seriescast.operators.windows import add, mean
from seriescast.plans import recipes as R
from seriescast.sources.bars import scan_series, select_bars, write_bars


def in_order(df):
    return df.toPandas().sort_values(["ticker", "ds"]).reset_index(drop=True)


def test_positions_follow_dates(bars):
    df, pdf = bars
    got = in_order(index_series(df))
    for _, g in got.groupby("ticker"):
        assert list(g["pos"]) == list(range(len(g)))
        assert set(g["n_rows"]) == {len(g)}


def test_positions_of_timestamps(spark):
    pdf = make_bars({"A": 60})
    df = spark.createDataFrame(pdf, BARS_DDL).withColumn(
        "ds", F.timestamp_seconds(F.unix_date("ds") * 600 + 1_600_000_000))
    got = index_series(df).orderBy("ds").toPandas()
    assert list(got["pos"]) == list(range(60))


@pytest.mark.parametrize("size", [64, 128, 2048])
def test_blocks_do_not_change_windows(bars, size):
    df, pdf = bars
    got = in_order(own_rows(add(blocks(df, 50, size), {"m": mean("close", 50)})))
    want = pdf.groupby("ticker")["close"].rolling(50, min_periods=1).mean().to_numpy()
    assert len(got) == len(pdf)
    np.testing.assert_allclose(got["m"], want, rtol=1e-12)


@pytest.mark.parametrize("name", ["rf", "xgb", "lstm"])
def test_block_size_does_not_change_recipes(bars, name):
    df, _ = bars
    build = R.recipe(name).build
    small, large = in_order(build(df, block=64)), in_order(build(df))
    assert list(small.columns) == list(large.columns) and len(small) == len(large)
    numeric = [c for c in small.columns if c not in ("ticker", "ds")]
    np.testing.assert_allclose(small[numeric].astype(float), large[numeric].astype(float), rtol=1e-8, atol=1e-9)


def test_gap_fill(spark, bars):
    df, pdf = bars
    holes = df.withColumn("close", F.when(F.dayofmonth("ds") % 4 == 0, F.col("close")))
    want = pdf.assign(close=pdf["close"].where(pdf["ds"].map(lambda d: d.day % 4 == 0)))
    want = want.groupby("ticker")["close"].transform(lambda s: s.ffill().bfill().fillna(0)).to_numpy()
    got = in_order(gap_fill(holes, ["close"], size=16))
    np.testing.assert_array_equal(got["close"], want)


def test_running_sum_and_price_path(bars):
    df, pdf = bars
    got = in_order(running_sum(df, "volume", "total", size=16))
    np.testing.assert_allclose(got["total"], pdf.groupby("ticker")["volume"].cumsum())
    flat = in_order(price_path(df.withColumn("r", F.lit(0.0)), "r", "close", size=16))
    np.testing.assert_allclose(flat["price"], pdf.groupby("ticker")["close"].transform("first"))


def test_series_values_reach_every_row(bars):
    df, pdf = bars
    tops = df.groupBy("ticker").agg(F.max("close").alias("top"))
    got = in_order(with_series_values(df, tops, size=16))
    np.testing.assert_array_equal(got["top"], pdf.groupby("ticker")["close"].transform("max"))


def test_stored_bars_keep_positions_and_prune(spark, bars, tmp_path):
    df, pdf = bars
    path = str(tmp_path / "bars")
    ranged = str(tmp_path / "ranged")
    write_bars(df, path, by_ticker=True)
    write_bars(df, ranged)
    for p in (path, ranged):
        series = scan_series(spark, p, ["G300"])
        assert index_series(series) is series
        assert series.count() == 300
    assert "EqualTo(ticker,G300)" in series._jdf.queryExecution().toString()
    plan = select_bars(spark.read.parquet(path), ["G300"], "2020-06-01", "2020-07-01")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(ticker" in plan and "PushedFilters: [IsNotNull(ds), GreaterThanOrEqual(ds" in plan
    assert "volume" not in plan.split("ReadSchema")[1]
