import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def make_bars(lengths: dict[str, int], seed: int = 7, start: str = "2020-01-01") -> pd.DataFrame:
    """Random-walk bars on business days, one series per entry."""
    rng = np.random.default_rng(seed)
    frames = []
    for ticker, n in lengths.items():
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        opening = close * (1 + rng.normal(0, 0.005, n))
        frames.append(pd.DataFrame({
            "ticker": ticker, "ds": pd.bdate_range(start, periods=n).date, "open": opening,
            "high": np.maximum(close, opening) * 1.01, "low": np.minimum(close, opening) * 0.99,
            "close": close, "volume": rng.integers(1, 1000, n).astype(float)}))
    return pd.concat(frames, ignore_index=True).sample(frac=1, random_state=seed)


BARS_DDL = "ticker string, ds date, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="session")
def bars(spark):
    """Series below, at and above every minimum length."""
    pdf = make_bars({"A1": 1, "B5": 5, "C13": 13, "D19": 19, "E49": 49, "F70": 70, "G300": 300})
    return spark.createDataFrame(pdf, BARS_DDL).cache(), pdf.sort_values(["ticker", "ds"])
