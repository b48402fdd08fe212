"""Daily price bars: scanning, date ranges, validation, eligibility."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescast.operators.layout import blocks, index_series, own_rows, unblocked
from seriescast.operators.windows import add, green_day

PRICE_COLUMNS = ["open", "high", "low", "close"]

# The symbols offered for selection.
UNIVERSE = [
    "AAPL", "GOOGL", "MSFT", "AMZN", "TSLA", "META", "NVDA", "NFLX", "ORCL", "CRM", "ADBE", "INTC", "AMD",
    "JPM", "BAC", "WFC", "GS", "MS", "C", "BRK-B", "V", "MA", "AXP",
    "JNJ", "PFE", "UNH", "ABBV", "MRK", "TMO", "ABT", "DHR", "BMY", "LLY",
    "XOM", "CVX", "COP", "EOG", "SLB", "MPC", "VLO", "PSX",
    "WMT", "HD", "PG", "KO", "PEP", "MCD", "NKE", "SBUX", "DIS", "COST",
    "BA", "CAT", "GE", "LMT", "RTX", "HON", "UPS", "FDX", "MMM",
    "T", "VZ", "TMUS", "CMCSA",
    "NU", "VALE", "ITUB", "BBD", "PBR", "GGAL", "YPF", "MELI", "GLOB",
    "SPY", "QQQ", "IWM", "EFA", "EEM", "VTI", "VEA", "VWO", "SPE",
    "GLD", "SLV", "USO", "UNG", "DXY", "UUP",
    "VIX", "UVXY", "SQQQ", "TQQQ",
    "BTC-USD", "ETH-USD", "ADA-USD", "DOT-USD", "SOL-USD", "MATIC-USD",
    "VNQ", "REZ", "IYR",
    "CIB", "BABA", "TSM", "ASML",
]

PERIOD_YEARS = {"1_year": 1, "3_years": 3, "5_years": 5, "10_years": 10}
DEFAULT_START = "2020-12-10"
DATE_FORMAT = "%Y-%m-%d"


def _parse(day: str | dt.date) -> dt.date:
    if isinstance(day, dt.datetime):
        return day.date()
    if isinstance(day, dt.date):
        return day
    try:
        return dt.datetime.strptime(day, DATE_FORMAT).date()
    except ValueError as e:
        raise ValueError(f"dates must look like YYYY-MM-DD, got {day!r}") from e


def default_range(start: str | None, end: str | None, as_of: str | dt.date) -> tuple[dt.date, dt.date]:
    """Missing start: three years of 365 days before ``as_of``; missing end: ``as_of``."""
    today = _parse(as_of)
    return (
        _parse(start) if start else today - dt.timedelta(days=3 * 365),
        _parse(end) if end else today,
    )


def resolve_range(start: str | None = None, end: str | None = None, period: str | None = None,
                  as_of: str | dt.date | None = None, default_start: str = DEFAULT_START,
                  default_end: str | None = None) -> tuple[dt.date, dt.date]:
    """An explicit pair wins, then a preset period of 365-day years, then the defaults."""
    today = _parse(as_of) if as_of else dt.date.today()
    if start and end:
        lo, hi = _parse(start), _parse(end)
    elif period in PERIOD_YEARS:
        lo, hi = today - dt.timedelta(days=365 * PERIOD_YEARS[period]), today
    else:
        lo, hi = _parse(default_start), _parse(default_end) if default_end else today
    if lo > hi:
        raise ValueError(f"start {lo} is after end {hi}")
    return lo, hi


def resolve_calendar_range(start: str | None, end: str | None, period: str | None,
                           as_of: str | dt.date) -> tuple[dt.date, dt.date]:
    """As the selection form does it: a custom pair wins, a preset goes back calendar years."""
    if start and end:
        return resolve_range(start, end)
    hi = _parse(as_of)
    years = PERIOD_YEARS.get(period or "", 1)
    try:
        lo = hi.replace(year=hi.year - years)
    except ValueError:  # 29 February
        lo = dt.date(hi.year - years, 3, 1)
    return lo, hi


def daily_bars(ticks: DataFrame, ticker: str | Column, ts: str, price: str, order: str) -> DataFrame:
    """Ticks to daily bars: first, highest, lowest and last price and the tick count."""
    key = F.col(ticker) if isinstance(ticker, str) else ticker
    return ticks.groupBy(key.alias("ticker"), F.to_date(ts).alias("ds")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def select_bars(bars: DataFrame, tickers: list[str] | None = None, start: str | dt.date | None = None,
                end: str | dt.date | None = None, volume: bool = False) -> DataFrame:
    """Bars of some tickers in ``[start, end)``; both filters reach the scan."""
    if tickers is not None:
        bars = bars.where(F.col("ticker").isin(tickers))
    if start is not None:
        bars = bars.where(F.col("ds") >= F.lit(_parse(start)))
    if end is not None:
        bars = bars.where(F.col("ds") < F.lit(_parse(end)))
    keep = ["ticker", "ds", *PRICE_COLUMNS]
    if volume and "volume" in bars.columns:
        keep.append("volume")
    return bars.select(*keep)


def scan_bars(spark: SparkSession, path: str, tickers: list[str] | None = None,
              start: str | None = None, end: str | None = None, as_of: str | None = None,
              volume: bool = False) -> DataFrame:
    """Read stored bars with ``green_day``; ranges default as in :func:`default_range`."""
    lo, hi = default_range(start, end, as_of or dt.date.today())
    return with_green_day(select_bars(spark.read.parquet(path), tickers, lo, hi, volume))


def write_bars(bars: DataFrame, path: str, by_ticker: bool = False) -> None:
    """Store bars with their positions, so that scans need no indexing.

    Files hold ranges of ``(ticker, ds)``: filters on either skip files and row groups by
    their statistics, and a hot ticker fills several files instead of one task.  With
    ``by_ticker`` there is also one folder per ticker, for universes of a few thousand.
    """
    indexed = index_series(bars)
    if by_ticker:
        writer = indexed.repartition("ticker", F.year("ds")).sortWithinPartitions("ticker", "ds").write
        writer.mode("overwrite").partitionBy("ticker").parquet(path)
    else:
        ranged = indexed.repartitionByRange("ticker", "ds").sortWithinPartitions("ticker", "ds")
        ranged.write.mode("overwrite").parquet(path)


def scan_series(spark: SparkSession, path: str, tickers: list[str] | None = None) -> DataFrame:
    """Whole stored histories with their stored positions."""
    bars = spark.read.parquet(path)
    return bars if tickers is None else bars.where(F.col("ticker").isin(tickers))


def with_green_day(bars: DataFrame) -> DataFrame:
    frame = add(blocks(bars, 1), {"green_day": green_day()})
    return unblocked(own_rows(frame))


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} not found, available: {df.columns}")


def missing_tickers(requested: DataFrame, bars: DataFrame) -> DataFrame:
    """Requested tickers without a single bar."""
    # distinct on both sides, so that a hot ticker is one row before anything is joined
    return requested.select("ticker").distinct().join(bars.select("ticker").distinct(), "ticker", "left_anti")


def minimum_rows(model: str, n_lags: int = 10, sequence_length: int = 30) -> dict[str, int]:
    """Fewest bars a series needs to be trained on and to be forecast."""
    if model == "rf":
        return {"train": max(2 * n_lags, 252), "predict": 2 * n_lags + 1}
    if model == "seq":
        return {"train": sequence_length + 30, "predict": sequence_length + n_lags}
    if model == "xgb":
        return {"train": n_lags + 5, "predict": n_lags + 5}
    return {"train": 2, "predict": 2}


def eligible_series(bars: DataFrame, train_rows: int, predict_rows: int) -> DataFrame:
    """Row count per series and whether it suffices for training and for forecasting."""
    return (
        bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("can_train", F.col("n_rows") >= train_rows)
        .withColumn("can_predict", F.col("n_rows") >= predict_rows)
        .withColumn(
            "reason",
            F.when(~F.col("can_train"), F.concat(
                F.lit("has "), F.col("n_rows").cast("string"),
                F.lit(f" rows, needs {train_rows}"))),
        )
    )


def invalid_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL/NaN and infinity counts per column, in one pass."""
    def count_if(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    sums = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        sums += [count_if(x.isNull() | F.isnan(x)).alias(f"n{i}"),
                 count_if(F.abs(x) == float("inf")).alias(f"i{i}")]
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_null"),
                 F.col(f"i{i}").alias("n_inf"))
        for i, c in enumerate(columns)
    ])
    return df.agg(*sums).select(F.inline(rows))


def invalid_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows holding a NULL, NaN or infinity."""
    bad = F.lit(False)
    for c in columns:
        x = F.col(c).cast("double")
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.where(bad)


def span_check(bars: DataFrame, min_days: int = 760) -> DataFrame:
    """Warn about series whose date span is empty or shorter than ``min_days``."""
    days = F.date_diff(F.col("end_ds"), F.col("start_ds"))
    return (
        bars.groupBy("ticker").agg(F.min("ds").alias("start_ds"), F.max("ds").alias("end_ds"))
        .withColumn("days", days)
        .withColumn("warning", F.when(days <= 0, "empty").when(days < min_days, "short").otherwise("ok"))
    )
