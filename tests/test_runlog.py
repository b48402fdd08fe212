import datetime as dt

from pyspark.sql import functions as F

from seriescast.streaming import runlog

T0 = dt.datetime(2024, 1, 1, 12, 0)


def event(job, ticker, state, progress, minutes):
    return (job, ticker, "rf", state, progress, runlog.STEPS.get(progress, ""), T0 + dt.timedelta(minutes=minutes))


EVENTS = [
    event("1", "AAPL", "PENDING", 0, 0), event("1", "AAPL", "PROGRESS", 5, 1), event("1", "AAPL", "SUCCESS", 100, 3),
    event("2", "TSLA", "PROGRESS", 20, 0), event("3", "MSFT", "PROGRESS", 50, 8),
]


def test_fold_and_timeouts(spark):
    status = runlog.latest_status(spark.createDataFrame(EVENTS, runlog.LOG_SCHEMA))
    as_of = F.lit("2024-01-01 12:12:00").cast("timestamp_ntz")
    got = {r["ticker"]: r["status"] for r in runlog.with_timeouts(status, as_of).collect()}
    assert got == {"AAPL": "completed", "TSLA": "timeout", "MSFT": "running"}


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    runlog.append_status(spark, path, EVENTS[:2])
    stream = runlog.stream_status(spark, path, str(tmp_path / "ck"), "statuses")
    try:
        stream.processAllAvailable()
        runlog.append_status(spark, path, EVENTS[2:])
        stream.processAllAvailable()
        rows = spark.table("statuses").collect()
    finally:
        stream.stop()
    newest = {}
    for r in rows:  # update mode emits a row per change
        if r["ticker"] not in newest or r["ts"] > newest[r["ticker"]]["ts"]:
            newest[r["ticker"]] = r
    assert {k: (v["status"], v["n_events"]) for k, v in newest.items()} == {
        "AAPL": ("completed", 3), "TSLA": ("running", 1), "MSFT": ("running", 1)}
