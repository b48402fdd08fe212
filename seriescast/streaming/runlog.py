"""Run status: an append-only log folded to the latest state of every run.

The same fold serves a batch table and a stream in update mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Job states and what they are shown as.
STATES = {"PENDING": "queued", "PROGRESS": "running", "SUCCESS": "completed", "FAILURE": "failed"}
FINAL = ["completed", "failed"]
STEPS = {5: "started", 20: "loading data", 50: "training", 90: "trained"}

LOG_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("ticker", T.StringType()),
    T.StructField("model_type", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("progress", T.IntegerType()), T.StructField("current_step", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
])


def shown_state(state: Column) -> Column:
    label = F.when(state.isNull(), None)
    for raw, shown in STATES.items():
        label = label.when(F.upper(state) == raw, shown)
    return label.otherwise(F.lower(state))


def latest_status(log: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Latest row per run; ``order`` breaks ties of ``ts``."""
    keys = keys or ["ticker", "model_type"]
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("ts", *(order or ["progress"])))
    return log.groupBy(*keys).agg(newest.alias("r"), F.min("ts").alias("started"),
                                  F.count(F.lit(1)).alias("n_events")).select(
        *keys, *[F.col(f"r.{c}").alias(c) for c in rest], "started", "n_events").withColumn(
        "status", shown_state(F.col("state")))


def with_timeouts(status: DataFrame, as_of: Column, minutes: int = 10) -> DataFrame:
    """Unfinished runs older than ``minutes`` become ``timeout``."""
    late = (as_of - F.expr(f"INTERVAL {minutes} MINUTES") > F.col("started")) & ~F.col("status").isin(FINAL)
    return status.withColumn("status", F.when(late, "timeout").otherwise(F.col("status")))


def append_status(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Log some events; the log is a folder of small files, written by append only."""
    spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream_status(spark: SparkSession, path: str, checkpoint: str, query_name: str):
    """Fold the log as it grows into an in-memory table, in update mode."""
    log = spark.readStream.schema(LOG_SCHEMA).parquet(path)
    return (
        latest_status(log).writeStream.outputMode("update").format("memory").queryName(query_name)
        .option("checkpointLocation", checkpoint).start()
    )
