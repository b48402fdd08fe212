"""spark-submit jobs/train_all.py BARS_PATH STORE_PATH [rf|xgb|seq]

Train one panel model on every stored series, store it, and write the next ten bars.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from seriescast.plans import forecast, training  # noqa: E402
from seriescast.sources import bars, registry  # noqa: E402


def main(bars_path: str, store_path: str, kind: str = "rf", horizon: int = 10) -> None:
    spark = SparkSession.builder.appName(f"train-{kind}").getOrCreate()
    series = bars.scan_series(spark, bars_path)
    result = training.train(series, training.TrainConfig(kind))
    registry.save_model(result.model, store_path, f"{kind}_model_generic")
    result.metrics.write.mode("overwrite").parquet(f"{store_path}/metrics/{kind}")
    rows = forecast.forecast(result.model, series, horizon)
    rows.write.mode("overwrite").parquet(f"{store_path}/forecasts/{kind}")


if __name__ == "__main__":
    main(*sys.argv[1:4])
