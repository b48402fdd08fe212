"""spark-submit jobs/forecast_all.py BARS_PATH STORE_PATH MODEL_NAME HORIZON CSV_PATH

Forecast every stored series with a stored model and export the rows as CSV.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from seriescast.plans import forecast, report  # noqa: E402
from seriescast.sources import bars, registry  # noqa: E402


def main(bars_path: str, store_path: str, name: str, horizon: str, csv_path: str) -> None:
    spark = SparkSession.builder.appName(f"forecast-{name}").getOrCreate()
    model = registry.load_model(spark, store_path, name)
    rows = forecast.forecast(model, bars.scan_series(spark, bars_path), int(horizon))
    report.export_csv(rows, csv_path)


if __name__ == "__main__":
    main(*sys.argv[1:6])
