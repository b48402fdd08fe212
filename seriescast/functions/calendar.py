"""Calendar features and future dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


PART_NAMES = ["day_of_week", "month", "quarter", "day_of_month"]
CYCLE_NAMES = ["day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos"]
ONE_HOT_NAMES = [f"month_{m}" for m in range(1, 13)] + [f"dow_{d}" for d in range(7)]


def calendar_parts(ds: str = "ds") -> dict[str, str]:
    """Expression text per calendar part; Monday is 0."""
    return dict(zip(PART_NAMES, (f"weekday({ds})", f"month({ds})", f"quarter({ds})", f"dayofmonth({ds})")))


def calendar_cycles(ds: str = "ds") -> dict[str, str]:
    dow, month = f"2 * pi() * weekday({ds}) / 7", f"2 * pi() * month({ds}) / 12"
    return dict(zip(CYCLE_NAMES, (f"sin({dow})", f"cos({dow})", f"sin({month})", f"cos({month})")))


def one_hot_calendar(ds: str = "ds") -> dict[str, str]:
    months = {f"month_{m}": f"CAST(month({ds}) = {m} AS INT)" for m in range(1, 13)}
    return months | {f"dow_{d}": f"CAST(weekday({ds}) = {d} AS INT)" for d in range(7)}


def business_days(last: Column, horizon: int) -> Column:
    """The ``horizon`` weekdays after ``last``; no holiday calendar."""
    days = F.sequence(F.date_add(last, 1), F.date_add(last, 2 * horizon + 7))
    return F.slice(F.filter(days, lambda d: F.weekday(d) < 5), 1, horizon)


def calendar_days(last: Column, horizon: int) -> Column:
    return F.sequence(F.date_add(last, 1), F.date_add(last, horizon))


def future_dates(last: DataFrame, horizon: int, calendar: str = "business") -> DataFrame:
    """``(ticker, last_ds)`` to ``(ticker, step, ds)`` for steps 1..horizon."""
    make = {"business": business_days, "day": calendar_days}[calendar]
    return last.select("ticker", F.posexplode(make(F.col("last_ds"), horizon)).alias("step", "ds")).select(
        "ticker", (F.col("step") + 1).alias("step"), "ds")
