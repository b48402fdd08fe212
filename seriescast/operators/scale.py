"""Per-series scalers: fit to a parameter frame, apply and invert as expressions.

``fit`` gives one row per series with a center and a spread per column;
scaled = (x - center) / spread, and a constant column scales to 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriescast.operators.layout import with_series_values
from seriescast.operators.quantiles import exact_quantiles

KINDS = ("minmax", "robust", "standard")


def _c(c: str) -> str:
    return f"_center_{c}"


def _s(c: str) -> str:
    return f"_spread_{c}"


def fit(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """Scaler parameters per ticker from the rows given (pass the train rows only).

    The rows come from an indexed frame; ``n_rows`` is the length of the whole series.
    """
    length = F.max("n_rows").alias("n_rows")
    if kind == "minmax":
        return df.groupBy("ticker").agg(length, *[
            F.expr(t) for c in columns
            for t in (f"CAST(min({c}) AS DOUBLE) AS {_c(c)}", f"CAST(max({c}) - min({c}) AS DOUBLE) AS {_s(c)}")
        ])
    if kind == "standard":
        return df.groupBy("ticker").agg(length, *[
            F.expr(t) for c in columns for t in (f"avg({c}) AS {_c(c)}", f"stddev_pop({c}) AS {_s(c)}")
        ])
    if kind == "robust":
        names = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
                          for c in columns])
        q = exact_quantiles(df.select("ticker", F.inline(names)), ["ticker", "name"], "value",
                            [0.25, 0.5, 0.75], cut_by="name")
        lengths = df.groupBy("ticker").agg(length)
        return lengths.join(q.groupBy("ticker").agg(*[
            a for c in columns
            for a in (
                F.max(F.when(F.col("name") == c, F.col("q")[1])).alias(_c(c)),
                F.max(F.when(F.col("name") == c, F.col("q")[2] - F.col("q")[0])).alias(_s(c)),
            )
        ]), "ticker")
    raise ValueError(f"unknown scaler {kind!r}, available: {KINDS}")


def _divisor(c: str) -> str:
    # like the usual scalers, a column without spread is only centred
    return f"if({_s(c)} = 0, 1D, {_s(c)})"


def scaled(c: str) -> Column:
    return F.expr(f"({c} - {_c(c)}) / {_divisor(c)}")


def unscaled(x: str, c: str) -> Column:
    return F.expr(f"{x} * {_divisor(c)} + {_c(c)}")


def _parameters(params: DataFrame, columns: list[str], same: bool) -> tuple[DataFrame, list[str]]:
    """Parameter columns in use; the lengths only hold for the series they were fitted on."""
    used = [f(c) for c in columns for f in (_c, _s)]
    return params.select("ticker", *(["n_rows"] if same else []), *used), used


def apply(df: DataFrame, params: DataFrame, columns: list[str], suffix: str = "",
          same: bool = False) -> DataFrame:
    """Scale ``columns`` in place, or into new columns when a suffix is given.

    ``same`` says that ``df`` has the very series the parameters were fitted on, which
    saves counting them.
    """
    used, extra = _parameters(params, columns, same)
    return with_series_values(df, used).withColumns(
        {f"{c}{suffix}": scaled(c) for c in columns}).drop(*extra)


def apply_with_label(df: DataFrame, params: DataFrame, columns: list[str], label: str,
                     same: bool = False) -> DataFrame:
    """Scale ``columns`` and keep how to undo the label's scaling: ``_center``, ``_spread``."""
    used, extra = _parameters(params, [*columns, label], same)
    return with_series_values(df, used).withColumns(
        {c: scaled(c) for c in columns} | {"_center": F.col(_c(label)), "_spread": F.expr(_divisor(label))}).drop(*extra)


def invert(df: DataFrame, params: DataFrame, columns: dict[str, str], same: bool = False) -> DataFrame:
    """Map scaled columns back; ``columns`` gives for each the column it was fitted on."""
    fitted = sorted(set(columns.values()))
    used, extra = _parameters(params, fitted, same)
    return with_series_values(df, used).withColumns(
        {name: unscaled(name, c) for name, c in columns.items()}).drop(*extra)
