"""Additive regression per series: trend with change points, seasonality, regressors.

All series are fitted in one pass.  A row's design vector is an array expression; each
block of rows is reduced to its Gram matrix, the matrices of a series are added up, and
only the sum (a few thousand numbers per series) is solved.  Normal priors on the change
points, seasonal terms and regressors are ridge penalties.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriescast.functions.calendar import future_dates
from seriescast.operators import align, metrics
from seriescast.operators.layout import BLOCK, block_of, index_series, with_series_values
from seriescast.operators.split import rolling_origin, split_two
from seriescast.sources.storage import materialize

# Default prior scales, change points and Fourier orders, and the search space.
CHANGEPOINTS = 25
YEARLY_ORDER, WEEKLY_ORDER = 10, 3
GRID = {
    "changepoint_prior_scale": [0.001, 0.01, 0.05, 0.1, 0.5],
    "seasonality_prior_scale": [0.01, 0.1, 1.0, 10.0],
    "holidays_prior_scale": [0.01, 0.1, 1.0, 10.0],
    "seasonality_mode": ["additive", "multiplicative"],
}


@dataclass(frozen=True)
class AdditiveParams:
    changepoint_prior_scale: float = 0.05
    seasonality_prior_scale: float = 10.0
    holidays_prior_scale: float = 10.0
    seasonality_mode: str = "additive"
    changepoint_range: float = 0.8
    changepoints: int = CHANGEPOINTS
    yearly: bool = True
    weekly: bool = True

    def penalties(self, n_regressors: int) -> list[float]:
        """Inverse prior variances in the order of the design vector."""
        season = 2 * (YEARLY_ORDER * self.yearly + WEEKLY_ORDER * self.weekly)
        return ([1e-8, 1 / 25] + [1 / self.changepoint_prior_scale**2] * self.changepoints
                + [1 / self.seasonality_prior_scale**2] * season + [1 / 100] * n_regressors)


@dataclass
class AdditiveModel:
    params: AdditiveParams
    regressors: list[str]
    coefficients: DataFrame
    keys: list[str] = field(default_factory=lambda: ["ticker"])

    def predict(self, frame: DataFrame) -> DataFrame:
        """Add ``yhat``, ``yhat_lower``, ``yhat_upper``; absent regressors count as 0."""
        frame = align.zero_filled(frame, self.regressors)
        if {"pos", "n_rows"} <= set(frame.columns):
            joined = with_series_values(frame, self.coefficients, keys=tuple(self.keys))
        else:  # future dates: a horizon's worth of rows per series
            joined = frame.join(self.coefficients, self.keys)
        x = design(self.params, self.regressors)
        dot = F.aggregate(F.zip_with(x, "_beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        out = joined.withColumn("_fit", dot)
        back = (lambda v: F.exp(v)) if self.params.seasonality_mode == "multiplicative" else (lambda v: v)
        half = 1.959963984540054 * F.col("_sigma")
        return out.withColumns({
            "yhat": back(F.col("_fit") * F.col("_scale")),
            "yhat_lower": back((F.col("_fit") - half) * F.col("_scale")),
            "yhat_upper": back((F.col("_fit") + half) * F.col("_scale")),
        }).drop("_fit", "_beta", "_sigma", *STATS, *[f"_m_{r}" for r in self.regressors],
                *[f"_s_{r}" for r in self.regressors])


    def save(self, path: str) -> None:
        self.coefficients.write.mode("overwrite").parquet(f"{path}/coefficients")
        about = json.dumps({"params": asdict(self.params), "regressors": self.regressors, "keys": self.keys})
        self.coefficients.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.mode(
            "overwrite").text(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> AdditiveModel:
        about = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
        return AdditiveModel(AdditiveParams(**about["params"]), about["regressors"],
                             spark.read.parquet(f"{path}/coefficients"), about["keys"])


STATS = ["_t0", "_span", "_scale"]


def target(params: AdditiveParams) -> Column:
    """Multiplicative terms add up on the logarithm."""
    return F.ln("y") if params.seasonality_mode == "multiplicative" else F.col("y")


def series_stats(train: DataFrame, params: AdditiveParams, regressors: list[str], keys: list[str]) -> DataFrame:
    """Start, span and scale of each series and the moments of its regressors."""
    moments = [a for r in regressors for a in (
        F.avg(r).alias(f"_m_{r}"), F.stddev_pop(r).alias(f"_s_{r}"))]
    length = [F.max("n_rows").alias("n_rows")] if "n_rows" in train.columns else []
    return train.groupBy(*keys).agg(
        *length, F.min("ds").alias("_t0"),
        F.greatest(F.date_diff(F.max("ds"), F.min("ds")), F.lit(1)).cast("double").alias("_span"),
        F.greatest(F.max(F.abs(target(params))), F.lit(1e-300)).alias("_scale"), *moments)


def design(params: AdditiveParams, regressors: list[str]) -> Column:
    """Intercept, slope, hinges, Fourier terms and standardised regressors of a row."""
    day = "date_diff(ds, DATE '1970-01-01')"
    t = "(date_diff(ds, _t0) / _span)"
    terms = ["1D", t]
    for i in range(1, params.changepoints + 1):
        at = params.changepoint_range * i / (params.changepoints + 1)
        terms.append(f"greatest({t} - {at}D, 0D)")
    for on, order, period in ((params.yearly, YEARLY_ORDER, 365.25), (params.weekly, WEEKLY_ORDER, 7.0)):
        if on:
            for k in range(1, order + 1):
                terms += [f"{f}(2 * pi() * {k} * {day} / {period}D)" for f in ("sin", "cos")]
    terms += [f"coalesce(({r} - _m_{r}) / if(_s_{r} = 0, 1D, _s_{r}), 0D)" for r in regressors]
    return F.expr(f"array({', '.join(f'CAST({x} AS DOUBLE)' for x in terms)})")


def gram(train: DataFrame, params: AdditiveParams, regressors: list[str], keys: list[str]) -> DataFrame:
    """``_gram`` per key: X'X, X'y and y'y as one flat array."""
    stats = series_stats(train, params, regressors, keys)
    # joined part by part, so that the parts of one series stay apart
    last_part = F.expr(f"(n_rows - 1) div {BLOCK}")
    spread = stats.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), last_part))).drop("n_rows")
    rows = train.join(spread, [*keys, "_part"]).select(
        *keys, "_part", design(params, regressors).alias("_x"), (target(params) / F.col("_scale")).alias("_y"))
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("_g", T.ArrayType(T.DoubleType()))])

    def reduce_block(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = np.column_stack([np.stack(pdf["_x"].to_numpy()), pdf["_y"].to_numpy(dtype=float)])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "_g": [(xy.T @ xy).ravel()]})

    # a part has at most BLOCK rows; adding up cells needs no order and combines before the shuffle
    cells = rows.groupBy(*keys, "_part").applyInPandas(reduce_block, schema).select(
        *keys, F.posexplode("_g").alias("_i", "_v")).groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"))
    packed = cells.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda c: c["_v"]).alias("_gram"))
    counts = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return packed.join(counts, keys).join(stats.drop("n_rows"), keys)


def solve(grams: DataFrame, penalties: list[list[float]]) -> DataFrame:
    """One row per key and penalty vector (``_set``): coefficients and residual deviation."""
    schema = T.StructType([f for f in grams.schema if f.name not in ("_gram", "_rows")] + [
        T.StructField("_set", T.IntegerType()), T.StructField("_beta", T.ArrayType(T.DoubleType())),
        T.StructField("_sigma", T.DoubleType())])
    names = [f.name for f in schema]

    def solve_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                flat = np.asarray(row["_gram"], dtype=float)
                p = int(round(len(flat) ** 0.5))
                g = flat.reshape(p, p)
                xx, xy, yy = g[:-1, :-1], g[:-1, -1], g[-1, -1]
                for i, penalty in enumerate(penalties):
                    sigma2 = 0.05**2  # prior scale of the noise on the scaled series
                    for _ in range(3):
                        beta = np.linalg.solve(xx + np.diag(penalty) * sigma2, xy)
                        sse = max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0)
                        sigma2 = max(sse / max(row["_rows"], 1), 1e-12)
                    out.append(row | {"_set": i, "_beta": beta.tolist(), "_sigma": sigma2**0.5})
            yield pd.DataFrame(out, columns=names)

    return grams.mapInPandas(solve_batches, schema)


def parts(frame: DataFrame) -> DataFrame:
    """Block number of each row, the unit that is reduced in one task."""
    return index_series(frame).withColumn("_part", block_of(BLOCK))


def fit(train: DataFrame, params: AdditiveParams, regressors: list[str]) -> AdditiveModel:
    """``train`` has ``ticker, ds, y`` and the regressors; all its series are fitted."""
    grams = gram(parts(train), params, regressors, ["ticker"])
    solved = solve(grams, [params.penalties(len(regressors))]).drop("_set")
    return AdditiveModel(params, regressors, materialize(solved, "additive"))


def forecast(model: AdditiveModel, frame: DataFrame, horizon: int,
             calendar: str = "day") -> DataFrame:
    """Future dates with frozen regressors."""
    names = model.regressors
    values = frame.select("ticker", "ds", *names)
    future = align.future_regressors(values, names, horizon, calendar) if names else future_dates(
        frame.groupBy("ticker").agg(F.max("ds").alias("last_ds")), horizon, calendar)
    return model.predict(future).select(
        "ticker", "step", "ds", F.col("yhat").alias("prediction"), F.col("yhat_lower").alias("lower_bound"),
        F.col("yhat_upper").alias("upper_bound"), F.lit("additive").alias("model_used"))


def grid(space: dict[str, list] | None = None) -> list[AdditiveParams]:
    space = space or GRID
    return [AdditiveParams(**dict(zip(space, values))) for values in product(*space.values())]


def search(frame: DataFrame, candidates: list[AdditiveParams], regressors: list[str]) -> DataFrame:
    """Rolling-origin RMSE of each candidate; best first.

    The Gram matrices of a cut-off serve every candidate of the same seasonality mode.
    """
    folds = materialize(parts(rolling_origin(frame)), "origins")
    keys = ["ticker", "cutoff"]
    scores = None
    for mode in sorted({c.seasonality_mode for c in candidates}):
        mine = [(i, c) for i, c in enumerate(candidates) if c.seasonality_mode == mode]
        grams = gram(folds.where("role = 'train'"), mine[0][1], regressors, keys)
        solved = materialize(solve(grams, [c.penalties(len(regressors)) for _, c in mine]), "solved")
        model = AdditiveModel(mine[0][1], regressors, solved, keys)
        numbers = F.array(*[F.lit(i) for i, _ in mine])
        scored = model.predict(folds.where("role = 'test'")).withColumn("candidate", F.get(numbers, F.col("_set")))
        by_cutoff = scored.groupBy("candidate", *keys).agg(
            F.sqrt(F.avg((F.col("y") - F.col("yhat")) ** 2)).alias("rmse"))
        scores = by_cutoff if scores is None else scores.unionByName(by_cutoff)
    board = scores.groupBy("candidate").agg(F.avg("rmse").alias("rmse"), F.count(F.lit(1)).alias("n_scores"))
    described = F.array(*[F.lit(repr(c)) for c in candidates])
    # one row per candidate
    rank = F.row_number().over(Window.orderBy("rmse", "candidate"))
    return board.withColumn("params", F.get(described, F.col("candidate"))).withColumn("rank", rank)


def train(frame: DataFrame, regressors: list[str], params: AdditiveParams | None = None, ratio: float = 0.8,
          draws: int = 0, seed: int = 42) -> tuple[AdditiveModel, DataFrame]:
    """Ordered split, optional search over ``draws`` of the grid, fit, hold-out metrics with R2."""
    stored = materialize(split_two(frame, ratio), "additive")
    head = stored.where("split = 'train'").withColumn("n_rows", F.floor(F.col("n_rows") * F.lit(ratio)))
    if draws:
        space = grid()
        candidates = random.Random(seed).sample(space, min(draws, len(space)))
        params = candidates[search(head, candidates, regressors).orderBy("rank").first()["candidate"]]
    model = fit(head, params or AdditiveParams(), regressors)
    return model, metrics.r_squared(model.predict(stored.where("split = 'test'")), ["ticker"])
