"""Parameter search over expanding-window folds.

Fits run concurrently from driver threads and share one stored, scaled frame per fold;
importances for feature selection are computed once per fold, not once per candidate.
Only scores (one number per fold and candidate) come back to the driver.
"""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriescast.operators import split
from seriescast.plans import models as M
from seriescast.plans.training import (
    TrainConfig,
    fit_scaler,
    helper_for,
    model_input,
    spread_out,
    training_frame,
)
from seriescast.sources.storage import materialize

# The default search spaces.  MLlib has no minimum split size, so that
# dimension of the forest space is kept in the grid and has no effect on a fit.
FOREST_SPACE = {
    "select_max_features": [10, 15, 20],
    "n_estimators": [100, 200],
    "max_depth": [10, 15, 20, None],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [3, 5, 7],
    "max_features": ["sqrt", "log2", "0.5", "0.7"],
}
BOOST_SPACE = {
    "select_threshold": ["median", "1.25*mean", None],
    "n_estimators": [100, 200],
    "max_depth": [3, 5, 7],
    "learning_rate": [0.01, 0.05, 0.1],
    "subsample": [0.7, 0.8],
    "max_features": ["0.7", "0.8"],
}

WIDE_BOOST_SPACE = {
    "n_estimators": [50, 100, 200],
    "max_depth": [3, 5, 7],
    "learning_rate": [0.01, 0.1, 0.3],
    "subsample": [0.6, 0.8, 1.0],
    "max_features": ["0.6", "0.8", "1.0"],
    "gamma": [0.0, 0.1, 1.0],
}

Candidate = dict[str, Any]


def grid(space: dict[str, list]) -> list[Candidate]:
    return [dict(zip(space, values)) for values in product(*space.values())]


def grid_size(space: dict[str, list]) -> int:
    size = 1
    for values in space.values():
        size *= len(values)
    return size


def sample(space: dict[str, list], n: int, seed: int = M.SEED) -> list[Candidate]:
    """``n`` distinct combinations (all of them where there are no more)."""
    everything = grid(space)
    return everything if n >= len(everything) else random.Random(seed).sample(everything, n)


def grid_frame(spark: SparkSession, space: dict[str, list]) -> DataFrame:
    """The grid as rows of text, one column per parameter."""
    rows = [tuple(None if v is None else str(v) for v in c.values()) for c in grid(space)]
    return spark.createDataFrame(rows, ", ".join(f"{name} string" for name in space))


def search_plan(series: DataFrame, space: dict[str, list]) -> DataFrame:
    """Every combination for every series, generated per row rather than by a join."""
    out = series
    for name, values in space.items():
        options = F.array(*[F.lit(None if v is None else str(v)).cast("string") for v in values])
        out = out.withColumn(name, F.explode(options))
    return out


def sample_per_series(series: DataFrame, space: dict[str, list], n: int, seed: int = M.SEED) -> DataFrame:
    """``n`` distinct combinations for every series: those with the smallest seeded hashes."""
    plan = search_plan(series, space)
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), "ticker", *[F.coalesce(c, F.lit("None")) for c in space]).cast("binary"))
    # a series has as many rows as the grid has combinations
    order = Window.partitionBy("ticker").orderBy(draw, *space)
    return plan.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= n)


def params_of(kind: str, candidate: Candidate, seed: int = M.SEED):
    known = {k: v for k, v in candidate.items() if k in M.PARAMS[kind].__dataclass_fields__}
    return M.PARAMS[kind](**known, seed=seed)


def search(bars: DataFrame, cfg: TrainConfig, candidates: list[Candidate], folds: int = 3,
           parallel: int = 4) -> tuple[DataFrame, Candidate]:
    """Leaderboard (mean fold MSE, best first) and the best candidate."""
    spark = bars.sparkSession
    frame, names = training_frame(bars, cfg)
    scaler = fit_scaler(frame, names, cfg)
    train_rows = model_input(frame, names, scaler).where("split = 'train'").withColumn(
        "n_rows", split.share(F.col("n_rows"), cfg.ratio))
    folded = materialize(
        split.ts_folds(train_rows, folds).select("fold", "role", "ticker", "pos", *names, "label"), "folds", ("fold", "role"))

    def part(fold: int, role: str) -> DataFrame:
        rows = folded.where((F.col("fold") == fold) & (F.col("role") == role)).drop("fold", "role")
        return spread_out(rows) if role == "train" else rows

    ranked = {}
    for f in range(folds):
        ranked[f] = M.rank_importances(
            part(f, "train"), names, helper_for(params_of(cfg.recipe.name, {}), cfg.helper_trees))

    def score(task: tuple[int, Candidate, int]) -> tuple[int, int, float]:
        i, candidate, f = task
        chosen = M.choose(ranked[f], candidate.get("select_threshold", cfg.select),
                          candidate.get("select_max_features", cfg.max_features))
        model = M.fit_selected(part(f, "train"), names, chosen,
                               params_of(cfg.recipe.name, candidate).estimator())
        error = F.col("label") - F.col("prediction")
        mse = model.transform(part(f, "test")).agg(F.avg(error * error)).first()[0]
        return i, f, float(mse)

    tasks = [(i, c, f) for i, c in enumerate(candidates) for f in range(folds)]
    with ThreadPoolExecutor(parallel) as pool:
        scores = list(pool.map(score, tasks))
    board = leaderboard(spark.createDataFrame(scores, "candidate int, fold int, mse double"))
    described = F.array(*[F.lit(repr(c)) for c in candidates])
    board = board.withColumn("params", F.get(described, F.col("candidate")))
    best = board.orderBy("rank").first()["candidate"]
    return board, candidates[best]


def leaderboard(scores: DataFrame, key: str = "candidate") -> DataFrame:
    """Mean error per candidate and its rank; ties go to the first candidate."""
    board = scores.groupBy(key).agg(F.avg("mse").alias("mean_mse"), F.count(F.lit(1)).alias("n_folds"))
    # one row per candidate, a few hundred at most
    return board.withColumn("rank", F.row_number().over(Window.orderBy("mean_mse", key)))


def best_config(cfg: TrainConfig, candidate: Candidate) -> TrainConfig:
    """The configuration that refits the best candidate on all train rows."""
    return replace(
        cfg, params=params_of(cfg.recipe.name, candidate),
        select=candidate.get("select_threshold", cfg.select),
        max_features=candidate.get("select_max_features", cfg.max_features))
