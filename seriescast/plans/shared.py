"""Search by shared fits: one model per fold and tree-changing setting scores every candidate of its group.

Forest candidates that differ only in tree count and depth share one forest grown to the greatest count and
depth of their group: a candidate of n trees and depth d is the mean of the first n trees, each cut at depth d,
where an inner node predicts the mean of its rows (MLlib stores that prediction with every node).  Boosted
candidates that differ only in rounds share one model: a candidate of n rounds is the staged sum of its first n
weighted trees, which is exactly what MLlib fits for n rounds (round m draws its rows and features from seed + m
alone).  Settings MLlib ignores (``min_samples_split``) make twins, scored once; selection settings that choose the
same features share their fits too.

The trees of a fitted model are read back from its saved form (Spark's parquet of nodes) into flat arrays, at most
trees x (2 rows / min_samples_leaf) nodes, and every candidate of a group is scored in one pass over the fold's
test rows: a task walks all rows of an Arrow batch through one tree at a time, level by level in numpy, keeping
for each depth the value reached there, and adds them into running sums from which each candidate's prediction
is read when its tree count is reached.  Only (candidate, squared error, rows) per task comes back.

Depth truncation of a deep tree equals a shallow fit when a node's split does not depend on the depth limit: so
for single trees with all features (tested), not for bootstrapped forests, whose first n trees are a different
draw of n trees than a forest fitted with n: the same model class, a different random seed stream.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescast.operators import split
from seriescast.plans import models as M
from seriescast.plans.search import Candidate, leaderboard, params_of
from seriescast.plans.training import TrainConfig, fit_scaler, helper_for, model_input, spread_out, training_frame
from seriescast.sources.storage import fresh_path, materialize

#: Settings that only cut a grown model: prefixes of trees and, for forests, depths.
CUTS = {"rf": ("n_estimators", "max_depth"), "seq": ("n_estimators", "max_depth"), "xgb": ("n_estimators",)}


@dataclass(frozen=True)
class Trees:
    """The nodes of an ensemble as flat arrays; ``left`` is -1 at a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    depth: int


def read_trees(ensemble) -> Trees:
    """Flat arrays of a fitted MLlib forest or boosted model, read from its saved nodes."""
    spark = SparkSession.active()
    path = fresh_path(spark, "trees")
    ensemble.write().save(path)
    nodes = (spark.read.parquet(f"{path}/data")
             .select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
                     F.coalesce("nodeData.split.featureIndex", F.lit(-1)).alias("feature"),
                     F.coalesce(F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), 0), F.lit(0.0)).alias("threshold"))
             .toPandas().sort_values(["treeID", "id"], ignore_index=True))
    sizes = nodes.groupby("treeID").size().sort_index().to_numpy()
    roots = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    offset = roots[nodes["treeID"].to_numpy()]
    left, right = nodes["leftChild"].to_numpy(np.int64), nodes["rightChild"].to_numpy(np.int64)
    trees = Trees(
        feature=np.maximum(nodes["feature"].to_numpy(np.int64), 0), threshold=nodes["threshold"].to_numpy(float),
        left=np.where(left >= 0, left + offset, -1), right=np.where(right >= 0, right + offset, -1),
        value=nodes["prediction"].to_numpy(float), roots=roots, weights=np.asarray(ensemble.treeWeights, float),
        depth=0)
    return replace(trees, depth=int(_depths(trees).max()))


def _depths(trees: Trees) -> np.ndarray:
    depth = np.zeros(len(trees.value), np.int64)
    # pre-order: a parent comes before its children
    for i in range(len(trees.value)):
        if trees.left[i] >= 0:
            depth[trees.left[i]] = depth[trees.right[i]] = depth[i] + 1
    return depth


def walk(trees: Trees, tree: int, x: np.ndarray, depth: int) -> np.ndarray:
    """``out[k, row]``: the tree's prediction for each row when cut at depth k, for k = 0..depth."""
    node = np.full(len(x), trees.roots[tree], np.int64)
    rows = np.arange(len(x))
    out = np.empty((depth + 1, len(x)))
    for k in range(depth + 1):
        out[k] = trees.value[node]
        inner = trees.left[node] >= 0
        if k == depth or not inner.any():
            out[k + 1:] = out[k]
            break
        go_left = x[rows, trees.feature[node]] <= trees.threshold[node]
        node = np.where(inner, np.where(go_left, trees.left[node], trees.right[node]), node)
    return out


def staged_predictions(trees: Trees, x: np.ndarray, cuts: list[tuple[int, int]], average: bool) -> np.ndarray:
    """``out[c, row]``: the prediction of the first n trees cut at depth d, for every cut (n, d)."""
    depth = max(d for _, d in cuts)
    wanted = defaultdict(list)
    for c, (n, _) in enumerate(cuts):
        wanted[n].append(c)
    total = np.zeros((depth + 1, len(x)))
    out = np.empty((len(cuts), len(x)))
    for t in range(max(wanted)):
        total += trees.weights[t] * walk(trees, t, x, depth)
        for c in wanted.get(t + 1, []):
            n, d = cuts[c]
            out[c] = total[d] / (trees.weights[:n].sum() if average else 1.0)
    return out


def _scorer(trees: Trees, cuts: list[tuple[int, int]], average: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sse = np.zeros(len(cuts))
        rows = 0
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["x"].to_numpy())
            y = pdf["label"].to_numpy(float)
            err = staged_predictions(trees, x, cuts, average) - y
            sse += (err * err).sum(axis=1)
            rows += len(y)
        yield pd.DataFrame({"cut": np.arange(len(cuts), dtype=np.int64), "sse": sse, "n": np.full(len(cuts), rows, np.int64)})

    return run


def score_cuts(pipeline, test: DataFrame, cuts: list[tuple[int, int]], average: bool) -> list[float]:
    """Mean squared error on ``test`` of every cut (n, d) of the pipeline's ensemble."""
    trees = read_trees(pipeline.stages[-1])
    staged = test
    for stage in pipeline.stages[:-1]:
        staged = stage.transform(staged)
    column = pipeline.stages[-1].getFeaturesCol()
    rows = staged.select(vector_to_array(column).alias("x"), F.col("label").cast("double").alias("label"))
    summed = (rows.mapInPandas(_scorer(trees, cuts, average), "cut long, sse double, n long")
              .groupBy("cut").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n")).collect())
    by_cut = {r.cut: r.sse / r.n if r.n else float("nan") for r in summed}
    return [by_cut[c] for c in range(len(cuts))]


def depth_of(params) -> int:
    return min(params.max_depth or M.DEEPEST, M.DEEPEST)


def plan_fits(kind: str, candidates: list[Candidate], chosen: list[list[int]], seed: int = M.SEED):
    """Groups of candidates sharing one fit: {(features, grown params): [(candidate, (n, d)), ...]}."""
    cut_keys = CUTS[kind]
    groups: dict[tuple, list[tuple[int, tuple[int, int]]]] = defaultdict(list)
    for i, (candidate, features) in enumerate(zip(candidates, chosen)):
        params = params_of(kind, candidate, seed)
        shared = replace(params, **{k: getattr(type(params)(), k) for k in cut_keys})
        groups[tuple(features), shared].append((i, (params.n_estimators, depth_of(params))))
    return groups


def grown(kind: str, shared, members: list[tuple[int, tuple[int, int]]]):
    """The parameters of the one fit a group needs: its greatest count and depth."""
    most = max(n for _, (n, _) in members)
    if "max_depth" in CUTS[kind]:
        return replace(shared, n_estimators=most, max_depth=max(d for _, (_, d) in members))
    return replace(shared, n_estimators=most)


def shared_search(bars: DataFrame, cfg: TrainConfig, candidates: list[Candidate], folds: int = 3,
                  parallel: int = 4) -> tuple[DataFrame, Candidate]:
    """As ``search.search``: leaderboard (mean fold MSE, best first) and the best candidate, by shared fits."""
    spark = bars.sparkSession
    kind = cfg.recipe.name
    frame, names = training_frame(bars, cfg)
    scaler = fit_scaler(frame, names, cfg)
    train_rows = model_input(frame, names, scaler).where("split = 'train'").withColumn(
        "n_rows", split.share(F.col("n_rows"), cfg.ratio))
    folded = materialize(
        split.ts_folds(train_rows, folds).select("fold", "role", "ticker", "pos", *names, "label"), "folds", ("fold", "role"))

    def part(fold: int, role: str) -> DataFrame:
        rows = folded.where((F.col("fold") == fold) & (F.col("role") == role)).drop("fold", "role")
        return spread_out(rows) if role == "train" else rows

    fits = []
    for f in range(folds):
        ranked = M.rank_importances(part(f, "train"), names, helper_for(params_of(kind, {}), cfg.helper_trees))
        chosen = [M.choose(ranked, c.get("select_threshold", cfg.select), c.get("select_max_features", cfg.max_features))
                  for c in candidates]
        fits += [(f, features, shared, members) for (features, shared), members in plan_fits(kind, candidates, chosen).items()]

    def run(fit) -> list[tuple[int, int, float]]:
        f, features, shared, members = fit
        params = grown(kind, shared, members)
        pipeline = M.fit_selected(part(f, "train"), names, list(features), params.estimator())
        cuts = sorted({cut for _, cut in members})
        mse = dict(zip(cuts, score_cuts(pipeline, part(f, "test"), cuts, average=kind != "xgb")))
        return [(i, f, mse[cut]) for i, cut in members]

    with ThreadPoolExecutor(parallel) as pool:
        scores = [s for part_scores in pool.map(run, fits) for s in part_scores]
    board = leaderboard(spark.createDataFrame(scores, "candidate int, fold int, mse double"))
    described = F.array(*[F.lit(repr(c)) for c in candidates])
    board = board.withColumn("params", F.get(described, F.col("candidate")))
    best = board.orderBy("rank").first()["candidate"]
    return board, candidates[best]
