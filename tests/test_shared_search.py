"""Search by shared fits against plain refits, and the tree evaluator against MLlib's own predictions."""

import numpy as np
import pytest
from conftest import BARS_DDL, make_bars
from pyspark.sql import functions as F

from seriescast.plans import search, shared
from seriescast.plans import training as T
from seriescast.plans.models import BoostParams, ForestParams, fit_selected


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(make_bars({"AAA": 300, "BBB": 340, "CCC": 40}), BARS_DDL).cache()


def board(b):
    return sorted((r.candidate, round(r.mean_mse, 9), r.rank, r.n_folds) for r in b.collect())


def test_boosted_rounds_from_staged_sums_equal_refits(panel):
    cfg = T.TrainConfig("xgb", params=BoostParams(4, 2), helper_trees=2, select="median", max_features=None)
    cands = search.grid({"n_estimators": [2, 5], "max_depth": [2, 3], "learning_rate": [0.1, 0.3]})
    plain, best = search.search(panel, cfg, cands, folds=2)
    fast, fast_best = shared.shared_search(panel, cfg, cands, folds=2)
    assert board(fast) == board(plain) and fast_best == best


def test_tree_cut_at_depth_equals_a_shallow_fit(panel):
    cfg = T.TrainConfig("rf", params=ForestParams(6, 4), helper_trees=4)
    cands = search.grid({"n_estimators": [1], "max_depth": [1, 2, 4, None], "max_features": ["all"], "min_samples_leaf": [3]})
    assert board(shared.shared_search(panel, cfg, cands, folds=2)[0]) == board(search.search(panel, cfg, cands, folds=2)[0])


def test_evaluator_equals_mllib_predictions(spark, panel):
    cfg = T.TrainConfig("rf", params=ForestParams(6, 4), helper_trees=4)
    frame, names = T.training_frame(panel, cfg)
    rows = frame.where("split = 'train'")
    pipeline = fit_selected(rows, names, [0, 2, 3], ForestParams(7, 5, max_features="sqrt").estimator())
    test = frame.where("split = 'test'")
    error = F.col("label") - F.col("prediction")
    mllib = pipeline.transform(test).agg(F.avg(error * error)).first()[0]
    assert shared.score_cuts(pipeline, test, [(7, 5)], average=True)[0] == pytest.approx(mllib, rel=1e-12)
    # prefixes and cuts by brute force over MLlib's single trees
    trees = pipeline.stages[-1].trees
    staged = pipeline.stages[1].transform(pipeline.stages[0].transform(test))
    x = np.stack([r.chosen.toArray() for r in staged.select("chosen").collect()])
    y = np.asarray([r.label for r in staged.select("label").collect()])
    per_tree = np.stack([[t.predict(v) for v in staged.select("chosen").toPandas()["chosen"]] for t in trees[:3]])
    assert shared.score_cuts(pipeline, test, [(3, 5)], average=True)[0] == pytest.approx(
        float(np.mean((per_tree.mean(axis=0) - y) ** 2)), rel=1e-12)
    flat = shared.read_trees(pipeline.stages[-1])
    assert np.allclose(shared.walk(flat, 0, x, 5)[-1], per_tree[0])
    assert np.allclose(shared.walk(flat, 0, x, 0)[0], flat.value[flat.roots[0]])


def test_twins_and_equal_choices_share_one_fit():
    cands = [{"n_estimators": 100, "max_depth": 10, "min_samples_split": 2, "min_samples_leaf": 3, "max_features": "sqrt"},
             {"n_estimators": 200, "max_depth": None, "min_samples_split": 5, "min_samples_leaf": 3, "max_features": "sqrt"},
             {"n_estimators": 100, "max_depth": 10, "min_samples_split": 10, "min_samples_leaf": 3, "max_features": "sqrt"},
             {"n_estimators": 100, "max_depth": 10, "min_samples_split": 2, "min_samples_leaf": 5, "max_features": "sqrt"}]
    groups = shared.plan_fits("rf", cands, [[0, 1], [0, 1], [0, 1], [0, 1]])
    assert sorted(sorted(i for i, _ in m) for m in groups.values()) == [[0, 1, 2], [3]]
    (key, members), = [(k, m) for k, m in groups.items() if len(m) == 3]
    grown = shared.grown("rf", key[1], members)
    assert (grown.n_estimators, grown.max_depth) == (200, 30)
    assert {cut for _, cut in members} == {(100, 10), (200, 30)}
    boosted = shared.plan_fits("xgb", [{"n_estimators": 100, "max_depth": 3}, {"n_estimators": 200, "max_depth": 3},
                                       {"n_estimators": 100, "max_depth": 5}], [[0], [0], [0]])
    assert sorted(len(m) for m in boosted.values()) == [1, 2]


def test_walk_by_hand():
    # root: x0 <= 0.5 ? node 1 (leaf 1.0) : node 2 (x1 <= 2 ? leaf 3.0 : leaf 4.0); node 2 predicts 3.5
    flat = shared.Trees(feature=np.asarray([0, 0, 1, 0, 0]), threshold=np.asarray([0.5, 0, 2, 0, 0]),
                        left=np.asarray([1, -1, 3, -1, -1]), right=np.asarray([2, -1, 4, -1, -1]),
                        value=np.asarray([2.0, 1.0, 3.5, 3.0, 4.0]), roots=np.asarray([0]), weights=np.asarray([1.0]),
                        depth=2)
    x = np.asarray([[0.0, 0.0], [1.0, 1.0], [1.0, 3.0]])
    assert shared.walk(flat, 0, x, 2).tolist() == [[2.0, 2.0, 2.0], [1.0, 3.5, 3.5], [1.0, 3.0, 4.0]]
