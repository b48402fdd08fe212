"""The registered queries of the text operators, those with SQL side by side with it, and the pipeline."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import check_oracles  # noqa: E402
import corpus_pipeline  # noqa: E402
from seriescast import llm  # noqa: E402

SF = "/root/testdata/sf0.001"
llm.load_all()


@pytest.fixture(scope="module")
def duck():
    return check_oracles.connect(SF)


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_matches_sql(spark, duck, name):
    ok, note = check_oracles.compare(spark, duck, name, SF)
    assert ok, note


def test_all_fourteen_are_registered():
    assert {n.split("_")[0] for n in llm.QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        after = [r.doc_id for r in docs.collect()]
        assert len(after) == len(set(after)) and set(after) <= before
        before = set(after)
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == before
