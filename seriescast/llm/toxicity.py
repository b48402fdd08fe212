"""Toxicity of text: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, their stems (the first letters), word pairs and pairs with one
word between.  Rates are per coordinate and the L1 term keeps nearly all weights at exactly 0, so the model that
goes to the tasks is small, and bounded by the number of hash buckets.  Labelled rows are dealt by id to as many
shards as their number asks for; each shard streams its rows through FTRL from the common state, and the states
are averaged after every epoch.  So neither a task nor the driver holds the labelled rows, and the result doesn't
depend on the cluster.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescast.llm.registry import held_out, query, table, texts
from seriescast.sources.storage import materialize

WORD = re.compile(r"[^\W_]+")
BITS = 18
STEM = 5
#: At most so many labelled rows are learnt from.
MAX_LABELLED = 20_000
SHARD_ROWS = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.5
KNOWN_WORDS = 200_000
BIAS = 1 << BITS  # a bucket of its own after the hashed ones

# Odd multipliers of the hash; any will do, but training and scoring must share them.
MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _Words(dict):
    """crc32 of words and, in the upper half, of their stems; emptied when full, so that its memory is bounded."""

    def __missing__(self, w: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[w] = zlib.crc32(w.encode()) | zlib.crc32(b"stem " + w[:STEM].encode()) << 32
        return h


def buckets(text: str, known: _Words) -> np.ndarray:
    """Bucket of every word, stem, pair and skip pair, repeats included."""
    found = WORD.findall(text.lower())
    both = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    w, s = (both & np.uint64(0xFFFFFFFF)) + np.uint64(1), (both >> np.uint64(32)) + np.uint64(1)
    shift = np.uint64(64 - BITS)
    one = np.concatenate([w, s]) * MIX[0] >> shift
    two = ((w[:-1] * MIX[1] + w[1:]) * MIX[0]) >> shift
    skip = ((w[:-2] * MIX[2] + w[2:] * MIX[3]) * MIX[0]) >> shift
    return np.concatenate([one, two, skip]).astype(np.int64)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """State of FTRL-proximal: sums of adjusted gradients z and of squared gradients n."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z.copy(), n.copy()

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == BIAS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def _features():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in batches:
            at = [np.append(np.unique(buckets(t.as_py(), known)), BIAS) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array(at, pa.list_(pa.int32()))], ["doc_id", "label", "at"])

    return run


def _epoch(state: tuple[np.ndarray, np.ndarray]):
    """FTRL over one shard (one partition), row by row; gives the buckets whose state has moved."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(*state), False
        for b in batches:
            for at, label in zip(b.column("at"), b.column("label").to_pylist()):
                seen = True
                model.learn(at.values.to_numpy(), label)
        if seen:
            moved = np.flatnonzero(model.n != state[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(moved), pa.array(model.z[moved] - state[0][moved]), pa.array(model.n[moved] - state[1][moved])],
                ["at", "dz", "dn"])

    return run


def train(labelled: DataFrame, shard_rows: int = SHARD_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights that are not 0, from (doc_id, text, label).

    All rows given are learnt from.  Without rows there is no weight.  What comes to the driver is bounded by
    the number of buckets, and comes as Arrow columns: a Python row for each takes ten times their memory.
    """
    rows = labelled.filter("label IN (0, 1)").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    rows = materialize(rows.mapInArrow(_features(), "doc_id long, label int, at array<int>"), "toxic-features")
    shards = max(1, -(-rows.count() // shard_rows))
    # the same rows are one shard on every cluster, in the same order
    dealt = rows.withColumn("h", F.xxhash64("doc_id")).repartition(shards, F.pmod("h", F.lit(shards)))
    dealt = dealt.sortWithinPartitions("h", "doc_id", "label").select("label", "at").persist()
    state = np.zeros(BIAS + 1), np.zeros(BIAS + 1)
    for _ in range(epochs):
        moved = dealt.mapInArrow(_epoch(state), "at long, dz double, dn double").groupBy("at").agg(
            F.sum("dz").alias("dz"), F.sum("dn").alias("dn"), F.count(F.lit(1)).alias("shards")).toArrow()
        at = moved["at"].to_numpy()
        state = state[0].copy(), state[1].copy()
        # a bucket moves by the mean over the shards that saw it
        state[0][at] += moved["dz"].to_numpy() / moved["shards"].to_numpy()
        state[1][at] += moved["dn"].to_numpy() / moved["shards"].to_numpy()
    dealt.unpersist()
    every = np.arange(BIAS + 1)
    w = Ftrl(*state).weights(every)
    return np.flatnonzero(w), w[w != 0]


def _score(at: np.ndarray, weight: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(BIAS + 1)
        dense[at] = weight
        used, known = dense != 0, _Words()
        for b in batches:
            sums = np.empty(b.num_rows)
            for i, t in enumerate(b.column("text")):
                found = buckets(t.as_py(), known)
                sums[i] = dense[BIAS] + dense[np.unique(found[used[found]])].sum()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sigmoid(sums))], ["doc_id", "score"])

    return run


def learn_from(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, label) of the labelled documents that aren't held out; contradictory labels are left out.

    Of more than ``max_labelled`` labels a random part of that size (by hash) is used.  As their number is bounded
    they are broadcast, and the texts need no shuffle.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("toxic").alias("label"), F.max("toxic").alias("most")).filter("label = most").filter(~held_out())
    some = marks.orderBy(F.xxhash64(F.lit("learn"), "doc_id"), "doc_id").limit(max_labelled).select("doc_id", "label")
    return texts(docs).join(F.broadcast(some), "doc_id")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    A null or empty text gets the score of the bias alone.  If no label can be learnt from, every score is 0 and
    nothing is predicted toxic.  Rows with a null id are scored, never learnt from; repeated rows each give theirs.
    """
    at, weight = train(learn_from(docs, labels))
    score = F.col("score") if len(at) else F.lit(0.0)
    return (texts(docs).mapInArrow(_score(at, weight), "doc_id long, score double")
            .select("doc_id", held_out().alias("held_out"), score.alias("score"),
                    (score >= 0.5).cast("int").alias("predicted")))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, null ids included; all columns are kept.

    Rows of one id with different texts are judged one by one, and a row is dropped by its own score.
    """
    at, weight = train(learn_from(docs, table(spark, sf_dir, "labels")))
    if not len(at):
        return docs
    return docs.mapInArrow(_keep(at, weight, docs.columns.index("text")), docs.schema)


def _keep(at: np.ndarray, weight: np.ndarray, text_column: int):
    score = _score(at, weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(text_column).fill_null("")
            one = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), text], ["doc_id", "text"])
            kept = next(score(iter([one]))).column("score").to_numpy() < 0.5
            yield b.filter(pa.array(kept))

    return run


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
