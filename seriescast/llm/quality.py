"""Quality of documents by co-training: one classifier sees the text, another what describes the page.

The text view is the mix of character classes and how they follow each other, the variety of the words and their
repetition.  The page view is language, source, length and layout.  In every round each view's confident verdicts
on unlabelled documents are handed to the other as pseudo-labels.  In the end both views are calibrated on
labelled rows that neither has learnt from, and combined.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescast.llm.registry import digest, held_out, query, table
from seriescast.sources.storage import materialize

ROUNDS = 2
CONFIDENT = 0.97
PSEUDO_WEIGHT = 0.5
#: At most about so many labelled rows are learnt from (a random part by hash if there are more).
MAX_LABELLED = 50_000

LOWER, UPPER, DIGIT, SPACE, LINE, STOP, MARK, OTHER = range(8)
TRIPLES = 64  # buckets of three classes in a row
LANGS, SOURCES = 8, 32


def _classes() -> np.ndarray:
    """Class of every character of the Basic Multilingual Plane, then one for what lies beyond."""
    kinds = np.full(0x10001, OTHER, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if ch in "\n\r":
            kinds[c] = LINE
        elif ch.isspace():
            kinds[c] = SPACE
        elif ch.islower():
            kinds[c] = LOWER
        elif ch.isupper():
            kinds[c] = UPPER
        elif ch.isdigit():
            kinds[c] = DIGIT
        elif ch.isalpha():
            kinds[c] = LOWER
        elif ch in ".,;:'\"?!()-":
            kinds[c] = STOP
        elif c < 128:
            kinds[c] = MARK
    return kinds


def text_view(text: str, kinds: np.ndarray) -> list[float]:
    """Shares of character classes and of three classes in a row (runs count once), and figures of the words."""
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0x10000)
    of = kinds[codes]
    shares = np.bincount(of, minlength=8)[:8] / max(1, len(of))
    runs = of[np.append(True, of[1:] != of[:-1])] if len(of) else of
    triples = (runs[:-2].astype(np.int64) * 64 + runs[1:-1] * 8 + runs[2:]) * 0x9E3779B1 >> 13 & (TRIPLES - 1)
    follow = np.bincount(triples, minlength=TRIPLES) / max(1, len(triples))
    words = text.split()
    counts = Counter(words)
    most = counts.most_common(1)[0][1] / len(words) if words else 0.0
    pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1)
    variety = len(counts) / len(words) if words else 0.0
    length = len(text) / len(words) if words else 0.0
    return [*shares, *follow, most, pairs, variety, float(np.log1p(length))]


def page_view(text: str, lang: str | None, source: str | None) -> list[float]:
    """Language and source in hashed places, length and layout."""
    lines = text.split("\n")
    filled = [x for x in lines if x.strip()]
    where = np.zeros(LANGS + SOURCES)
    where[zlib.crc32((lang or "").encode()) % LANGS] = 1.0
    where[LANGS + zlib.crc32((source or "").encode()) % SOURCES] = 1.0
    sizes = [len(x) for x in filled] or [0]
    return [*where, float(np.log1p(len(text))), float(np.log1p(len(lines))), float(np.log1p(np.mean(sizes))),
            float(np.log1p(max(sizes))), float(np.log1p(min(sizes))), len(set(filled)) / max(1, len(filled)),
            len(filled) / max(1, len(lines)), sum(x.rstrip()[-1] in ".!?" for x in filled) / max(1, len(filled))]


FEATURES = "doc_id long, digest long, a array<double>, b array<double>"


def _features():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _classes()
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            langs, sources = b.column("lang").to_pylist(), b.column("source").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("digest"),
                 pa.array([text_view(t, kinds) for t in texts], pa.list_(pa.float64())),
                 pa.array([page_view(*x) for x in zip(texts, langs, sources)], pa.list_(pa.float64()))],
                ["doc_id", "digest", "a", "b"])

    return run


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, a, b): both views; a column lang or source that isn't there is taken as null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = lambda c: F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"), text.alias("text"),
                       own("lang"), own("source"))
    return rows.mapInArrow(_features(), FEATURES)


def fit(rows: DataFrame, view: str) -> LogisticRegressionModel | None:
    """Logistic regression of ``label`` on a view; none without both labels."""
    if rows.select("label").distinct().count() < 2:
        return None
    return LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", maxIter=30, regParam=1e-3).fit(
        rows.select(array_to_vector(F.col(view)).alias("x"), F.col("label").cast("double").alias("label"), "weight"))


def logit(view: str, model: LogisticRegressionModel | None) -> Column:
    """The model's log odds as an expression over the view's array; 0 without a model."""
    if model is None:
        return F.lit(0.0)
    terms = F.zip_with(F.col(view), F.array(*(F.lit(float(c)) for c in model.coefficients)), lambda x, c: x * c)
    return F.aggregate(terms, F.lit(float(model.intercept)), lambda s, x: s + x)


def probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(35.0)), F.lit(-35.0))))


def score_quality(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT,
                  max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score_text, score_page, score, keep) of each row; a higher score is better quality.

    Held-out rows are never learnt from; a fifth of the other labelled rows only calibrates.  Contradictory or
    missing labels don't count.  Without labels of both kinds every score is 0.5 and every row is kept.  Null and
    empty texts are scored by what they have; repeated rows and null ids each give their row.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.min("quality").alias("label"), F.max("quality").alias("most")).filter("label = most AND label IN (0, 1)")
    rows = features(docs)
    marked = rows.join(marks.select("id", "label"), F.col("doc_id") == F.col("id"), "left").drop("id")
    part = F.crc32(F.concat(F.lit("part "), F.col("doc_id").cast("string")).cast("binary")) % 1000
    role = F.when(held_out(), "held").when(F.col("label").isNull(), "open").when(part < 200, "calibrate").otherwise("learn")
    stored = materialize(marked.withColumn("role", role).withColumn("part", part), "quality-views")
    n = stored.filter("role = 'learn'").count()
    learn = stored.filter((F.col("role") == "learn") & (F.col("part") < 200 + 800 * min(1.0, max_labelled / max(1, n)))).select(
        "a", "b", "label", F.lit(1.0).alias("weight"))
    models: dict[str, LogisticRegressionModel | None] = {v: fit(learn, v) for v in "ab"}
    pool = stored.filter("role = 'open'")
    for _ in range(rounds):
        taught = {}
        for view, other in (("a", "b"), ("b", "a")):
            if models[other] is None:
                taught[view] = models[view]
                continue
            p = probability(logit(other, models[other]))
            verdicts = pool.withColumn("p", p).filter((F.col("p") >= confident) | (F.col("p") <= 1 - confident)).select(
                "a", "b", (F.col("p") >= 0.5).cast("int").alias("label"), F.lit(PSEUDO_WEIGHT).alias("weight"))
            taught[view] = fit(learn.unionByName(verdicts), view)
        models = taught
    scored = stored.select("doc_id", "label", "role", logit("a", models["a"]).alias("za"), logit("b", models["b"]).alias("zb"))
    check = scored.filter("role = 'calibrate'").select(F.array("za", "zb").alias("z"), "label", F.lit(1.0).alias("weight"))
    both = fit(check, "z")
    alone = {v: fit(check.withColumn("z", F.array(F.get("z", F.lit(i)))), "z") for i, v in enumerate("ab")}
    scored = scored.withColumn("z", F.array("za", "zb")).withColumn("z_a", F.array("za")).withColumn("z_b", F.array("zb"))
    score = probability(logit("z", both))
    return scored.select("doc_id", held_out().alias("held_out"), probability(logit("z_a", alone["a"])).alias("score_text"),
                         probability(logit("z_b", alone["b"])).alias("score_page"), score.alias("score"),
                         (score >= 0.5).cast("int").alias("keep"))


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
