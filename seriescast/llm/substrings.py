"""Passages that repeat across documents: content-defined chunks by a gear rolling hash, matched by digest.

A chunk ends where the rolling hash of the last sixteen bytes has its upper bits at zero, so the ends inside a
passage depend on the passage alone and an insertion moves only the ends next to it.  Chunks have a least and a
greatest length.  Digests found in more than one document mark their chunks; neighbouring marked chunks with the
same first document are one span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriescast.llm.registry import digest, query, table, texts
from seriescast.sources.storage import materialize

GEAR = np.random.default_rng(5).integers(0, 1 << 16, 256, np.uint16)
WINDOW = 16  # bits of the hash, and so bytes that it depends on
MASK = np.uint16(0xF800)  # an end once in 32 bytes
LEAST, MOST = 16, 256
SEGMENT = 1 << 20
MIN_WORDS = 24


def rolling(raw: np.ndarray) -> np.ndarray:
    """h(i) = 2 h(i - 1) + gear of byte i, in sixteen bits."""
    g = GEAR[raw]
    h = g.copy()
    for k in range(1, WINDOW):
        h[k:] += g[:-k] << np.uint16(k)
    return h


def chunk_ends(raw: np.ndarray, starts: np.ndarray) -> list[int]:
    """Ends of the chunks of some UTF-8 bytes, never inside a character; ``starts`` marks first bytes."""
    n, found = len(raw), []
    for at in range(0, n, SEGMENT):
        back = max(0, at - WINDOW)
        h = rolling(raw[back:at + SEGMENT])[at - back:]
        found.append(np.flatnonzero((h & MASK) == 0) + at + 1)
    ends = np.concatenate(found) if found else np.zeros(0, np.int64)
    ends = ends[ends < n]
    ends = ends[starts[ends]].tolist() + [n]
    out, last = [], 0
    for e in ends:
        while e - last > MOST:
            last += MOST
            while last < n and not starts[last]:
                last += 1
            out.append(last)
        if e - last >= LEAST or e == n and e > last:
            out.append(e)
            last = e
    return out


CHUNKS = "doc_id long, digest long, no long, start long, end long, words long, chunk binary"


def _chunks(only_digest: bool):
    """Chunks of each text, with places in code points; or just what counting needs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for doc, mark, t in zip(b.column("doc_id").to_pylist(), b.column("digest").to_pylist(), b.column("text")):
                data = t.as_py().encode()
                if not data:
                    continue
                raw = np.frombuffer(data, np.uint8)
                first = (raw & 0xC0) != 0x80
                ends = chunk_ends(raw, first)
                begins = [0, *ends[:-1]]
                n = len(ends)
                digests = pa.array([xxhash.xxh3_128_digest(data[a:e]) for a, e in zip(begins, ends)], pa.binary())
                doc_ids = pa.array([doc] * n, pa.int64())
                if only_digest:
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array([mark] * n, pa.int64()), digests],
                                                     ["doc_id", "digest", "chunk"])
                    continue
                chars = np.append(0, np.cumsum(first))
                gaps = np.append(0, np.cumsum((raw == 32) | (raw == 10) | (raw == 9)))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array([mark] * n, pa.int64()), pa.array(np.arange(n)), pa.array(chars[begins]),
                     pa.array(chars[ends]), pa.array(gaps[ends] - gaps[begins]), digests],
                    ["doc_id", "digest", "no", "start", "end", "words", "chunk"])

    return run


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, digest, start, end, n_words, n_chunks, first_doc_id, kept): spans found in other documents too.

    Places are in code points.  ``kept`` says that this document is the first with all of the span, by id; it is
    what stays when repeats are removed.  A run of repeated chunks is cut where their first document changes, so
    every chunk stays in its own.  Repeats within one document alone don't count, nor do rows of one id
    count as other documents; documents without id are told apart by their text and
    keep a span only where no document with an id has it.  Null
    and empty texts have no spans.  Runs of fewer than ``min_words`` words are left out; a span that is a part of a
    longer run may have fewer.
    """
    rows = texts(docs).withColumn("digest", digest())
    counted = rows.mapInArrow(_chunks(True), "doc_id long, digest long, chunk binary").withColumn("doc", F.coalesce(
        "doc_id", "digest"))
    shared = counted.groupBy("chunk").agg(F.min("doc").alias("low"), F.max("doc").alias("high"),
                                          F.min("doc_id").alias("first_doc_id")).filter("low <> high")
    shared = materialize(shared.select("chunk", "first_doc_id"), "shared-chunks")
    marked = rows.mapInArrow(_chunks(False), CHUNKS).join(shared, "chunk").drop("chunk").distinct()
    w = Window.partitionBy("doc_id", "digest").orderBy("no")
    same = F.lag("no").over(w).eqNullSafe(F.col("no") - 1) & F.lag("first_doc_id").over(w).eqNullSafe(F.col("first_doc_id"))
    parts = marked.withColumn("run", F.col("no") - F.row_number().over(w)).withColumn("new", F.when(same, 0).otherwise(1))
    spans = parts.withColumn("part", F.sum("new").over(w)).groupBy("doc_id", "digest", "run", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"),
        F.count(F.lit(1)).alias("n_chunks"), F.min("first_doc_id").alias("first_doc_id"),
        F.min(F.expr("first_doc_id <=> doc_id")).alias("kept"))
    whole = F.sum("n_words").over(Window.partitionBy("doc_id", "digest", "run"))
    return spans.withColumn("run_words", whole).filter(F.col("run_words") >= min_words).drop("run", "part", "run_words")


def _without():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, spans in zip(b.column("text"), b.column("spans").to_pylist()):
                text, parts, at = t.as_py(), [], 0
                for s in sorted(spans or (), key=lambda x: x["start"]):
                    parts.append(text[at:s["start"]])
                    at = s["end"]
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out)], ["doc_id", "text"])

    return run


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text) of each row, spans that an earlier document keeps being cut out."""
    cut = repeated_spans(docs, min_words).filter("NOT kept").groupBy("doc_id", "digest").agg(
        F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = texts(docs).withColumn("digest", digest()).alias("r")
    both = rows.join(cut.alias("c"), F.expr("r.doc_id <=> c.doc_id AND r.digest = c.digest"), "left")
    return both.select("r.doc_id", "r.text", "c.spans").mapInArrow(_without(), "doc_id long, text string")


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "end", "n_words", "n_chunks", "first_doc_id", "kept")
