"""Packing of documents into sequences: first-fit decreasing in randomised groups.

A document becomes pieces of the full length and a rest.  Full pieces are sequences of their own; rests are put,
longest first, into the first open sequence with room.  A tournament tree over the room left finds that sequence
in logarithmic time.  Groups are drawn by a hash of the id and have a fixed expected size, so each is packed by a
task of bounded size and none waits for another.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescast.llm.bytebpe import load
from seriescast.llm.registry import query, table, texts

TOKENIZER = "byte_bpe_50k.json"
LENGTH = 2048
END = 1
GROUP = 2048

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PIECES_ARROW = [pa.int64()] * 5


def _pieces(tokenizer: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = np.append(bpe.ids(text.as_py()), END).astype("<u4")
                for at in range(0, len(ids), length):
                    part = ids[at:at + length]
                    rows.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECES_ARROW)],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class RoomTree:
    """Tournament tree over sequences: each inner node holds the most room below it."""

    def __init__(self, sequences: int, room: int):
        self.leaves = 1 << max(0, (sequences - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """The first sequence with ``size`` tokens of room, which is taken; and the room it had before."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < size:
                at += 1
        had = most[at]
        most[at] = had - size
        found = at - self.leaves
        while at > 1:
            at //= 2
            top = max(most[2 * at], most[2 * at + 1])
            if most[at] == top:
                break
            most[at] = top
        return found, had


def first_fit_decreasing(sizes: list[int], room: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each size; ``sizes`` come longest first and none is above ``room``."""
    tree = RoomTree(len(sizes), room)
    found = [tree.put(s) for s in sizes]
    return [f for f, _ in found], [room - had for _, had in found]


def _pack(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True],
                              kind="stable", ignore_index=True)
        at, offset = first_fit_decreasing(pdf["length"].tolist(), length)
        # groups are fewer than 2^31 and a group has fewer than 2^32 pieces
        pdf["sequence_id"] = (pdf["grp"].to_numpy(np.int64) << 32) + np.asarray(at, np.int64)
        pdf["offset"] = np.asarray(offset, np.int64)
        return pdf.drop(columns="grp")

    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece.

    Every row of ``docs`` gives its tokens and an end id, a null or empty text the end id alone.  Repeated rows
    and rows without id are packed like others, each on its own.  An empty table gives no pieces.
    """
    rows = texts(docs)
    groups = max(1, -(-docs.select(F.lit(1)).count() // group))
    drawn = F.xxhash64(F.coalesce("doc_id", "ids_crc32"), F.lit(42))
    pieces = rows.mapInArrow(_pieces(tokenizer, length), PIECES).withColumn("grp", F.pmod(drawn, F.lit(groups)).cast("int"))
    return pieces.groupBy("grp").applyInPandas(_pack(length), PIECES + ", sequence_id long, offset long")


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
