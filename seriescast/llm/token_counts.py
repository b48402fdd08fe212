"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced again.

A chunk encoded alone has wrong tokens near its ends only.  Two neighbours are joined at a place inside their
overlap where both have a token boundary and which is stable: the pre-tokenizer splits there whatever stands to
the left or right (before white space that follows something else, or between a letter and a full stop or the
like).  What one chunk has before such a place and the next has after it is what the whole text has.  Where an
overlap holds no such place, the document is cut again with a wider one; at last it is one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriescast.llm.bytebpe import load
from seriescast.llm.registry import digest, query, table, texts
from seriescast.sources.storage import materialize

TOKENIZER = "byte_bpe_50k.json"
#: Characters that no alternative of the pre-tokenizer holds after a letter, nor any special token.
AFTER_LETTER = frozenset(".,;:!?()。，、")
BATCH = 256


def stable(text: str, at: int) -> bool:
    """Whether the pre-tokenizer splits before ``text[at]`` in any text that has these two characters."""
    before, here = text[at - 1], text[at]
    return (here in " \n\r\t" and not before.isspace()) or (here in AFTER_LETTER and before.isascii()
                                                            and before.isalpha())


def _count(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for b in batches:
            counts = [len(bpe.ids(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(counts, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    return run


CHUNKS = "doc_id long, digest long, chunk long, start long, last boolean, piece string"
CHUNKS_ARROW = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("chunk", pa.int64()),
                          ("start", pa.int64()), ("last", pa.bool_()), ("piece", pa.string())])


def _cut(size: int, overlap: int):
    """Chunk k starts at k * size and reaches ``overlap`` characters into the next one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                text, head = b.column("text")[row].as_py(), [b.column(c)[row].as_py() for c in ("doc_id", "digest")]
                n = max(1, -(-(len(text) - overlap) // size))
                for at in range(0, n, BATCH):
                    rows = [(*head, k, k * size, k == n - 1, text[k * size: k * size + size + overlap] if k < n - 1
                             else text[k * size:]) for k in range(at, min(at + BATCH, n))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows), CHUNKS_ARROW)], schema=CHUNKS_ARROW)

    return run


ENCODED = ("doc_id long, digest long, chunk long, last boolean, n long, left_at array<long>, left_n array<long>, "
           "right_at array<long>, right_n array<long>")
LISTS = pa.list_(pa.int64())


def _encode(tokenizer: str, overlap: int):
    """Tokens of each chunk, and the stable boundaries in both overlaps with the tokens before them."""
    def places(text: str, ends, lo: int, hi: int, start: int) -> tuple[list[int], list[int]]:
        found = [(i + 1, int(e)) for i, e in enumerate(ends.tolist()) if lo < e < hi and stable(text, e)]
        return [start + e for _, e in found], [i for i, _ in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for b in batches:
            n, sides = [], [[], [], [], []]
            for text, start, chunk, last in zip(*(b.column(c).to_pylist() for c in ("piece", "start", "chunk", "last"))):
                ids, ends = bpe.offsets(text)
                n.append(len(ids))
                # a place needs the character before and after it, and one more that looks ahead
                left = places(text, ends, 0, overlap - 1, start) if chunk else ([], [])
                right = places(text, ends, len(text) - overlap, len(text) - 1, start) if not last else ([], [])
                for side, values in zip(sides, (*left, *right)):
                    side.append(values)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "digest", "chunk", "last")), pa.array(n, pa.int64()),
                 *(pa.array(s, LISTS) for s in sides)],
                ["doc_id", "digest", "chunk", "last", "n", "left_at", "left_n", "right_at", "right_n"])

    return run


def _before(at: str, n: str, place: Column) -> Column:
    return F.element_at(F.col(n), F.array_position(F.col(at), place).cast("int"))


def splice(encoded: DataFrame) -> DataFrame:
    """One row per document: ``n_tokens``, null if two neighbours have no stable boundary in common."""
    w = Window.partitionBy("doc_id", "digest").orderBy("chunk")
    common = F.array_intersect("right_at", F.lead("left_at").over(w))
    joined = encoded.withColumn("cut", F.when(F.size(common) > 0, F.get(common, (F.size(common) / 2).cast("int"))))
    joined = joined.withColumn("from", F.lag("cut").over(w))
    upto = F.when(F.col("last"), F.col("n")).otherwise(_before("right_at", "right_n", F.col("cut")))
    since = F.when(F.col("chunk") == 0, F.lit(0)).otherwise(_before("left_at", "left_n", F.col("from")))
    part = joined.select("doc_id", "digest", (upto - since).alias("part"))
    return part.groupBy("doc_id", "digest").agg(
        F.when(F.count("part") == F.count(F.lit(1)), F.sum("part")).alias("n_tokens"), F.count(F.lit(1)).alias("n_chunks"))


def spliced_counts(huge: DataFrame, tokenizer: str, size: int, overlap: int) -> DataFrame:
    """(doc_id, digest, n_tokens, n_chunks) of every document of ``huge`` (doc_id, digest, text)."""
    done, pending = None, huge
    while True:
        pieces = pending.mapInArrow(_cut(size, overlap), CHUNKS).repartition("doc_id", "digest", "chunk")
        counted = materialize(splice(pieces.mapInArrow(_encode(tokenizer, overlap), ENCODED)), "spliced")
        good = counted.filter("n_tokens IS NOT NULL")
        done = good if done is None else done.unionByName(good)
        failed = counted.filter("n_tokens IS NULL")
        if failed.isEmpty():
            return done
        keys = failed.select("doc_id", "digest").alias("f")
        pending = pending.alias("p").join(keys, F.expr("p.doc_id <=> f.doc_id AND p.digest = f.digest"), "left_semi")
        overlap *= 4
        size = max(size, 4 * overlap)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = 16384, overlap: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_chunks): tokens of each whole text, added special tokens not counted.

    A null text is empty and has 0 tokens.  Rows are counted one by one: repeated rows and null ids each give
    their row.  Texts longer than ``size + overlap`` characters go through chunks, spread over the cluster by
    document and chunk; an empty table gives an empty result.
    """
    rows = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    is_huge = F.length("text") > size + overlap
    small = rows.filter(~is_huge).mapInArrow(_count(tokenizer), "doc_id long, n_bytes long, n_tokens long")
    keyed = rows.filter(is_huge).withColumn("digest", digest())
    huge = keyed.select("doc_id", "digest", "text").dropDuplicates(["doc_id", "digest"])
    counts = spliced_counts(huge, tokenizer, size, overlap).alias("c")
    large = keyed.select("doc_id", "digest", "n_bytes").alias("k").join(
        counts, F.expr("k.doc_id <=> c.doc_id AND k.digest = c.digest")).select(
        "k.doc_id", "k.n_bytes", "c.n_tokens", "c.n_chunks")
    return small.withColumn("n_chunks", F.lit(1).cast("long")).unionByName(large)


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)
