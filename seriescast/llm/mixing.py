"""Mixing sources to target weights: fixed blocks of words, multinomial shards, permuted slots, blocks joined by index.

Size of a document: its words, the runs of ``[^\\x20\\x09-\\x0D]+`` (null text: 0).  Sources are ordered by code
point, null last, and weigh ``WEIGHTS`` in turn (5, 2, 1, 5, 2, 1, ...).  Targets share all sizes by weight; none
passes ``CAP`` times its source's size, and what a capped source gives up is shared again by weight among the
others until none is above (water filling, exact in fractions).

Method.
1. Blocks.  Each source's documents are laid end to end in a fixed pseudorandom order (a hash of the row) and cut
   into blocks of ``BLOCK`` words.  A document's offset comes from a distributed running sum (range partitions,
   a running sum inside each, partition totals added back), so a source with a third of all rows is no one task.
2. Shards.  A source fills target / (mean block length) block slots, rounded, at most 3 nb (nb: its blocks).  The
   slots are dealt to output shards of ``SHARD_BLOCKS``: each shard's count of every source is a random draw, split
   down a binary tree of shard ranges by multivariate hypergeometric draws seeded by the range.  (Independent
   multinomials per shard were the first plan; they left sources whole blocks off target, e.g. on sf0.001 a
   target of 1437 words with 0 taken, so the draws now keep every source's total exact.)
3. Slots.  A source's slots are numbered across shards (running sum again) and mapped through a keyed permutation
   of 0..3 nb - 1 (Feistel rounds with cycle walking), then to block ``index mod nb``; so a block is taken at most
   ``CAP`` times.
4. Join.  Slots are counted per (source, block) and joined to the (document, block) overlaps by block index;
   ``taken`` is the sum of overlap x times taken.

Each source's taken words come near its target: a slot takes a block of mean length on average, so the expected
words are within half a mean block of it, and the short last block, drawn at most 3 times, adds at most 3 times its
shortfall (3.5 blocks at worst; a few thousandths of a source of some thousand blocks).  No
document exceeds ``CAP`` times its size, and reruns give the same rows.  Edge cases: an empty table gives no rows;
a null or empty text has size 0 and takes 0; rows repeated are documents of their own; very long texts span many
blocks; other input columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from seriescast.llm.registry import query, table
from seriescast.sources.storage import materialize

# Fixed values of the contract.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3

#: Words per block, blocks per output shard, seed of shards and permutations.
BLOCK = 2048
SHARD_BLOCKS = 4096
SEED = 20240601
#: Sources are few; their table goes to the driver behind this count.
MAX_SOURCES = 1_000_000

MASK64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def targets(sizes: list[int], weights: list[int], cap: int = CAP) -> list[Fraction]:
    """Water filling: shares of ``sum(sizes)`` by weight, none above ``cap`` times its size."""
    total = sum(sizes)
    fixed: dict[int, Fraction] = {}
    while True:
        rest = total - sum(fixed.values())
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        weight = sum(weights[i] for i in open_)
        share = {i: Fraction(rest * weights[i], weight) if weight else Fraction(0) for i in open_}
        over = [i for i in open_ if share[i] > cap * sizes[i]]
        if not over:
            return [fixed[i] if i in fixed else share[i] for i in range(len(sizes))]
        for i in over:
            fixed[i] = Fraction(cap * sizes[i])


def _mix(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A 64-bit mixer of two unsigned vectors (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = (x * np.uint64(0x9E3779B97F4A7C15) + key) & MASK64
        z = ((z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)) & MASK64
        z = ((z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)) & MASK64
        return z ^ (z >> np.uint64(31))


def permute(index: np.ndarray, size: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of 0..size-1 applied to ``index``: Feistel rounds on a power-of-4 domain, cycle walking."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(zlib.crc32(f"{key}:{r}".encode()) | (key & 0xFFFFFFFF) << 32) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        return (left << np.uint64(half)) | right

    x = once(index.astype(np.uint64))
    out = x >= np.uint64(size)
    while out.any():
        x[out] = once(x[out])
        out = x >= np.uint64(size)
    return x.astype(np.int64)


def _running(key: str, order: list[str], value: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        carry: dict = {}
        for pdf in batches:
            before = pdf.groupby(key, sort=False)[value].cumsum() - pdf[value]
            start = pdf[key].map(lambda k: carry.get(k, 0)).astype("int64")
            pdf["_local"] = before.to_numpy("int64") + start.to_numpy("int64")
            for k, s in pdf.groupby(key, sort=False)[value].sum().items():
                carry[k] = carry.get(k, 0) + int(s)
            pdf["_pid"] = pid
            yield pdf

    return run


def running_sum(df: DataFrame, key: str, order: list[str], value: str, out: str, label: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows before each of its ``key`` in ``order``.

    Rows are range-partitioned by (key, order) and summed inside partitions; partition totals per key (at most
    partitions + keys rows) are added back by a broadcast join.  No key is gathered in one task.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    schema = StructType(df.schema.fields + [StructField("_local", LongType()), StructField("_pid", IntegerType())])
    local = materialize(ranged.mapInPandas(_running(key, order, value), schema), label)
    totals = local.groupBy("_pid", key).agg(F.sum(value).alias("_t"))
    if totals.count() > parts + MAX_SOURCES:
        raise ValueError("more partition totals than partitions and keys")
    before = {}
    rows = sorted(totals.collect(), key=lambda r: r["_pid"])
    base = []
    for r in rows:
        k = r[key]
        base.append((r["_pid"], k, before.get(k, 0)))
        before[k] = before.get(k, 0) + r["_t"]
    key_type = dict(df.dtypes)[key]
    bases = spark.createDataFrame(base, f"_pid int, {key} {key_type}, _base long")
    return (local.join(F.broadcast(bases), ["_pid", key])
            .withColumn(out, F.col("_base") + F.col("_local")).drop("_pid", "_base", "_local"))


def slot_totals(goal: list[Fraction], sizes: list[int], nb: list[int], cap: int = CAP) -> list[int]:
    """Blocks each source fills: its target over its mean block length, rounded, at most ``cap`` times its blocks."""
    return [min(cap * n, int(g * n / sz + Fraction(1, 2))) if sz else 0 for g, sz, n in zip(goal, sizes, nb)]


def shard_counts(shard: int, totals: np.ndarray, slots: int, shard_blocks: int, seed: int) -> np.ndarray:
    """Blocks of every source in ``shard``: the totals split down a binary tree of shard ranges.

    Each split draws the left half's composition (a multivariate hypergeometric of its block count) seeded by the
    range alone, so every shard below it sees the same draw, and the shards' counts add up to the totals.
    """
    lo, hi = 0, -(-slots // shard_blocks)
    counts = np.asarray(totals, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = min(mid * shard_blocks, slots) - lo * shard_blocks
        drawn = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(counts, left)
        if shard < mid:
            counts, hi = drawn, mid
        else:
            counts, lo = counts - drawn, mid
    return counts


def _draws(totals: list[int], slots: int, shard_blocks: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [pd.DataFrame({"shard": pd.Series([], dtype="int64"), "src": pd.Series([], dtype="int32"),
                                 "cnt": pd.Series([], dtype="int64")})]
            for h in pdf["id"].tolist():
                got = shard_counts(h, np.asarray(totals, np.int64), slots, shard_blocks, seed)
                nz = np.flatnonzero(got)
                out.append(pd.DataFrame({"shard": np.full(len(nz), h, np.int64), "src": nz.astype(np.int32),
                                         "cnt": got[nz].astype(np.int64)}))
            yield pd.concat(out)

    return run


def _blocks_of_slots(nb: list[int], seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.empty(len(pdf), np.int64)
            for s, idx in pdf.groupby("src").indices.items():
                n = nb[int(s)]
                out[idx] = permute(pdf["slot"].to_numpy(np.int64)[idx], CAP * n, seed * 1_000_003 + int(s)) % n
            yield pd.DataFrame({"src": pdf["src"].to_numpy(np.int32), "block": out})

    return run


def mix(docs: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) of every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col("doc_id"), F.col("text"), F.col("source"), F.lit(seed)).alias("_o"))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    if per_source.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = per_source.collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.source_size) for r in found]
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))]
    goal = targets(sizes, weights)
    total = sum(sizes)
    nb = [-(-s // block) for s in sizes]
    srcs = spark.createDataFrame(
        [(i, r.source, sizes[i], float(goal[i])) for i, r in enumerate(found)],
        "src int, source string, source_size long, target double")
    keyed = srcs.select("src", F.col("source").alias("_source"))
    placed = running_sum(rows.join(F.broadcast(keyed), rows.source.eqNullSafe(keyed._source)).drop("_source", "source"),
                         "src", ["_o", "doc_id", "size"], "size", "off", "mix-docs")
    placed = materialize(placed.withColumn("_row", F.monotonically_increasing_id()), "mix-placed")

    totals = slot_totals(goal, sizes, nb)
    slots = sum(totals)
    shards = -(-slots // shard_blocks)
    counts = spark.range(shards, numPartitions=max(1, min(shards, 4096))).mapInPandas(
        _draws(totals, slots, shard_blocks, seed), "shard long, src int, cnt long")
    numbered = running_sum(counts, "src", ["shard"], "cnt", "first", "mix-shards")
    slot_rows = numbered.select("src", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("cnt") - 1)).alias("slot"))
    taken_blocks = (slot_rows.mapInPandas(_blocks_of_slots(nb, seed), "src int, block long")
                    .groupBy("src", "block").agg(F.count(F.lit(1)).alias("times")))

    spans = (placed.where(F.col("size") > 0)
             .select("_row", "src", "off", "size",
                     F.explode(F.sequence(F.expr(f"off div {block}"), F.expr(f"(off + size - 1) div {block}"))).alias("block")))
    lo = F.greatest(F.col("off"), F.col("block") * block)
    hi = F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * block)
    taken = (spans.join(taken_blocks, ["src", "block"])
             .groupBy("_row").agg(F.sum((hi - lo) * F.col("times")).alias("taken")))
    return (placed.join(taken, "_row", "left").join(F.broadcast(srcs), "src")
            .select("doc_id", "size", "source_size", "target",
                    F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"), "source"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


@query("op12_mixing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
