"""Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: chosen-path join.

Sets that are equal are one set with a weight.  Each run sends every set down a tree: a node draws a MinHash
function (and, one time in four, a second one, so that 1 / 0.8 children are expected) and hands the set to the
child of its smallest shingle; sets that share many shingles share paths.  Buckets of a few sets are compared all
with all by their signatures; larger ones first compare every set with one pivot, drop those that nearly equal
it, whose other links the pivot has too, and split the rest further.  Sets that are linked to one pivot already
need no comparison among themselves: buckets of these alone end there, and those with few others end with these
compared to all.  Runs repeat until the chance of losing a pair of exactly the threshold is below the target.

The links so found only say which sets belong together.  All pairs within a component are then verified by exact
similarity, in cells of bounded size that give counts and spanning links, never pairs.  So links are counted
exactly however a component was found.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescast.llm.components import components
from seriescast.llm.registry import digest, query, table, texts
from seriescast.sources.storage import materialize

WORD = re.compile(r"[^\W_]+")
WIDTH = 5
JACCARD = 0.8
RECALL = 0.999
SIGNATURE = 64
LEAF = 256
#: Sets of one label that fewer than LEAF others are compared to at once.
WIDE = 16 * LEAF
DEPTH = 10
#: Pairs whose signatures agree less are not linked: four standard deviations below the threshold.
ESTIMATE = JACCARD - 4 * math.sqrt(JACCARD * (1 - JACCARD) / SIGNATURE)
#: Sets that agree so much with a pivot leave the tree: what is linked to them is also linked to the pivot.
SAME = 0.92
CELL_SETS, CELL_SHINGLES = 512, 200_000
KNOWN_WORDS = 200_000
#: Up to so many sets to verify (24 bytes each) are broadcast to find their texts; beyond, both sides are shuffled.
BROADCAST_SETS = 1_000_000

# Odd multipliers of the hashes: any will do.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
A = (np.random.default_rng(7).integers(1, 1 << 63, SIGNATURE, np.uint64) << np.uint64(1)) | np.uint64(1)
B = np.random.default_rng(8).integers(0, 1 << 63, SIGNATURE, np.uint64)


def runs_for(recall: float, jaccard: float, depth: int = 3) -> int:
    """Runs after which a pair at the threshold is missed with a chance below 1 - recall, at a usual depth."""
    found = jaccard ** depth
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))


class _Words(dict):
    def __missing__(self, w: str) -> int:
        import xxhash

        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w.encode())
        return h


def shingles(text: str, known: _Words, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of runs of words, sorted; a shorter text is one run, a text without words has none."""
    found = WORD.findall(text.lower())
    w = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = max(1, len(w) - width + 1) if len(w) else 0
    h = np.zeros(n, np.uint64)
    for k in range(min(width, len(w))):
        h = (h ^ w[k:k + n]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(h: np.ndarray) -> np.ndarray:
    """The least value of each hash function, in blocks so that memory stays bounded."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 8192):
        part = h[at:at + 8192]
        least = np.minimum(least, (part[None, :] * A[:, None] + B[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype("<u4")


SIGNED = "doc_id long, digest long, key long, n long, sig binary"


def _sign():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = _Words()
        for b in batches:
            keys, sizes, sigs = [], [], []
            for t in b.column("text"):
                h = shingles(t.as_py(), known)
                keys.append(xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63))
                sizes.append(len(h))
                sigs.append(signature(h).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("digest"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(sigs, pa.binary())], ["doc_id", "digest", "key", "n", "sig"])

    return run


def _mixed(*values: np.ndarray) -> np.ndarray:
    h = np.zeros(len(values[0]), np.uint64)
    for v in values:
        h = (h ^ v.astype(np.uint64)) * MULTIPLIER
        h ^= h >> np.uint64(31)
    return h


def children(paths: np.ndarray, sigs: np.ndarray, jaccard: float, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Rows and paths of the children of (path, signature) rows; what a node draws depends on its path alone."""
    paths = paths.view(np.uint64)
    every, at = [], np.arange(len(paths))
    for k in range(most):
        drawn = _mixed(paths, np.full(len(paths), k + 1))
        which = (drawn % np.uint64(SIGNATURE)).astype(np.int64)
        child = _mixed(paths, which, sigs[at, which])
        chosen = at if k == 0 else at[(drawn >> np.uint64(40)) % np.uint64(1000) < int(1000 * (1 / jaccard - 1))]
        every.append((chosen, child[chosen]))
    return np.concatenate([e[0] for e in every]), np.concatenate([e[1] for e in every]).view(np.int64)


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, SIGNATURE)


def _roots(runs: int, jaccard: float):
    """The first two levels of each run, without branching: one shared passage then fills few buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                sigs, keys = _signatures(b.column("sig")), b.column("key").to_numpy()
                for r in range(runs):
                    paths = _mixed(np.full(len(keys), r + 1)).view(np.int64)
                    for _ in range(2):
                        _, paths = children(paths, sigs, jaccard, most=1)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(paths)], ["key", "path"])

    return run


def _split(jaccard: float):
    """Links of each set to its bucket's pivot, and the paths on which the others go on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sigs, keys, paths = _signatures(b.column("sig")), b.column("key").to_numpy(), b.column("path").to_numpy()
            pivot = b.column("pivot").to_numpy()
            agree = (sigs == _signatures(b.column("pivot_sig"))).mean(axis=1)
            linked = (agree >= ESTIMATE) & (keys != pivot)
            on = np.flatnonzero((agree < SAME) | (keys == pivot))
            rows, down = children(paths[on], sigs[on], jaccard)
            label, of_pivot = b.column("label").to_numpy(), b.column("pivot_label").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([keys[linked], keys[on][rows]])), pa.array(np.concatenate([pivot[linked], down])),
                 pa.array(np.concatenate([of_pivot[linked], label[on][rows]])),
                 pa.array(np.arange(linked.sum() + len(rows)) < linked.sum())], ["key", "to", "label", "is_link"])

    return run


class _Sets:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def _spanning(near: np.ndarray) -> np.ndarray:
    """Root of each row of a symmetric matrix of links."""
    sets = _Sets(len(near))
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        sets.join(int(i), int(j))
    return np.array([sets.root(i) for i in range(len(near))], np.int64)


def _compare(bucket: pa.Table) -> pa.Table:
    """Spanning links between the labels of a bucket by its signatures; pairs of the commonest label need none."""
    labels, at, times = np.unique(bucket.column("label").to_numpy(), return_inverse=True, return_counts=True)
    sigs, joined = _signatures(bucket.column("sig")), _Sets(len(labels))
    for i in np.flatnonzero(at != times.argmax()):
        for j in np.unique(at[(sigs == sigs[i]).mean(axis=1) >= ESTIMATE]):
            joined.join(int(at[i]), int(j))
    root = np.array([joined.root(i) for i in range(len(labels))], np.int64)
    some = root != np.arange(len(root))
    return pa.table({"a": labels[some], "b": labels[root[some]]})


def _only(sigs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """The signatures of the keys in ``rows``, stored: joins on each level then move these alone."""
    keys = materialize(rows.select("key").distinct(), "keys")
    few = keys.count() <= BROADCAST_SETS
    return materialize(sigs.join(F.broadcast(keys) if few else keys, "key", "left_semi"), name)


def _sizes(rows: DataFrame, level: int) -> DataFrame:
    """(path, size, pivot, pivot_label, most, common) of buckets with several labels; ``most`` sets have the label ``common``."""
    first = F.min(F.struct("key", "label")).alias("first")
    if level == 1:  # every set is its own label
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"), first, F.lit(1).cast("long").alias("most"), F.min("label").alias("common"))
    else:
        sizes = rows.groupBy("path", "label").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).groupBy("path").agg(
            F.sum("n").alias("size"), first, F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("common"))
    return sizes.filter("size > most").select("path", "size", F.col("first.key").alias("pivot"), F.col("first.label").alias("pivot_label"), "most", "common")


def candidate_links(sets: DataFrame, jaccard: float, runs: int, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """Links (a, b) between keys of ``sets`` (key, sig) that the tree finds.

    A set's label is the least set that links lead to so far, through pivots' labels, or itself.  Sets of one label are already together, so
    buckets of a single label can't join anything and end; so do those where fewer than ``leaf`` sets have another label than the commonest:
    these are compared with all, which is cut into blocks.
    """
    sigs = sets.select("key", "sig")
    rows = materialize(sigs.mapInArrow(_roots(runs, jaccard), "key long, path long"), "paths").withColumn("label", F.col("key"))
    leaves, links = [], []
    for level in range(1, depth + 1):
        rows = materialize(rows.join(_sizes(rows, level), "path"), "buckets")
        blocks = F.ceil(F.col("size") / max(leaf, WIDE)).cast("int")
        own = F.array(F.pmod(F.xxhash64("key"), blocks).cast("int"))
        common = F.col("label") == F.col("common")
        leaves.append(rows.filter(F.col("size") - F.col("most") < leaf).select(
            "path", "key", "label", F.explode(F.when(common, own).otherwise(F.sequence(F.lit(0), blocks - 1))).alias("cell")))
        big = rows.filter(F.col("size") - F.col("most") >= leaf)
        if level == 1:
            sigs = _only(sigs, rows, "bucket-signatures")
        if big.isEmpty():
            break
        if level == depth:  # what no split takes apart is compared block by block
            blocks = F.ceil(F.col("size") / leaf).cast("int")
            own = F.pmod(F.xxhash64("key"), blocks).cast("int")
            leaves.append(big.select("path", "key", "label", F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: (
                F.least(own, o) * blocks + F.greatest(own, o) + 1).cast("int"))).alias("cell")))
            break
        if level == 1:  # the sets of later levels are among these
            split = _only(sigs, big, "split-signatures")
        pivots = split.select(F.col("key").alias("pivot"), F.col("sig").alias("pivot_sig"))
        known = big.join(split, "key").join(pivots, "pivot")
        moved = materialize(known.mapInArrow(_split(jaccard), "key long, to long, label long, is_link boolean"), "moved")
        new = moved.filter("is_link")
        links.append(new.select(F.col("key").alias("a"), F.col("to").alias("b")))
        linked = new.groupBy("key").agg(F.min("label").alias("linked"))
        rows = moved.filter("NOT is_link").join(linked, "key", "left").select(
            "key", F.col("to").alias("path"), F.least("label", "linked").alias("label"))
    every = leaves[0]
    for more in leaves[1:]:
        every = every.unionByName(more)
    found = every.join(sigs, "key").groupBy("path", "cell").applyInArrow(_compare, "a long, b long")
    for more in links:
        found = found.unionByName(more)
    return found.distinct()


SHINGLED = "key long, hashes array<long>"


def _shingle():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array([shingles(t.as_py(), known).view(np.int64) for t in b.column("text")],
                                           pa.list_(pa.int64()))], ["key", "hashes"])

    return run


def similar(sets: list[np.ndarray], jaccard: float) -> np.ndarray:
    """Which pairs of sets have the similarity, exactly."""
    n = np.array([len(s) for s in sets])
    inverse = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), n)
    shared = np.bincount(inverse)[inverse] > 1  # others are in no intersection
    column = np.unique(inverse[shared], return_inverse=True)[1]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (lo, lo + 4096))
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        both += m @ m.T
    return both >= jaccard * (n[:, None] + n[None, :] - both) - 1e-6


def _verify(jaccard: float):
    """Links of a cell: for each set the weight it is linked to, and a root among its sets."""
    def run(cell: pa.Table) -> pa.Table:
        keys, weight, side = (cell.column(c).to_numpy() for c in ("key", "weight", "side"))
        order = np.argsort(keys)
        keys, weight, side = keys[order], weight[order], side[order]
        values = cell.column("hashes").combine_chunks()
        near = similar([values[int(i)].values.to_numpy() for i in order], jaccard)
        np.fill_diagonal(near, False)
        if cell.column("cross")[0].as_py():  # pairs within a block belong to the block's own cell
            near &= side[:, None] != side[None, :]
        return pa.table({"key": keys, "links": near @ weight, "root": keys[_spanning(near)]})

    return run


def first_row(doc_id: str = "doc_id") -> Column:
    """Orders rows by id, those without one last, then by text."""
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"), F.col("digest"))


def jaccard_classes(docs: DataFrame, jaccard: float = JACCARD, recall: float = RECALL) -> DataFrame:
    """(doc_id, digest, first, n_links) of each row of ``docs``: its class and its number of links.

    ``first`` is the class's first row by id (ids that are null last) as (no_id, doc_id, digest).  ``n_links``
    counts the other rows that are similar, copies included; repeated rows are copies of each other.  Texts of
    fewer than five words are one shingle; texts without words, null ones too, are in no class but their own and
    have no links.
    """
    rows = materialize(texts(docs).withColumn("digest", digest()).mapInArrow(_sign(), SIGNED), "signatures")
    full = rows.filter("n > 0")
    sets = materialize(full.groupBy("key").agg(
        F.count(F.lit(1)).alias("weight"), F.min(first_row()).alias("one"), F.first("n").alias("n"),
        F.first("sig").alias("sig")), "sets")
    found = components(candidate_links(sets, jaccard, runs_for(recall, jaccard)))
    held = materialize(found.withColumnRenamed("node", "key").join(sets.drop("sig"), "key"), "members")
    # the shingles of one row of each set
    wanted = held.select("key", F.col("one.doc_id").alias("id"), F.col("one.digest").alias("mark"))
    if held.count() <= BROADCAST_SETS:  # so that the texts of all documents need no shuffle
        wanted = F.broadcast(wanted)
    source = texts(docs).withColumn("digest", digest()).alias("d").join(
        wanted.alias("w"), F.expr("d.doc_id <=> w.id AND d.digest = w.mark")).select("w.key", "d.text")
    shingled = source.mapInArrow(_shingle(), SHINGLED).dropDuplicates(["key"])
    blocks = held.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / CELL_SHINGLES), F.ceil(
        F.count(F.lit(1)) / CELL_SETS)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    cells = (held.join(blocks, "root").withColumn("side", own).select(
        "root", "key", "weight", "side", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
            F.least(F.col("side"), o).alias("i"), F.greatest(F.col("side"), o).alias("j")))).alias("c"))
        .select("root", "key", "weight", "side", "c.i", "c.j", (F.col("c.i") != F.col("c.j")).alias("cross")))
    checked = materialize(cells.join(shingled, "key").groupBy("root", "i", "j").applyInArrow(
        _verify(jaccard), "key long, links long, root long"), "verified")
    classes = components(checked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    classes = classes.withColumnRenamed("node", "key")
    linked = checked.groupBy("key").agg(F.sum("links").alias("links"))
    firsts = classes.join(sets.select("key", "one"), "key").groupBy("root").agg(F.min("one").alias("first"))
    of_key = sets.select("key", "weight", "one").join(classes.join(firsts, "root").select("key", "first"), "key", "left").join(
        linked, "key", "left").select("key", F.coalesce("first", "one").alias("first"),
                                      (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = full.select("doc_id", "digest", "key").join(of_key, "key").select("doc_id", "digest", "first", "n_links")
    alone = rows.filter("n = 0").select("doc_id", "digest", first_row().alias("first"), F.lit(0).cast("long").alias("n_links"))
    return named.unionByName(alone)


def stage_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, the first by id; texts without words are in no class and stay."""
    classes = materialize(jaccard_classes(docs), "classes")
    lost = classes.filter(~F.expr("doc_id <=> first.doc_id AND digest = first.digest")).select(
        F.col("doc_id").alias("lost_id"), F.col("digest").alias("lost_digest")).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = docs.join(lost, F.expr("CAST(doc_id AS LONG) <=> lost_id") & (digest(text) == F.col("lost_digest")), "left_anti")
    repeated = materialize(classes.filter("n_links > 0").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
                           .filter("n > 1").select(F.col("doc_id").alias("lost_id"), F.col("digest").alias("lost_digest")), "repeated")
    if repeated.isEmpty():
        return kept
    again = F.expr("CAST(doc_id AS LONG) <=> lost_id") & (digest(text) == F.col("lost_digest"))
    return kept.join(repeated, again, "left_anti").unionByName(
        kept.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "text"]))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws
  FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 4], ' ')) AS h FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE k >= 0.8 * (na.n + nb.n - k)),
r AS (SELECT a AS doc_id, a AS c FROM (SELECT DISTINCT a FROM e) UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce((SELECT min(c) FROM r WHERE r.doc_id = d.doc_id), d.doc_id) AS class_id,
       (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_links
FROM documents d"""


@query("op7_ngram_jaccard", SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "n_links")
