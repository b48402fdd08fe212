"""Phrase collocations per language, mined level by level through a broadcast trie of frequent phrases.

Texts are lower-cased in A-Z only (a null text is empty), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces, and pieces
into words, the runs of ``[^\\x20\\x09]+``.  Per language (null: ``und``), ``n`` counts all word occurrences and
f(phrase) all contiguous occurrences of a phrase inside one piece, overlapping ones included.

Method.  Level 1 counts (lang, word): a task cuts the bytes of a slice of texts in numpy (all cuts are ASCII), an
Arrow dictionary numbers the words, and Spark sums the counts of the slices.  A phrase can reach ``MIN_COUNT`` only
if each of its shorter parts does (Apriori), so the trie holds only frequent phrases: the frequent words of every
language are its first level (state = word id), the frequent word pairs its second.  Texts are turned once into
arrays of word ids (0 for a rare word and after every piece) and stored.  For each level a task numbers the distinct
pairs of a slice of ids, advances the trie by these alone (in key order, so the search stays in cache), and
positions whose prefix and suffix are both frequent give a key (prefix, next word).  Keys are counted per slice,
parted by a hash, sent as arrays, and added up part by part in numpy.  A level's keys are not listed before
counting, since candidates joined from frequent parts would pair every left with every right neighbour of a common
word.

The levels are sorted arrays of keys ``parent * span + word`` searched with ``np.searchsorted`` (logarithmic)
rather than a double array (``base + word``, constant): children of common words span the whole vocabulary, and a
double array placed by first fit grew past the driver's 1500 MB on 0.5 GB in the check tool (commit 8baa98d).

The trie is shipped only when its node count is at most ``TRIE_NODES`` (8 bytes a pair and a word's text in the
tasks).  With more frequent pairs than that the tasks get a filter of ``FILTER_BITS`` hashed bits that passes all of
them; what it passes besides is counted exactly too and drops out by its count.  With more frequent words the same
counts come from ``ngram_counts_native``, an exact Spark count of every 2- and 3-word window, which is also the
brute force of the tests.  Phrases are decoded from keys by joins in Spark.

Scores.  A candidate is a phrase of 2 or 3 words with a = f >= ``MIN_COUNT``.  Each cut after k words gives
l = f(first part), r = f(rest) and floor(1e6 a^2 / (l r)); the lowest counts, ties to the smallest k.  Arithmetic
is exact in decimal(38, 0) (a <= l and a <= r, so the score fits a long).  A pair lying inside a 3-word candidate
with 2 f(longer) >= a is dropped.  Each language keeps its first ``TOP`` by score desc, a desc, phrase asc (UTF-8
bytes), ranked in two steps (per salt, then per language) so no task holds all candidates of a hot language.

Edge cases: an empty table gives no rows; null and empty texts give no words; rows repeated count as often as
they stand; very long texts are processed whole (one id array per Arrow batch); other columns of the input are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriescast.llm.registry import ORACLES, query, table
from seriescast.sources.storage import materialize

# Fixed values of the contract.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
PIECE_SPLIT = r"[.,;:!?\x0A-\x0D]"
WORD_SPLIT = r"[\x20\x09]+"
MIN_COUNT = 10
LONGEST = 3
TOP = 2000
KEEP_LONGER = 50  # percent: a pair goes when 100 * f(longer) >= KEEP_LONGER * a

#: Largest trie shipped to the tasks; beyond it pairs are told by a filter, and with more words the exact Spark count runs.
TRIE_NODES = 8_000_000
FILTER_BITS, FILTER_PARTS = 1 << 28, 64
#: About so many bytes of text, and so many ids, are held as arrays at once.
SLICE_BYTES, SLICE_IDS = 6 << 20, 1_000_000
#: Parts in which the keys of a level are added up: at least so many, and one for about so many words.
PARTS, PART_WORDS = 256, 2_000_000
#: Ranking in two steps: candidates of a language are first ranked in this many parts.
RANK_SALTS = 64

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Of a byte: 0 inside words, 1 between words, 2 between pieces.
_KIND = bytes(2 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 1 if chr(c) in " \t" else 0 for c in range(256))
#: Odd factor that spreads keys over the high bits of 64.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _lang() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")


def _pieces(docs: DataFrame) -> DataFrame:
    """(lang, ws): the words of each piece, as arrays."""
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    return (docs.select(_lang(), F.explode(F.split(lowered, PIECE_SPLIT)).alias("piece"))
            .select("lang", F.filter(F.split("piece", WORD_SPLIT), lambda w: w != "").alias("ws"))
            .where(F.size("ws") > 0))


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Texts of about ``SLICE_BYTES`` at a time, cut into words.

    Each: place of the first text, words before each text and in all, the distinct words, each word's number among
    them, and whether the word ends a piece.
    """
    texts = texts.cast(pa.large_binary())
    texts = texts.fill_null(b"") if texts.null_count else texts
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    first = 0
    while first < len(texts):
        upto = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        own = offsets[first:upto + 1] - offsets[first]
        low = b"" if data is None else data[int(offsets[first]):int(offsets[upto])].to_pybytes().translate(_LOWER)
        kind = np.frombuffer(low.translate(_KIND), np.uint8)
        inside, cut = kind == 0, kind == 2
        cut[own[:-1][own[:-1] < own[1:]]] = True  # a text's first byte begins a piece
        begins = inside & cut
        begins[1:] |= inside[1:] & ~inside[:-1]
        if len(inside):
            begins[0] = inside[0]
        ends = np.append(~inside[1:] | begins[1:], True)[:len(inside)] & inside
        starts = np.flatnonzero(begins)
        at = np.append(0, np.cumsum(np.flatnonzero(ends) + 1 - starts))
        piece = np.cumsum(cut, dtype=np.int32)[starts]
        before = np.searchsorted(starts, own)
        letters = np.frombuffer(low, np.uint8)[inside]
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
        yield (first, before, found.dictionary.cast(pa.large_string()), found.indices.to_numpy(zero_copy_only=False),
               np.append(piece[1:] != piece[:-1], True)[:len(starts)])
        first = upto


def _languages(column: pa.Array, first: int, before: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Languages, and the number of each word's language among them."""
    langs = column.slice(first, len(before) - 1).dictionary_encode()
    return langs.dictionary, np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(before))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f) of each slice."""
    for b in batches:
        for first, before, words, code, _ in _slices(b.column("text")):
            langs, lang = _languages(b.column("lang"), first, before)
            keys, counts = np.unique(lang * len(words) + code, return_counts=True)
            lang, code = np.divmod(keys, max(1, len(words)))
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang)).cast(pa.string()),
                                              words.take(pa.array(code)).cast(pa.string()), pa.array(counts, pa.int64())],
                                             ["lang", "word", "f"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(_lang(), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of every word."""
    return _texts(docs).mapInArrow(_word_rows, "lang string, word string, f long").groupBy("lang", "word").agg(
        F.sum("f").alias("f"))


def ngram_counts_native(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, words, f) of every phrase of 2..``longest`` words with f >= ``min_count``, by a plain Spark count."""
    pieces = _pieces(docs)
    grams = []
    for k in range(2, longest + 1):
        starts = F.sequence(F.lit(0), F.size("ws") - k)
        grams.append(pieces.where(F.size("ws") >= k).select(
            "lang", F.explode(F.transform(starts, lambda i: F.slice("ws", i + 1, k))).alias("words")))
    out = grams[0]
    for g in grams[1:]:
        out = out.unionByName(g)
    return out.groupBy("lang", "words").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= min_count)


class TrieLevels:
    """The trie of frequent phrases, one sorted array of keys ``parent * span + word`` per level above the first.

    State 0 is the root, states 1..V are the words (a word's id), and the states of a level follow those of the
    level below in key order.  ``step`` finds the children of all positions at once with ``np.searchsorted``.
    """

    def __init__(self, words: int):
        self.span = words + 1
        self.levels: list[tuple[np.ndarray, int]] = []
        self.size = self.span

    def add_level(self, keys: np.ndarray) -> None:
        """Adds the sorted keys ``parent * span + word`` of a level; their states follow in that order."""
        self.levels.append((np.asarray(keys, np.int64), self.size))
        self.size += len(keys)

    def step(self, states: np.ndarray, ids: np.ndarray, level: int = 0) -> np.ndarray:
        """The child of every state by the id beside it in the ``level``-th added level, 0 where there is none."""
        keys, first = self.levels[level]
        wanted = states * self.span + ids
        at = np.searchsorted(keys, wanted)
        ok = (states > 0) & (ids > 0) & (at < len(keys))
        ok[ok] = keys[at[ok]] == wanted[ok]
        return np.where(ok, first + at, 0)


class PairFilter:
    """``FILTER_BITS`` bits: those of the hashed keys it was made of are set."""

    def __init__(self, bits: np.ndarray, words: int):
        self.bits, self.span = bits, words + 1

    @staticmethod
    def places(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - (FILTER_BITS.bit_length() - 1))).astype(np.int64)

    def step(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Above 0 for every pair the filter passes."""
        at = self.places(states * self.span + ids)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1

    @staticmethod
    def of(pairs: DataFrame, words: int) -> PairFilter:
        """The filter of the pairs (head, last): bits are set part by part in tasks, and joined on the driver."""
        size = FILTER_BITS // FILTER_PARTS

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.sort(PairFilter.places(b.column("head").to_numpy() * (words + 1) + b.column("last").to_numpy()))
                cuts = np.searchsorted(at, np.arange(FILTER_PARTS + 1) * size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(FILTER_PARTS), pa.int64()),
                     pa.array([(at[a:e] % size).astype(np.int32).tobytes() for a, e in zip(cuts, cuts[1:])], pa.binary())],
                    ["part", "places"])

        def merged(rows: pa.Table) -> pa.Table:
            own = np.zeros(size, np.bool_)
            for p in rows.column("places"):
                own[np.frombuffer(p.as_py(), np.int32)] = True
            return pa.table({"part": rows.column("part")[:1], "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        made = pairs.select("head", "last").mapInArrow(placed, "part long, places binary").groupBy("part").applyInArrow(
            merged, "part long, bits binary").toArrow()
        for part, own in zip(made.column("part").to_pylist(), made.column("bits")):
            bits[part * size // 8:(part + 1) * size // 8] = np.frombuffer(own.as_buffer(), np.uint8)
        return PairFilter(bits, words)


def _id_rows(vocab: dict[str, pa.Array], offsets: dict[str, int]):
    """Each text as little-endian int32 word ids, 0 for rare words, one 0 after every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, before, words, code, last in _slices(b.column("text")):
                langs, lang = _languages(b.column("lang"), first, before)
                ids = np.zeros(len(code), "<i4")
                for at, name in enumerate(langs.to_pylist()):
                    if name in vocab:
                        known = pc.fill_null(pc.index_in(words, vocab[name].cast(pa.large_string())), -1).to_numpy()
                        known = np.where(known >= 0, known + offsets[name], 0).astype("<i4")
                        mine = lang == at
                        ids[mine] = known[code[mine]]
                cuts = np.append(0, np.cumsum(last))
                out = np.zeros(len(ids) + int(cuts[-1]), "<i4")
                out[np.arange(len(ids)) + cuts[:-1]] = ids
                ends = ((before + cuts[before]) * 4).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(ends) - 1, [
                    None, pa.py_buffer(ends), pa.py_buffer(out)])], ["ids"])

    return run


def _batch_ids(column: pa.Array) -> np.ndarray:
    """All ids of a batch as one int32 view of the Arrow buffer, no copy: every text ends with a 0."""
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or ends[-1] == ends[0]:
        return np.empty(0, np.int32)
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view("<i4")


def _chunks(ids: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Slices of about ``size`` ids, each ending after a 0, so that no phrase is cut."""
    start = 0
    while start < len(ids):
        end = min(start + size, len(ids))
        if end < len(ids):
            end += int(np.argmax(ids[end - 1:] == 0))
        yield ids[start:end]
        start = end


KEYS = "part long, heads binary, lasts binary, counts binary"


def _level_keys(trie: TrieLevels | PairFilter, level: int, parts: int):
    """Counts per slice of (prefix, next word id), as arrays (heads, lasts, counts) of each of ``parts`` parts of the keys.

    Prefix and suffix are frequent.  A head is the first word's id at level 2 and the key of the first two words at
    level 3.
    """
    span = trie.span

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _chunks(_batch_ids(b.column("ids")), SLICE_IDS):
                ids = part.astype(np.int64)
                at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
                pairs = ids[at] * span + ids[at + 1]
                if level == 2:
                    keys, counts = np.unique(pairs, return_counts=True)
                    heads, lasts = np.divmod(keys, span)
                else:
                    pairs, number = np.unique(pairs, return_inverse=True)
                    frequent = trie.step(*np.divmod(pairs, span)) > 0
                    prefix = np.full(len(ids), -1)
                    prefix[at] = np.where(frequent[number], number, -1)
                    at = np.flatnonzero((prefix[:-1] >= 0) & (prefix[1:] >= 0))
                    keys, counts = np.unique(prefix[at] * span + ids[at + 2], return_counts=True)
                    heads, lasts = np.divmod(keys, span)
                    heads = pairs[heads]
                spread = ((heads * span + lasts).astype(np.uint64) * _SPREAD) >> np.uint64(32)
                to = (spread % np.uint64(parts)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(parts + 1))
                own = np.flatnonzero(np.diff(cuts))
                columns = [(heads[order].astype("<i8")), (lasts[order].astype("<i4")), (counts[order].astype("<i4"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), *(pa.array([c[cuts[p]:cuts[p + 1]].tobytes() for p in own], pa.binary()) for c in columns)],
                    ["part", "heads", "lasts", "counts"])

    return run


def _added_up(span: int, min_count: int):
    """(head, last, f) of the keys of one part with f >= ``min_count``."""

    def run(rows: pa.Table) -> pa.Table:
        heads, lasts, counts = (np.concatenate([np.frombuffer(v.as_py(), kind) for v in rows.column(c)])
                                for c, kind in (("heads", "<i8"), ("lasts", "<i4"), ("counts", "<i4")))
        heads, number = np.unique(heads, return_inverse=True)
        keys = number * span + lasts
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        f = np.add.reduceat(counts[order].astype(np.int64), first)
        keys, f = keys[first][f >= min_count], f[f >= min_count]
        return pa.table({"head": pa.array(heads[keys // span], pa.int64()), "last": pa.array(keys % span, pa.int64()),
                         "f": pa.array(f, pa.int64())})

    return run


def ngram_counts_trie(docs: DataFrame, words: DataFrame, min_count: int = MIN_COUNT,
                      trie_nodes: int = TRIE_NODES) -> DataFrame | None:
    """(lang, words, f) as ``ngram_counts_native``, through the trie; None where its words would pass ``trie_nodes``.

    The driver holds the frequent words as Arrow arrays and the pairs' sorted keys as one numpy array, or where the
    trie would pass ``trie_nodes`` the filter of the pairs.
    """
    spark = docs.sparkSession
    frequent = words.where(F.col("f") >= min_count)
    if frequent.count() > trie_nodes:
        return None
    # ids run language by language; the words go to the tasks with the function (broadcast by PySpark)
    table_ = frequent.orderBy("lang", F.col("f").desc(), "word").select("lang", "word").toArrow()
    langs = table_.column("lang").combine_chunks().dictionary_encode()
    codes = langs.indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(codes)]
    word_col = table_.column("word").combine_chunks()
    # taken, not sliced: a pickled slice carries its whole parent buffer
    vocab = {langs.dictionary[int(codes[a])].as_py(): word_col.take(pa.array(np.arange(a, b))) for a, b in zip(starts, ends)}
    offsets = {langs.dictionary[int(codes[a])].as_py(): int(a) + 1 for a in starts}
    # the same ids in Spark, so that no table of words is made on the driver (one task: at most TRIE_NODES rows)
    names = frequent.select("lang", "word", F.row_number().over(
        Window.orderBy("lang", F.col("f").desc(), "word")).cast("long").alias("id"))
    trie = TrieLevels(len(codes))
    coded = materialize(_texts(docs).mapInArrow(_id_rows(vocab, offsets), "ids binary"), "collocation-ids")
    del table_, word_col
    parts = max(PARTS, (words.agg(F.sum("f")).first()[0] or 0) // PART_WORDS)
    found = []
    for level in range(2, LONGEST + 1):
        counted = materialize(coded.mapInArrow(_level_keys(trie, level, parts), KEYS).groupBy("part").applyInArrow(
            _added_up(trie.span, min_count), "head long, last long, f long"), f"collocations-{level}")
        found.append(counted)
        if level < LONGEST and counted.count() + trie.size > trie_nodes:
            trie = PairFilter.of(counted, len(codes))
        elif level < LONGEST:
            keys = counted.select((F.col("head") * trie.span + F.col("last")).alias("k")).toArrow().column("k")
            trie.add_level(np.sort(keys.to_numpy()))
    span = trie.span
    pairs = found[0].select(F.col("head").alias("i1"), F.col("last").alias("i2"), F.lit(None).cast("long").alias("i3"), "f")
    triples = found[1].select(F.expr(f"head div {span}").alias("i1"), F.expr(f"head % {span}").alias("i2"),
                              F.col("last").alias("i3"), "f")
    out = pairs.unionByName(triples)
    for i in ("i1", "i2", "i3"):
        out = out.join(names.select(F.col("id").alias(f"_{i}"), F.col("lang").alias(f"{i}_lang"), F.col("word").alias(f"{i}_word")),
                       F.col(i) == F.col(f"_{i}"), "left").drop(f"_{i}")
    return out.select(F.col("i1_lang").alias("lang"),
                      F.when(F.col("i3").isNull(), F.array("i1_word", "i2_word"))
                      .otherwise(F.array("i1_word", "i2_word", "i3_word")).alias("words"), "f")


def _score(k: int) -> Column:
    """floor(1e6 a^2 / (l r)) of cut ``k``, exact: integral division of decimals."""
    d = "decimal(38,0)"
    return F.expr(f"(cast(1000000 as {d}) * cast(a as {d}) * cast(a as {d})) div (cast(l{k} as {d}) * cast(r{k} as {d}))")


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, trie_nodes: int = TRIE_NODES,
                 use_trie: bool = True) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` collocations."""
    words = materialize(word_counts(docs), "collocation-words")
    grams = ngram_counts_trie(docs, words, min_count, trie_nodes) if use_trie else None
    if grams is None:
        grams = ngram_counts_native(docs, LONGEST, min_count)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    grams = grams.select("lang", "words", F.col("f").alias("a"), F.array_join("words", " ").alias("phrase"),
                         F.size("words").alias("len"))
    # frequencies of every part a cut can give: frequent words and pairs
    parts = (words.where(F.col("f") >= min_count).select("lang", F.col("word").alias("p"), F.col("f").alias("fp"))
             .unionByName(grams.where(F.col("len") == 2).select("lang", F.col("phrase").alias("p"), F.col("a").alias("fp"))))
    cands = grams
    for k in (1, 2):
        cands = (cands.withColumn(f"h{k}", F.when(F.col("len") > k, F.array_join(F.slice("words", 1, k), " ")))
                 .withColumn(f"t{k}", F.when(F.col("len") > k, F.array_join(F.slice("words", k + 1, LONGEST), " "))))
    return _finish(cands, parts, totals, top)


def _finish(cands: DataFrame, parts: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    for k in (1, 2):
        for side, col in (("l", f"h{k}"), ("r", f"t{k}")):
            look = parts.select(F.col("lang").alias("_lang"), F.col("p").alias("_p"), F.col("fp").alias(f"{side}{k}"))
            cands = cands.join(look, (F.col("lang") == F.col("_lang")) & (F.col(col) == F.col("_p")), "left").drop("_lang", "_p")
    s1, s2 = _score(1), _score(2)
    second = (F.col("len") > 2) & (s2 < s1)
    scored = cands.select("lang", "words", "phrase", "a", "len",
                          F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"),
                          F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"),
                          F.when(second, s2).otherwise(s1).alias("score"))
    # a pair inside a 3-word candidate with 2 f(longer) >= a goes
    tri = scored.where(F.col("len") == 3)
    inner = (tri.select("lang", F.array_join(F.slice("words", 1, 2), " ").alias("_p"), F.col("a").alias("fl"))
             .unionByName(tri.select("lang", F.array_join(F.slice("words", 2, 2), " ").alias("_p"), F.col("a").alias("fl")))
             .groupBy("lang", "_p").agg(F.max("fl").alias("longer")))
    pairs = (scored.where(F.col("len") == 2)
             .join(inner.withColumnRenamed("lang", "_lang"),
                   (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_p")), "left")
             .where(F.col("longer").isNull() | (100 * F.col("longer") < KEEP_LONGER * F.col("a")))
             .drop("_lang", "_p", "longer"))
    kept = pairs.unionByName(tri)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS)))
    near = salted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", F.col("a").cast("long").alias("a"), F.col("l").cast("long").alias("l"),
        F.col("r").cast("long").alias("r"), F.col("n").cast("long").alias("n"), F.col("score").cast("long").alias("score"))


def stage_collocations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return collocations(docs)


@query("op11_collocations")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
uni AS (SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest(ws) AS g FROM w) GROUP BY ALL),
tot AS (SELECT lang, sum(f) AS n FROM uni GROUP BY lang),
bi AS (SELECT lang, g[1] AS w1, g[2] AS w2, count(*) AS f FROM (
         SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: [ws[i], ws[i + 1]])) AS g FROM w WHERE len(ws) >= 2)
       GROUP BY ALL HAVING count(*) >= 10),
tri AS (SELECT lang, g[1] AS w1, g[2] AS w2, g[3] AS w3, count(*) AS f FROM (
          SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) AS g
          FROM w WHERE len(ws) >= 3)
        GROUP BY ALL HAVING count(*) >= 10),
c2 AS (
  SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, u1.f AS l, u2.f AS r,
         (1000000::HUGEINT * b.f * b.f) // (u1.f::HUGEINT * u2.f) AS score
  FROM bi b JOIN uni u1 ON u1.lang = b.lang AND u1.g = b.w1 JOIN uni u2 ON u2.lang = b.lang AND u2.g = b.w2
  WHERE NOT EXISTS (SELECT 1 FROM tri t WHERE t.lang = b.lang AND 100 * t.f >= 50 * b.f
                    AND ((t.w1 = b.w1 AND t.w2 = b.w2) OR (t.w2 = b.w1 AND t.w3 = b.w2)))),
c3 AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a,
         u1.f AS l1, b23.f AS r1, (1000000::HUGEINT * t.f * t.f) // (u1.f::HUGEINT * b23.f) AS s1,
         b12.f AS l2, u3.f AS r2, (1000000::HUGEINT * t.f * t.f) // (b12.f::HUGEINT * u3.f) AS s2
  FROM tri t
  JOIN uni u1 ON u1.lang = t.lang AND u1.g = t.w1
  JOIN uni u3 ON u3.lang = t.lang AND u3.g = t.w3
  JOIN bi b12 ON b12.lang = t.lang AND b12.w1 = t.w1 AND b12.w2 = t.w2
  JOIN bi b23 ON b23.lang = t.lang AND b23.w1 = t.w2 AND b23.w2 = t.w3),
c AS (
  SELECT lang, phrase, a, l, r, score FROM c2
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END,
         least(s1, s2) FROM c3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase ASC) AS rank FROM c)
SELECT ranked.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
       score::BIGINT AS score
FROM ranked JOIN tot USING (lang)
WHERE rank <= 2000
"""
ORACLES["op11_collocations"] = ORACLE
