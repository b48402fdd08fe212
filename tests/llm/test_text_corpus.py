"""Operators over the whole corpus: phrase collocations, source mixing, spelling variants."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriescast.llm import collocations, mixing, spelling

SF = "/root/testdata/sf0.001"
#: Columns whose names the operators use for their own.
DDL = ("doc_id long, text string, lang string, source string, _o string, _row string, src string, off string, "
       "word string, n string, f string, a string, key string, _p string, g string, block string")


def frame(spark, rows):
    """(doc_id, text, lang, source) rows plus clashing columns."""
    return spark.createDataFrame([(i, t, lang, s, *["x"] * 12) for i, t, lang, s in rows], DDL)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- op11: phrase collocations -------------------------------------------------------------------------------


def brute_collocations(rows, top=collocations.TOP):
    lower = str.maketrans(collocations.UPPER, collocations.LOWER)
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i:i + k])] += 1
    out = []
    cands = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= 10}
    for (lang, ws), a in cands.items():
        if len(ws) == 2 and any(len(o) == 3 and lo == lang and 2 * b >= a and (o[:2] == ws or o[1:] == ws)
                                for (lo, o), b in cands.items()):
            continue
        cuts = []
        for k in range(1, len(ws)):
            left, right = f[lang, ws[:k]], f[lang, ws[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(ws), a, left, right, n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(ranked)


def spark_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_collocations_small_against_brute_force(spark):
    rows = ([(1, "The cat sat. the Cat sat on the mat", "en", "s")] * 12 + [(2, "big red dog, big red dog", None, "s")] * 6
            + [(3, "Ünïcode wörds here\tand ünïcode wörds here", "de", None)] * 11 + [(4, None, "en", "s"), (5, "", None, None)]
            + [(None, "the cat sat on the mat", "en", "s")] * 3)
    docs = frame(spark, rows)
    expect = brute_collocations([(t, lang) for _, t, lang, _ in rows])
    assert expect
    assert spark_rows(collocations.collocations(docs)) == expect
    assert spark_rows(collocations.collocations(docs, use_trie=False)) == expect


def test_collocations_trie_and_native_agree_on_documents(spark):
    docs = documents(spark)
    got = spark_rows(collocations.collocations(docs))
    assert got == spark_rows(collocations.collocations(docs, use_trie=False))
    texts = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    assert got == brute_collocations(texts)


def test_collocations_beyond_the_trie_bound_is_exact(spark):
    docs = documents(spark)
    assert spark_rows(collocations.collocations(docs, trie_nodes=10)) == spark_rows(collocations.collocations(docs))


def test_collocations_with_more_pairs_than_the_trie_holds_count_no_windows(spark, monkeypatch):
    docs = documents(spark)
    want = spark_rows(collocations.collocations(docs, use_trie=False))
    words = collocations.word_counts(docs).where(F.col("f") >= collocations.MIN_COUNT).count()

    def never(*args):
        raise AssertionError("every window was counted")

    monkeypatch.setattr(collocations, "ngram_counts_native", never)
    assert spark_rows(collocations.collocations(docs, trie_nodes=words + 1)) == want


def test_slices_of_texts_hold_their_words_and_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 8)
    rng = random.Random(9)
    texts = ["".join(rng.choice("aBé .\t;\n\x00\xa0") for _ in range(rng.randrange(14))) for _ in range(400)] + [None, "", "a", "a b."]
    got = [[] for _ in texts]
    for first, before, words, code, last in collocations._slices(pa.array([None, *texts])[1:]):
        found = words.take(pa.array(code)).to_pylist()
        for at, (a, e) in enumerate(zip(before, before[1:]), first):
            got[at] = list(zip(found[a:e], last[a:e].tolist()))
    want = []
    for text in texts:
        pieces = [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").replace("B", "b"))]
        want.append([(w, i == len(p)) for p in pieces for i, w in enumerate(p, 1)])
    assert got == want


def test_collocations_empty_table(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None, None)])).count() == 0


def test_collocations_long_text_and_ties(spark):
    long = "alpha beta gamma. " * 20000 + "delta epsilon " * 15
    got = spark_rows(collocations.collocations(frame(spark, [(1, long, "en", "s")])))
    assert got == brute_collocations([(long, "en")])
    # ties of score and a are ranked by phrase bytes
    assert [r[2] for r in got if r[7] == got[0][7] and r[3] == got[0][3]] == sorted(
        [r[2] for r in got if r[7] == got[0][7] and r[3] == got[0][3]], key=str.encode)


def test_scores_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_000_007, 3_000_000_000_011, 3_000_000_000_013
    df = spark.createDataFrame([(a, left, right, left, right)], "a long, l1 long, r1 long, l2 long, r2 long")
    assert df.select(collocations._score(1).alias("s")).first().s == 1_000_000 * a * a // (left * right)


def test_trie_levels():
    rng = random.Random(3)
    words = 500
    trie = collocations.TrieLevels(words)
    pairs = sorted({(rng.randint(1, words), rng.randint(1, words)) for _ in range(3000)})
    trie.add_level(np.asarray([p * trie.span + c for p, c in pairs]))
    child = {pc: words + 1 + i for i, pc in enumerate(pairs)}
    ps = np.asarray([rng.randint(0, words) for _ in range(20000)])
    cs = np.asarray([rng.randint(0, words) for _ in range(20000)])
    assert trie.step(ps, cs).tolist() == [child.get((p, c), 0) for p, c in zip(ps.tolist(), cs.tolist())]
    triples = sorted({(child[p], rng.randint(1, words)) for p in rng.sample(pairs, 200) for _ in range(3)})
    trie.add_level(np.asarray([p * trie.span + c for p, c in triples]))
    got = trie.step(np.asarray([p for p, _ in triples]), np.asarray([c for _, c in triples]), 1)
    assert got.tolist() == list(range(words + 1 + len(pairs), words + 1 + len(pairs) + len(triples)))


# --- op12: mixing ---------------------------------------------------------------------------------------------


def brute_targets(sizes, weights, cap=3):
    """Water filling by bisection on the level: t_i = min(cap s_i, level w_i) summing to the total."""
    total = sum(sizes)
    lo, hi = Fraction(0), Fraction(total + 1)
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(cap * s, mid * w) for s, w in zip(sizes, weights)) < total:
            lo = mid
        else:
            hi = mid
    return [float(min(cap * s, hi * w)) for s, w in zip(sizes, weights)]


@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
@settings(max_examples=200, deadline=None)
def test_targets_water_filling(sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights)
    if sum(sizes):
        assert sum(got) == sum(sizes)
    assert all(g <= 3 * s for g, s in zip(got, sizes))
    assert [float(g) for g in got] == pytest.approx(brute_targets(sizes, weights), rel=1e-9, abs=1e-6)


@given(st.integers(1, 5000), st.integers(0, 2**40))
@settings(max_examples=100, deadline=None)
def test_permutation_is_a_bijection(size, key):
    got = mixing.permute(np.arange(size), size, key)
    assert sorted(got.tolist()) == list(range(size))


def test_shard_counts_add_up():
    totals = np.asarray([700, 0, 5, 1300, 1])
    slots = int(totals.sum())
    got = np.asarray([mixing.shard_counts(h, totals, slots, 97, 5) for h in range(-(-slots // 97))])
    assert got.sum(axis=0).tolist() == totals.tolist()
    assert got.sum(axis=1).tolist() == [min(97, slots - 97 * h) for h in range(len(got))]


def brute_mix(rows, block=mixing.BLOCK, shard_blocks=mixing.SHARD_BLOCKS, seed=mixing.SEED):
    """Every step in one process: rows are (doc_id, size, source, order hash)."""
    sources = sorted({s for _, _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(z for _, z, s, _ in rows if s == src) for src in sources]
    goal = mixing.targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sources))])
    nb = [-(-z // block) for z in sizes]
    totals = mixing.slot_totals(goal, sizes, nb)
    slots = sum(totals)
    counts = [mixing.shard_counts(h, np.asarray(totals), slots, shard_blocks, seed) for h in range(-(-slots // shard_blocks))]
    out = []
    for i, src in enumerate(sources):
        times = Counter()
        taken_slots = sum(int(c[i]) for c in counts)
        blocks = mixing.permute(np.arange(taken_slots), 3 * nb[i], seed * 1_000_003 + i) % nb[i] if taken_slots else []
        times.update(int(b) for b in blocks)
        off = 0
        for doc, z, _, _ in sorted((r for r in rows if r[2] == src), key=lambda r: (r[3], -1 if r[0] is None else r[0], r[1])):
            taken = sum(times[b] * (min(off + z, (b + 1) * block) - max(off, b * block))
                        for b in range(off // block, (off + z - 1) // block + 1)) if z else 0
            out.append((doc, z, sizes[i], float(goal[i]), taken, src))
            off += z
    return sorted(out, key=repr)


def mix_rows(spark, docs, **kw):
    got = mixing.mix(docs, **kw).select("doc_id", "size", "source_size", "target", "taken", "source").collect()
    return sorted((tuple(r) for r in got), key=repr)


def order_hashes(docs, seed=mixing.SEED):
    return [(r.doc_id, r.size, r.source, r.o) for r in docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD)).alias("size"),
        F.xxhash64(F.col("doc_id"), F.col("text"), F.col("source"), F.lit(seed)).alias("o")).collect()]


def test_mix_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 300))), None, rng.choice(["a", "b", "c", "d", None]))
            for i in range(400)]
    rows += [(7, None, None, "a"), (None, "x y z", None, "b"), (8, "", None, None)] + [(9, "same words here", None, "a")] * 3
    docs = frame(spark, rows)
    got = mix_rows(spark, docs, block=64, shard_blocks=16)
    assert got == brute_mix(order_hashes(docs), block=64, shard_blocks=16)
    assert all(r[4] <= 3 * r[1] for r in got)
    for src in {r[5] for r in got}:
        mine = [r for r in got if r[5] == src]
        assert abs(sum(r[4] for r in mine) - mine[0][3]) <= 3.5 * 64


def test_mix_documents_near_target_and_rerun(spark):
    docs = documents(spark)
    first = mix_rows(spark, docs)
    assert first == mix_rows(spark, docs)
    assert len(first) == docs.count()
    assert all(r[4] <= 3 * r[1] for r in first)
    for src in {r[5] for r in first}:
        mine = [r for r in first if r[5] == src]
        assert abs(sum(r[4] for r in mine) - mine[0][3]) <= 3.5 * mixing.BLOCK


def test_mix_empty_and_null(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    got = mix_rows(spark, frame(spark, [(1, None, None, None), (None, None, None, "s")]))
    assert [(r[1], r[4]) for r in got] == [(0, 0), (0, 0)]


# --- op13: spelling variants ----------------------------------------------------------------------------------


def edit_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(lower)
            if doc is not None:
                h = zlib.crc32(f"{doc}:{low}".encode())
                if h % 31 == 0:
                    low = low[:h % len(low)] + low[h % len(low) + 1:]
            n[low] += 1
    words = sorted(w for w, c in n.items() if len(w) >= 7 and c >= 2)
    near = {w: [v for v in words if edit_one(w, v)] for w in words}
    form = {}
    for w in words:
        top = min(near[w], key=lambda v: (-n[v], v)) if near[w] else None
        form[w] = top if top is not None and n[top] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in words)


def variant_rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@given(st.lists(st.text(alphabet="abcé", min_size=1, max_size=9), max_size=60))
@settings(max_examples=200, deadline=None)
def test_sorted_list_search_finds_every_near_pair(words):
    found = spelling.near_pairs_sorted(words)
    ws = sorted(set(words))
    assert sorted(found) == sorted((a, b) for i, a in enumerate(ws) for b in ws[i + 1:] if edit_one(a, b))


@given(st.lists(st.text(alphabet="abc", min_size=7, max_size=10), max_size=60))
@settings(max_examples=200, deadline=None)
def test_both_groupings_with_the_bounded_tail_scan_find_every_pair(words):
    ws = sorted(set(words))
    found = set()
    for key in {w[:spelling.KEY] for w in ws}:
        found |= set(spelling.near_pairs_sorted([w for w in ws if w[:spelling.KEY] == key]))
    for key in {w[-spelling.KEY:] for w in ws}:
        tail = [w[::-1] for w in ws if w[-spelling.KEY:] == key]
        found |= {tuple(sorted((a[::-1], b[::-1]))) for a, b in spelling.near_pairs_sorted(tail, spelling.KEY + 1)}
    assert found == {(a, b) for i, a in enumerate(ws) for b in ws[i + 1:] if edit_one(a, b)}


@given(st.lists(st.text(alphabet="abc", min_size=7, max_size=10), max_size=60))
@settings(max_examples=200, deadline=None)
def test_groups_of_half_words_find_every_pair(words):
    ws = sorted(set(words))
    rows = [(side, m, w[::-1] if side else w) for w in ws for m in (len(w), len(w) - 1) for side in (0, 1) if m >= 7]
    got = spelling._group_pairs(pd.DataFrame(rows, columns=["side", "m", "word"]))
    assert ({tuple(sorted(p)) for p in zip(got["a"], got["b"])}
            == {(a, b) for i, a in enumerate(ws) for b in ws[i + 1:] if edit_one(a, b)})


def test_words_of_one_beginning_and_end_are_dealt_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BUCKET", 100)
    rng = random.Random(17)
    words = sorted({"pre" + "".join(rng.choices("abcdefgh", k=6)) + "ing" for _ in range(500)})
    placed = spelling.members(spark.createDataFrame([(w,) for w in words], "word string"))
    assert placed.count() == 4 * len(words)
    assert max(r["count"] for r in placed.groupBy("g").count().collect()) < len(words)
    near = {tuple(r) for r in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert near == {(a, b) for a in words for b in words if edit_one(a, b)}


def test_variants_small_against_brute_force(spark):
    base = "colour colours coloured neighbour neighbours neighbor Straße Mañana mañanas"
    rows = ([(i, "Colour neighbour recognise recognize " * 3) for i in range(40)]
            + [(100 + i, "colours recognise misspelling mispelling misspellin " + base) for i in range(4)]
            + [(None, "colouur neighbbour recognise"), (7, None), (8, ""), (9, "x" * 5 + " " + "abcdefgh" * 4000)] * 2)
    docs = frame(spark, [(i, t, None, None) for i, t in rows])
    got = variant_rows(spelling.variants(docs))
    expect = brute_variants(rows)
    assert got == expect
    assert any(r[1] is not None for r in got)


def test_variants_chains_follow_to_the_root(spark):
    # n: aaaaaaa 2, aaaaaab 20, aaaaabb 200: the first's form is the second, its root the third
    rows = [(1, "aaaaaaa " * 2), (2, "aaaaaab " * 20), (3, "aaaaabb " * 200)]
    docs = frame(spark, [(i, t, None, None) for i, t in rows])
    got = {r[0]: r for r in variant_rows(spelling.variants(docs))}
    assert got == {r[0]: r for r in brute_variants(rows)}
    assert got["aaaaaaa"][1:3] == ("aaaaaab", "aaaaabb")


def test_variants_documents_against_brute_force(spark):
    docs = documents(spark)
    assert variant_rows(spelling.variants(docs)) == brute_variants(
        [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_variants_empty(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None, None, None), (2, "", None, None)])).count() == 0
