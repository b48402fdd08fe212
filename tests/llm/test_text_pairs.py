"""Operators that set documents against each other: personal data, benchmark items, repeats, near copies, search."""

import hashlib
import itertools
import math
import random
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriescast.llm import components, decontaminate, jaccard, pii, search, substrings

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, key string, digest string, term string, item_id string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "k", "d", "t", "i", "n") for i, t in rows], DDL)


def sentence(rng, n=40):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


# --- personal data ----------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(values)) % 10 == 0


def counts(kind, match):
    digits = re.sub(r"\D", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")),
            "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def plain_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "")
             if counts(kind, m[0])]
    return ",".join(f"{kind}:{a}:{e}" for a, _, e, kind in sorted(found))


def test_pii_against_plain_patterns(spark):
    rng = random.Random(3)
    parts = ["a@b.co", "@", ".", "x.y", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", " ", "-", "9",
             "é", "😀", "_", "0007.1.1.255", "12345", "+", "\n", "me@x", "4111111111111111", "%"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(25)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "7" * 60000), (1003, "a" * 60000 + "@b.c"), (1004, "1-" * 30000), (None, "p@q.rs"),
             (5, rows[5][1]), (5, "other 9.9.9.9"), (1005, "a@b.c." * 3000), (1006, "+1 1" * 9000)]
    got = defaultdict(list)
    for r in pii.find_pii(table(spark, rows)).collect():
        assert sum((r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_term)) == len(list(filter(None, r.spans.split(","))))
        base = ",".join(s for s in r.spans.split(",") if not s.startswith("term"))
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256
        got[r.doc_id].append(base)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(plain_spans(t))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}


def test_disclosing_terms(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng)) for i in range(200)]
    # Zorblax stands next to one address in different passages and hardly elsewhere; w1 is common
    rows += [(300 + i, f"{sentence(rng, 12)} Zorblax ann@x.org w1 {sentence(rng, 12)}") for i in range(6)]
    rows += [(400 + i, f"w1 {sentence(rng, 20)}") for i in range(100)]
    rows += [(500, "Zorblax alone"), (501, None)]
    docs = table(spark, rows)
    keyed = pii.keyed(docs)
    base = pii.base_spans(keyed)
    found = {r.term: r.ratio for r in pii.disclosing_terms(keyed, base).collect()}
    n, n_e, n_et, n_t = len(rows), 6, 6, 7
    assert found["zorblax"] == pytest.approx(math.log(n * n_et / (n_e * n_t)) / math.log(n / n_e))
    assert set(found) == {"zorblax"} or set(found) <= {"zorblax", "ann"}
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert "[TERM] [EMAIL] w1" in clean[300].text and "Zorblax" not in clean[300].text
    assert clean[500].text == "Zorblax alone" and clean[501].text is None
    assert clean[0].text == rows[0][1] and pii.sanitise(docs).columns == docs.columns
    spans = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    assert "term:" in spans[300] and spans[500] == ""
    for s in spans[303].split(","):
        kind, a, e = s.split(":")
        assert rows[203][1][int(a):int(e)] == {"term": "Zorblax", "email": "ann@x.org"}[kind]


def test_copies_are_no_evidence(spark):
    rows = [(i, "rare words near bob@x.org are only copied") for i in range(8)] + [(100 + i, "nothing here") for i in range(50)]
    assert all(r.n_term == 0 for r in pii.find_pii(table(spark, rows)).collect())


def test_pii_of_nothing(spark):
    assert pii.find_pii(table(spark, [])).collect() == [] == pii.sanitise(table(spark, [])).collect()


# --- benchmark items --------------------------------------------------------------------

def runs(text, width=5, short=False):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    if short and 0 < len(w) < width:
        return {tuple(w)}
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def test_contained_items(spark):
    rng = random.Random(5)
    items = [(f"i{k}", sentence(rng, n)) for k, n in enumerate([3, 5, 6, 9, 14, 25, 44, 70, 131])] + [("none", None), ("i3", None)]
    rows = [(k, sentence(rng, rng.randrange(10, 300))) for k in range(60)]
    for k, (_, text) in enumerate(items[:9]):
        w = text.split()
        for cut in (0, len(w) // 10, len(w) // 4):
            rows.append((100 + len(rows), f"{sentence(rng, 50)} {' '.join(w[cut:]).upper()}, {sentence(rng, 3000)}"))
    rows += [(None, items[5][1]), (None, None), (7, ""), (8, items[4][1]), (8, items[4][1])]
    tests = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id string, text string, digest string")
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in decontaminate.contained_items(table(spark, rows), tests).collect()}
    want = {}
    for (i, t), (k, item) in itertools.product(rows, items):
        a, b = runs(t), runs(item)
        if b and len(a & b) >= 0.8 * len(b):
            want[i, k] = (len(b), len(a & b))
    assert got == want and len(want) > 15
    assert decontaminate.contained_items(table(spark, []), tests).collect() == []
    assert decontaminate.contained_items(table(spark, rows), tests.limit(0)).collect() == []


def test_decontamination_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = {r.doc_id for r in decontaminate.contained_items(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    more = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    kept = decontaminate.stage_decontaminate(spark, more, SF)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted({r.doc_id for r in docs.collect()} - bad | {-1})


def test_decontamination_of_rows_without_id(spark):
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text), key=len)
    rng = random.Random(14)
    rows = [(None, f"{sentence(rng)} {item}"), (None, item), (None, "clean " + sentence(rng)), (None, None), (1, item),
            (1, "other text of a document that holds an item"), (2, sentence(rng))]
    more = table(spark, rows)
    kept = decontaminate.stage_decontaminate(spark, more, SF)
    assert kept.columns == more.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([rows[2], rows[3], rows[6]])


# --- repeats ----------------------------------------------------------------------------

def test_chunks_cover_and_resync():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh é日\n") for _ in range(20000))
    ends = []
    for t in (text, "inserted " + text):
        raw = np.frombuffer(t.encode(), np.uint8)
        e = substrings.chunk_ends(raw, (raw & 0xC0) != 0x80)
        sizes = np.diff([0, *e])
        assert e[-1] == len(raw) and max(sizes) <= substrings.MOST + 3 and min(sizes[:-1]) >= substrings.LEAST
        assert "".join(t.encode()[a:b].decode() for a, b in zip([0, *e], e)) == t
        ends.append(e)
    assert len({x + 9 for x in ends[0]} & set(ends[1])) > 0.95 * len(ends[0])


def test_rolling_is_the_gear_hash():
    raw = np.random.default_rng(1).integers(0, 256, 200).astype(np.uint8)
    h, want = 0, []
    for b in raw:
        h = (2 * h + int(substrings.GEAR[b])) & 0xFFFF
        want.append(h)
    assert substrings.rolling(raw).tolist() == want


def test_repeated_spans(spark):
    rng = random.Random(7)
    passages = [sentence(rng, 55) for _ in range(20)]
    rows = [(i, sentence(rng, 200)) for i in range(40)]
    rows += [(100 + i, f"{sentence(rng, rng.randrange(80))} {passages[i % 20]} {sentence(rng, rng.randrange(1, 80))}") for i in range(40)]
    rows += [(200, None), (201, ""), (202, "a" * 5000), (None, passages[0]), (100, rows[40][1]), (203, ("same " * 40 + sentence(rng, 30)) * 2)]
    got = substrings.repeated_spans(table(spark, rows)).collect()
    text = dict(rows)
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append(r)
        if r.doc_id is not None:
            assert any(text[r.doc_id][r.start:r.end] in t for i, t in rows if t and i != r.doc_id)
    assert {*range(100, 140), None} == set(found)
    for i in range(20):
        assert all(r.kept and r.first_doc_id == 100 + i for r in found[100 + i])
        assert all(not r.kept and r.first_doc_id == 100 + i for r in found[120 + i])
        assert max(r.n_words for r in found[120 + i]) >= 25
    cut = {r.doc_id: r.text for r in substrings.without_repeats(table(spark, rows)).collect()}
    assert cut[100] == rows[40][1] and len(cut[120]) < len(rows[60][1]) - 150 and cut[200] == "" and cut[0] == rows[0][1]
    assert substrings.repeated_spans(table(spark, [])).collect() == []


def test_every_repeated_chunk_stays_in_its_first_document(spark):
    rng = random.Random(11)
    shared, own, tail = sentence(rng, 60), sentence(rng, 120), sentence(rng, 60)
    rows = [(1, f"{sentence(rng, 40)} {shared} {sentence(rng, 40)}"), (2, f"{own} {shared} {tail}"), (4, f"{own} {shared} {tail}"),
            (5, f"{tail} {sentence(rng, 90)}"), (None, f"{own} {shared}"), (6, None)]
    docs = table(spark, rows)
    chunks = {}
    for i, t in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        ends = substrings.chunk_ends(raw, (raw & 0xC0) != 0x80) if len(raw) else []
        chunks[i, t] = [(a, e, t[a:e]) for a, e in zip([0, *ends], ends)]
    holders = defaultdict(set)
    for (i, t), found in chunks.items():
        for *_, c in found:
            holders[c].add(i)
    spans = substrings.repeated_spans(docs).collect()
    cut = {(r.doc_id, r.text) for r in substrings.without_repeats(docs).collect()}
    assert {r.first_doc_id for r in spans if r.doc_id == 4} == {1, 2}
    for r in spans:
        inside = [c for (i, t), found in chunks.items() if i == r.doc_id for a, e, c in found
                  if r.start <= a and e <= r.end]
        firsts = {min((i for i in holders[c] if i is not None), default=None) for c in inside}
        assert firsts == {r.first_doc_id} and r.kept == (r.first_doc_id == r.doc_id)
    for c, ids in holders.items():
        if len(ids) > 1:
            first = min(i for i in ids if i is not None)
            assert any(c in t for i, t in cut if i == first), (first, c)


# --- near copies ------------------------------------------------------------------------

def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_classes(rows, threshold=0.8):
    sets = [runs(t, short=True) for _, t in rows]
    links = defaultdict(set)
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            links[i].add(j)
            links[j].add(i)
    seen, classes = {}, []
    for i in range(len(rows)):
        if i not in seen:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen[x] = len(classes)
                    todo += links[x]
            classes.append(None)
    return [(seen[i], len(links[i])) for i in range(len(rows))]


def near_copies(rng, n_base=25, copies=12):
    rows = []
    for _ in range(n_base):
        w = sentence(rng, rng.randrange(4, 160)).split()
        for _ in range(rng.randrange(copies)):
            v = list(w)
            for _ in range(rng.randrange(3)):
                v[rng.randrange(len(v))] = f"x{rng.randrange(1000)}"
            rows.append(" ".join(v))
    big = sentence(rng, 120).split()
    for _ in range(150):  # a bucket that has to be split
        v = list(big)
        for _ in range(rng.randrange(4)):
            v[rng.randrange(len(v))] = f"x{rng.randrange(1000)}"
        rows.append(" ".join(v))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("leaf, depth", [(64, 10), (8, 2)])
def test_jaccard_classes(spark, monkeypatch, leaf, depth):
    monkeypatch.setattr(jaccard, "CELL_SETS", 32)
    links = jaccard.candidate_links
    monkeypatch.setattr(jaccard, "candidate_links", lambda s, j, r: links(s, j, r, leaf=leaf, depth=depth))
    rows = near_copies(random.Random(9))
    rows += [(1000, None), (1001, ""), (1002, "!!"), (1003, "two words"), (1004, "Two, words"), (3, rows[3][1]), (None, rows[3][1])]
    got = jaccard.jaccard_classes(table(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute_classes(rows)
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((i, n) for (i, _), (_, n) in zip(rows, want))
    first = {}
    for (i, _), (c, _) in zip(rows, want):
        first[c] = min(first.get(c, math.inf), math.inf if i is None else i)
    assert Counter((r.doc_id, r["first"].doc_id) for r in got) == Counter((i, first[c]) for (i, _), (c, _) in zip(rows, want))


def test_buckets_of_one_class_end(spark, monkeypatch):
    rng = random.Random(16)
    base = sentence(rng, 150).split()
    rows = []
    for i in range(120):
        v = list(base)
        for _ in range(2):
            v[rng.randrange(len(v))] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(v)))
    sets = jaccard.texts(table(spark, rows)).withColumn("digest", jaccard.digest()).mapInArrow(jaccard._sign(), jaccard.SIGNED)
    sets = jaccard.materialize(sets.select("key", "sig"), "sets")
    kept, stored = jaccard.materialize, []
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: stored.append((name, kept(df, name))) or stored[-1][1])
    links = jaccard.candidate_links(sets, 0.8, 10, leaf=8, depth=6)
    assert len({r.root for r in components.components(links).collect()}) == 1
    after = [df.count() for name, df in stored if name == "buckets"]
    assert sum(after[1:]) < after[0] / 2, after


def test_buckets_of_one_class_and_few_others_end(spark, monkeypatch):
    rng = random.Random(17)
    base = sentence(rng, 150).split()
    near = []
    for _ in range(150):
        v = list(base)
        for _ in range(2):
            v[rng.randrange(len(v))] = f"x{rng.randrange(10 ** 6)}"
        near.append(" ".join(v))
    others = [" ".join(base[:110] + [f"y{rng.randrange(10 ** 6)}" for _ in range(80)]) for _ in range(30)]
    rows = list(enumerate(near + others))
    monkeypatch.setattr(jaccard, "WIDE", 16, raising=False)  # several blocks
    kept, stored = jaccard.materialize, []
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: stored.append((name, kept(df, name))) or stored[-1][1])
    links = jaccard.candidate_links
    monkeypatch.setattr(jaccard, "candidate_links", lambda s, j, r: links(s, j, r, leaf=16, depth=8))
    got = {r.doc_id: (r["first"].doc_id, r.n_links) for r in jaccard.jaccard_classes(table(spark, rows)).collect()}
    want = brute_classes(rows)
    first = {c: min(i for (i, _), (d, _) in zip(rows, want) if d == c) for c, _ in want}
    assert got == {i: (first[c], n) for (i, _), (c, n) in zip(rows, want)}
    after = [df.count() for name, df in stored if name == "buckets"]
    assert len(after) <= 4 and sum(after) < 2 * after[0], after


def test_compare_joins_labels():
    rng = np.random.default_rng(18)
    sig = rng.integers(0, 1 << 32, (4, jaccard.SIGNATURE)).astype("<u4")
    bucket = jaccard.pa.table({"key": [1, 2, 3, 4, 5], "label": [1, 1, 3, 4, 5], "sig": [sig[k].tobytes() for k in (0, 1, 1, 2, 2)]})
    found = jaccard._compare(bucket)
    assert sorted(zip(found["a"].to_pylist(), found["b"].to_pylist())) == [(3, 1), (5, 4)]


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_classes(table(spark, [])).collect() == []
    assert len(jaccard.jaccard_classes(table(spark, [(1, None), (1, None)])).collect()) == 2


def test_jaccard_stage(spark):
    rows = near_copies(random.Random(10), 12, 8)
    rows += [(1000, None), (1001, ""), (3, rows[3][1]), (None, rows[3][1])]
    docs = table(spark, rows)
    kept = jaccard.stage_jaccard(spark, docs, SF)
    assert kept.columns == docs.columns
    first = {}
    for (i, _), (c, _) in zip(rows, brute_classes(rows)):
        first[c] = min(first.get(c, math.inf), math.inf if i is None else i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())


# --- search -----------------------------------------------------------------------------

def test_top_k_is_exact():
    rng = np.random.default_rng(11)
    for k in (1, 5, 10):
        for _ in range(40):
            lists, scores = [], defaultdict(float)
            for _ in range(rng.integers(1, 6)):
                docs = np.sort(rng.choice(600, rng.integers(1, 500), replace=False))
                parts = rng.integers(1, 5, len(docs)) / 2
                lists.append((float(rng.integers(1, 4)), search.Postings(docs, parts)))
                for d, p in zip(docs.tolist(), parts.tolist()):
                    scores[d] += lists[-1][0] * p
            want = sorted(((s, -d) for d, s in scores.items()), reverse=True)[:k]
            assert search.top_k(lists, list(range(600)), k) == want


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 16)
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(60)))) for i in range(120)]
    rows += [(200, None), (220, ""), (None, "w1 w2"), (240, rows[40][1]), (40, rows[40][1])]
    texts = {i: t or "" for i, t in rows if i is not None}
    tf = {i: Counter(re.findall(r"[^\W_]+", t.lower())) for i, t in texts.items()}
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    part = {(i, w): f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for i, c in tf.items() for w, f in c.items()}
    want = {}
    for q in (i for i in tf if i % 20 == 0):
        terms = sorted((w for w in tf[q] if df[w] > 1), key=lambda w: (-round(part[q, w] * idf[w], 6), w))[:12]
        scores = {i: round(sum(part[i, w] * idf[w] for w in terms if w in c), 6) for i, c in tf.items() if any(w in c for w in terms)}
        for place, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10], 1):
            want[q, place] = (i, s)
    got = {(r.query_id, r.place): (r.doc_id, r.score) for r in search.search_documents(table(spark, rows), most=12).collect()}
    assert got.keys() == want.keys() and len(got) > 40
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in want)
    assert search.search_documents(table(spark, [])).collect() == []


def test_search_asks_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 16)
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    rng = random.Random(15)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(20, 80)))) for i in range(1, 150)]
    rows += [(0, " ".join(f"a{i:02d}" for i in range(30))), (500, "a29 a28"), (501, "a29"), (520, "alone"), (540, ""), (560, None)]
    tf = {i: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in rows}
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    want = {}
    for q in (i for i in tf if i % 20 == 0):
        scores = {i: round(sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in tf[q] if w in c), 6)
                  for i, c in tf.items() if any(w in c for w in tf[q])}
        for place, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10], 1):
            want[q, place] = (i, s)
    got = {(r.query_id, r.place): (r.doc_id, r.score) for r in search.search_documents(table(spark, rows)).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in want)
    # by words past the 12 greatest, and by a word no other document has
    assert {got[0, p][0] for p in (1, 2, 3)} == {0, 500, 501} and got[520, 1][0] == 520


def test_search_shards_give_what_reaches_the_score_found_before(spark, monkeypatch, tmp_path):
    """Rows that the shards make grow with the queries, not with queries x shards."""
    monkeypatch.setattr(search, "SHARD_DOCS", 32)
    rng = random.Random(16)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(20, 80)))) for i in range(27 * 32)]
    made, inner = str(tmp_path), search._search

    def counted(*args):
        run = inner(*args)

        def counting(docs, queries):
            out = run(docs, queries)
            with open(f"{made}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(out.num_rows))
            return out

        return counting

    monkeypatch.setattr(search, "_search", counted)
    got = [tuple(r) for r in search.search_documents(table(spark, rows)).select("query_id", "place", "doc_id", "score").collect()]
    asked = sum(i % 20 == 0 for i, _ in rows)
    assert len(got) == 10 * asked
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) < 100 * asked
    monkeypatch.setattr(search, "SHARD_DOCS", 10_000)
    once = search.search_documents(table(spark, rows)).select("query_id", "place", "doc_id", "score").collect()
    assert sorted(got) == sorted(tuple(r) for r in once)


def test_packs_hold_queries_and_their_terms():
    rows = [(7, "b", 3), (7, "a", 2), (9, "a", 2), (7, "a", 2), (-1, "c", 1)]
    packed = search._pack(pa.table({"pack": [4] * 5, "query_id": [q for q, _, _ in rows], "term": [t for _, t, _ in rows], "df": [d for *_, d in rows]}))
    (p,) = packed.to_pylist()
    terms, numbers, at, got = p["terms"].split(" "), np.frombuffer(p["numbers"], np.uint16), 0, {}
    for q, size in zip(p["query_ids"], p["sizes"]):
        got[q], at = {(terms[i], p["dfs"][i]) for i in numbers[at:at + size]}, at + size
    assert p["pack"] == 4 and got == {-1: {("c", 1)}, 7: {("a", 2), ("b", 3)}, 9: {("a", 2)}}


def test_words_of_search():
    for text in ["".join(map(chr, range(128))), "a_b__C d\x1ce\x85f", "É_É İx ß_1²٣ ǅ", "x́y _ __", ""] + [f"Ab{chr(c)}9z" for c in range(0x3000)]:
        assert search.words(text) == re.findall(r"[^\W_]+", text.lower())
