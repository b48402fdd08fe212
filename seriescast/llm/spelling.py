"""Spelling variants: near words found by a banded edit DP over a sorted vocabulary, forms and roots by joins.

Words.  Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]+`` (a null text has none), lower-cased in A-Z only.  With h the
unsigned crc32 of UTF-8 ``<doc_id>:<run>``, a run with ``h % 31 == 0`` loses its code point ``h % length`` (a null
doc_id gives a null h: nothing is deleted).  Words are the distinct results of at least ``MIN_LENGTH`` code points
that occur at least ``MIN_COUNT`` times over all rows (``n``).

Near words differ by exactly one inserted, deleted or replaced code point.  Let m be the length of the shorter and
h = m // 2: the two share their first h code points (the edit lies at position h or later) or their last m - h (it
lies earlier).  So a word of length L stands in four groups: with m = L and with m = L - 1, by its first m // 2 and
by its last m - m // 2 code points (reversed words), and every group is searched by the sorted-list method:

* words are sorted and each is compared with all words after it in the group;
* the edit rows of a candidate are kept by depth and reused for the next candidate up to their common prefix
  (adjacent LCPs), and only cells within one of the diagonal are kept (banded, capped at 2);
* where a row is above 1 everywhere, every word with that prefix is out, and the scan jumps to the first word
  with a shorter common prefix (a table of those jumps is built once per group);

Groups are small; tasks take about ``BUCKET`` rows of whole groups, dealt by a hash.

A word's form is its near word of largest n (ties: least in code-point order) if that n >= ``FORM_RATIO`` times its
own; its root follows forms to the end (pointer doubling by joins: each step multiplies n by 10, so chains are
short).  Returned: word, form, root, n, n_near (0 if none), form_n (null without form).

Edge cases: an empty table or no words give no rows; repeated rows count as often as they stand; very long texts
give their runs whole; other input columns are never read.  A group holds distinct words only (counts are summed
before), so a hot word is one row; the largest group is the largest set of words of two lengths sharing half their letters.
"""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescast.llm.registry import query, table
from seriescast.sources.storage import materialize

# Fixed values of the contract.
RUN = "([A-Za-zÀ-ÿ]+)"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
DELETE_MOD = 31
MIN_LENGTH = 7
MIN_COUNT = 2
FORM_RATIO = 10
#: Letters of the shortest group keys: MIN_LENGTH // 2.
KEY = 3
#: Rows of groups searched together.
BUCKET = 4000

FAR = 2  # edit distances above one are all the same here


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of the contract."""
    runs = docs.select(F.col("doc_id").cast("string").alias("id"),
                       F.explode(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")),
                                                      F.lit(RUN), F.lit(1))).alias("run"))
    low = F.translate("run", UPPER, LOWER)
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), low).cast("binary"))
    cut = F.concat(F.expr("substring(low, 1, at)"), F.expr("substring(low, at + 2)"))
    words = (runs.select(low.alias("low"), h.alias("h")).withColumn("at", (F.col("h") % F.length("low")).cast("int"))
             .select(F.when(F.col("h") % DELETE_MOD == 0, cut).otherwise(F.col("low")).alias("word")))
    return (words.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= MIN_COUNT))


def _jumps(words: list[str], lcp: list[int], longest: int) -> list[list[int]]:
    """``jump[j][t]``: the first index after j whose common prefix with word j is shorter than t."""
    n = len(words)
    jump: list[list[int]] = [[]] * n
    last = [n] * (longest + 2)
    for j in range(n - 1, -1, -1):
        jump[j] = last
        if j > 0:
            last = last[:lcp[j] + 1] + [j] * (longest + 1 - lcp[j])
    return jump


def near_pairs_sorted(words: list[str], least: int | None = None) -> list[tuple[str, str]]:
    """Pairs (w, v), w before v in code-point order, of words of the list at edit distance exactly one.

    ``least``: only pairs whose common prefix is at least len(w) - ``least`` are wanted; the scan from w then ends
    where that prefix ends (a jump), instead of at the end of the list.
    """
    words = sorted(set(words))
    n = len(words)
    if n < 2:
        return []
    lcp = [0] * n
    for j in range(1, n):
        a, b = words[j - 1], words[j]
        k, top = 0, min(len(a), len(b))
        while k < top and a[k] == b[k]:
            k += 1
        lcp[j] = k
    longest = max(len(w) for w in words)
    jump = _jumps(words, lcp, longest)
    out = []
    for i in range(n - 1):
        w = words[i]
        m = len(w)
        # rows[t] = (D[t][t-1], D[t][t], D[t][t+1]) of the current candidate's first t code points against w
        rows = [(FAR, 0, 1 if m >= 1 else FAR)]
        j = i + 1
        shared = lcp[j]  # common prefix of the rows kept and the current candidate
        stop = jump[i][m - least] if least is not None and m - least > 0 else n
        while j < stop:
            v = words[j]
            del rows[shared + 1:]
            dead = 0
            for t in range(len(rows), len(v) + 1):
                a, b, c = rows[t - 1]
                ch = v[t - 1]
                x = t - 1  # cell D[t][t-1]
                left = t if x == 0 else min(a + (ch != w[x - 1]) if x - 1 < m else FAR, b + 1)
                left = min(left, FAR) if x <= m else FAR
                mid = min((b + (ch != w[t - 1])) if t - 1 < m else FAR, c + 1, left + 1, FAR) if t <= m else FAR
                right = min((c + (ch != w[t])) if t < m else FAR, mid + 1, FAR) if t + 1 <= m else FAR
                rows.append((left, mid, right))
                if min(left, mid, right) > 1:
                    dead = t
                    break
            if dead:
                # every word sharing v's first ``dead`` code points is as far
                nxt = jump[j][dead]
                shared = min(dead - 1, lcp[nxt]) if nxt < n else 0
                j = nxt
                continue
            t = len(v)
            if abs(t - m) <= 1 and rows[t][m - t + 1] == 1:
                out.append((w, v))
            nxt = j + 1
            shared = min(len(v), lcp[nxt]) if nxt < n else 0
            j = nxt
    return out


def _key(side: int, m: int) -> int:
    return m - m // 2 if side else m // 2


def _group_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = sorted(zip(pdf["side"].tolist(), pdf["m"].tolist(), pdf["word"].tolist()))
    found: list[tuple[str, str]] = []
    for (side, m, _), group in groupby(rows, lambda r: (r[0], r[1], r[2][:_key(r[0], r[1])])):
        words = [w for *_, w in group]
        if len(words) > 1:
            pairs = [p for p in near_pairs_sorted(words) if m in (len(p[0]), len(p[1]))]  # others have a group of m + 1
            found += [(a[::-1], b[::-1]) for a, b in pairs] if side else pairs
    return pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found]}, dtype=object)


def members(words: DataFrame) -> DataFrame:
    """(side, m, word, g): the rows of ``words`` in each of their groups, words of side 1 reversed; g is the bucket."""
    buckets = max(1, -(-4 * words.count() // BUCKET))
    length = F.length("word")
    member = lambda side, m, word: F.struct(F.lit(side).alias("side"), m.alias("m"), word.alias("word"))
    each = [member(side, m, word) for m in (length, length - 1) for side, word in ((0, F.col("word")), (1, F.reverse("word")))]
    rows = words.select(F.explode(F.array(*each)).alias("r")).select("r.*").where(F.col("m") >= MIN_LENGTH)
    half = F.floor(F.col("m") / 2).cast("int")
    key = F.substring("word", F.lit(1), F.when(F.col("side") == 0, half).otherwise(F.col("m") - half))
    return rows.withColumn("g", F.pmod(F.xxhash64("side", "m", key), F.lit(buckets)))


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): every near pair, both ways."""
    found = members(words).groupBy("g").applyInPandas(_group_pairs, "a string, b string")
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = materialize(word_counts(docs), "spelling-words")
    pairs = materialize(near_words(words), "spelling-pairs")
    counted = pairs.join(words.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    best = counted.groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min_by(F.struct((-F.col("nb")).alias("k"), F.col("b").alias("b")), F.struct((-F.col("nb")).alias("k"), F.col("b"))).alias("top"))
    with_form = (words.join(best.withColumnRenamed("a", "word"), "word", "left")
                 .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(-F.col("top.k") >= FORM_RATIO * F.col("n"), F.col("top.b")).alias("form"),
                         F.when(-F.col("top.k") >= FORM_RATIO * F.col("n"), -F.col("top.k")).cast("long").alias("form_n")))
    with_form = materialize(with_form, "spelling-forms")
    # pointer doubling: root <- root of root until nothing moves
    hop = with_form.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        nxt = materialize(hop.alias("x").join(hop.alias("y"), F.col("x.root") == F.col("y.word"), "left")
                          .select(F.col("x.word").alias("word"), F.coalesce(F.col("y.root"), F.col("x.root")).alias("root"),
                                  (F.col("y.root") != F.col("x.root")).alias("moved")), "spelling-roots")
        if nxt.where("moved").limit(1).count() == 0:
            hop = nxt.drop("moved")
            break
        hop = nxt.drop("moved")
    return with_form.join(hop, "word").select("word", "form", "root", F.col("n").cast("long").alias("n"), "n_near", "form_n")


def stage_spelling(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return variants(docs)


@query("op13_spelling")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
