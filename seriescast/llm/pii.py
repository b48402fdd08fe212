"""Personal data in text, and terms that reveal it, by DataFrame functions alone.

Base kinds are found by patterns.  Their values are the protected entities.  What a term says about an entity is
estimated from how often the two occur together: with p(e) the share of documents that mention the entity and
p(e | t) the share among those with the term, the term discloses

    PMI(e; t) / IC(e) = (log p(e | t) - log p(e)) / -log p(e)

of the entity's information content.  Terms above a threshold are generalised, and removed if they give all of
it away.  Copies of one passage count as one mention, so that copied text isn't taken for evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriescast.llm.registry import digest, query, table, texts, words
from seriescast.sources.storage import materialize

KINDS = ("email", "ip", "card", "phone", "term")

# The base patterns.  The look-behind and possessive forms find the same matches as the plain ones
# but never scan a run of characters twice, so that a text without spaces takes linear time too.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){11,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
WORD = r"[\p{L}\p{N}]+"

PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
SIDE = 64  # characters of context on each side of an entity

DISCLOSURE = 0.8
REMOVAL = 1.0
SUPPORT = 3


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = F.reverse(digits(value))
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substr(d, i, F.lit(1)).cast("int")
        twice = x * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x)

    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


#: kind: pattern, what a text must hold to be searched at all, which matches count.
BASE: dict[str, tuple[str, Callable[[Column], Column], Callable[[Column], Column]]] = {
    "email": (EMAIL, lambda t: F.instr(t, "@") > 0, lambda v: F.lit(True)),
    "ip": (IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(rf"^(?:{PART}\.){{3}}{PART}$")),
    "card": (CARD, lambda t: t.rlike(CARD), luhn),
    "phone": (PHONE, lambda t: F.instr(t, "+") > 0, lambda v: F.length(digits(v)).between(9, 15)),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches in order, each with the gap before it and the text around it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def around(gaps: Column) -> Column:
        pairs = F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
        both = F.zip_with(pairs, F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(1))), lambda p, after: F.struct(
            p["gap"].alias("gap"), p["value"].alias("value"), F.coalesce(after, F.lit("")).alias("after")))
        return F.transform(F.filter(both, lambda m: m["value"].isNotNull()), lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(m["gap"]).alias("gap"), m["value"].alias("value"),
            F.concat_ws(" ", F.right(m["gap"], F.lit(SIDE)), F.left(m["after"], F.lit(SIDE))).alias("context")))

    return let(F.split(text, pattern, -1), around)


MATCH = "array<struct<kind:int,i:int,gap:int,value:string,context:string>>"


def located(rows: DataFrame, found: Column) -> DataFrame:
    """(doc_id, digest, kind, start, end, value, context): matches exploded, with places in code points."""
    hits = rows.select("doc_id", "digest", F.explode(found).alias("m")).select("doc_id", "digest", "m.*")
    hits = hits.groupBy("doc_id", "digest", "kind", "i").agg(  # rows that repeat
        *(F.first(c).alias(c) for c in ("gap", "value", "context")))
    w = Window.partitionBy("doc_id", "digest", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(w)
    return hits.withColumn("end", end).select(
        "doc_id", "digest", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value", "context")


def base_spans(rows: DataFrame) -> DataFrame:
    """Spans of the base kinds in (doc_id, digest, text)."""
    none = F.array().cast(MATCH)
    every = [F.when(may(F.col("text")), matches(F.col("text"), pattern, k).cast(MATCH)).otherwise(none)
             for k, (pattern, may, _) in enumerate(BASE.values())]
    spans = located(rows, F.concat(*every))
    valid = F.lit(False)
    for k, (_, _, ok) in enumerate(BASE.values()):
        valid = F.when(F.col("kind") == k, ok(F.col("value"))).otherwise(valid)
    return spans.filter(valid)


def entity() -> Column:
    """The protected value: letters in one case, numbers by their digits."""
    return F.when(F.col("kind") < 2, F.lower("value")).otherwise(digits(F.col("value")))


def disclosing_terms(rows: DataFrame, spans: DataFrame, disclosure: float = DISCLOSURE,
                     support: int = SUPPORT) -> DataFrame:
    """(kind, entity, term, ratio) of terms that disclose an entity, from counts over all documents.

    A pair counts only if it occurs in ``support`` different passages.
    """
    n = rows.count()
    mentions = spans.select("kind", entity().alias("entity"), "context").distinct()
    terms = F.array_distinct(F.filter(words(F.col("context")), lambda w: w.rlike(r"\p{L}{2}")))
    times = mentions.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("n_e")).filter(F.col("n_e") >= support)
    pairs = (mentions.join(times.select("kind", "entity"), ["kind", "entity"], "left_semi")
             .select("kind", "entity", F.explode(terms).alias("term"))
             .groupBy("kind", "entity", "term").agg(F.count(F.lit(1)).alias("n_et")).filter(F.col("n_et") >= support))
    pairs = materialize(pairs.join(times, ["kind", "entity"]), "pii-pairs")
    held = rows.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    documents = held.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))  # summed before it meets the pairs
    gain = F.log(F.lit(float(n)) * F.col("n_et") / (F.col("n_e") * F.greatest("n_t", "n_et")))
    content = F.log(F.lit(float(n)) / F.col("n_e"))
    return (pairs.join(documents, "term").filter(content > 0).withColumn("ratio", gain / content)
            .filter(F.col("ratio") >= disclosure).select("kind", "entity", "term", "ratio"))


def document_terms(spans: DataFrame, revealing: DataFrame) -> DataFrame:
    """(doc_id, digest, term, ratio): what each document must not say, given what it mentions."""
    held = spans.select("doc_id", "digest", "kind", entity().alias("entity")).distinct()
    return held.join(revealing, ["kind", "entity"]).groupBy("doc_id", "digest", "term").agg(F.max("ratio").alias("ratio"))


def same_row(a: str, b: str) -> Column:
    return F.expr(f"{a}.doc_id <=> {b}.doc_id AND {a}.digest = {b}.digest")


def term_spans(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, digest, kind, start, end, ratio) of every occurrence of a document's terms."""
    held = terms.select("doc_id", "digest").distinct()
    some = rows.alias("r").join(held.alias("h"), same_row("r", "h"), "left_semi")
    spots = located(some, matches(F.col("text"), WORD, len(BASE))).withColumn("word", F.lower("value"))
    return spots.alias("s").join(terms.alias("t"), same_row("s", "t") & F.expr("s.word = t.term")).select(
        "s.doc_id", "s.digest", "s.kind", "s.start", "s.end", "t.ratio")


def keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("digest", digest())


def find_pii(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans) of each row.

    Spans are kind:start:end in code points.  A null or empty text has none; repeated rows and null ids each give
    their row.  Tables in which nothing repeats have no term spans.
    """
    rows = keyed(docs)
    base = materialize(base_spans(rows), "pii-spans")
    terms = materialize(document_terms(base, disclosing_terms(rows, base, disclosure, support)), "pii-terms")
    spans = base.select("doc_id", "digest", "kind", "start", "end").unionByName(
        term_spans(rows, terms).select("doc_id", "digest", "kind", "start", "end"))
    names = F.array(*map(F.lit, KINDS))
    text = F.concat_ws(":", F.get(names, F.col("kind")), F.col("start"), F.col("end"))
    per_row = spans.groupBy("doc_id", "digest").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", text.alias("span")))).alias("s"),
        *(F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(KINDS))).alias("p")
    every = F.coalesce("s", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,span:string>>"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: x["span"]), ",")
    return (rows.select("doc_id", "digest").alias("r").join(per_row, same_row("r", "p"), "left")
            .select("r.doc_id", *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS),
                    F.sha2(listed(F.filter(every, lambda x: x["kind"] < len(BASE))).cast("binary"), 256).alias("base_sha256"),
                    listed(every).alias("spans")))


def replaced(text: Column, pattern: str, make: Callable[[Column], Column]) -> Column:
    """The text with every match replaced by what ``make`` gives for it."""
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       lambda gap, value: F.concat(gap, F.coalesce(make(value), F.lit(""))))
    return F.array_join(parts, "")


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, removal: float = REMOVAL,
             support: int = SUPPORT) -> DataFrame:
    """``docs`` with base kinds masked as [EMAIL] and so on, terms generalised to [TERM] or removed.

    Every row and column stays; ``n_chars`` is brought up to date where there is one.  Null texts stay null.
    """
    rows = keyed(docs)
    base = materialize(base_spans(rows), "pii-spans")
    found = document_terms(base, disclosing_terms(rows, base, disclosure, support))
    terms = materialize(found.groupBy("doc_id", "digest").agg(
        F.collect_list(F.when(F.col("ratio") < removal, F.col("term"))).alias("general"),
        F.collect_list(F.when(F.col("ratio") >= removal, F.col("term"))).alias("gone")), "pii-terms")
    id_, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    own = docs.columns
    out = docs.select(F.struct(*own).alias("own"), F.col("text").alias("clean"), id_.alias("doc_id"),
                      digest(text).alias("digest")).alias("d").join(terms.alias("t"), same_row("d", "t"), "left")
    out = out.select("own", "clean", "general", "gone")
    t = F.col("clean")
    word = lambda v: F.when(F.array_contains("gone", F.lower(v)), "").when(
        F.array_contains("general", F.lower(v)), "[TERM]").otherwise(v)
    for kind, (pattern, may, ok) in BASE.items():
        mask = lambda v, ok=ok, kind=kind: F.when(ok(v), F.lit(f"[{kind.upper()}]")).otherwise(v)
        out = out.withColumn("clean", F.when(may(t), replaced(t, pattern, mask)).otherwise(t))
    out = out.withColumn("clean", F.when(F.col("gone").isNotNull(), replaced(t, WORD, word)).otherwise(t))
    new = {"text": t, **({"n_chars": F.when(t.isNull(), F.col("own.n_chars")).otherwise(
        F.length(t).cast(docs.schema["n_chars"].dataType))} if "n_chars" in own else {})}
    return out.select(*(new.get(c, F.col(f"own.`{c}`")).alias(c) for c in own))


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise(docs)


@query("op3_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
