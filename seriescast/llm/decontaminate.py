"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact containment.

Items are partitioned by the number of their shingles, each partition reaching up to a power of two.  An item's
sketch is its smallest shingle hashes; a partition with sizes up to u keeps floor((1 - t) u) + 1 of them.  An item
with at least the share t of its shingles in a document misses at most floor((1 - t) n) of its n, so at least one
hash of its sketch is among the document's: the search loses nothing.  Sketches are small whatever the length of
the documents, which are probed by all their shingles; so a short item inside a long document is as easy to find
as one that stands alone.  Candidates are verified by their shingles as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriescast.llm.pii import let, same_row
from seriescast.llm.registry import digest, query, table, texts, words
from seriescast.sources.storage import materialize

WIDTH = 5
CONTAINMENT = 0.8


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hash of every run of ``width`` words; none in shorter texts."""
    def of(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - width)
        return F.when(F.size(w) >= width, F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width)))))

    return let(words(text), of)


def shingle_texts(text: Column, width: int = WIDTH) -> Column:
    def of(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - (width - 1))
        return F.when(F.size(w) >= width, F.array_distinct(F.transform(
            at, lambda i: F.array_join(F.slice(w, i, F.lit(width)), " "))))

    return let(words(text), of)


def sketches(items: DataFrame, containment: float) -> DataFrame:
    """(item_id, n, h): the smallest hashes of each item, as many as its size partition asks for."""
    hashed = items.select("item_id", F.array_sort(F.array_distinct(shingle_hashes(F.col("text")))).alias("hs"))
    sized = hashed.withColumn("n", F.size("hs")).filter("n > 0")
    bound = F.pow(F.lit(2), F.ceil(F.log2("n")))
    kept = F.least(F.col("n"), F.floor((1 - containment) * bound + 1e-9) + 1).cast("int")
    return sized.select("item_id", "n", F.explode(F.slice("hs", F.lit(1), kept)).alias("h"))


def verified(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, digest, item_id, n_item, n_shared) of every text that holds an item, see ``contained_items``."""
    rows = texts(docs).withColumn("digest", digest())
    tests = items.groupBy("item_id").agg(F.min("text").alias("text"))
    sketch = materialize(sketches(tests, containment), "sketches")
    probes = rows.select("doc_id", "digest", shingle_hashes(F.col("text")).alias("hs")).select(
        "doc_id", "digest", F.size("hs").alias("runs"), F.explode("hs").alias("h"))
    found = (probes.join(sketch, "h").filter(F.col("runs") >= F.col("n") * containment - 1e-9)
             .select("doc_id", "digest", "item_id").distinct())
    found = materialize(found, "candidates")
    full = tests.select("item_id", shingle_texts(F.col("text")).alias("all")).withColumn("n_item", F.size("all"))
    wanted = found.join(full.select("item_id", "n_item", F.explode("all").alias("shingle")), "item_id")
    held = rows.alias("r").join(found.select("doc_id", "digest").distinct().alias("f"), same_row("r", "f"), "left_semi")
    held = held.groupBy("doc_id", "digest").agg(F.first("text").alias("text")).select(
        "doc_id", "digest", F.explode(shingle_texts(F.col("text"))).alias("shingle"))
    both = wanted.alias("w").join(held.alias("h"), same_row("w", "h") & F.expr("w.shingle = h.shingle"))
    counts = both.groupBy("w.doc_id", "w.digest", "w.item_id").agg(
        F.max("w.n_item").cast("long").alias("n_item"), F.count(F.lit(1)).alias("n_shared"))
    return counts.filter(F.col("n_shared") >= F.col("n_item") * containment - 1e-9)


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every document that holds an item.

    ``items`` has item_id and text.  Containment is the share of the item's distinct runs of five words that the
    document has; words are compared in lower case without punctuation.  Items or documents with fewer than five
    words have no runs and never match, nor do null texts.  Rows of one id are one document's texts, of which the
    best counts; rows without id count together.  Repeated items of one id are one item, its first text by order.
    """
    good = verified(docs, items, containment)
    return good.groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared")
                                                 ).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` whose document holds no benchmark item; a row without id is a document of its own."""
    found = verified(docs, table(spark, sf_dir, "benchmark"))
    mark = lambda doc_id, own: F.when(doc_id.isNull(), own)
    bad = materialize(found.select(F.col("doc_id").alias("bad_id"), mark(F.col("doc_id"), F.col("digest")).alias("bad_text"))
                      .distinct(), "contaminated")
    id_ = F.col("doc_id").cast("long")
    own = mark(id_, digest(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return docs.join(bad, id_.eqNullSafe(F.col("bad_id")) & own.eqNullSafe(F.col("bad_text")), "left_anti")



SQL = """
WITH w AS (SELECT {id} AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'),
                  lambda x: x <> '') AS ws FROM {table}),
     p AS (SELECT id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
SELECT DISTINCT id, array_to_string(ws[i:i + 4], ' ') AS s FROM p"""

ORACLE = f"""
WITH d AS ({SQL.format(id="doc_id", table="documents")}), b AS ({SQL.format(id="item_id", table="benchmark")}),
     n AS (SELECT id, count(*) AS n_item FROM b GROUP BY id),
     x AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM x JOIN n ON n.id = item_id WHERE n_shared >= 0.8 * n_item"""


@query("op4_decontamination", ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
