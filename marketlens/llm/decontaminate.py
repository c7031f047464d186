"""Benchmark decontamination by size-partitioned MinHash containment search.

Benchmark items are short, documents may be long, so the search is for items whose
shingle set is contained in a document's to at least ``percent``. Items are
partitioned by size into classes of doubling width. An item's MinHash sketch is its
k smallest shingle hashes, with k set per class: an item of u shingles that is
contained to t misses at most u - ceil(t u) of them, so with

    k = top - ceil(t * top) + 1        (top: largest size of the class)

at least one hash of the sketch is in the document. Documents are never sketched:
each of their shingles probes the sketches, and no contained item can be missed at
any document length. Candidates are then verified by exact shingle strings.

Everything is built-in DataFrame functions. The sketch table is written to the
shared folder, so that Spark joins it by its true size: broadcast if small, by a
shuffle otherwise.

Defined cases: null or empty texts contain nothing and are contained in nothing; an
item of fewer than five words is one shingle of that many words; rows that repeat a
document or item id are one document or item with all their shingles; rows with a
null document id are documents by their text; items with a null id take no part; an
empty table gives no rows; texts of any length are searched whole. Extra columns, of any
name, never reach the search; the stage keeps them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketlens.llm.common import fresh_name, stored

SHINGLE = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: str) -> Column:
    parts = F.split(F.translate(F.col(text), UPPER, LOWER), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def _starts(n: int) -> Column:
    """Start positions of the n-word shingles of ``words``; none if it has fewer words."""
    return F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - (n - 1))).otherwise(
        F.array().cast("array<int>"))


def hashed(n: int) -> Column:
    return F.transform(_starts(n), lambda i: F.xxhash64(F.lit(n), *[F.element_at("words", i + j) for j in range(n)]))


def spelled(n: int) -> Column:
    return F.transform(_starts(n), lambda i: F.array_join(F.slice("words", i, F.lit(n)), " "))


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """(item_id, width, h, s, n_item): the distinct shingles of every item."""
    items = (benchmark.where(F.col("item_id").isNotNull()).select("item_id", word_array("text").alias("words"))
             .where(F.size("words") > 0))
    parts = None
    for n in range(1, SHINGLE + 1):
        of_n = items.where(F.size("words") == n if n < SHINGLE else F.size("words") >= n)
        part = of_n.select("item_id", F.lit(n).alias("width"),
                           F.explode(F.arrays_zip(hashed(n).alias("h"), spelled(n).alias("s"))).alias("z"))
        part = part.select("item_id", "width", F.col("z.h").alias("h"), F.col("z.s").alias("s"))
        parts = part if parts is None else parts.unionByName(part)
    parts = parts.distinct()
    size = parts.groupBy("item_id").agg(F.count("*").alias("n_item"))
    return parts.join(size, "item_id")


def sketches(shingles: DataFrame, percent: int) -> DataFrame:
    """(item_id, width, h): each item's k smallest hashes, k by size class."""
    top = F.pow(F.lit(2.0), F.floor(F.log2("n_item")) + 1).cast("long") - 1
    k = top - F.ceil(top * percent / F.lit(100)) + 1
    order = Window.partitionBy("item_id").orderBy("h", "s")
    return (shingles.withColumn("k", k).withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("k"))
            .select("item_id", "width", "h").distinct())


def _with_key(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): rows with a null id are told apart by their text."""
    key = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.concat(F.lit("t"), F.sha2("text", 256)))
    return docs.where(F.col("text").isNotNull()).select(key.alias("key"), "doc_id", "text")


def contained_items(docs: DataFrame, benchmark: DataFrame, *, percent: int = 75) -> DataFrame:
    """key, doc_id, item_id, n_shared, n_item, containment of all pairs at or above ``percent``."""
    items = stored(item_shingles(benchmark), "decon-items")
    sketch = stored(sketches(items, percent), "decon-sketches")
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most five numbers
    keyed = _with_key(docs)
    wordy = keyed.select("key", word_array("text").alias("words"))
    hits = None
    for n in widths:
        probe = wordy.select("key", F.explode(hashed(n)).alias("h"))
        hit = probe.join(sketch.where(F.col("width") == n).select("h", "item_id"), "h").select("key", "item_id")
        hits = hit if hits is None else hits.unionByName(hit)
    if hits is None:
        hits = keyed.select("key", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id")).limit(0)
    cand = stored(hits.distinct(), "decon-candidates")
    found = keyed.join(cand.select("key").distinct(), "key", "left_semi")
    ids = found.select("key", "doc_id").distinct()
    wordy = found.select("key", word_array("text").alias("words"))
    shared = None
    for n in widths:
        own = wordy.select("key", F.explode(spelled(n)).alias("s"))
        part = own.join(items.where(F.col("width") == n).select("s", "item_id", "n_item"), "s")
        shared = part if shared is None else shared.unionByName(part)
    if shared is None:
        shared = cand.select("key", F.lit("").alias("s"), "item_id", F.lit(1).cast("long").alias("n_item"))
    counts = (shared.join(cand, ["key", "item_id"], "left_semi").groupBy("key", "item_id", "n_item")
              .agg(F.countDistinct("s").alias("n_shared"))
              .where(F.col("n_shared") * 100 >= F.col("n_item") * percent))
    return counts.join(ids, "key").select("key", "doc_id", "item_id", "n_shared", "n_item",
                                          (F.col("n_shared") / F.col("n_item")).alias("containment"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, percent: int = 75) -> DataFrame:
    """The documents that contain no item, all their columns kept."""
    name = fresh_name(docs, "contaminated")
    found = stored(contained_items(docs.select("doc_id", "text"), benchmark, percent=percent).select("key").distinct(),
                   "decon-found").withColumnRenamed("key", name)
    key = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.concat(F.lit("t"), F.sha2("text", 256)))
    return docs.join(found, key == F.col(name), "left_anti")


SQL = """
WITH dw AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents WHERE text IS NOT NULL
), bw AS (
  SELECT item_id, [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), bi AS (
  SELECT item_id, least(len(w), 5) AS k, w, unnest(generate_series(1, len(w) - least(len(w), 5) + 1)) AS i
  FROM bw WHERE len(w) > 0
), items AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM bi
), di AS (
  SELECT doc_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i
  FROM dw, (SELECT DISTINCT k FROM items) WHERE len(w) >= k
), docs AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM di
), sizes AS (
  SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id
)
SELECT d.doc_id, b.item_id, count(*) AS n_shared, any_value(z.n_item) AS n_item,
       count(*) / any_value(z.n_item) AS containment
FROM docs d JOIN items b ON d.s = b.s AND d.k = b.k JOIN sizes z ON z.item_id = b.item_id
GROUP BY d.doc_id, b.item_id HAVING 100 * count(*) >= 75 * any_value(z.n_item)
"""
