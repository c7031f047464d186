"""Ranked lexical search of whole texts by a hybrid of two ways to read inverted lists.

The documents become an inverted index over the items' terms, in blocks of documents: a
block's row holds the ids and lengths of its documents and, term by term, its list of
(document, count). The corpus numbers come from all blocks: documents, terms, and each
term's documents. Every task then answers every item, block by block:

* Term at a time: the item's short lists are summed into accumulators, which from then on
  are one iterator over documents, bounded by their greatest sum.
* Document at a time: this iterator and the long lists are ordered by bound. Lists whose
  bounds together stay below the score to beat can't bring in a document, so only the
  others propose; the proposed documents are looked up in one list after the other,
  skipping over all others, and dropped once what is left can't lift them.

The score to beat starts with the k-th best accumulator and carries over from block to
block of a task. A task keeps k documents an item, and these lists are merged by rank.

Bounds: the items go in blocks of about ``ITEM_BLOCK`` (item, term) pairs, each a pass over
the documents; only such a block's terms and their document counts reach the driver and are
broadcast. A long or frequent list is never whole anywhere, but in pieces by block.

Defined cases: rows are documents, and items, of their own, also if ids repeat or are null
(equal scores: null ids last); null and empty texts, and texts without terms, are in no
list and not counted; without documents or items the result is empty; extra columns never
reach the operator.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from marketlens.llm.common import stored

K = 10
BLOCK_DOCS = 4096
BLOCK_POSTINGS = 400_000
ITEM_BLOCK = 200_000
#: Lists are short as long as together they hold at most this share of a block's documents.
SHORT_SHARE = 0.5
#: Terms are letters and digits of ASCII and everything beyond it; A-Z is lower-cased.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERMS).split() if text else []


def _item_terms(batches):
    for b in batches:
        rows = [(k, t, n) for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                for t, n in zip(*np.unique(np.array(terms(text), dtype=object), return_counts=True))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
                                          pa.array([int(r[2]) for r in rows], pa.int64())], names=["key", "term", "reps"])


class _Block:
    """Documents read so far, and the numbers of their terms that any item has."""

    def __init__(self):
        self.ids, self.n, self.found, self.postings = [], [], [], 0

    def row(self, n_terms: int):
        docs = len(self.ids)
        at = np.repeat(np.arange(docs, dtype=np.int64), [len(x) for x in self.found])
        word = np.fromiter((t for x in self.found for t in x), dtype=np.int64, count=len(at))
        pairs, tf = np.unique(word * docs + at, return_counts=True)
        word, at = pairs // max(docs, 1), pairs % max(docs, 1)
        names, df = np.unique(word, return_counts=True)
        n = np.array(self.n, dtype=np.int64)
        return (self.ids, n.tobytes(), int((n > 0).sum()), int(n.sum()), names.tolist(), df.tolist(),
                at.astype(np.int32).tobytes(), tf.astype(np.int32).tobytes())


INDEX = "n binary, docs long, length long, terms array<int>, df array<long>, at binary, tf binary"


def _indexer(vocabulary, kind: pa.DataType):
    names = ["ids", "n", "docs", "length", "terms", "df", "at", "tf"]
    types = [pa.list_(kind), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def batch(block):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(block.row(len(vocabulary.value)), types)], names=names)

    def run(batches):
        number = {t: i for i, t in enumerate(vocabulary.value)}
        get, block = number.get, _Block()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ts = terms(text)
                if not ts:
                    continue
                hits = [i for i in map(get, ts) if i is not None]
                block.ids.append(doc)
                block.n.append(len(ts))
                block.found.append(hits)
                block.postings += len(hits)
                if len(block.ids) >= BLOCK_DOCS or block.postings >= BLOCK_POSTINGS:
                    yield batch(block)
                    block = _Block()
        if block.ids:
            yield batch(block)
    return run


class Top:
    """The k best (score, id) of one item so far; equal scores by id, nulls last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def beat(self) -> int:
        """A document needs at least this score."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        rows = self.rows + list(zip(scores.tolist(), ids))
        self.rows = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))[:self.k]


class Lists:
    """A block's lists with what each posting adds for a weight of one."""

    def __init__(self, names, df, at: bytes, tf: bytes, n: bytes, docs: int, length: int):
        self.docs = len(n) // 8
        m = 25 + (75 * np.frombuffer(n, dtype=np.int64) * docs) // length
        self.at = np.frombuffer(at, dtype=np.int32)
        tf = np.frombuffer(tf, dtype=np.int32).astype(np.int64)
        self.adds = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.at])
        ends = np.cumsum(df)
        self.span = {t: (int(e - d), int(e)) for t, d, e in zip(names, df, ends)}
        most = np.maximum.reduceat(self.adds, ends - df) if len(self.at) else []
        self.most = dict(zip(names, map(int, most)))

    def search(self, weights: list[tuple[int, int]], k: int, beat: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that reach ``beat`` and can be among the k best; (term, weight) pairs in."""
        lists = sorted((self.span[t][1] - self.span[t][0], t, w) for t, w in weights if t in self.span and w > 0)
        sums, taken, held = np.zeros(self.docs, dtype=np.int64), 0, 0
        while taken < len(lists) and held + lists[taken][0] <= SHORT_SHARE * self.docs:
            size, t, w = lists[taken]
            a, e = self.span[t]
            sums[self.at[a:e]] += w * self.adds[a:e]  # a document is in a list once
            taken, held = taken + 1, held + size
        short = np.flatnonzero(sums)
        if len(short) >= k:
            beat = max(beat, int(np.partition(sums[short], len(short) - k)[len(short) - k]))
        # One bounded iterator of accumulators (None) among the long lists.
        order = [(int(sums.max()), None, 1)] if len(short) else []
        order = sorted(order + [(w * self.most[t], t, w) for _, t, w in lists[taken:]], key=lambda x: -x[0])
        left = np.cumsum([x[0] for x in order][::-1])[::-1].tolist() + [0]  # the bounds from each list on
        proposing = sum(x >= beat for x in left[:-1])
        if not proposing:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        scores = np.zeros(self.docs, dtype=np.int64)
        for _, t, w in order[:proposing]:
            if t is None:
                scores[short] += sums[short]
            else:
                a, e = self.span[t]
                scores[self.at[a:e]] += w * self.adds[a:e]
        found = np.flatnonzero(scores)
        got = scores[found]
        for i, (_, t, w) in enumerate(order[proposing:], proposing):
            keep = got + left[i] >= beat
            found, got = found[keep], got[keep]
            if t is None:
                got = got + sums[found]
                continue
            a, e = self.span[t]
            own = self.at[a:e]
            to = np.minimum(np.searchsorted(own, found), len(own) - 1)  # skips to each document
            got = got + np.where(own[to] == found, w * self.adds[a:e][to], 0)
        keep = got >= beat
        found, got = found[keep], got[keep]
        if len(got) > k:
            keep = got >= np.partition(got, len(got) - k)[len(got) - k]
            found, got = found[keep], got[keep]
        return found, got


def _searcher(queries, docs: int, length: int, k: int, kind: pa.DataType):
    def run(batches):
        items, best = queries.value, {}
        for b in batches:
            for row in b.to_pylist():
                lists = Lists(row["terms"], np.array(row["df"], dtype=np.int64), row["at"], row["tf"], row["n"], docs, length)
                for key, weights in items:
                    top = best.get(key) or best.setdefault(key, Top(k))
                    found, got = lists.search(weights, k, top.beat)
                    if len(found):
                        top.add(got, [row["ids"][i] for i in found.tolist()])
        rows = [(key, doc, score) for key, top in best.items() for score, doc in top.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind),
                                          pa.array([r[2] for r in rows], pa.int64())], names=["key", "doc", "score"])
    return run


def _one_block(docs: DataFrame, own: list, k: int, kind) -> DataFrame | None:
    """(key, doc, score): the k best documents of every item in ``own``, rows (key, term, reps)."""
    from pyspark.sql.pandas.types import to_arrow_type
    spark, arrow = docs.sparkSession, to_arrow_type(kind)
    vocabulary = sorted({bytes(r["term"]) for r in own})
    number = {t: i for i, t in enumerate(vocabulary)}
    send = spark.sparkContext.broadcast
    name = kind.simpleString()
    index = stored(docs.mapInArrow(_indexer(send(vocabulary), arrow), f"ids array<{name}>, {INDEX}"), "lists")
    n, length = index.agg(F.sum("docs"), F.sum("length")).first()
    if not n:
        return None
    zipped = index.select(F.explode(F.arrays_zip("terms", "df")).alias("p"))
    df = dict(zipped.groupBy("p.terms").agg(F.sum("p.df").alias("df")).collect())  # at most the block's terms
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    items: dict[int, list] = {}
    for r in own:
        t = number[bytes(r["term"])]
        if t in weight:
            items.setdefault(r["key"], []).append((t, weight[t] * r["reps"]))
    return index.mapInArrow(_searcher(send(list(items.items())), n, length, k, arrow), f"key long, doc {name}, score long")


def ranked(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
           item_text: str = "text", k: int = K) -> DataFrame:
    """item id, rank, doc id, score: the k best documents of every item."""
    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    keyed = stored(items.select(F.monotonically_increasing_id().alias("key"), F.col(item_id).alias("item"),
                                F.col(item_text).alias("text")), "items")
    pairs = stored(keyed.select("key", "text").mapInArrow(_item_terms, "key long, term binary, reps long"), "item-terms")
    blocks = max(1, math.ceil(pairs.count() / ITEM_BLOCK))
    found = []
    for b in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()  # about ITEM_BLOCK rows
        if own and (part := _one_block(src, own, k, src.schema["doc"].dataType)) is not None:
            found.append(part)
    if not found:
        found = [docs.sparkSession.createDataFrame([], f"key long, doc {src.schema['doc'].dataType.simpleString()}, score long")]
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(keyed.select("key", "item"), "key").select(
        F.col("item").alias(item_id), "rank", F.col("doc").alias(id_col), "score")


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+') AS t
  FROM documents WHERE text IS NOT NULL
), q AS (
  SELECT i, item_id, term, count(*) AS reps FROM (
    SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+')) AS term
    FROM benchmark WHERE text IS NOT NULL)
  GROUP BY ALL
), c AS (
  SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS length FROM d WHERE len(t) > 0
), p AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM p, c GROUP BY term, docs
), s AS (
  SELECT i, item_id, r, CAST(sum(reps * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.t) * docs) // length)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (r), c GROUP BY ALL
), k AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM s JOIN d USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
