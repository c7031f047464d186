"""Exact n-gram Jaccard join as a metric-space join with pivots.

Jaccard distance d is a metric; documents link if d <= eps = 0.25. Most documents
share nothing, so every document pivot is at distance 1 from almost all of them, and
a flat Voronoi diagram over document pivots would copy everything everywhere. The
join therefore goes down in levels, each exact:

1. Documents with the same shingle set are one class (distance 0).
2. The first pivots are single shingles. A class is at distance 1 - 1/n of the pivots
   it contains and at 1 of all others; it lies in the regions of its rarest ones. With
   shingles in one global order and t = 0.75, a linked class shares at least one of
   the first n - ceil(t n) + 1 shingles, so being copied to these regions is enough.
3. Inside a region the classes' positions of the shared shingle bound the symmetric
   difference. For a pair whose first common shingle it is, the triangle inequality
   through the region's pivot leaves |x & y| <= min(n_x - i, n_y - j): that, and the
   sizes, are the window a pair must be in.
4. Every region takes its most central class as pivot. What lies within eps of it is
   one component with it, and needs no further pair among itself. The rest of the
   region are boundary classes: they go on with a pivot of their own, recursively, for
   ``levels`` levels, and what is then left in another component than its region's
   pivot is copied to the size cells of its window and compared there.
5. The universe of shingles is cut into parts, more for larger sets. Through each part
   as a pivot, the triangle inequality for the symmetric difference gives |x ^ y| >= the
   sum over parts of | |x in part| - |y in part| |; pairs outside that window are dropped.
6. The others are verified on the whole shingle sets; components follow from the links.

The global order puts frequent shingles last. Their counts are over all documents, in
2**``ORDER_BITS`` buckets of the shingles' hashes: a fixed size at any corpus, in which
a shingle stands out once it is more frequent than the spread of a bucket's other
shingles. Tasks pass their counts on as compressed blocks of buckets, summed in two
steps; workers get the logarithms, a byte per bucket. The order decides speed only: any
order gives the same links. Shingles are 64-bit hashes of whole word sequences.

Defined cases: null and empty texts have an empty set, link with nothing and are
their own component; texts of fewer than five words are one shingle; rows that repeat
an id are one document for links (each row keeps its own n_shingles); a null id is in
no component (null), though its text counts for nobody else's links either; texts of any
length count whole; an empty table gives no rows. Extra columns, of any name, never reach
the join; the stage keeps them as they are.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from marketlens.llm.common import fresh_name, lean, quoted, shuffle_width, stored
from marketlens.llm.components import components
from marketlens.llm.words import WordHash, shingle_set, words

#: A signature has 2**bits parts, about a part for every eight shingles, within these bits.
PARTS_BITS = (6, 16)
#: Regions are keyed by this many bits of a shingle's hash; a collision only adds pairs to verify.
KEY_BITS = 40
#: Buckets of the shingle counts, as bits of a hash: 8 MB for every worker, at any corpus size.
ORDER_BITS = 23
#: The buckets travel in this many blocks.
ORDER_BLOCKS = 64


def _sets(batch, col: int, memo: WordHash):
    for text in batch.column(col).to_pylist():
        yield shingle_set(memo.of(words(text)))
    memo.trim()


def _class_of(s: np.ndarray) -> int | None:
    return np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else None


def _signature(s: np.ndarray) -> bytes:
    """How many shingles lie in each part; two neighbouring parts make one of the next coarser cut."""
    bits = min(PARTS_BITS[1], max(PARTS_BITS[0], int(len(s) // 8).bit_length()))
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint32).tobytes() if counts.max() > 255 else b"\x01" + counts.astype(np.uint8).tobytes()


def _parts(sig: bytes) -> np.ndarray:
    small = len(sig) % 2
    return np.frombuffer(sig, dtype=np.uint8 if small else np.uint32, offset=small).astype(np.int64)


def difference_bound(sig_x: bytes, sig_y: bytes) -> int:
    """A lower bound of the symmetric difference, from two signatures."""
    p, q = _parts(sig_x), _parts(sig_y)
    if len(p) > len(q):
        p, q = q, p
    q = q.reshape(len(p), -1).sum(axis=1)
    return int(np.abs(p - q).sum())


def _bucket(s: np.ndarray) -> np.ndarray:
    """The count bucket of every shingle, by bits that the region keys' order doesn't start with."""
    return (s & np.uint64((1 << ORDER_BITS) - 1)).astype(np.int64)


def _packed(no: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())],
                                      names=["block", "counts"])


def _classes(batches):
    """(doc_id, cls, n, sig) of every row; then (block, counts), the shingles of a task's rows with an id, counted in
    buckets before anything is shuffled. Both from one pass, in rows of their own, the other columns null."""
    memo, counts = WordHash(), np.zeros(1 << ORDER_BITS, dtype=np.int32)  # of one task's shingles
    id_type = None
    names = ["doc_id", "cls", "n", "sig", "block", "counts"]
    for b in batches:
        sets, id_type = list(_sets(b, 1, memo)), b.schema.field(0).type
        known = [s for s, ok in zip(sets, b.column(0).is_valid().to_pylist()) if ok and len(s)]
        if known:
            np.add.at(counts, _bucket(np.concatenate(known)), 1)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([_class_of(s) for s in sets], pa.int64()),
             pa.array([len(s) for s in sets], pa.int64()), pa.array([_signature(s) for s in sets], pa.binary()),
             pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names=names)
    for no, block in enumerate(counts.reshape(ORDER_BLOCKS, -1)):
        if block.any():
            packed = _packed(no, block.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                 *packed.columns], names=names)


def _block_sums(batches):
    """(block, counts): the sum of every block that a task is dealt, one blob at a time."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for no, blob in zip(b.column(0).to_pylist(), b.column(1)):
            counts = np.frombuffer(zlib.decompress(blob.as_buffer()), dtype=np.int64)
            sums[no] = sums[no] + counts if no in sums else counts
    for no, counts in sums.items():
        yield _packed(no, counts)


def _frequencies(blobs: DataFrame) -> np.ndarray:
    """4 * log2 of the shingles of all documents in every bucket: a byte for any 64-bit count.

    ``blobs`` has the tasks' (block, counts). ``ORDER_BLOCKS`` rows of a fixed size reach the driver.
    """
    kind = "block int, counts binary"
    width = shuffle_width(blobs.sparkSession)
    blobs = blobs.withColumn("part", F.spark_partition_id() % max(1, math.isqrt(width)))
    some = blobs.repartition(width, "block", "part").drop("part").mapInArrow(lean("words", _block_sums), kind)
    total = some.repartition(ORDER_BLOCKS, "block").mapInArrow(lean("words", _block_sums), kind)
    level = np.zeros((ORDER_BLOCKS, (1 << ORDER_BITS) // ORDER_BLOCKS), dtype=np.uint8)
    for row in total.collect():
        counts = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.int64)
        level[row["block"]] = np.round(4 * np.log2(1.0 + counts))
    return level.reshape(-1)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _prefixes(shared, percent: int):
    def run(batches):
        counts = shared.value
        memo = WordHash()
        for b in batches:
            ids, cls, ns, keys = b.column(0).to_pylist(), [], [], []
            kept = []
            for i, s in zip(ids, _sets(b, 1, memo)):
                if not len(s):
                    continue
                first = s[np.lexsort((s, counts[_bucket(s)]))[:prefix_size(len(s), percent)]]
                kept.append(i)
                cls.append(_class_of(s))
                ns.append(len(s))
                keys.append((first >> np.uint64(64 - KEY_BITS)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept, b.schema.field(0).type), pa.array(cls, pa.int64()), pa.array(ns, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "x", "n", "keys"])
    return run


def _apart(percent: int):
    """Keeps the pairs whose signatures allow a link."""
    def run(batches):
        for b in batches:
            n = b.column(2).to_numpy() + b.column(3).to_numpy()
            bound = np.array([difference_bound(p, q) for p, q in
                              zip(b.column(4).to_pylist(), b.column(5).to_pylist())], dtype=np.int64)
            ok = pa.array((100 + percent) * bound <= (100 - percent) * n)
            yield pa.RecordBatch.from_arrays([b.column(i).filter(ok) for i in (0, 1)], names=["x", "y"])
    return run


def _verify(docs: DataFrame, reps: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of classes whose whole sets reach the threshold."""
    one = reps.select(F.col("cls").alias("x"), F.col("n").alias("x_n"), F.col("sig").alias("x_sig"))
    two = reps.select(F.col("cls").alias("y"), F.col("n").alias("y_n"), F.col("sig").alias("y_sig"))
    pairs = stored(pairs.join(one, "x").join(two, "y").select("x", "y", "x_n", "y_n", "x_sig", "y_sig")
                   .mapInArrow(lean("words", _apart(percent)), "x long, y long"), "join-pairs")
    need = pairs.select(F.col("x").alias("cls")).unionByName(pairs.select(F.col("y").alias("cls"))).distinct()
    # Sorted, so that the ids are stored small and Spark sees how small.
    ids = stored(reps.join(need, "cls", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
                 .orderBy("doc_id"), "join-ids")

    def run(batches):
        memo, seen = WordHash(), set()
        for b in batches:
            sets = {c: s for s in _sets(b, 1, memo) if (c := _class_of(s)) is not None and c not in seen}
            seen.update(sets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets, pa.int64()), pa.array([s.tobytes() for s in sets.values()], pa.binary())],
                names=["cls", "set"])

    sets = stored(docs.join(ids, "doc_id", "left_semi").mapInArrow(lean("words", run), "cls long, set binary"), "join-sets")

    def check(batches):
        for b in batches:
            a, c = [], []
            for x, y, p, q in zip(*(b.column(i).to_pylist() for i in range(4))):
                p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    a.append(x)
                    c.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    left = sets.select(F.col("cls").alias("x"), F.col("set").alias("x_set"))
    right = sets.select(F.col("cls").alias("y"), F.col("set").alias("y_set"))
    return stored(pairs.join(left, "x").join(right, "y").select("x", "y", "x_set", "y_set")
                  .mapInArrow(lean("words", check), "a long, b long"), "join-links")


def _in_window(percent: int, a: str = "", b: str = "o_"):
    """Whether two members of a region can be linked, by their sizes and positions."""
    n1, n2, i1, i2 = F.col(f"{a}n"), F.col(f"{b}n"), F.col(f"{a}pos"), F.col(f"{b}pos")
    return ((100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))
            & ((100 + percent) * F.least(n1 - i1, n2 - i2) >= percent * (n1 + n2)))


def _central():
    """Orders a region's classes: the most central one has the fewest rarer shingles, for its size."""
    return F.struct((F.col("pos") / F.col("n")).alias("at"), "x", "n", "pos")


def _repivoted(members: DataFrame) -> DataFrame:
    """Members of the regions that hold two or more, with a pivot chosen among these."""
    pivot = (members.groupBy("s").agg(F.count("*").alias("size"), F.min(_central()).alias("p")).where("size > 1")
             .select("s", F.col("p.x").alias("o_x"), F.col("p.n").alias("o_n"), F.col("p.pos").alias("o_pos")))
    return members.select("s", "x", "n", "pos").join(pivot, "s")


def _pivot_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of a member and its region's pivot that can be linked."""
    return (members.where((F.col("x") != F.col("o_x")) & _in_window(percent))
            .select(F.least("x", "o_x").alias("x"), F.greatest("x", "o_x").alias("y")).distinct())


def _labelled(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members and pivots with their components so far."""
    own = comp.select(F.col("a").alias("x"), F.col("b").alias("c"))
    piv = comp.select(F.col("a").alias("o_x"), F.col("b").alias("o_c"))
    return (members.join(own, "x", "left").join(piv, "o_x", "left")
            .withColumn("c", F.coalesce("c", "x")).withColumn("o_c", F.coalesce("o_c", "o_x")))


def _residual_pairs(members: DataFrame, percent: int, cells: float = 1.2) -> DataFrame:
    """Pairs of a region in different components, met in size cells.

    ``members`` has s, x, n, pos, c (component) and o_c (the pivot's). Classes outside
    the pivot's component look into the size cells of their window; everyone is at
    home in one cell. Pairs inside the pivot's component need no comparison. A window
    spans a factor of 16 / 9 at most, so about four cells of ratio ``cells``.
    """
    cell = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(cells))).cast("int")
    lo = F.floor(F.col("n") * percent / 100)
    hi = F.least(F.ceil(F.col("n") * 100 / percent),
                 F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent - F.col("n")))
    away = (members.where(F.col("c") != F.col("o_c")).withColumn("lo", F.greatest(lo, F.lit(1))).withColumn("hi", hi)
            .where("hi >= lo")
            .select("s", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"), "x", "n", "pos", "c"))
    home = members.select("s", cell(F.col("n")).alias("cell"), F.col("x").alias("o_x"), F.col("n").alias("o_n"),
                          F.col("pos").alias("o_pos"), F.col("c").alias("h_c"))
    met = away.join(home, ["s", "cell"]).where((F.col("c") != F.col("h_c")) & _in_window(percent))
    return met.select(F.least("x", "o_x").alias("x"), F.greatest("x", "o_x").alias("y")).distinct()


def linked_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75,
                      levels: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    both = stored(src.mapInArrow(lean("words", _classes), f"doc_id {kind}, cls long, n long, sig binary, block int, counts binary"),
                  "join-classes")
    rows = both.where("block is null").select("doc_id", "cls", "n", "sig")
    known = rows.where("doc_id is not null and cls is not null")
    reps = stored(known.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"),
                                           F.first("sig").alias("sig")), "join-reps")
    named = src.where("doc_id is not null and text is not null")
    shared = spark.sparkContext.broadcast(_frequencies(both.where("block is not null").select("block", "counts")))
    # Copies go before their shingles are spread: rows that aren't their class's first.
    row_key = F.xxhash64("x", "doc_id")
    copies = stored(known.select(F.col("cls").alias("x"), "doc_id").join(
        reps.select(F.col("cls").alias("x"), "rep"), "x").where("doc_id <> rep").select(row_key.alias("copy")).distinct()
        .orderBy("copy"), "join-copies")
    lists = named.mapInArrow(lean("words", _prefixes(shared, percent)), f"doc_id {kind}, x long, n long, keys array<long>")
    spread = (lists.join(copies, row_key == F.col("copy"), "left_anti")
              .select("x", "n", F.posexplode("keys").alias("pos", "s")))
    # One exchange: whether a region holds two classes, or more, and its pivot.
    region = Window.partitionBy("s")
    middle = (F.col("x") != F.col("lo")) & (F.col("x") != F.col("hi"))
    members = stored(spread.withColumn("lo", F.min("x").over(region)).withColumn("hi", F.max("x").over(region))
                     .withColumn("p", F.min(_central()).over(region)).withColumn("large", F.max(middle).over(region))
                     .where("lo < hi")
                     .select("s", "x", "n", F.col("pos").cast("long").alias("pos"), F.col("p.x").alias("o_x"),
                             F.col("p.n").alias("o_n"), F.col("p.pos").cast("long").alias("o_pos"), "large"),
                     "join-regions")

    several = known.groupBy("doc_id").agg(F.min("cls").alias("a"), F.collect_set("cls").alias("all")) \
        .where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")
    links = stored(several, "join-links")
    comp = components(links)
    # A region of two classes is done with its pivot's pair.
    large = members.where("large").drop("large")
    todo = members.drop("large")
    for level in range(levels):
        if level:
            # Boundary classes go on with a pivot of their own; one component needs no more pairs.
            todo = _repivoted(stored(_labelled(todo if level > 1 else large, comp).where("c <> o_c")
                                     .select("s", "x", "n", "pos"), "join-boundary"))
        links = links.unionByName(_verify(named, reps, _pivot_pairs(todo, percent), percent))
        comp = components(links)
    rest = _residual_pairs(_labelled(large, comp), percent)
    links = links.unionByName(_verify(named, reps, rest, percent))
    comp = components(links)

    label = F.coalesce("b", "cls")
    lowest = (reps.select("cls", "rep").join(comp, F.col("cls") == F.col("a"), "left").withColumn("label", label)
              .select("cls", "label", "rep"))
    smallest = lowest.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_class = lowest.join(smallest, "label").select(F.col("cls").alias("k_cls"), "component_id")
    out = rows.join(by_class, F.col("cls") == F.col("k_cls"), "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def without_duplicates(docs: DataFrame, *, percent: int = 75) -> DataFrame:
    """One document of each component: the one with the smallest id, all its columns kept.

    Rows that repeat an id are one document, of which the smallest row stays; rows with
    a null id, and documents without words, are in no group and stay.
    """
    found = stored(linked_components(docs.select("doc_id", "text"), percent=percent), "dedup-found")
    other = fresh_name(docs, "other_id")
    gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias(other)).distinct(), "dedup-gone")
    again = stored(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1")
                   .select(F.col("doc_id").alias(other)), "dedup-again")
    same = F.col("doc_id") == F.col(other)
    kept = docs.join(gone, same, "left_anti")
    once = kept.join(again, same, "left_anti")
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    one = kept.join(again, same, "left_semi").groupBy("doc_id").agg(F.min(row).alias("row")).select("row.*")
    return once.unionByName(one)
