"""Conversation structure repair by Four-Russians block tables.

A conversation's rows become symbols: must-delete, or one of four role initials with a
whole or a truncated text. Roles have to follow ``(s?(ua)+)?``, an automaton of four
states. For every suffix of the symbols there is a vector, the cheapest cost from each
state to the end; its differences are bounded, so after normalising by the least entry
only a handful of vectors exist (``Tables`` finds them by closure). The tables hold, for
every block of ``BLOCK`` symbols and every normalised vector behind it, the normalised
vector before it and the cost that was taken off. A conversation is read from its end,
one lookup a block; then the blocks are expanded one after another, each backward from the
vector behind it, and walked forward by the least edit initial that keeps the cheapest
cost, which gives the ASCII-least of the cheapest edits.

Rows are ordered by a range partitioning, so a conversation of any size is cut into
segments. Blocks compose, and so do segments: each of a cut conversation's segments gives
its map of vectors, from which the vector behind each segment follows, then its map of
states, from which the state before each follows; then all segments are walked at once.
Equal rows travel as one row with a count. Only the digest of a cut conversation is
sequential: one task streams its lines in order, a chunk at a time.

Defined cases: null role or text is one space, a null conversation id is a conversation of
its own and null turns come first; rows of one turn are ordered by role, then text; rows
that repeat are duplicates of the first; a role of another initial can only be deleted or
reroled; a conversation without rows after the damage has zeros, an empty audit and the
digest of the empty string; without input there are no rows. Texts of any length are taken
whole, and extra columns never reach the operator.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from marketlens.llm.common import shuffle_width, stored

# Costs of the edits and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
INITIALS = "sua"
BLOCK = 4
WHITE = " \t\n\x0b\x0c\r"
CHUNK_BYTES = 1 << 20

#: States: nothing yet, after system, after user, after assistant. By state: where a system,
#: user or assistant row leads (None: not allowed), and where the one role that may be written leads.
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
#: Symbols: 0 has to go; then whole and truncated rows by initial (s, u, a, other).
MUST_GO, N_SYMBOLS = 0, 9
NEVER = 1 << 20


def symbol(initial: str, truncated: bool) -> int:
    return 1 + (INITIALS + initial).index(initial) + 4 * truncated if initial in INITIALS and initial else 4 + 4 * truncated


def _with_inserts(v: list[int]) -> tuple[int, ...]:
    u, a = min(v[2], v[3] + INSERT), min(v[3], v[2] + INSERT)
    return min(v[0], u + INSERT), min(v[1], u + INSERT), u, a


def _before(sym: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end from before a row, from those after it."""
    best = []
    for q in range(4):
        c = after[q] + DELETE
        if sym != MUST_GO:
            stays = TRUNCATED * (sym > 4)
            c = min(c, after[NEXT[q]] + REROLE + stays)
            to = KEEP[q].get((INITIALS + "?")[(sym - 1) % 4])
            if to is not None:
                c = min(c, after[to] + stays)
        best.append(c)
    return _with_inserts(best)


class Tables:
    """Normalised vectors (the first is the end's) and their transitions by symbol and by block."""

    def __init__(self):
        end = _with_inserts([0, NEVER, NEVER, 0])
        self.vectors, known = [end], {end: 0}
        one, cost = [], []
        for v in self.vectors:  # grows while it is read: the closure
            for s in range(N_SYMBOLS):
                w = _before(s, v)
                low = min(w)
                w = tuple(x - low for x in w)
                if w not in known:
                    known[w] = len(self.vectors)
                    self.vectors.append(w)
                one.append(known[w])
                cost.append(low)
        self.to = np.array(one, dtype=np.int16).reshape(-1, N_SYMBOLS).T  # symbol, vector behind it
        self.cost = np.array(cost, dtype=np.int64).reshape(-1, N_SYMBOLS).T
        # A block's number reads its symbols as digits, the first one the highest.
        self.block_to, self.block_cost = self.to.copy(), self.cost.copy()
        for _ in range(BLOCK - 1):  # one more symbol in front
            nxt = self.to[:, self.block_to].reshape(-1, len(self.vectors))
            add = (self.cost[:, self.block_to] + self.block_cost).reshape(-1, len(self.vectors))
            self.block_to, self.block_cost = nxt, add

    def blocks(self, syms: bytes) -> tuple[bytes, np.ndarray]:
        """The symbols before the first whole block, and the numbers of the blocks."""
        head = len(syms) % BLOCK
        digits = np.frombuffer(syms, dtype=np.uint8)[head:].reshape(-1, BLOCK).astype(np.int64)
        return syms[:head], digits @ (N_SYMBOLS ** np.arange(BLOCK - 1, -1, -1))

    def maps(self, syms: bytes) -> np.ndarray:
        """The vector before a segment for every vector behind it."""
        head, numbers = self.blocks(syms)
        at = np.arange(len(self.vectors))
        for no in numbers[::-1]:
            at = self.block_to[no][at]
        for s in reversed(head):
            at = self.to[s][at]
        return at

    def trace(self, syms: bytes, behind: int, state: int, last: bool):
        """(edits of every row, edits at the end, cost, state): an edit is its initial, an insertion before it I."""
        head, numbers = self.blocks(syms)
        ends, vec = [behind], behind
        for no in numbers[::-1].tolist():
            vec = int(self.block_to[no, vec])
            ends.append(vec)
        edits, spent, at = [], 0, 0
        for length, vec in [(len(head), ends[-1])] * bool(head) + [(BLOCK, v) for v in ends[-2::-1]]:
            part, vecs = syms[at:at + length], [vec]
            for s in reversed(part):  # the block backward
                vecs.append(int(self.to[s, vecs[-1]]))
            vecs.reverse()
            for s, here, there in zip(part, vecs, vecs[1:]):
                base, after, done = int(self.cost[s, there]), self.vectors[there], ""
                stays = TRUNCATED * (s > 4)
                while True:
                    left = self.vectors[here][state] + base
                    if after[state] + DELETE == left:
                        done, spent = done + "D", spent + DELETE
                        break
                    if self.vectors[here][NEXT[state]] + base + INSERT == left:
                        done, spent, state = done + "I", spent + INSERT, NEXT[state]
                        continue
                    to = KEEP[state].get((INITIALS + "?")[(s - 1) % 4]) if s != MUST_GO else None
                    if to is not None and after[to] + stays == left:
                        done, spent, state = done + "K", spent + stays, to
                    else:
                        done, spent, state = done + "R", spent + REROLE + stays, NEXT[state]
                    break
                edits.append(done)
            at += length
        tail = ""
        if last:
            while state in (1, 2):
                tail, spent, state = tail + "I", spent + INSERT, NEXT[state]
        return edits, tail, spent, state


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """conv, turn, role, text, n: the rows after the damage that crc32 of ``conv:turn`` does, equal ones as one with a count."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name("conv"), F.lit(":"), name("turn"))) % 20
    rows = rows.withColumn("fault", fault).where("fault <> 0")
    return rows.select(
        "conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"),
    ).groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("n"))


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows in order, cut into segments: ``seg`` and ``idx`` number them."""
    keys = ["conv", "turn", "role"]
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    ranged = (rows.repartitionByRange(shuffle_width(rows.sparkSession), *keys, F.substring("text", 1, 32))
              .sortWithinPartitions(*keys, "text"))
    return stored(ranged.select(
        F.spark_partition_id().alias("seg"), F.monotonically_increasing_id().alias("idx"), *keys, "text", "n",
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))).alias("said")), "turns")


def _seen(rows: DataFrame) -> DataFrame:
    """(seg, idx) of the rows whose role and text an earlier row of the conversation has."""
    keys = rows.select("conv", "said", "seg", "idx")
    first = (keys.groupBy("conv", "said").agg(F.min(F.struct("seg", "idx")).alias("first"), F.count("*").alias("k"))
             .where("k > 1").select(F.col("conv").alias("c"), F.col("said").alias("s"), "first"))
    return (keys.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")))
            .where(F.struct("seg", "idx") != F.col("first")).select("seg", "idx"))


def _marked(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Every segment's rows in order; a row seen before follows a row that says so, with a null role."""
    marks = seen.select("seg", "idx", *[F.lit(None).cast(rows.schema[c].dataType).alias(c)
                                        for c in rows.columns if c not in ("seg", "idx")])
    n = shuffle_width(rows.sparkSession)
    return rows.unionByName(marks).repartition(n, "seg").drop("said")


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.sortWithinPartitions("seg", "idx", F.col("role").isNotNull())


class _Segment:
    """One segment's symbols and counts; ``lines`` keeps (role, text, n) of its rows."""

    def __init__(self):
        self.syms, self.lines = bytearray(), []
        self.turns = self.blank = self.dup = self.cut = self.illegal = 0
        self.turn = [None, None]
        self.initials = [None, None]

    def add(self, turn, role, text, n, blank, cut, seen):
        initial = role[:1]
        if blank or seen:
            self.syms += bytes(n)
            self.blank += n * blank
            self.dup += n * (not blank)
        else:
            self.syms.append(symbol(initial, cut))
            self.syms += bytes(n - 1)
            self.cut += cut
            self.dup += n - 1
        if self.initials[1] is not None:
            self.illegal += self.initials[1] + initial not in LEGAL
        self.illegal += n - 1
        self.initials = [initial if self.initials[0] is None else self.initials[0], initial]
        if turn is not None and turn != self.turn[1]:
            self.turns += 1
            self.turn = [turn if self.turn[0] is None else self.turn[0], turn]
        self.lines.append((role, text, n))

    def repaired(self, edits: list[str], tail: str, state: int):
        """The lines that stay or are written, as bytes."""
        at = 0
        for role, text, n in self.lines:
            for done in edits[at:at + n]:
                for e in done:
                    if e == "D":
                        continue
                    if e == "K":
                        state = KEEP[state][role[:1]]
                        yield f"{role}:{text}".encode("utf-8", "surrogatepass")
                    else:
                        yield f"{ROLE[state]}:{text if e == 'R' else ''}".encode("utf-8", "surrogatepass")
                        state = NEXT[state]
            at += n
        for _ in tail:
            yield f"{ROLE[state]}:".encode()
            state = NEXT[state]


LEGAL = ("su", "ua", "au")


def _read(rows, with_text: bool) -> _Segment:
    s, seen = _Segment(), False
    for r in rows:
        turn, role, text, n, blank, cut = r[3:9]
        if role is None:
            seen = True
            continue
        s.add(turn, role, text if with_text else None, n, blank, cut, seen)
        seen = False
    return s


def _whole(batches):
    """(seg, conv, rows in order); a mark takes the conversation of the row that it stands in front of."""
    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def marked(own):
        mark = None
        for r in own:
            if r[4] is None:
                mark = r
                continue
            if mark is not None and mark[1] == r[1]:
                yield (*mark[:2], r[2], *mark[3:])
            mark = None
            yield r
    for seg, own in groupby(rows(), key=lambda r: r[0]):
        for conv, part in groupby(marked(own), key=lambda r: r[2]):
            yield seg, conv, part


COLUMNS = ["seg", "idx", "conv", "turn", "role", "text", "n", "blank", "cut"]


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def _plan(marked: DataFrame, rows: DataFrame, kind) -> DataFrame:
    """(c, seg, behind, state, parts) of the segments of conversations that were cut.

    A partition shares conversations with at most its two neighbours, so the result has
    at most two rows a partition and is broadcast.
    """
    schema = f"c {kind.simpleString()}, seg int"
    per = (rows.select("conv", "seg").distinct().groupBy("conv").agg(F.collect_list("seg").alias("segs"))
           .where(F.size("segs") > 1).select(F.col("conv").alias("c_conv"), F.explode("segs").alias("c_seg")))
    cut = F.broadcast(stored(per, "cut"))
    mine = marked.drop("text").withColumn("text", F.lit("")).select(*COLUMNS)
    mine = mine.join(cut, (F.col("seg") == F.col("c_seg")) & (F.col("conv").eqNullSafe(F.col("c_conv")) | F.col("role").isNull()),
                     "left_semi")
    at = _arrow(kind)

    def symbols(batches):
        for seg, conv, part in _whole(batches):
            s = _read(part, False)
            if s.syms:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv], at), pa.array([seg], pa.int32()), pa.array([bytes(s.syms)], pa.binary())], names=["c", "seg", "syms"])
    syms = _in_order(mine).mapInArrow(symbols, f"{schema}, syms binary").join(
        cut, (F.col("seg") == F.col("c_seg")) & F.col("c").eqNullSafe(F.col("c_conv")), "left_semi")
    syms = stored(syms, "symbols")

    def maps(batches):
        for b in batches:
            got = [tables().maps(x).tolist() for x in b.column("syms").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("seg"), pa.array(got, pa.list_(pa.int32()))], names=["c", "seg", "map"])

    def behind(table: pa.Table) -> pa.Table:
        order = sorted(zip(table["seg"].to_pylist(), table["map"].to_pylist()), reverse=True)
        vec, out = 0, []
        for seg, to in order:
            out.append((seg, vec))
            vec = to[vec]
        return pa.table({"c": pa.array([table["c"][0].as_py()] * len(out), at), "seg": pa.array([x[0] for x in out], pa.int32()),
                         "behind": pa.array([x[1] for x in out], pa.int32()),
                         "last": pa.array([i == 0 for i in range(len(out))])})
    found = (syms.mapInArrow(maps, f"{schema}, map array<int>").groupBy("c").applyInArrow(behind, f"{schema}, behind int, last boolean"))
    both = syms.alias("a").join(found.alias("b"), F.col("a.c").eqNullSafe(F.col("b.c")) & (F.col("a.seg") == F.col("b.seg"))) \
        .select("a.c", "a.seg", "syms", "behind", "last")

    def states(batches):
        for b in batches:
            got = [[tables().trace(x, v, q, False)[3] for q in range(4)]
                   for x, v in zip(b.column("syms").to_pylist(), b.column("behind").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("seg"), b.column("behind"), b.column("last"),
                                              pa.array(got, pa.list_(pa.int32()))], names=["c", "seg", "behind", "last", "ends"])

    def before(table: pa.Table) -> pa.Table:
        t, q, out = table.sort_by("seg"), 0, []
        for ends in t["ends"].to_pylist():
            out.append(q)
            q = ends[q]
        return t.drop(["ends"]).append_column("state", pa.array(out, pa.int32()))
    return both.mapInArrow(states, f"{schema}, behind int, last boolean, ends array<int>").groupBy("c") \
        .applyInArrow(before, f"{schema}, behind int, last boolean, state int")


STATS = ("lo long, hi long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, "
         "first string, final string, audit string")


def _walk(kind):
    at = _arrow(kind)
    names = ["conv", "seg", "alone", "part", "chunk", "lo", "hi", "turns", "blank", "duplicate", "truncated", "illegal",
             "cost", "first", "final", "audit", "sha"]
    types = [at, pa.int32(), pa.bool_(), pa.int32(), pa.binary(), *[pa.int64()] * 8, *[pa.string()] * 4]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        held = []
        for seg, conv, part in _whole(batches):
            part = list(part)
            behind, last, state = part[-1][9:12]
            alone = behind is None
            s = _read(part, True)
            start = 0 if alone else state
            edits, tail, cost, _ = tables().trace(bytes(s.syms), 0 if alone else behind, start, alone or last)
            sha, chunk, n, any_line = hashlib.sha256(), bytearray(), 0, False
            for line in s.repaired(edits, tail, start):
                if alone:
                    sha.update(b"\n" + line if any_line else line)
                else:
                    chunk += b"\n" + line
                any_line = True
                if len(chunk) >= CHUNK_BYTES:
                    n += 1
                    yield batch([(conv, seg, False, n, bytes(chunk), *[None] * 12)])
                    chunk.clear()
            if chunk:
                yield batch([(conv, seg, False, n + 1, bytes(chunk), *[None] * 12)])
            held.append((conv, seg, alone, 0, None, *s.turn, s.turns, s.blank, s.dup, s.cut, s.illegal, cost, *s.initials,
                         "".join(edits) + tail, sha.hexdigest() if alone else None))
            if len(held) >= 256:
                yield batch(held)
                held = []
        if held:
            yield batch(held)
    return run, (f"conv {kind.simpleString()}, seg int, alone boolean, part int, chunk binary, {STATS}, sha string")


def _digests(kind):
    """(c, sha) of cut conversations, whose chunks come in order; each starts with the newline before its first line."""
    at = _arrow(kind)

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))
        for conv, part in groupby(rows(), key=lambda r: r[0]):
            sha, first = hashlib.sha256(), True
            for _, _, _, chunk in part:
                sha.update(chunk[1:] if first else chunk)
                first = False
            yield pa.RecordBatch.from_arrays([pa.array([conv], at), pa.array([sha.hexdigest()])], names=["c", "sha"])
    return run, f"c {kind.simpleString()}, sha string"


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The report of every conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    kind = turns.schema[conv].dataType
    rows = _ordered(damage(turns, conv, turn, role, text))
    marked = _marked(rows, stored(_seen(rows), "seen"))
    plan = F.broadcast(stored(_plan(marked, rows, kind), "segments").select(
        "c", F.col("seg").alias("p_seg"), "behind", "last", "state"))
    run, schema = _walk(kind)
    planned = marked.join(plan, (F.col("seg") == F.col("p_seg")) & F.col("conv").eqNullSafe(F.col("c")), "left") \
        .select(*COLUMNS, "behind", "last", "state")
    walked = stored(_in_order(planned).mapInArrow(run, schema), "walked")
    whole = walked.where("alone").select(
        "conv", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0)).alias("gaps"),
        *COUNTS[1:], "audit", "sha")
    # Cut conversations: at most two rows a partition here, besides the chunks.
    parts = walked.where("not alone and part = 0")
    w = Window.partitionBy("conv").orderBy("seg")
    known = F.last("hi", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    pair = F.concat(F.lag("final").over(w), F.col("first"))
    parts = parts.withColumn("again", F.coalesce((known == F.col("lo")).cast("long"), F.lit(0))) \
        .withColumn("seam", F.when(pair.isNotNull() & ~pair.isin(*LEGAL), 1).otherwise(0))
    joined = parts.groupBy("conv").agg(
        F.coalesce(F.max("hi") - F.min("lo") + 1 - F.sum("turns") + F.sum("again"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.sum("illegal") + F.sum("seam")).alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    digest, digest_schema = _digests(kind)
    n = shuffle_width(turns.sparkSession)
    shas = (walked.where("not alone and part > 0").select("conv", "seg", "part", "chunk").repartition(n, "conv")
            .sortWithinPartitions("conv", "seg", "part").mapInArrow(digest, digest_schema))
    cut = joined.join(shas, F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    found = whole.unionByName(cut)
    ids = turns.select(F.col(conv).alias("id")).distinct()
    return ids.join(found, F.col("id").eqNullSafe(F.col("conv")), "left").select(
        F.col("id").alias(conv), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
