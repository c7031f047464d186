"""Byte-level BPE encoding and decoding by recursive DuckDB queries per partition.

A worker splits its texts at the tokenizer's pattern and gathers the distinct
pieces it has not met before. They become token-position rows in an in-process
DuckDB; a recursive query joins neighbouring tokens to the merge table and
contracts every piece's leftmost pair of minimum rank until no pair is left. The
same query decodes each piece by an ordered aggregation of its tokens' bytes.
Documents are the concatenation of their pieces, both ways: their chunks between safe
spaces are numbered once, and a batch's ids are one gather over what the numbers stand
for. What is known outlives a task, as texts share most words. Chunks age at
1.5 times ``cache_entries`` or ``CACHE_BYTES``, pieces at ``cache_entries``, and are forgotten if
they aren't met again until the next time. So memory stays bounded.

Defined cases: null texts are empty and give no ids; pieces that are a token as a
whole are taken whole, as the tokenizer's library does; pieces of more than
``LONG_BYTES`` bytes go through the same contraction with a heap, as one recursion
step per merge would be quadratic in their length; repeated rows are encoded each; texts of
any length are encoded whole; an empty table gives no rows. Extra columns, of any name, never
reach the operator.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from marketlens.llm.common import entering, held_by

LONG_BYTES = 256
BLOCK_PIECES = 10_000
#: Entries of a generation: pieces, and half as many chunks more; there are two generations. A worker
#: takes about 130 bytes an entry, and larger generations contract fewer pieces again.
CACHE_ENTRIES, CACHE_BYTES = 350_000, 48 << 20

#: Contract every piece's leftmost pair of minimum rank until a fixpoint, then decode.
RECURSION = """
WITH RECURSIVE state(piece, done, toks) AS (
  SELECT piece, false, list(tok ORDER BY pos) FROM piece_bytes GROUP BY piece
  UNION ALL
  SELECT s.piece, b.best IS NULL,
         CASE WHEN b.best IS NULL THEN s.toks
              ELSE s.toks[:(b.best & 65535) - 1] || [(b.best >> 16)::INTEGER] || s.toks[(b.best & 65535) + 2:] END
  FROM state s LEFT JOIN (
    SELECT piece, min((m.rank::BIGINT << 16) | pos) AS best
    FROM (SELECT piece, unnest(generate_series(1, len(toks) - 1)) AS pos,
                 unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r FROM state WHERE NOT done) p
    JOIN merges m ON m.l = p.l AND m.r = p.r
    GROUP BY piece) b ON b.piece = s.piece
  WHERE NOT s.done
)
SELECT t.piece, list(t.tok ORDER BY t.pos) AS ids, string_agg(v.hex, '' ORDER BY t.pos) AS bytes
FROM (SELECT piece, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM state WHERE done) t
JOIN vocabulary v ON v.id = t.tok
GROUP BY t.piece ORDER BY t.piece
"""

_BREAK = re.compile(r" (?=\S)(?<=\S )")


class _Numbers(dict):
    """Numbers strings in the order they are met; ``new`` holds those without ids so far."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


WHOLE, ODD, UNSAFE = range(3)  # a chunk decodes to itself, or not, or can't be looked up by itself


class Coder:
    """Encodes and decodes pieces; one per worker process and vocabulary."""

    def __init__(self, vocab_path: str, pattern: str, entries: int = CACHE_ENTRIES):
        import duckdb
        import regex

        self.entries = entries

        self.pattern = regex.compile(pattern)
        with open(vocab_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {i: b for b, i in self.ranks.items()}
        l, r, rank = array("i"), array("i"), array("i")
        for b, i in self.ranks.items():
            for k in range(1, len(b)):
                if (left := self.ranks.get(b[:k])) is not None and (right := self.ranks.get(b[k:])) is not None:
                    l.append(left)
                    r.append(right)
                    rank.append(i)
        self.byte_ids = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int32)
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB"})
        self.con.register("m_in", pa.table({n: np.frombuffer(x, dtype=np.int32) for n, x in (("l", l), ("r", r), ("rank", rank))}))
        self.con.register("v_in", pa.table({"id": pa.array(list(self.token), pa.int32()),
                                            "hex": [b.hex() for b in self.token.values()]}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m_in; CREATE TABLE vocabulary AS SELECT * FROM v_in")
        self.clear()

    def clear(self) -> None:
        self.pieces: dict[str, bytes] = {}  # ids as little-endian unsigned 32-bit integers
        self.aged: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}  # decoded bytes of the pieces that don't decode to themselves
        self._new_chunks()
        self.aged_chunks = ({}, self.ids, self.ends, self.kind)

    def _new_chunks(self) -> None:
        self.spaced = _Numbers()  # chunks that follow a space
        self.ids = np.empty(0, dtype="<u4")  # of all chunks, one after another
        self.ends = np.zeros(1, dtype=np.int64)
        self.kind = np.empty(0, dtype=np.uint8)
        self.odd_chunks: dict[int, bytes] = {}
        self.held = 0

    def _keep(self, piece: str, raw: bytes, ids: bytes, text: bytes) -> None:
        self.pieces[piece] = ids
        if text != raw:
            self.odd[piece] = text

    def _contract(self, pieces: list[str]) -> None:
        """Ids and bytes of new pieces, by one recursive query."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        toks = [np.array([i], dtype=np.int32) if (i := self.ranks.get(b)) is not None
                else self.byte_ids[np.frombuffer(b, dtype=np.uint8)] for b in raw]
        lens = np.array([len(t) for t in toks])
        flat = np.concatenate(toks)
        piece = np.repeat(np.arange(len(raw), dtype=np.int32), lens)
        pos = (np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32)
        self.con.register("piece_bytes", pa.table({"piece": piece, "pos": pos, "tok": flat}))
        for i, ids, text in self.con.execute(RECURSION).fetchall():
            self._keep(pieces[i], raw[i], np.array(ids, dtype="<u4").tobytes(), bytes.fromhex(text))
        self.con.unregister("piece_bytes")

    def _contract_long(self, piece: str) -> None:
        """The same contraction for one long piece, with a heap of (rank, position)."""
        raw = piece.encode("utf-8", "surrogatepass")
        if raw in self.ranks:
            self._keep(piece, raw, np.array([self.ranks[raw]], dtype="<u4").tobytes(), raw)
            return
        n = len(raw)
        end, after, before = [i + 1 for i in range(n)], [i + 1 for i in range(n)], [i - 1 for i in range(n)]
        rank = lambda i: self.ranks.get(raw[i:end[after[i]]]) if after[i] < n else None
        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or rank(i) != r:
                continue
            j = after[i]
            alive[j], end[i], after[i] = False, end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k))
        ids = [self.ranks[raw[i:end[i]]] for i in range(n) if alive[i]]
        self._keep(piece, raw, np.array(ids, dtype="<u4").tobytes(), b"".join(self.token[i] for i in ids))

    def _learn(self, chunks: list[str]) -> list[list[str]]:
        """Pieces of every chunk; new ones are contracted block by block."""
        cut = [self.pattern.findall(c) for c in chunks]
        small = []
        for p in {p for ps in cut for p in ps if p not in self.pieces}:
            if (ids := self.aged.get(p)) is not None:
                self.pieces[p] = ids
            elif len(p) * 4 > LONG_BYTES and len(p.encode("utf-8", "surrogatepass")) > LONG_BYTES:
                self._contract_long(p)
            else:
                small.append(p)
        for i in range(0, len(small), BLOCK_PIECES):
            self._contract(small[i:i + BLOCK_PIECES])
        return cut

    def _decoded(self, pieces: list[str]) -> bytes | None:
        """The bytes that the pieces decode to; None if these are their own."""
        if not self.odd or not any(p in self.odd for p in pieces):
            return None
        return b"".join(self.odd[p] if p in self.odd else p.encode("utf-8", "surrogatepass") for p in pieces)

    def _number(self, heads: list[str]) -> list[list[str]]:
        """Ids of the chunks that were met for the first time; the pieces of ``heads``, learnt with them."""
        new, self.spaced.new = self.spaced.new, []
        first = len(self.kind)
        kind = np.array([UNSAFE if not c or c[0].isspace() or c[-1].isspace() else WHOLE for c in new], dtype=np.uint8)
        ids = [b""] * len(new)
        known, old_ids, old_ends, old_kind = self.aged_chunks
        safe = []
        for i in np.flatnonzero(kind == WHOLE).tolist():
            if (k := known.get(new[i])) is not None and old_kind[k] == WHOLE:
                ids[i] = old_ids[old_ends[k]:old_ends[k + 1]].tobytes()
            else:
                safe.append(i)
        cut = self._learn([" " + new[i] for i in safe] + heads)
        for i, ps in zip(safe, cut):
            ids[i] = self.pieces[ps[0]] if len(ps) == 1 else b"".join([self.pieces[p] for p in ps])
            if (text := self._decoded(ps)) is not None:
                kind[i], self.odd_chunks[first + i] = ODD, text
        self.held += sum(map(len, new)) + sum(map(len, ids))
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), dtype="<u4")])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)])
        self.kind = np.concatenate([self.kind, kind])
        return cut[len(safe):]

    def _plain(self, text: str, pieces: list[list[str]]) -> tuple[bytes, bytes]:
        """(ids, decoded bytes) of one text from all its pieces."""
        ps = [p for c in pieces for p in c]
        text_bytes = self._decoded(ps)
        return (b"".join([self.pieces[p] for p in ps]),
                text.encode("utf-8", "surrogatepass") if text_bytes is None else text_bytes)

    def code(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, decoded bytes) of every text.

        A space between two characters that aren't white space always starts a new
        piece, so texts are cut there and the chunks are looked up as they are. Where
        all pieces decode to themselves, so does the text.
        """
        if len(self.spaced) > 1.5 * self.entries or self.held > CACHE_BYTES:
            self.aged_chunks = (dict(self.spaced), self.ids, self.ends, self.kind)
            self._new_chunks()
        if len(self.pieces) > self.entries:
            self.aged, self.pieces = self.pieces, {}
            self.odd = {p: x for p, x in self.odd.items() if p in self.aged}
        parts = [t.split(" ") for t in texts]
        rest = [p[1:] for p in parts]
        at = np.fromiter(map(self.spaced.__getitem__, chain.from_iterable(rest)), dtype=np.int64,
                         count=sum(map(len, rest)))
        heads = self._number([p[0] for p in parts])
        kind, start = self.kind[at], self.ends[at]
        size = self.ends[at + 1] - start
        flat = self.ids[np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        to = np.concatenate([[0], np.cumsum(size)])
        edge = np.concatenate([[0], np.cumsum([len(r) for r in rest])]).astype(np.int64)
        out = []
        for n, (text, p) in enumerate(zip(texts, parts)):
            a, e = edge[n], edge[n + 1]
            worst = kind[a:e].max() if e > a else WHOLE
            head = p[0]
            if not head or head[-1].isspace() or worst == UNSAFE:
                chunks = _BREAK.split(text)
                chunks = chunks[:1] + [" " + c for c in chunks[1:]]
                out.append(self._plain(text, self._learn(chunks)))
                continue
            ids = b"".join([self.pieces[x] for x in heads[n]]) + flat[to[a]:to[e]].tobytes()
            odd_head = self._decoded(heads[n])
            if worst == WHOLE and odd_head is None:
                raw = text.encode("utf-8", "surrogatepass")
            else:
                raw = head.encode("utf-8", "surrogatepass") if odd_head is None else odd_head
                raw += b"".join(self.odd_chunks[i] if k == ODD else (" " + c).encode("utf-8", "surrogatepass")
                                for i, k, c in zip(at[a:e].tolist(), kind[a:e].tolist(), rest[n]))
            out.append((ids, raw))
        return out


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(vocab_path: str, pattern: str, entries: int = CACHE_ENTRIES) -> Coder:
    """This process's coder; tables and cache outlive a task when Spark reuses the worker, until
    another operator's task starts in it."""
    entering("bpe")
    key = (vocab_path, pattern)
    if key not in _CODERS:
        _CODERS[key] = Coder(*key)
    held_by("bpe", _release)
    _CODERS[key].entries = entries
    return _CODERS[key]


def _release() -> None:
    for c in _CODERS.values():
        c.con.close()
    _CODERS.clear()


def encode(docs: DataFrame, vocab_path: str, pattern: str, *, id_col: str = "doc_id",
           text_col: str = "text", cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (binary) of every row."""
    def run(batches):
        c = coder(vocab_path, pattern, cache_entries)
        for b in batches:
            got = c.code([x or "" for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x[0]) // 4 for x in got], pa.int64()),
                 pa.array([x[0] for x in got], pa.binary()), pa.array([x[1] for x in got], pa.binary())],
                names=["id", "n_tokens", "ids", "decoded"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = src.mapInArrow(run, StructType([StructField("id", src.schema["id"].dataType), StructField("n_tokens", LongType()),
                                          StructField("ids", BinaryType()), StructField("decoded", BinaryType())]))
    return out.withColumnRenamed("id", id_col)
