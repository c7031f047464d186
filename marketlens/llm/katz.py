"""Katz backoff language model: counting, storing and scoring.

Counts come from all training documents, of all words and of all bigrams (a document's
start and end count among the words here). Tables are partitioned by a 64-bit hash of
the n-gram. Good-Turing discounts the counts up to ``K``, and the freed mass of a
history goes to the words not seen after it,

    P(w | h) = d(c) c(h w) / c(h)                  if c(h w) > 0
             = alpha(h) P(w)                       otherwise
    P(w)     = d(c) c(w) / N, or the mass left over for one unknown word

where alpha(h) = (1 - sum of seen P(. | h)) / (1 - sum of their P(.)) normalises
exactly; a history without bigrams has alpha 1.

The work goes by groups of documents, at most one input partition and about
``GROUP_TOKENS`` tokens each. A group's texts are read once and stored as numbers of
its sorted word hashes. It asks every table bucket for the n-grams it holds, once each,
and gets the corpus counts back in the order it asked. The buckets of the bigram table
ask those of the unigram table in the same way, and send them sums for each history
they hold; alpha stays with the history's unigram and goes back to the groups that asked
for it. A group's tokens are then evaluated from its replies. What is shuffled grows
with the distinct n-grams of the groups, and no n-gram's or history's occurrences ever
meet in one task.

Defined cases: null texts are empty and have the end token alone; without training
rows every word is the unknown word, with probability 1; counts of counts are smoothed by a
log-linear fit before they discount (copies make them uneven), and where they don't
fall faster than 1 / r, or fewer than two of them are there, the absolute discount
n1 / (n1 + 2 n2) takes its place; a distribution that would
leave no mass is scaled to leave one count; rows that repeat are scored each, and
count each; words and bigrams are identified by a 64-bit hash; ``phi`` above 0 leaves out
the bigrams of words with a smaller share of the tokens, by default none; texts of any length
are counted and scored whole; an empty table gives no rows. Extra columns, of any name, never
reach the model.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from marketlens.llm.common import fold, shuffle_width, stored
from marketlens.llm.words import words

K = 5
START, END = b" ", b""  # no word holds a space or is empty
BLOB = "kind int, bucket int, grp long, keys binary, h binary, w binary, counts binary"
GROUP_TOKENS = 2_000_000


class _Local(dict):
    """Numbers words in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.int32, count=len(ws))

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self), dtype=np.uint64, count=len(self))


START_KEY, END_KEY = (np.uint64(xxhash.xxh3_64_intdigest(w)) for w in (START, END))


def _pack(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: the high bytes of small numbers vanish."""
    raw = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unpack(b: bytes, dtype=np.int64) -> np.ndarray:
    if not b:
        return np.empty(0, dtype)
    raw = pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T.copy().view(dtype).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.uint64), dtype=np.uint64)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)).astype(np.int64) % buckets


def _pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit hash of (history, word), from their hashes."""
    x = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in the sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def _by_bucket(at: np.ndarray):
    """(bucket, places) of every bucket met; places keep their order."""
    order = np.argsort(at, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
        if len(part):
            yield int(at[part[0]]), part


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts x, where each distinct value starts in it, and each x's number among these."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    number = np.empty(len(x), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return order, np.flatnonzero(new), number


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)],
                                      names=[n for n, _ in fields])


def _pair_row(bucket: int, grp: int, words: np.ndarray, h: np.ndarray, w: np.ndarray, counts: np.ndarray) -> tuple:
    """Row of bigrams, given as places in the sorted hashes ``words``."""
    used, inv = np.unique(np.concatenate([h, w]), return_inverse=True)
    inv = inv.astype(np.uint32)
    return (2, bucket, grp, _pack_keys(words[used]), _pack(inv[:len(h)]), _pack(inv[len(h):]),
            _pack(counts.astype(np.int64)))


def _pairs(keys: bytes, h: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the histories and words of such a row."""
    words = _keys(keys)
    return words[_unpack(h, np.uint32)], words[_unpack(w, np.uint32)]


def _code(id_type: pa.DataType):
    """A row per group of documents: ids, training flags, lengths, sorted word hashes, words as places in these."""
    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        local, ids, train, docs = _Local(), [], [], []

        def out():
            local[START], local[END]
            hashes = local.hashes()
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            sizes = np.array([len(d) for d in docs], dtype=np.int64)
            row = [(part << 24) + made], [ids], [_pack(np.array(train, np.uint8))], [_pack(sizes)], \
                [_pack_keys(hashes[order])], [_pack(rank[np.concatenate(docs)])]
            kinds = [pa.int64(), pa.list_(id_type), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)],
                                              names=["grp", "ids", "train", "sizes", "keys", "codes"])

        tokens = 0
        for b in batches:
            for i, text, f in zip(*(b.column(k).to_pylist() for k in range(3))):
                d = local.of(words(text) + [END])
                ids.append(i)
                train.append(f)
                docs.append(d)
                tokens += len(d)
                if tokens >= GROUP_TOKENS:
                    yield out()
                    made, tokens = made + 1, 0
                    local, ids, train, docs = _Local(), [], [], []
        if docs:
            yield out()
    return run


class _Group:
    """Words and bigrams of a group's row."""

    def __init__(self, sizes: bytes, keys: bytes, codes: bytes):
        self.sizes, self.keys, self.w = _unpack(sizes), _keys(keys), _unpack(codes, np.uint32).astype(np.int32)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.start = int(np.searchsorted(self.keys, START_KEY))
        self.h = np.empty_like(self.w)
        self.h[1:] = self.w[:-1]
        self.h[self.first] = self.start
        self.order, self.starts, self.number = _distinct(self.h.astype(np.int64) * len(self.keys) + self.w)
        at = self.order[self.starts]
        self.pair_h, self.pair_w = self.h[at], self.w[at]

    def words_by_bucket(self, buckets: int):
        return _by_bucket(_bucket(self.keys, buckets))

    def pairs_by_bucket(self, side: int):
        """By a grid of history and word, so that a bucket holds few words; a frequent word is in ``side`` of them."""
        at = _bucket(self.keys, side)
        return _by_bucket(at[self.pair_h] * side + at[self.pair_w])


def _ask(buckets: int, side: int):
    """Every group's words and bigrams with their training counts, a row per bucket."""
    def run(batches):
        for b in batches:
            for g, train, *row in zip(*(b.column(n).to_pylist() for n in ("grp", "train", "sizes", "keys", "codes"))):
                group = _Group(*row)
                flags = np.repeat(_unpack(train, np.uint8), group.sizes).astype(np.int64)
                c = np.add.reduceat(flags[group.order], group.starts)
                # Every token has one history; a start is the history of a document's first token.
                ones = np.bincount(group.pair_w, weights=c, minlength=len(group.keys)).astype(np.int64)
                ones[group.start] = flags[group.first].sum()
                for i, at in group.words_by_bucket(buckets):
                    yield _rows(BLOB, [(1, i, g, _pack_keys(group.keys[at]), b"", b"", _pack(ones[at]))])
                for i, at in group.pairs_by_bucket(side):
                    yield _rows(BLOB, [_pair_row(i, g, group.keys, group.pair_h[at], group.pair_w[at], c[at])])
    return run


def _total(key, t):
    """Sum the groups' counts of a bucket. The table's row has group -1; the replies have their group, and
    for words the places in the table, for bigrams the counts, in the order of the question."""
    kind, bucket = (k.as_py() for k in key)
    grps, keys, hs, ws, cs = (t.column(x).to_pylist() for x in ("grp", "keys", "h", "w", "counts"))
    pairs = [_pairs(*x) for x in zip(keys, hs, ws)] if kind == 2 else []
    own = [_pair(*x) for x in pairs] if kind == 2 else [_keys(k) for k in keys]
    ends = np.cumsum([len(x) for x in own])[:-1]
    own = np.concatenate(own)
    order, starts, number = _distinct(own)
    c = np.add.reduceat(np.concatenate([_unpack(x) for x in cs])[order], starts)
    if kind == 1:
        rows = [(1, bucket, -1, _pack_keys(own[order[starts]]), b"", b"", _pack(c))]
        rows += [(1, bucket, g, b"", _pack(np.diff(x, prepend=0)), b"", b"")
                 for g, x in zip(grps, np.split(number, ends))]
    else:
        at = order[starts][c > 0]
        h, w = (np.concatenate(x)[at] for x in zip(*pairs))
        del pairs, own, order
        vocab, at = np.unique(np.concatenate([h, w]), return_inverse=True)
        h, w = at[:len(h)], at[len(h):]
        order = np.argsort(h * len(vocab) + w)
        rows = [_pair_row(bucket, -1, vocab, h[order], w[order], c[c > 0][order])]
        rows += [(2, bucket, g, b"", b"", b"", _pack(c[x])) for g, x in zip(grps, np.split(number, ends))]
    return pa.Table.from_batches([_rows(BLOB, rows)])


def _counts_of_counts(c: np.ndarray) -> np.ndarray:
    """Counts of counts (r up to K + 1), at r = 0 the tokens, and last the distinct n-grams."""
    n = np.zeros(K + 3, dtype=np.int64)
    n[:K + 2] = np.bincount(c[(c > 0) & (c <= K + 1)], minlength=K + 2)
    n[0], n[K + 2] = c.sum(), (c > 0).sum()
    return n


COC = "r int, n long"


def _coc_rows(n: np.ndarray) -> list[tuple]:
    return list(zip([*range(K + 2), -1], n.tolist()))


def _unigram_summary(batches):
    n = np.zeros(K + 3, dtype=np.int64)
    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n += _counts_of_counts(_unpack(c)[_keys(k) != START_KEY])
    yield _rows(COC, _coc_rows(n))


def summary(found: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Tokens, distinct n-grams and counts of counts, from partial ones."""
    n = {r.r: r.n for r in found.groupBy("r").agg(F.sum("n").alias("n")).collect()}
    return n.get(0, 0), n.get(-1, 0), {r: n.get(r, 0) for r in range(1, K + 2)}


def slope(n: dict[int, int]) -> float | None:
    """Slope of the line through log n_r over log r, each n_r spread over the gap to its neighbours."""
    rs = [r for r in sorted(n) if n[r] > 0]
    if len(rs) < 2:
        return None
    gaps = [(hi - lo) / 2 for lo, hi in zip([0, *rs], [*rs[1:], 2 * rs[-1] - rs[-2]])]
    return float(np.polyfit(np.log(rs), np.log([n[r] / g for r, g in zip(rs, gaps)]), 1)[0])


def discounts(n: dict[int, int]) -> np.ndarray:
    """d(r) for r = 0..K + 1 (1 from K + 1 on): Good-Turing over smoothed counts of counts.

    A slope under -1 makes every d(r) lie between 0 and 1; for others, or fewer than two
    counts of counts, the absolute discount is left.
    """
    d = np.ones(K + 2)
    r = np.arange(1, K + 1)
    b = slope(n)
    if b is not None and b < -1:
        a = (K + 1.0) ** (b + 1)
        d[1:K + 1] = (((r + 1) / r) ** (b + 1) - a) / (1 - a)
        return d
    share = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    d[1:K + 1] = (r - share) / r
    return d


class Unigrams:
    """Discounted unigram probabilities, with the mass left for one unknown word."""

    def __init__(self, n: int, v: int, counts_of_counts: dict[int, int]):
        self.n, self.v, self.d = n, v, discounts(counts_of_counts)
        small = sum(r * k * self.d[r] for r, k in counts_of_counts.items() if r <= K)
        big = n - sum(r * k for r, k in counts_of_counts.items() if r <= K)
        left = 1 - (small + big) / n if n else 1.0
        self.scale = 1.0
        if n and left < 1 / (n + 1):
            self.scale = (1 - 1 / (n + 1)) * n / (small + big)
            left = 1 / (n + 1)
        self.unknown = left

    def p(self, c: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.full(len(c), self.unknown)
        return np.where(c > 0, self.scale * self.d[np.minimum(c, K + 1)] * c / self.n, self.unknown)


def _word_questions(buckets: int, edge: int):
    """The words a bucket of the bigram table needs counts of, a row per bucket of the unigram table."""
    def run(batches):
        for b in batches:
            for pair_bucket, keys, w in zip(*(b.column(i).to_pylist() for i in range(3))):
                k = _keys(keys)
                if edge == 1:  # every history is kept
                    k = k[np.unique(_unpack(w, np.uint32))]
                yield _rows("a_bucket int, asker int, a_keys binary",
                            [(i, pair_bucket, _pack_keys(k[at])) for i, at in _by_bucket(_bucket(k, buckets))])
    return run


def _word_answers(asked: pa.Table, table: pa.Table) -> pa.Table:
    keys, counts = _unigram_rows(table)
    rows = []
    for asker, k in zip(asked.column("asker").to_pylist(), asked.column("a_keys").to_pylist()):
        at, there = _find(keys, _keys(k))
        rows.append((asker, k, _pack(np.where(there, counts[at], 0) if len(keys) else np.zeros(len(at), np.int64))))
    return pa.Table.from_batches([_rows("asker int, a_keys binary, a_counts binary", rows)])


def _unigram_rows(t: pa.Table, keys: str = "keys", counts: str = "counts") -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of rows of words, once each, and their counts."""
    k = np.concatenate([np.empty(0, np.uint64), *(_keys(x) for x in t.column(keys).to_pylist())])
    c = np.concatenate([np.empty(0, np.int64), *(_unpack(x) for x in t.column(counts).to_pylist())])
    k, at = np.unique(k, return_index=True)
    return k, c[at]


def _kept(keys: np.ndarray, counts: np.ndarray, edge: int) -> np.ndarray:
    """Words that bigrams are kept for; all that are counted at edge 1."""
    return (counts >= edge) | (((keys == END_KEY) | (keys == START_KEY)) & (counts > 0))


def _table_bigrams(t: pa.Table, answers: pa.Table, edge: int):
    """(history, count, count of the word) of the bigrams in rows of the table."""
    keys, counts = _unigram_rows(answers, "a_keys", "a_counts")
    kept = _kept(keys, counts, edge)
    for k, h, w, c in zip(*(t.column(x).to_pylist() for x in ("keys", "h", "w", "counts"))):
        (h, w), c = _pairs(k, h, w), _unpack(c)
        aw = _find(keys, w)[0]
        if edge == 1:
            yield h, c, counts[aw]
            continue
        ok = kept[aw] & kept[_find(keys, h)[0]]
        yield h[ok], c[ok], counts[aw[ok]]


def _whole_bigram_summary(batches):
    n = np.zeros(K + 3, dtype=np.int64)
    for b in batches:
        for c in b.column(0).to_pylist():
            n += _counts_of_counts(_unpack(c))
    yield _rows(COC, _coc_rows(n))


def _bigram_summary(edge: int):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        n = sum((_counts_of_counts(c) for _, c, _ in _table_bigrams(t, answers, edge)), np.zeros(K + 3, np.int64))
        return pa.Table.from_batches([_rows(COC, _coc_rows(n))])
    return run


SUMS = "s_bucket int, s_keys binary, seen binary, uni binary"


def _history_sums(uni: Unigrams, d: np.ndarray, edge: int, buckets: int):
    """Per history: the discounted counts of the words seen after it, and their unigram mass."""
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for h, c, cw in _table_bigrams(t, answers, edge):
            u, inv = np.unique(h, return_inverse=True)
            seen = np.bincount(inv, weights=d[np.minimum(c, K + 1)] * c, minlength=len(u))
            low = np.bincount(inv, weights=uni.p(cw), minlength=len(u))
            rows += [(i, _pack_keys(u[at]), _pack(seen[at]), _pack(low[at]))
                     for i, at in _by_bucket(_bucket(u, buckets))]
        return pa.Table.from_batches([_rows(SUMS, rows)])
    return run


REPLY = "r_grp long, n int, r_bucket int, r_counts binary, r_alpha binary, r_factor binary"


def _with_backoff(ones: pa.Table, sums: pa.Table) -> pa.Table:
    """The unigram replies of a bucket: counts, and every history's alpha and factor of the seen words."""
    cols = [ones.column(x).to_pylist() for x in ("bucket", "grp", "keys", "h", "counts")]
    keys, counts = next(((_keys(k), _unpack(c)) for _, g, k, _, c in zip(*cols) if g < 0),
                        (np.empty(0, np.uint64), np.empty(0, np.int64)))
    seen, low = np.zeros(len(keys)), np.zeros(len(keys))
    for k, x, y in zip(*(sums.column(n).to_pylist() for n in ("s_keys", "seen", "uni"))):
        at = np.searchsorted(keys, _keys(k))  # every history is counted
        seen[at] += _unpack(x, np.float64)
        low[at] += _unpack(y, np.float64)
    share, least = seen / np.maximum(counts, 1), 1.0 / (counts + 1)
    tight = 1 - share < least
    factor = np.where(tight, (1 - least) / np.maximum(share, 1e-300), 1.0)
    alpha = np.where(seen > 0, np.where(tight, least, 1 - share) / np.maximum(1 - low, 1e-300), 1.0)
    rows = []
    for bucket, g, _, h, _ in zip(*cols):
        if g >= 0:
            at = np.cumsum(_unpack(h))
            rows.append((g, 1, bucket, _pack(counts[at]), _pack(alpha[at]), _pack(factor[at])))
    return pa.Table.from_batches([_rows(REPLY, rows)])


def _evaluate(uni: Unigrams, d: np.ndarray, edge: int, buckets: int, side: int, id_type: pa.DataType):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        got = {(n, b): x for n, b, *x in zip(*(replies.column(n).to_pylist() for n in (
            "n", "r_bucket", "r_counts", "r_alpha", "r_factor")))}
        group = _Group(*(docs.column(n)[0].as_py() for n in ("sizes", "keys", "codes")))
        c, pairs = np.empty(len(group.keys), np.int64), np.empty(len(group.pair_h), np.int64)
        alpha, factor = np.empty(len(c)), np.empty(len(c))
        for i, at in group.words_by_bucket(buckets):
            x, y, z = got[1, i]
            c[at], alpha[at], factor[at] = _unpack(x), _unpack(y, np.float64), _unpack(z, np.float64)
        for i, at in group.pairs_by_bucket(side):
            pairs[at] = _unpack(got[2, i][0])
        kept, log_uni = _kept(group.keys, c, edge), np.log10(uni.p(c))
        base = np.log10((c + 1) / (uni.n + 1 * (uni.v + 1)))
        h, w = group.pair_h, group.pair_w
        out = log_uni[w] + np.log10(alpha)[h]
        hit = (pairs > 0) & kept[h] & kept[w]
        n, h = pairs[hit], h[hit]
        out[hit] = np.log10(factor[h] * d[np.minimum(n, K + 1)] * n / c[h])
        sums = [np.add.reduceat(x, group.first) for x in ((c > 0).astype(np.int64)[group.w], base[group.w],
                                                          out[group.number])]
        ids = docs.column("ids").combine_chunks()
        return pa.table({"id": (ids.flatten()).cast(id_type), "n_tokens": pa.array(group.sizes),
                         "n_known": pa.array(sums[0]), "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})
    return run


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2,
          phi: float = 0.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    from pyspark.sql.pandas.types import to_arrow_type
    spark = docs.sparkSession
    is_held = fold(F.col("id"), folds) == held
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType
    rows = stored(src.select("id", "text", (~is_held).alias("train")).mapInArrow(
        _code(to_arrow_type(kind)), f"grp long, ids array<{kind.simpleString()}>, train binary, sizes binary, "
                                    "keys binary, codes binary"), "katz-docs")
    groups = rows.count()
    buckets = max(1, min(groups, shuffle_width(spark)), groups // 20)
    side = max(1, math.isqrt(max(buckets, groups // 4)))

    counted = stored(rows.select("grp", "train", "sizes", "keys", "codes").mapInArrow(_ask(buckets, side), BLOB)
                     .groupBy("kind", "bucket").applyInArrow(_total, BLOB), "katz-counts")
    ones, twos = counted.where("kind = 1 and grp = -1"), counted.where("kind = 2 and grp = -1")
    uni = Unigrams(*summary(ones.select("keys", "counts").mapInArrow(_unigram_summary, COC)))
    edge = max(1, int(np.ceil(phi * uni.n)))

    answers = stored(twos.select("bucket", "keys", "w").mapInArrow(
        _word_questions(buckets, edge), "a_bucket int, asker int, a_keys binary")
                     .groupBy("a_bucket").cogroup(ones.groupBy("bucket"))
                     .applyInArrow(_word_answers, "asker int, a_keys binary, a_counts binary"), "katz-answers")
    known = twos.groupBy("bucket").cogroup(answers.groupBy("asker"))
    d2 = discounts(summary(twos.select("counts").mapInArrow(_whole_bigram_summary, COC) if edge == 1
                           else known.applyInArrow(_bigram_summary(edge), COC))[2])
    sums = known.applyInArrow(_history_sums(uni, d2, edge, buckets), SUMS)
    replies = (counted.where("kind = 1").groupBy("bucket").cogroup(sums.groupBy("s_bucket"))
               .applyInArrow(_with_backoff, REPLY)
               .unionByName(counted.where("kind = 2 and grp >= 0").select(
                   F.col("grp").alias("r_grp"), F.lit(2).alias("n"), F.col("bucket").alias("r_bucket"),
                   F.col("counts").alias("r_counts"), F.lit(b"").alias("r_alpha"), F.lit(b"").alias("r_factor"))))
    out = (rows.select("grp", "ids", "sizes", "keys", "codes").groupBy("grp").cogroup(replies.groupBy("r_grp"))
           .applyInArrow(_evaluate(uni, d2, edge, buckets, side, to_arrow_type(kind)),
                         f"id {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double"))
    return out.select(F.col("id").alias(id_col), is_held.alias("held_out"), "n_tokens", "n_known",
                      F.lit(uni.n).cast("long").alias("train_tokens"), "base_score", "score")
