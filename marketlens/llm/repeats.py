"""Suffix-array deduplication with a run-length index.

Every byte is removed that a string of ``length`` bytes covers which also starts anywhere
else, in another text or the same one. Bytes are those of UTF-8; matches stay inside a text.

1. Regions. A window is a start of ``length`` bytes. It belongs to the least hash of the
   ``GRAM``-byte strings in it, its anchor, so that equal windows have equal anchors. A run of
   windows with one anchor is a region; each window is in one region, and neighbours share
   ``length - 1`` bytes, so they can't match each other in a whole window.
2. Which regions can match. The parts of the input send their distinct (anchor, region)
   hashes to buckets, and learn for each: nobody else has the anchor; only exact copies have
   it, which are one string with a count, repeated from end to end; or several different
   regions do, or the region is periodic. Of each of the latter, one part sends the bytes.
3. Run-length index. A bucket's regions become one text. From its suffix array, ordered to
   the regions' ends, only the Burrows-Wheeler transform's runs are used: an LCP is computed
   at run heads and run ends alone (the samples). All other positions' matching statistics
   are streamed in text order, each one less than the position's before it. A window with a
   statistic of ``length`` or more, to the suffix before or after it, is repeated.
4. Marks go back to the part that sent the region (all others hold a copy, and know it), and
   are merged text by text.

An anchor with more than ``HOT_REGIONS`` different regions (a common passage) is split: each of
its regions is cut by the anchor's offset in the window, into two, then four, ... ranges of
offsets, and the pieces go through steps 2 to 4 like texts of their own. The windows of a piece
share more bytes than the anchor, and those, hashed, are its new anchor; after eight rounds a
piece is a single window. Texts are stored once, bucketed by part, and never shuffled: only
hashes, verdicts and the regions that need the index are. No part, bucket or group grows with
the corpus.

Defined cases: null and empty texts are empty and keep nothing; texts shorter than
``length`` bytes are kept; rows that repeat remove each other whole, if long enough; very
long texts are read in pieces and are never cut short; without rows there is no result;
extra columns never reach the operator. Regions are told apart by 64 bits for the anchor and
64 for the region.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from marketlens.llm.common import shuffle_width, stored
from marketlens.session import scratch_path

LENGTH = 200
GRAM = 32
#: Window starts that are hashed at once, and windows in a region at most.
STRIDE, REGION = 1 << 16, 512
PART_BYTES = 12 << 20
BUCKET_ENTRIES = 400_000
INDEX_BYTES = 400_000
HOT_REGIONS = 2048
OFFSET_BITS = 8  # offsets of an anchor in its window are below 2**OFFSET_BITS
#: Spark's own limit for a table; a bucket then has several parts, which stay groups of their own.
MOST_BUCKETS = 100_000
NOBODY, COPIES, SENDS, SPLIT = range(4)
AGAIN, PERIODIC = 1, 2  # flags of a part's entry: it has the region several times, the region repeats itself
REPEATED = 8  # added to a verdict: the region itself occurs at least twice
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    h, n = raw.astype(np.uint64) + np.uint64(1), 1
    while n < GRAM:
        h = h[:-n] * _MIX + (h[n:] ^ (h[n:] >> np.uint64(29)))
        h ^= h >> np.uint64(32)
        n *= 2
    return h * _MIX


def regions(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, periodic) of every region of a text, in order.

    Two equal windows of one region make the text between them periodic, and then the anchor's
    string starts a window and is found again in the next one: ``periodic`` marks such regions.
    """
    total, out = len(raw) - length + 1, []
    data = np.frombuffer(raw, dtype=np.uint8)
    for at in range(0, total, STRIDE):
        n = min(STRIDE, total - at)
        grams, span, want = _gram_hashes(data[at:at + n + length - 1]), 1, length - GRAM + 1
        least = grams
        while span * 2 <= want:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[:n], least[want - span:want - span + n])
        new = np.ones(n, dtype=bool)
        new[1:] = least[1:] != least[:-1]
        lo = np.flatnonzero(new)
        size = np.diff(np.append(lo, n))
        if size.max() > REGION:
            lo = np.concatenate([np.arange(a, a + s, REGION) for a, s in zip(lo.tolist(), size.tolist())])
        again = np.concatenate([[0], np.cumsum((grams[:n - 1] == least[:-1]) & ~new[1:])])
        hi = np.append(lo[1:], n) - 1
        out.append((lo + at, hi + at, least[lo], again[hi] > again[lo]))
    if not out:
        return tuple(np.empty(0, dtype=x) for x in (np.int64, np.int64, np.uint64, bool))
    lo, hi, anchor, periodic = (np.concatenate(x) for x in zip(*out))
    return lo, hi, _mixed(anchor), periodic


def pieces(raw: bytes, level: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, periodic) of a region's pieces, like ``regions``.

    A piece is a run of windows around the same occurrence of the anchor, with offsets in the
    same one of 2**level ranges; its anchor is the hash of the bytes that all such windows share.
    """
    n = len(raw) - length + 1
    grams = _gram_hashes(np.frombuffer(raw, dtype=np.uint8))
    found = np.flatnonzero(grams == grams.min())
    start = np.arange(n)
    here = found[np.searchsorted(found, start)]  # the anchor's first occurrence in each window
    shift = OFFSET_BITS - level
    part = (here - start) >> shift
    new = np.ones(n, dtype=bool)
    new[1:] = (part[1:] != part[:-1]) | (here[1:] != here[:-1])
    lo = np.flatnonzero(new)
    low = part[lo] << shift
    cores = [raw[g - a:g - a - (1 << shift) + 1 + length] for g, a in zip(here[lo].tolist(), low.tolist())]
    anchor = np.fromiter((xxhash.xxh3_64_intdigest(c, seed=a + 1) for c, a in zip(cores, low.tolist())), dtype=np.uint64, count=len(lo))
    return lo, np.append(lo[1:], n) - 1, anchor, np.zeros(len(lo), dtype=bool)


def _entries(anchor: np.ndarray, own: np.ndarray, periodic: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The distinct (anchor, hash, flags) of a part in order, and each region's place among them."""
    order = np.lexsort((own, anchor))
    a, s = anchor[order], own[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    place = np.empty(len(a), dtype=np.int32)
    place[order] = np.cumsum(new) - 1
    n = int(new.sum())
    flags = AGAIN * (np.bincount(place, minlength=n) > 1) + PERIODIC * (np.bincount(place, periodic, n) > 0)
    return a[new].tobytes() + s[new].tobytes() + flags.astype(np.uint8).tobytes(), place


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(blob) // 17
    return (np.frombuffer(blob, dtype=np.uint64, count=n), np.frombuffer(blob, dtype=np.uint64, count=n, offset=8 * n),
            np.frombuffer(blob, dtype=np.uint8, count=n, offset=16 * n))


TEXTS = "part long, no int, id {kind}, raw binary, lo binary, hi binary, place binary, entries binary"


def _parse(length: int, kind: pa.DataType, level: int):
    """Rows of texts with their regions (pieces of regions, above level 0); after a part's texts, a row with its entries."""
    from pyspark import TaskContext
    names = ["part", "no", "id", "raw", "lo", "hi", "place", "entries"]
    types = [pa.int64(), pa.int32(), kind, pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def flush(part, held):
        blob, place = _entries(*(np.concatenate([x[i] for x in held]) for i in (4, 5, 6)))
        at, some, size = 0, [], 0
        for no, (doc, raw, lo, hi, *_) in enumerate(held):
            mine = place[at:at + len(lo)]
            at += len(lo)
            some.append((part, no, doc, raw, lo.astype(np.int32).tobytes(), hi.astype(np.int32).tobytes(), mine.tobytes(), None))
            size += len(raw)
            if size > 4 << 20:
                yield batch(some)
                some, size = [], 0
        yield batch([*some, (part, -1, None, None, None, None, None, blob)])

    def run(batches):
        part, held, size = TaskContext.get().partitionId() << 24, [], 0
        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                raw = raw or b""
                lo, hi, anchor, periodic = pieces(raw, level, length) if level else regions(raw, length)
                own = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:e + length]) for a, e in zip(lo.tolist(), hi.tolist())),
                                  dtype=np.uint64, count=len(lo))
                held.append((doc, raw, lo, hi, anchor, own, periodic))
                size += len(raw)
                if size >= PART_BYTES:
                    yield from flush(part, held)
                    part, held, size = part + 1, [], 0
        if held:
            yield from flush(part, held)
    return run


def _dealt(buckets: int):
    """A part's entries by bucket: (bucket, part, first, entries)."""
    def run(batches):
        for b in batches:
            rows = []
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a, s, flags = _unpacked(blob)
                to = ((a >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                edges = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(a) else []
                for x, y in zip(edges, np.append(edges[1:], len(a)) if len(a) else []):
                    rows.append((int(to[x]), part, int(x), a[x:y].tobytes() + s[x:y].tobytes() + flags[x:y].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                names=["bucket", "part", "first", "entries"])
    return run


def _verdicts(hot: int):
    """Each entry of a bucket against all others of its anchor: (part, first, verdicts)."""
    def run(table: pa.Table) -> pa.Table:
        got = [_unpacked(x) for x in table["entries"].to_pylist()]
        sizes = [len(x[0]) for x in got]
        a, s, flags = (np.concatenate([x[i] for x in got]) for i in range(3))
        order = np.lexsort((s, a))
        new_a, new_s = np.ones(len(a), dtype=bool), np.ones(len(a), dtype=bool)
        new_a[1:] = a[order][1:] != a[order][:-1]
        new_s[1:] = new_a[1:] | (s[order][1:] != s[order][:-1])
        group, one = np.cumsum(new_a) - 1, np.cumsum(new_s) - 1
        different = np.bincount(group[new_s])[group]
        many = ((np.bincount(one) > 1) | (np.bincount(one, weights=flags[order] & AGAIN) > 0))[one]
        periodic = (flags[order] & PERIODIC) > 0
        # Of several holders of one region the first sends it; whoever holds it too knows that it is repeated.
        said = np.where(different == 1, np.where(many, COPIES, np.where(periodic, SENDS, NOBODY)),
                        np.where(~new_s, COPIES, np.where(different > hot, SPLIT, SENDS))).astype(np.uint8)
        said[many] += REPEATED
        out = np.empty(len(a), dtype=np.uint8)
        out[order] = said
        ends = np.cumsum(sizes)
        return pa.table({"part": table["part"], "first": table["first"],
                         "verdicts": pa.array([out[e - n:e].tobytes() for e, n in zip(ends, sizes)], pa.binary())})
    return run


def _said(blob_size: int, verdicts: pa.Table) -> np.ndarray:
    said = np.zeros(blob_size, dtype=np.uint8)
    for first, v in zip(verdicts["first"].to_pylist(), verdicts["verdicts"].to_pylist()):
        if v is not None:
            said[first:first + len(v)] = np.frombuffer(v, dtype=np.uint8)
    return said


CASES = "part long, place int, bucket double, repeated boolean, split boolean, region binary"


def _cases(length: int):
    """The regions that a part sends: (part, place, bucket as a fraction, ..., bytes)."""
    def run(texts: pa.Table, verdicts: pa.Table) -> pa.Table:
        at, out, said, a = [], [], np.empty(0, dtype=np.uint8), np.empty(0, dtype=np.uint64)
        blob = next((x for x in texts["entries"].to_pylist() if x is not None), None)
        if blob:
            a = _unpacked(blob)[0]
            said = _said(len(a), verdicts)
            open_ = np.isin(said & 7, (SENDS, SPLIT))
            for raw, lo, hi, place in zip(*(texts[c].to_pylist() for c in ("raw", "lo", "hi", "place"))):
                if not place:
                    continue
                p = np.frombuffer(place, dtype=np.int32)
                lo, hi = np.frombuffer(lo, dtype=np.int32), np.frombuffer(hi, dtype=np.int32)
                for i in np.flatnonzero(open_[p]).tolist():
                    if open_[p[i]]:  # once
                        open_[p[i]] = False
                        at.append(int(p[i]))
                        out.append(raw[lo[i]:hi[i] + length])
        at = np.array(at, dtype=np.int64)
        part = texts["part"][0].as_py() if len(texts) else 0
        return pa.table({"part": pa.array([part] * len(at), pa.int64()), "place": pa.array(at, pa.int32()),
                         "bucket": (a[at] >> np.uint64(32)).astype(np.float64) / 2.0 ** 32,
                         "repeated": (said[at] & REPEATED) > 0, "split": (said[at] & 7) == SPLIT,
                         "region": pa.array(out, pa.binary())})
    return run


# ---------------------------------------------------------------- the index
class RunIndex:
    """Runs of the Burrows-Wheeler transform of several strings, with the LCPs sampled at their heads and ends."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(x) for x in strings], dtype=np.int64)
        self.ends = np.cumsum(sizes + 1) - 1  # each string's separator
        self.starts = self.ends - sizes
        self.n = int(self.ends[-1]) + 1
        text = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
        number = np.cumsum(np.bincount(text, minlength=256) > 0)  # bytes that occur, from 1
        self.sym = number[text].astype(np.int32)
        self.sym[self.ends] = 0
        self.sep = np.repeat(self.ends, sizes + 1)  # where the string of each position ends
        self._order(int(number[-1]))
        self._runs()

    def _ahead(self, x: np.ndarray, h: int) -> np.ndarray:
        """``x`` from ``h`` positions on, never past the separator."""
        return x[np.minimum(self._here + h, self.sep)]

    def _ranks(self, key: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
        """Equal keys get equal ranks; sorts (key, position) as one number, so that equal keys stay in text order."""
        if bits + self._bits <= 64:
            both = np.sort(key << np.uint64(self._bits) | self._here.astype(np.uint64))
            self.sa = (both & np.uint64((1 << self._bits) - 1)).astype(np.int64)
            ordered = both >> np.uint64(self._bits)
        else:
            self.sa = np.argsort(key, kind="stable")
            ordered = key[self.sa]
        new = np.empty(self.n, dtype=bool)
        new[0] = False
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        rank = np.empty(self.n, dtype=np.int32)
        rank[self.sa] = np.cumsum(new, dtype=np.int32)
        return rank, int(rank[self.sa[-1]]) + 1

    def _order(self, symbols: int) -> None:
        """Ranks of the first h, 2h, 4h, ... symbols, until they reach every string's end."""
        self._here, self._bits = np.arange(self.n), max(1, self.n.bit_length())
        wide = symbols.bit_length()
        h = max(1, (64 - self._bits) // wide)
        key = self.sym.astype(np.uint64)
        for k in range(1, h):
            key = key << np.uint64(wide) | self._ahead(self.sym, k).astype(np.uint64)
        rank, distinct = self._ranks(key, h * wide)
        self.levels, longest = [(h, rank)], int((self.ends - self.starts).max()) + 1
        while h < longest and distinct < self.n:
            b = distinct.bit_length()
            rank, distinct = self._ranks(rank.astype(np.uint64) << np.uint64(b) | self._ahead(rank, h).astype(np.uint64), 2 * b)
            h *= 2
            self.levels.append((h, rank))
        self._first = self.levels[0][0]

    def _lcp(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common length of the suffixes at ``a`` and ``b``, from the ranks of every level."""
        end_a, end_b = self.sep[a], self.sep[b]
        most = np.minimum(end_a - a, end_b - b)
        x, y, got = a, b, np.zeros(len(a), dtype=np.int64)
        for h, rank in [*self.levels[::-1], *[(1, self.sym)] * (self._first - 1)]:
            step = h * (rank[x] == rank[y])
            got += step
            x, y = np.minimum(x + step, end_a), np.minimum(y + step, end_b)
        return np.minimum(got, most)

    def _runs(self) -> None:
        before = self.sym[self.sa - 1]
        # A string's start follows a separator (0), which never continues a run.
        change = np.ones(self.n + 1, dtype=bool)
        change[1:-1] = (before[1:] != before[:-1]) | (before[1:] == 0)
        heads, tails = np.flatnonzero(change[:-1]), np.flatnonzero(change[1:])
        self.runs = len(heads)
        zero = np.zeros(1, dtype=np.int64)
        self.head_at, self.tail_at = self.sa[heads], self.sa[tails]
        seams = self._lcp(self.sa[heads[1:] - 1], self.sa[heads[1:]])  # a run's end meets the next one's head
        self.head_lcp, self.tail_lcp = np.concatenate([zero, seams]), np.concatenate([seams, zero])

    def _streamed(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Samples carried on in text order, one less at each position without a sample."""
        found = np.full(self.n, -1, dtype=np.int64)
        found[at] = value
        last = np.maximum.accumulate(np.where(found >= 0, self._here, -1))
        return found[last] - (self._here - last)

    def matching_statistics(self) -> np.ndarray:
        """The longest match of every position's suffix that starts elsewhere in the strings."""
        return np.maximum(self._streamed(self.head_at, self.head_lcp), self._streamed(self.tail_at, self.tail_lcp))

    def repeated_windows(self, length: int) -> list[np.ndarray]:
        """Of every string, the starts of ``length`` symbols that also start elsewhere."""
        hit = np.flatnonzero(self.matching_statistics() >= length)
        cut = np.searchsorted(hit, np.append(self.starts, self.n))
        return [hit[x:y] - start for x, y, start in zip(cut, cut[1:], self.starts)]


def _indexed(length: int):
    def run(table: pa.Table) -> pa.Table:
        strings = table["region"].to_pylist()
        found = RunIndex(strings).repeated_windows(length)
        keep = pa.array([i for i, (x, known) in enumerate(zip(found, table["repeated"].to_pylist())) if len(x) and not known], pa.int64())
        return pa.table({"part": table["part"].take(keep), "first": table["place"].take(keep),
                         "mask": pa.array([found[i].astype(np.int32).tobytes() for i in keep.to_pylist()], pa.binary())})
    return run


def _known(texts: pa.Table, marks: pa.Table) -> tuple[np.ndarray, dict[int, list]]:
    """Of a part's entries: whether all windows are repeated, and the repeated ones of others."""
    blob = next((x for x in texts["entries"].to_pylist() if x is not None), b"")
    said = _said(len(blob) // 17, marks)
    masks: dict[int, list] = {}
    for e, m in zip(marks["first"].to_pylist(), marks["mask"].to_pylist()):
        if m is not None:
            masks.setdefault(e, []).append(np.frombuffer(m, dtype=np.int32))
    return (said & 7 == COPIES) | (said >= REPEATED), masks


def _repeated(texts: pa.Table, marks: pa.Table) -> pa.Table:
    """(part, first, mask): the repeated windows of split regions, from their pieces; their ids say whose they are."""
    whole, masks = _known(texts, marks)
    out = []
    for no, doc, lo, hi, place in zip(*(texts[c].to_pylist() for c in ("no", "id", "lo", "hi", "place"))):
        if no < 0:
            continue
        p, lo, hi = (np.frombuffer(x, dtype=np.int32) for x in (place, lo, hi))
        found = [np.arange(lo[i], hi[i] + 1) for i in np.flatnonzero(whole[p])]
        found += [lo[i] + m for i in np.flatnonzero(~whole[p]) for m in masks.get(int(p[i]), ())]
        if found:
            out.append((doc["part"], doc["place"], np.concatenate(found).astype(np.int32).tobytes()))
    return pa.table({"part": pa.array([r[0] for r in out], pa.int64()), "first": pa.array([r[1] for r in out], pa.int32()),
                     "mask": pa.array([r[2] for r in out], pa.binary())})


def _merged(length: int, kind: pa.DataType):
    """(id, n_bytes, spans, kept) of a part's texts, from the verdicts and the windows found in its regions."""
    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        whole, masks = _known(texts, marks)
        some = whole.copy()
        some[list(masks)] = True
        out = []
        for no, doc, raw, lo, hi, place in zip(*(texts[c].to_pylist() for c in ("no", "id", "raw", "lo", "hi", "place"))):
            if no < 0:
                continue
            p = np.frombuffer(place, dtype=np.int32)
            at = np.flatnonzero(some[p])
            if not len(at):
                out.append((doc, len(raw), [], raw))
                continue
            lo, hi = np.frombuffer(lo, dtype=np.int32), np.frombuffer(hi, dtype=np.int32)
            step = np.zeros(len(raw) + 1, dtype=np.int64)
            full = at[whole[p[at]]]
            np.add.at(step, lo[full], 1)
            np.add.at(step, hi[full] + length, -1)
            for i in at[~whole[p[at]]].tolist():
                for m in masks[int(p[i])]:
                    np.add.at(step, lo[i] + m, 1)
                    np.add.at(step, lo[i] + m + length, -1)
            gone = np.cumsum(step[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            out.append((doc, len(raw), [{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)],
                        np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"id": pa.array([r[0] for r in out], kind), "n_bytes": pa.array([r[1] for r in out], pa.int64()),
                         "spans": pa.array([r[2] for r in out], span), "kept": pa.array([r[3] for r in out], pa.binary())})
    return run


def _bucketed(texts: DataFrame, buckets: int) -> DataFrame:
    """Store the texts bucketed by part. A part is written by one task, so no shuffle comes before,
    and none later where texts meet what is sent back to their part."""
    spark, name = texts.sparkSession, f"marketlens_texts_{uuid.uuid4().hex}"
    texts.write.bucketBy(buckets, "part").option("path", scratch_path(spark, "texts")).saveAsTable(name)
    return spark.table(name)


def _marks(texts: DataFrame, length: int, hot: int, level: int) -> DataFrame:
    """(part, first, verdicts, mask) of the stored texts' entries: what each part is told."""
    width = shuffle_width(texts.sparkSession)
    entries = texts.where("no < 0").select("part", "entries")
    n = entries.agg(F.sum(F.length("entries"))).first()[0] or 0
    dealt = entries.mapInArrow(_dealt(max(width, math.ceil(n / 17 / BUCKET_ENTRIES))), "bucket long, part long, first int, entries binary")
    verdicts = stored(dealt.groupBy("bucket").applyInArrow(_verdicts(hot), "part long, first int, verdicts binary"), "verdicts")
    cases = stored(texts.groupBy("part").cogroup(verdicts.groupBy("part")).applyInArrow(_cases(length), CASES), "cases")

    sent = cases.where("not split")
    size, splits = cases.agg(F.sum(F.when(~F.col("split"), F.length("region"))), F.count(F.when(F.col("split"), 1))).first()
    buckets = max(width, math.ceil((size or 0) / INDEX_BYTES))
    masks = (sent.withColumn("bucket", (F.col("bucket") * buckets).cast("long")).groupBy("bucket")
             .applyInArrow(_indexed(length), MASK))
    if splits:
        smaller = cases.where("split").select(F.struct("part", "place").alias("id"), F.col("region").alias("text"))
        inner = _texts(smaller, length, level + 1)
        found = inner.groupBy("part").cogroup(_marks(inner, length, hot, level + 1).groupBy("part")).applyInArrow(_repeated, MASK)
        masks = masks.unionByName(found)
    none = F.lit(None).cast("binary")
    return stored(verdicts.withColumn("mask", none).unionByName(masks.withColumn("verdicts", none)), "marks")


MASK = "part long, first int, mask binary"


def _texts(src: DataFrame, length: int, level: int) -> DataFrame:
    """(id, text) rows with their regions, in parts, stored in buckets."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = src.schema["id"].dataType
    parsed = src.mapInArrow(_parse(length, to_arrow_type(kind), level), TEXTS.format(kind=kind.simpleString()))
    return _bucketed(parsed, min(MOST_BUCKETS, max(shuffle_width(src.sparkSession), src.rdd.getNumPartitions())))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                    hot: int = HOT_REGIONS) -> DataFrame:
    """id, n_bytes, spans (start and end of the bytes removed), kept (the remaining bytes) of every text."""
    from pyspark.sql.pandas.types import to_arrow_type
    if not 2 * GRAM <= length <= GRAM + (1 << OFFSET_BITS):
        raise ValueError(f"length must be from {2 * GRAM} to {GRAM + (1 << OFFSET_BITS)} bytes")
    texts = _texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), length, 0)
    kind = texts.schema["id"].dataType
    out = texts.groupBy("part").cogroup(_marks(texts, length, hot, 0).groupBy("part")).applyInArrow(
        _merged(length, to_arrow_type(kind)),
        f"id {kind.simpleString()}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("id", id_col)


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents
), n AS (SELECT r, doc_id, b, h, CAST(octet_length(b) AS BIGINT) AS n FROM d
), w AS (
  SELECT r, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS x
  FROM (SELECT r, h, unnest(range(0, n - 199)) AS i FROM n WHERE n >= 200)
), t AS (SELECT r, i, count(*) OVER (PARTITION BY x) AS k FROM w
), s AS (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM t WHERE k > 1
), g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM s
), spans AS (SELECT r, span, min(i) AS a, max(i) + 200 AS e FROM g GROUP BY ALL
), parts AS (
  SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL SELECT r, max(e), NULL FROM spans GROUP BY r
), kept AS (
  SELECT r, string_agg(substr(h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (coalesce(y, n) - x) AS BIGINT)), '' ORDER BY x) AS k
  FROM parts JOIN n USING (r) GROUP BY r
), total AS (SELECT r, CAST(sum(e - a) AS BIGINT) AS gone, count(*) AS spans FROM spans GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       CASE WHEN k IS NULL THEN sha256(b) ELSE sha256(unhex(k)) END AS kept_sha256
FROM n LEFT JOIN total USING (r) LEFT JOIN kept USING (r)
"""
