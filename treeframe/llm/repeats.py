"""Removal of repeated byte strings by a run-length suffix index.

A byte goes if some ``LENGTH``-byte string that covers it also starts in a document with a smaller id.

1. Anchors. Every LENGTH-byte string has one: its K-byte part of least hash. Equal strings have equal anchors, so a string
   can repeat only if its anchor occurs in two documents. Hashes and their documents are dealt by hash, many to a row, to
   find those. A hash that several documents of one batch have is known to be shared there and is asked about once for
   all of them: no hash brings more entries to a task than there are batches.
2. Segments. Of documents with shared anchors, the strings with one anchor are consecutive and form a segment of less
   than LENGTH + W bytes; segments are shuffled by anchor. Equal segments of one batch are sent once, for the least id.
3. Index. Of the different segments that share an anchor, those that a larger document could repeat are indexed: a
   run-compressed Burrows-Wheeler transform, with the suffix array sampled at both ends of each run. Those of all but the
   least document are streamed over it, many at once, backwards: a character equal to the transform's at the current row
   steps on, another one jumps to the nearest run end that has it, whichever end agrees longer. This gives each
   position's matching statistic and a row of the index; where it is LENGTH or more, the least document among the rows
   that begin with that string decides. A segment is left as soon as no position before can reach LENGTH.
   Segments of an anchor that more than ``MOST`` documents have (a phrase that stands in many surroundings) are cut into
   ``STEP`` starts each and keyed by all the bytes that those have in common, so that different surroundings go to
   different tasks. Anchors with a ``LISTED``-th of all entries, a list of bounded length, are known beforehand; a task
   that meets another one passes its segments on as they come, for a second round.
4. Marks are joined to their documents and the covered bytes removed.

Exact copies of a whole text are settled by its digest first: all but the one of least id take no part in 2 to 4.

Defined cases: a null text is empty; texts under LENGTH bytes lose nothing. A row without an id neither loses bytes nor
makes others lose any. Repeated rows of one id are one document and lose the same. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeframe.llm.common import discard, keys_of_partitions, materialize, stored, table

LENGTH, K = 50, 24
W = LENGTH - K + 1
_PIECE = 1 << 18  # string starts that are looked at together
MOST, STEP, LISTED = 4096, 3, 100_000
_PART = 16 << 20  # bytes of text to a partition, at most


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a LENGTH-byte string in data: where its anchor is, and the anchor's hash."""
    n = len(data) - 7
    w = np.ndarray((n,), "<u8", data.tobytes(), strides=(1,))
    h = w[:-16] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += w[8:-8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h += w[16:] * np.uint64(0x165667B19E3779F9)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    at, span = np.arange(len(h), dtype=np.int32), 1
    while span < W:
        step = min(span, W - span)
        less = h[step:] < h[:-step]
        at = np.where(less, at[step:], at[:-step])
        h = np.where(less, h[step:], h[:-step])
        span += step
    return at, h


def runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of string starts with one anchor, some texts at a time: text, first start, number of starts, hash."""
    part: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(x[2] for x in part), np.uint8)
        at, h = _anchors(data)
        ends = np.cumsum([len(x[2]) for x in part])
        begin = np.r_[0, ends[:-1]]
        owner = np.repeat(np.arange(len(part)), ends - begin)[: len(at)]
        good = np.arange(len(at)) + LENGTH <= ends[owner]
        new = good & np.r_[True, (at[1:] != at[:-1]) | ~good[:-1]]
        first = np.flatnonzero(new)
        stop = np.cumsum(good)
        count = np.diff(np.r_[stop[first] - 1, stop[-1] if len(stop) else 0])
        own = owner[first]
        return np.array([x[0] for x in part])[own], first - begin[own] + np.array([x[1] for x in part])[own], count, h[first]

    for i, t in enumerate(texts):
        for a in range(0, max(0, len(t) - LENGTH + 1), _PIECE):
            piece = t[a : a + _PIECE + LENGTH - 1]
            part.append((i, a, piece))
            size += len(piece)
            if size >= _PIECE:
                yield flush()
                part, size = [], 0
    if part:
        yield flush()


def _bytes(b: pa.RecordBatch, column: int) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in b.column(column).to_pylist()]


_DEALT = "bucket int, known boolean, hs binary, ds binary"


def _dealt(bucket: np.ndarray, h: np.ndarray, d: np.ndarray, known: bool) -> pa.RecordBatch:
    """A row for each bucket, with its hashes and documents as 64-bit integers; in document order, which compresses well."""
    order = np.lexsort((d, bucket))
    bucket, h, d = bucket[order], h[order], d[order]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[at[1:], len(bucket)] if len(at) else at
    cut = lambda x: pa.array([x[i:e].tobytes() for i, e in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array(np.full(len(at), known)), cut(h), cut(d)], names=["bucket", "known", "hs", "ds"])


def _bucket(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[(x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(len(keys))]


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64)


def _asker(keys: np.ndarray):
    """_id, text to hashes and documents: those that are asked about, by hash, and those known to be shared, by document."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            h, d = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for own, _, _, hashes in runs(_bytes(b, 1)):
                h.append(hashes), d.append(ids[own])
            h, d = np.concatenate(h).view(np.int64), np.concatenate(d)
            if not len(h):
                continue
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
            h, d = h[new], d[new]
            head = np.r_[True, h[1:] != h[:-1]]
            several = ~(head & np.r_[head[1:], True])
            yield _dealt(_bucket(h[head], keys), h[head], d[head], False)
            if several.any():
                yield _dealt(_bucket(d[several], keys), h[several], d[several], True)

    return ask


def _answerer(keys: np.ndarray):
    """All of a partition: each document and hash that it shares, by document."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in batches:
            known = b.column(1).to_numpy(zero_copy_only=False)
            if known.any():
                yield b.filter(pa.array(known))
            asked = b.filter(pa.array(~known))
            hs.append(_numbers(asked.column(2))), ds.append(_numbers(asked.column(3)))
        h, d = np.concatenate(hs), np.concatenate(ds)
        del hs, ds
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        if not len(h):
            return
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        shared = np.repeat(np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at), np.diff(np.r_[at, len(h)]))
        h, d = h[shared], d[shared]
        yield _dealt(_bucket(d, keys), h, d, True)

    return answer


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of a partition of documents and hashes: a row for each document."""
    got = [(_numbers(b.column(3)), _numbers(b.column(2))) for b in batches if b.num_rows]
    if not got:
        return
    d, h = (np.concatenate(c) for c in zip(*got, strict=True))
    if not len(d):
        return
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])]
    d, h = d[new], h[new]
    at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    ends = np.r_[at[1:], len(d)]
    for i in range(0, len(at), 4096):
        a, e = at[i : i + 4096], ends[i : i + 4096]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[a, e[-1:]] - a[0], pa.int32()), pa.array(h[a[0] : e[-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(d[a]), lists], names=["_d", "_hs"])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition of (.., _hs): the hashes that are a LISTED-th of it at least, and their number."""
    got = [b.column(0).flatten().to_numpy() for b in batches if b.num_rows]
    if got:
        h, n = np.unique(np.concatenate(got), return_counts=True)
        much = n >= max(8, int(n.sum()) // LISTED)
        yield pa.RecordBatch.from_arrays([pa.array(h[much]), pa.array(n[much])], names=["h", "n"])


def _crowded(active: DataFrame, most: int) -> np.ndarray:
    """Hashes that more than ``most`` documents share and that are a LISTED-th of all: LISTED at most, whatever the input."""
    total = active.agg(F.sum(F.size("_hs"))).first()[0] or 0
    counts = active.select("_hs").mapInArrow(_frequent, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r.h for r in counts.where(F.col("n") > max(most, total // LISTED)).select("h").collect()], np.int64))


_SEGMENT = "key bigint, d bigint, sig bigint, start int, n int, seg binary"


def _segmenter(crowded: np.ndarray):
    """_id, _sig, _t, _hs to segments of shared anchors; those known to repeat a smaller document have seg null."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _segments(batches):
            hot = np.isin(b.column(0).to_numpy(), crowded) & b.column(5).is_valid().to_numpy(zero_copy_only=False)
            if hot.any():
                yield _parted(b.filter(pa.array(hot)))
                b = b.filter(pa.array(~hot))
            yield b

    return segments


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            ids, sigs, texts = part.column(0).to_numpy(), part.column(1).to_numpy(), _bytes(part, 2)
            hashes, cuts = part.column(3).values.to_numpy(), part.column(3).offsets.to_numpy()
            shared = [np.unique(hashes[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
            found: list[tuple[np.ndarray, ...]] = []
            for own, start, count, h in runs(texts):
                h = h.view(np.int64)
                edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
                near = np.zeros(len(h), bool)
                for a, e in zip(edges, edges[1:], strict=False):
                    if len(s := shared[own[a]]):
                        near[a:e] = s[np.minimum(np.searchsorted(s, h[a:e]), len(s) - 1)] == h[a:e]
                found.append((own[near], start[near], count[near], h[near]))
            if not found:
                continue
            own, start, count, h = (np.concatenate(c) for c in zip(*found, strict=True))
            if not len(own):
                continue
            segs = pa.array([texts[i][x:e] for i, x, e in zip(own.tolist(), start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True)], pa.binary())
            code, d = segs.dictionary_encode().indices.to_numpy(), ids[own]
            known = d > _least(code, d)[code]
            segs = pc.if_else(pa.array(known), pa.scalar(None, pa.binary()), segs)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(known, d, h)), pa.array(d), pa.array(sigs[own]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), segs], names=["key", "d", "sig", "start", "n", "seg"])


def _least(code: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The least d of each code."""
    out = np.full(int(code.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(out, code, d)
    return out


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of strings, with the suffix array at run ends.

    Strings end with a symbol under all others; equal suffixes are ordered by string. owner: a number for each string;
    least() is the smallest of those whose string has the LENGTH bytes that stand at a row.
    """

    def __init__(self, strings: list[bytes], owner: np.ndarray):
        sizes = np.array([len(s) + 1 for s in strings])
        self.ends = np.cumsum(sizes)
        n = int(self.ends[-1])
        text = np.zeros(n + LENGTH, np.int64)
        body = np.ones(n, bool)
        body[self.ends - 1] = False
        text[:n][body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        self.text, string = text.astype(np.int16), np.repeat(np.arange(len(strings)), sizes)
        left = self.ends[string] - np.arange(n)  # symbols from here on, the end symbol included
        key, width = np.zeros(n, np.int64), 7
        for i in range(width):
            key = key << 9 | np.where(left > i, text[i : n + i], 0)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        while width <= int(sizes.max()):
            if width == 28:
                at = np.flatnonzero(left > LENGTH)
                same = np.unique(rank[at] * (n + 2) + rank[at + LENGTH - 28], return_inverse=True)[1]
            nxt = np.where(left > width, rank[np.minimum(np.arange(n) + width, n - 1)], 0)
            rank = np.unique(rank * (n + 2) + nxt, return_inverse=True)[1].astype(np.int64) + 1
            width *= 2
        sa = np.argsort(rank, kind="stable")
        before = np.where(np.isin(sa, self.ends - sizes), 0, self.text[sa - 1])
        head = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        length = np.diff(np.r_[head, n])
        self.head, self.char = head, before[head].astype(np.int64)
        order = np.argsort(self.char, kind="stable")
        to = np.zeros(len(head), np.int64)
        to[order] = np.cumsum(length[order]) - length[order]
        self.to, self.first, self.last = to, sa[head], sa[head + length - 1]
        self.length, self.by_char = length, self.char[order] * len(head) + order
        # intervals of rows that begin with the same LENGTH bytes, and the least owner in each
        row = np.zeros(n, np.int64)
        row[sa] = np.arange(n)
        of = np.full(n, -1, np.int64)
        of[row[at]] = same
        least = np.full(int(same.max()) + 1, np.iinfo(np.int64).max) if len(at) else np.zeros(0, np.int64)
        np.minimum.at(least, same, owner[string[at]])
        begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        self.begin, self.least = begin, np.where(of[begin] >= 0, least[of[begin]] if len(least) else 0, np.iinfo(np.int64).max)

    def agreeing(self, a: np.ndarray, b: np.ndarray, most: int, text: np.ndarray) -> np.ndarray:
        """Number of equal symbols from the index's positions a and text's positions b on, up to most or an end."""
        if not most:
            return np.zeros(len(a), np.int64)
        k = np.arange(most)
        x = self.text[np.minimum(a[:, None] + k, len(self.text) - 1)]
        same = (x == text[np.minimum(b[:, None] + k, len(text) - 1)]) & (x != 0)
        return np.where(same.all(axis=1), most, np.argmin(same, axis=1))

    def stream(self, begin: np.ndarray, end: np.ndarray, text: np.ndarray | None = None, least: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of the patterns text[begin:end], backwards and all at once: pattern, position, length, row.

        text: symbols over 0 (default: the index's own). A pattern ends early once no position before reaches ``least``.
        """
        text = self.text if text is None else text
        who = np.arange(len(begin))
        row, pos, size = np.zeros(len(begin), np.int64), np.full(len(begin), self.first[0]), np.zeros(len(begin), np.int64)
        at, r = end.astype(np.int64).copy(), len(self.head)
        while len(who):
            at = at - 1
            live = (at >= begin[who]) & (size + 1 + at - begin[who] >= least)
            who, row, pos, size, at = who[live], row[live], pos[live], size[live], at[live]
            if not len(who):
                return
            c = text[at].astype(np.int64)
            run = np.searchsorted(self.head, row, "right") - 1
            off = np.flatnonzero(self.char[run] != c)
            absent = off[:0]
            if len(off):
                slot = np.searchsorted(self.by_char, c[off] * r + run[off])
                up, down = self.by_char[np.maximum(slot - 1, 0)], self.by_char[np.minimum(slot, r - 1)]
                has_up, has_down = (slot > 0) & (up // r == c[off]), (slot < r) & (down // r == c[off])
                up, down, most = up % r, down % r, int(size[off].max())
                a = np.where(has_up, np.minimum(self.agreeing(self.last[up], at[off] + 1, most, text), size[off]), -1)
                b = np.where(has_down, np.minimum(self.agreeing(self.first[down], at[off] + 1, most, text), size[off]), -1)
                upward = a >= b
                run[off] = np.where(upward, up, down)
                row[off] = np.where(upward, self.head[up] + self.length[up] - 1, self.head[down])
                pos[off], size[off] = np.where(upward, self.last[up], self.first[down]), np.maximum(a, b)
                absent = off[~has_up & ~has_down]
            row = self.to[run] + row - self.head[run]
            pos, size = pos - 1, size + 1
            row[absent], pos[absent], size[absent] = 0, self.first[0], 0  # no such character: begin anew before it
            yield who, at, size, row

    def owner_at(self, row: np.ndarray) -> np.ndarray:
        return self.least[np.searchsorted(self.begin, row, "right") - 1]


def _marked(strings: list[bytes], owner: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """strings: different segments, of which owner is the least document. (segment, its starts whose string a smaller document of its group has).

    A string of LENGTH bytes stands in one group only, as its anchor does.
    """
    low, high = (np.zeros(int(group.max()) + 1, np.int64) for _ in range(2))
    low[:], high[:] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    np.minimum.at(low, group, owner), np.maximum.at(high, group, owner)
    held, asked = np.flatnonzero(owner < high[group]), np.flatnonzero(owner > low[group])
    index = RunIndex([strings[i] for i in held.tolist()], owner[held])
    size = np.array([len(strings[i]) + 1 for i in asked.tolist()])
    end = np.cumsum(size) - 1
    begin = end + 1 - size
    text = np.frombuffer(b"\0".join([strings[i] for i in asked.tolist()] + [b""]), np.uint8).astype(np.int16) + np.int16(1)
    who, start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w, at, n, row in index.stream(begin, end, text, LENGTH):
        long = np.flatnonzero(n >= LENGTH)
        less = long[index.owner_at(row[long]) < owner[asked[w[long]]]]
        who.append(w[less]), start.append(at[less] - begin[w[less]])
    who, start = asked[np.concatenate(who)], np.concatenate(start)
    order = np.lexsort((start, who))
    who, start = who[order], start[order]
    edges = np.flatnonzero(np.r_[True, who[1:] != who[:-1], True]) if len(who) else []
    for a, e in zip(edges, edges[1:], strict=False):
        yield int(who[a]), start[a:e]


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal covered intervals (from, to) of sorted string starts."""
    cut = np.flatnonzero(np.diff(starts) > LENGTH)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + LENGTH).tolist(), strict=True))


def _marks(d: np.ndarray, sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Rows of segments without bytes: of start a and n = b - a, all of which go."""
    none = np.zeros(len(d), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(none), pa.array(d, pa.int64()), pa.array(sig, pa.int64()), pa.array(a, pa.int32()), pa.array(np.asarray(b) - a, pa.int32()), pa.nulls(len(d), pa.binary())], names=["key", "d", "sig", "start", "n", "seg"])


def _parted(b: pa.RecordBatch) -> pa.RecordBatch:
    """Segments of a common anchor, cut into STEP starts each by their distance from it, keyed by the bytes that such starts share.

    Of equal parts only those of the least document keep their bytes; the others are known to repeat it.
    """
    segs = b.column(5).to_pylist()
    begin = np.cumsum([0, *map(len, segs)])[:-1]
    place = (_anchors(np.frombuffer(b"".join(segs), np.uint8))[0][begin] - begin).tolist()
    out = []
    for (d, sig, start, n), seg, p in zip(zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True), segs, place, strict=True):
        for k in range((p - n + 1) // STEP, p // STEP + 1):
            first, last = max(0, p - STEP * k - STEP + 1), min(n - 1, p - STEP * k)
            common = seg[p - STEP * k : p - STEP * k - STEP + 1 + LENGTH]
            out.append((xxhash.xxh64_intdigest(common, k) - (1 << 63), d, sig, start + first, last - first + 1, seg[first : last + LENGTH]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "d", "sig", "start", "n", "seg"])
    key, d = (made.column(i).to_numpy() for i in range(2))
    code = np.unique(np.c_[made.column(5).dictionary_encode().indices.to_numpy(), key], axis=0, return_inverse=True)[1].ravel()
    known = d > _least(code, d)[code]
    segs = pc.if_else(pa.array(known), pa.scalar(None, pa.binary()), made.column(5))
    return pa.RecordBatch.from_arrays([pa.array(np.where(known, d, key)), *made.columns[1:5], segs], names=made.schema.names)


def _matcher(most: int | None, block: int = 1 << 20):
    """A partition of segments to marks; with ``most``, anchors of more segments are passed on as _parted gives them."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: list[pa.RecordBatch] = []
        crowded, fresh, names = np.zeros(0, np.int64), 0, ["key", "d", "sig", "start", "n", "seg"]

        def pass_on(t: pa.Table | pa.RecordBatch, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
            for x in pa.Table.from_batches([t] if isinstance(t, pa.RecordBatch) else t.to_batches()).filter(pa.array(hot)).combine_chunks().to_batches(max_chunksize=1 << 16):
                if x.num_rows:
                    yield from settled(_parted(x))

        def settled(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """Marks of the known rows, and the others."""
            known = b.column(5).is_null().to_numpy(zero_copy_only=False)
            if known.any():
                d, sig, start, n = (b.column(i).to_numpy()[known] for i in (1, 2, 3, 4))
                yield _marks(d, sig, start, start + n + LENGTH - 1)
            yield b.filter(pa.array(~known))

        for b in batches:
            *marks, b = settled(b)
            yield from marks
            if most and len(crowded) and b.num_rows:
                hot = np.isin(b.column(0).to_numpy(), crowded)
                yield from pass_on(b, hot)
                b = b.filter(pa.array(~hot))
            sent.append(b.rename_columns(names))
            fresh += b.num_rows
            if most and fresh > 64 * most:
                t, fresh = pa.Table.from_batches(sent), 0
                keys, count = np.unique(t.column(0).to_numpy(), return_counts=True)
                if (count > most).any():
                    crowded = np.union1d(crowded, keys[count > most])
                    hot = np.isin(t.column(0).to_numpy(), crowded)
                    yield from pass_on(t, hot)
                    sent = t.filter(pa.array(~hot)).combine_chunks().to_batches()
        sent = [b for b in sent if b.num_rows]
        if not sent:
            return
        t = pa.Table.from_batches(sent)
        if most:
            keys, count = np.unique(t.column(0).to_numpy(), return_counts=True)
            if (count > most).any():
                hot = np.isin(t.column(0).to_numpy(), keys[count > most])
                yield from pass_on(t, hot)
                t = t.filter(pa.array(~hot))
                if not t.num_rows:
                    return
        yield from _indexed(t, block)

    return match


def _indexed(t: pa.Table, block: int) -> Iterator[pa.RecordBatch]:
    """Segments to marks."""
    h, d, sig, start, n = (t.column(i).to_numpy() for i in (0, 1, 2, 3, 4))
    encoded = t.column(5).combine_chunks().dictionary_encode()
    code, texts = encoded.indices.to_numpy(), encoded.dictionary
    least = _least(code, d)
    # equal segments: all but those of the least document go whole
    whole = d > least[code]
    if whole.any():
        yield _marks(d[whole], sig[whole], start[whole], start[whole] + n[whole] + LENGTH - 1)
    # an anchor with different segments, not all of one document, needs the index
    anchor = np.zeros(len(texts), np.int64)
    anchor[code] = h
    order = np.argsort(anchor, kind="stable")
    edges = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1]])
    apart = np.minimum.reduceat(least[order], edges) < np.maximum.reduceat(least[order], edges)
    groups = [order[a:e] for a, e, x in zip(edges, np.r_[edges[1:], len(order)], apart, strict=True) if x]
    mine = np.flatnonzero(~whole)
    mine = mine[np.argsort(code[mine], kind="stable")]
    of = np.searchsorted(code[mine], np.arange(len(texts) + 1))  # rows of the least document, by segment
    some: list[np.ndarray] = []
    size = 0
    for i, g in enumerate(groups):
        some.append(g)
        size += len(g)
        if size * (LENGTH + W) >= block or i == len(groups) - 1:
            codes = np.concatenate(some)
            out = []
            for k, starts in _marked(texts.take(pa.array(codes)).to_pylist(), least[codes], np.repeat(np.arange(len(some)), [len(x) for x in some])):
                rows = mine[of[codes[k]] : of[codes[k] + 1]]
                out += [(rows, np.full(len(rows), a), np.full(len(rows), e)) for a, e in _spans(starts)]
            if out:
                rows, a, e = (np.concatenate(c) for c in zip(*out, strict=True))
                yield _marks(d[rows], sig[rows], start[rows] + a, start[rows] + e)
            some, size = [], 0


def _whole(t: bytes, a: int, e: int) -> tuple[int, int]:
    """The span a to e, widened to the characters it cuts in two."""
    while 0 < a < len(t) and t[a] & 0xC0 == 0x80:
        a -= 1
    while e < len(t) and t[e] & 0xC0 == 0x80:
        e += 1
    return a, e


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_id, _sig, _t, _as, _bs to the digest columns (of the bytes that stay) and the whole characters that stay."""
    for b in batches:
        out = []
        for t, starts, ends in zip(_bytes(b, 2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            spans: list[list[int]] = []
            for a, e in sorted(zip(starts, ends, strict=True)):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(e, spans[-1][1])
                else:
                    spans.append([a, e])
            stay = lambda cuts: b"".join(t[e:a] for e, a in zip([0, *(e for _, e in cuts)], [*(a for a, _ in cuts), len(t)], strict=True))  # noqa: B023, E731
            out.append((sum(e - a for a, e in spans), len(spans), hashlib.sha256(stay(spans)).hexdigest(), stay([_whole(t, a, e) for a, e in spans])))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["_d", "_s", "_removed", "_spans", "_sha", "_rest"])


def repeats(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", rest: bool, most: int = MOST, listed: bool = True) -> tuple[DataFrame, DataFrame]:
    """(a) _id, _sig, _bytes, _sha, _copy for each row; (b) _d, _s, _removed, _spans, _sha2 and, with rest, _rest for each document that loses bytes but isn't a copy."""
    spark = df.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(t).alias("_sig"), t.alias("_t"))
    facts, plain = stored(rows.select("_id", "_sig", F.octet_length("_t").cast("long").alias("_bytes"), F.sha2("_t", 256).alias("_sha")), "repeats-facts")
    # only digests with more than one id are joined back; rows of the others move nowhere twice
    firsts = facts.where("_id IS NOT NULL").groupBy("_sha").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last")
    firsts = materialize(firsts.select(F.col("_sha").alias("_sha1"), "_first"), "repeats-firsts")  # Spark can split a hot digest's rows in the join then
    facts = materialize(facts.join(firsts, F.col("_sha") == F.col("_sha1"), "left").select("_id", "_sig", "_bytes", "_sha", F.coalesce((F.col("_first") < F.col("_id")) & (F.col("_bytes") >= LENGTH), F.lit(False)).alias("_copy")), "repeats-copies")
    discard(spark, plain)
    size = facts.agg(F.sum("_bytes")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // _PART)
    keys = keys_of_partitions(parts)
    asked = rows.where(F.col("_id").isNotNull() & (F.octet_length("_t") >= LENGTH)).select("_id", "_t").mapInArrow(_asker(keys), _DEALT)
    shared = asked.repartition(parts, "bucket").mapInArrow(_answerer(keys), _DEALT)
    shared = shared.repartition(parts, "bucket").mapInArrow(_gather, "_d bigint, _hs array<bigint>")  # as many as the document's anchors at most
    active = facts.where("_id IS NOT NULL AND NOT _copy").select(F.col("_id").alias("_d"), F.col("_sig").alias("_s")).distinct().join(shared, "_d")
    active, first_place = stored(active, "repeats-shared")
    crowded = _crowded(active, most) if listed else np.zeros(0, np.int64)
    held = rows.join(active, (F.col("_id") == F.col("_d")) & (F.col("_sig") == F.col("_s"))).select("_id", "_sig", "_t", "_hs")
    held, held_place = stored(held.dropDuplicates(["_id", "_sig"]) if facts.groupBy("_id", "_sig").count().where("count > 1 AND _id IS NOT NULL").limit(1).count() else held, "repeats-held")
    discard(spark, first_place)
    found, found_place = stored(held.mapInArrow(_segmenter(crowded), _SEGMENT).repartition(parts, "key").mapInArrow(_matcher(most), _SEGMENT), "repeats-found")
    again = found.where("seg IS NOT NULL").repartition(parts, "key").mapInArrow(_matcher(None), _SEGMENT)
    marks = found.where("seg IS NULL").unionByName(again).groupBy("d", "sig").agg(F.collect_list(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))).alias("_m"))  # bounded by the document's segments
    lost = held.join(marks, (F.col("_id") == F.col("d")) & (F.col("_sig") == F.col("sig"))).select("_id", "_sig", "_t", F.col("_m.a").alias("_as"), F.col("_m.b").alias("_bs"))
    lost = lost.mapInArrow(_cut, "_d bigint, _s bigint, _removed bigint, _spans bigint, _sha2 string, _rest binary")
    lost = materialize(lost if rest else lost.drop("_rest"), "repeats-lost")
    discard(spark, held_place, found_place)
    return facts, lost


def removals(df: DataFrame, **names) -> DataFrame:
    """A row for each row of df: id, n_bytes, n_removed, n_spans, kept_sha256."""
    id_col = names.get("id_col", "doc_id")
    facts, lost = repeats(df, rest=False, **names)
    both = facts.join(lost, (F.col("_id") == F.col("_d")) & (F.col("_sig") == F.col("_s")), "left")
    pick = lambda copy, else_: F.when(F.col("_copy"), copy).otherwise(else_)
    zero = F.lit(0).cast("long")
    return both.select(
        F.col("_id").alias(id_col),
        F.col("_bytes").alias("n_bytes"),
        pick(F.col("_bytes"), F.coalesce("_removed", zero)).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.coalesce("_spans", zero)).alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.coalesce("_sha2", "_sha")).alias("kept_sha256"),
    )


def without_repeats(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """df's rows with the repeated bytes gone from text (characters cut in two go whole), n_chars renewed; rows that lose all are dropped."""
    facts, lost = repeats(df, id_col=id_col, text=text, rest=True)
    lost = lost.select("_d", "_s", "_rest")
    change = facts.where("_copy").select(F.col("_id").alias("_d"), F.col("_sig").alias("_s"), F.lit(b"").alias("_rest")).distinct().unionByName(lost)
    sig = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    both = df.select(F.struct(*(F.col(c) for c in df.columns)).alias("_row"), F.col(id_col).cast("long").alias("_id"), sig.alias("_sig")).join(change, (F.col("_id") == F.col("_d")) & (F.col("_sig") == F.col("_s")), "left")
    clean = F.when(F.col("_rest").isNull(), F.col("_row")[text]).otherwise(F.col("_rest").cast("string"))
    both = both.where("_rest IS NULL OR octet_length(_rest) > 0").withColumn("_clean", clean)
    new = {text: F.col("_clean")} | ({n_chars: F.when(F.col("_rest").isNull(), F.col("_row")[n_chars]).otherwise(F.length("_clean").cast(df.schema[n_chars].dataType))} if n_chars in df.columns else {})
    return both.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in df.columns))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))
