"""Packing documents into sequences along a Hilbert curve.

Each document's words are hashed to signs in a few dimensions; their mean is a point, and its Hilbert index the sort key.
A range shuffle by (key, id) puts neighbours along the curve together and spreads equal keys by id, so copies of one
document don't meet in one task. The ranges hold about as many bytes of text each: their bounds come from a sample of
``SAMPLE`` rows at most, so that all keys are made once. Each task tokenizes its documents once, as they stream by in curve order, and cuts the
token stream every ``size`` ids. What a task has left at its end goes to sequences of powers of two, which need no
padding; so no sequence is padded at all. Sequence ids are (task << 40) + number.

Nulls: a null text is empty, so its one id is the separator; null ids sort first. Repeated rows are packed each. Memory
is that of one Arrow batch and one open sequence.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeframe.llm.common import keys_of_partitions, table

SIZE, DIMS, BITS = 1024, 4, 15
SAMPLE = 1_000_000
#: The split pattern of byte-level BPE and the name of its end token (fixed values).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = "<|endoftext|>"
_KEPT = 400_000  # words that a worker's memory holds; beyond it they are looked up anew
_SIGNS = np.array([[code >> d & 1 for d in range(DIMS)] for code in range(1 << DIMS)])


def point(text: str | None) -> np.ndarray:
    """Mean over the text's four-byte grams of DIMS hashed signs (0 or 1)."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) < 4:
        return np.full(DIMS, 0.5)
    g = data[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        g |= data[k : len(data) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    g *= np.uint32(2654435761)
    counts = np.bincount(g >> np.uint32(32 - DIMS), minlength=1 << DIMS)
    return (counts @ _SIGNS) / len(g)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of non-negative integers below 2 ** bits (Skilling's transform, a column at a time)."""
    x = points.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(texts: list[str | None]) -> np.ndarray:
    p = np.array([point(t) for t in texts]).reshape(-1, DIMS)
    spread = np.clip((p - 0.5) * 4 + 0.5, 0, 1)  # means lie near one half
    return hilbert(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


class _Unsafe(Exception):
    pass


class Tokens(dict):
    """Ids, as little-endian 32-bit bytes, of texts by a byte-level BPE file of the tokenizers library.

    The file's vocabulary is run by tiktoken, whose ids are the same (a token's id is its rank) in a fraction of the time.
    The file's added tokens are plain text, or, with ``added``, cut out first and given their own ids, as tokenizers does
    by default. Such a tokenizer splits before each single space between two characters that are no white space, so ids are kept by
    space-led word; a text with other white space next to a space is encoded as a whole.
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        super().__init__()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary = file["model"]["vocab"]
        listed = file.get("added_tokens") or []
        if added and any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in listed):
            raise ValueError("added tokens with single_word, lstrip or rstrip are not supported")
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in listed} if added else {}
        # the longest of those that start at a place
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        # such files write each byte as a printable character: itself, or the next free one from U+0100
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(map(byte.__getitem__, k)): v for k, v in vocabulary.items() if all(c in byte for c in k) and k != END}
        self.run = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return np.array(self.run(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Unsafe
        if len(self) > _KEPT:
            self.clear()
        self[word] = out = self.whole(" " + word)
        return out

    def encode(self, text: str) -> bytes:
        if self.cut and len(parts := self.cut.split(text)) > 1:
            return b"".join(self.added[x] if i % 2 else self.plain(x) for i, x in enumerate(parts))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest:
            return self.whole(text) if text else b""
        if not first or first[-1].isspace():
            return self.whole(text)
        try:
            return self.whole(first) + b"".join(map(self.__getitem__, rest))
        except _Unsafe:
            return self.whole(text)


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Cuts a stream of documents. Pieces: doc_id, start, length, crc32, doc_tokens, sequence_id, offset."""

    def __init__(self, first: int, size: int = SIZE):
        self.next, self.size, self.open, self.used = first, size, [], 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        n, at = len(ids) // 4, 0
        while at < n:
            take = min(n - at, self.size - self.used)
            self.open.append((doc_id, at, ids[4 * at : 4 * (at + take)], n))
            at, self.used = at + take, self.used + take
            if self.used == self.size:
                yield from self._close(self.open)
                self.open, self.used = [], 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, n in pieces:
            yield doc_id, start, len(ids) // 4, zlib.crc32(ids), n, self.next, offset
            offset += len(ids) // 4
        self.next += 1

    def finish(self) -> Iterator[tuple]:
        rest = self.open[::-1]
        for room in _powers(self.used):
            own = []
            while room:
                doc_id, start, ids, n = rest.pop()
                take = min(room, len(ids) // 4)
                own.append((doc_id, start, ids[: 4 * take], n))
                if len(ids) > 4 * take:
                    rest.append((doc_id, start + take, ids[4 * take :], n))
                room -= take
            yield from self._close(own)
        self.open, self.used = [], 0


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_WORKER: dict[tuple[str, bool], Tokens] = {}


def _pairs(keys: pa.Array, ids: pa.Array) -> np.ndarray:
    """(key, id) as numbers; a null id comes before all others."""
    out = np.zeros(len(keys), [("k", np.int64), ("i", np.int64)])
    out["k"], out["i"] = keys.to_numpy(zero_copy_only=False), ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
    return out


def _bounds(sample: pa.Table, parts: int) -> np.ndarray:
    """The sorted (key, id) at which ranges 1, 2 ... begin; about equal bytes of text lie between them."""
    pairs = _pairs(sample.column(0).combine_chunks(), sample.column(1).combine_chunks())
    size = sample.column(2).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) + 1
    order = np.lexsort((pairs["i"], pairs["k"]))
    run = np.cumsum(size[order])
    at = np.searchsorted(run, np.arange(1, parts) * (run[-1] / parts)) if len(run) else np.zeros(0, np.int64)
    return np.unique(pairs[order][at])


def _range(bounds: np.ndarray, keys: pa.Array, ids: pa.Array) -> np.ndarray:
    """The number of bounds that are not over each (key, id)."""
    pairs = _pairs(keys, ids)
    low, high = np.searchsorted(bounds["k"], pairs["k"], "left"), np.searchsorted(bounds["k"], pairs["k"], "right")
    for i in np.flatnonzero(low < high).tolist():
        low[i] += np.searchsorted(bounds["i"][low[i] : high[i]], pairs["i"][i], "right")
    return low


def pack(df: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text: str = "text", size: int = SIZE, separator: int = 0, parts: int | None = None, added: bool = False) -> DataFrame:
    """A row for each piece. tokenizer: path of a tokenizers file, on every executor; added: map its added tokens (else plain text)."""
    spark = df.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(curve_keys(b.column(1).to_pylist())), b.column(0), b.column(1)], names=["_k", "_id", "_t"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _WORKER[tokenizer, added] = _WORKER.get((tokenizer, added)) or Tokens(tokenizer, added)
        end = np.array([separator], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 40, size)
        for b in batches:
            rows = [x for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in packer.add(i, tokens.encode(t or "") + end)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], schema=_SCHEMA)
        if rows := list(packer.finish()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_SCHEMA)

    rows = df.select(F.col(id_col).cast("long"), F.col(text))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, min(SAMPLE / 2, 100 * parts) / max(1, rows.count()))
    bounds = _bounds(rows.sample(share, seed=3).mapInArrow(keyed, "_k bigint, _id bigint, _t string").select("_k", "_id", F.octet_length("_t")).limit(SAMPLE).toArrow(), parts)
    partition = keys_of_partitions(parts)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in keyed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(partition[_range(bounds, b.column(0), b.column(1))]), *b.columns], names=["_p", *b.schema.names])

    rows = rows.mapInArrow(dealt, "_p int, _k bigint, _id bigint, _t string")
    dealt = rows.repartition(parts, "_p").sortWithinPartitions("_p", "_k", "_id").select("_id", "_t")
    return dealt.mapInArrow(packed, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer=default_tokenizer(), added=True)
