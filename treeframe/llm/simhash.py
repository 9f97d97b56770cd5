"""SimHash fingerprints and their linking by a binary trie self-join.

Fingerprints are made from whole texts. Equal ones are one trie leaf, so exact copies never meet as pairs. If two
fingerprints differ in at most ``most`` bits, then of m blocks of bits they agree on m - most at least. For each choice
of m - most blocks the bits are permuted to put those first: that many top levels of the trie are walked with an error
budget of zero, which is what deals the trie out to tasks (a shuffle by those bits), and below them node pairs are walked
together with the differing bits added up, a pair being dropped as soon as the budget is exceeded. m grows with the
count of fingerprints so that the subtries stay small; every m finds all links. A subtrie of more than ``most_rows``
fingerprints is cut into chunks and each pair of chunks becomes a task of its own.

A task returns a spanning forest of the links it finds, never all pairs; the forests' connected components are those of
all links. Nulls: a null text has no words (fingerprint zero, linked like any other); a row with a null id takes the
component of the rows with its fingerprint, and is null and links nothing if none of them has an id. Repeated rows are
one node, and come back repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeframe.llm.common import materialize, table
from treeframe.llm.components import components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, width: int = 4) -> int:
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # splits at U+0009-000D and space
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) <= width:
        return h(b" ".join(w), 42)
    joined, ends = b" ".join(w), np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = [0, *ends[:-width].tolist()]
    got = np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(got), 1 << 16):
        part = got[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(got)).tobytes(), "big")


def signature(text: str) -> Column:
    """A hash that tells texts apart; null is the empty text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = 4, signed: bool = False) -> DataFrame:
    """id, _tf_fp (the fingerprint as a signed long), and if signed _tf_sig (see signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, width) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], names=["_tf_id", "_tf_fp", *["_tf_sig"][: len(b.columns) - 2]])

    own = [signature(text).alias("_tf_sig")] if signed else []
    return df.select(F.col(id_col).cast("long"), F.col(text), *own).mapInArrow(run, "_tf_id bigint, _tf_fp bigint" + ", _tf_sig bigint" * signed)


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if np.array_equal(y, x):
                return x
            x = self.up[y]

    def link(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Joins the pairs; returns those that joined two trees."""
        made = []
        while True:
            ra, rb = self.roots(a), self.roots(b)
            open_ = ra != rb
            if not open_.any():
                return made
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
            hi, first = np.unique(hi, return_index=True)  # one new link upward for each root
            self.up[hi] = lo[first]
            made += zip(a[first].tolist(), b[first].tolist(), strict=True)


def trie_links(values: np.ndarray, exact: int, most: int, side: np.ndarray | None = None, step: int = 4, block: int = 1 << 16) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links among distinct sorted uint64 values that agree on the top exact bits.

    Node pairs are walked down the trie step bits at a time, depth first in blocks, so memory does not grow with the
    number of pairs. side: with it, only values of different sides are linked.
    """
    n, forest, made = len(values), Forest(len(values)), []
    if n < 2:
        return made
    levels = [*range(exact, 64, step), 64]
    starts = []  # of each level: first index of each node
    for d in levels:
        key = values >> np.uint64(64 - d) if d else np.zeros(n, np.uint64)
        starts.append(np.flatnonzero(np.r_[True, key[1:] != key[:-1]]))
    ids = np.arange(len(starts[0]))
    sizes = np.diff(np.r_[starts[0], n])
    stack = [(0, ids[sizes > 1], ids[sizes > 1], np.zeros(int((sizes > 1).sum()), np.int64))]
    while stack:
        k, a, b, err = stack.pop()
        if len(a) > block:
            for i in range(0, len(a), block):
                stack.append((k, a[i : i + block], b[i : i + block], err[i : i + block]))
            continue
        if not len(a):
            continue
        if k == len(levels) - 1:  # leaves: one value each
            near = a != b
            if side is not None:
                near &= side[a] != side[b]
            made += forest.link(a[near], b[near])
            continue
        below = np.searchsorted(starts[k + 1], np.r_[starts[k], n])  # children of node i: below[i] .. below[i + 1]
        na, nb = below[a + 1] - below[a], below[b + 1] - below[b]
        each = na * nb
        if each.sum() > 4 * block and len(a) > 1:
            half = len(a) // 2
            stack += [(k, a[half:], b[half:], err[half:]), (k, a[:half], b[:half], err[:half])]
            continue
        of = np.repeat(np.arange(len(a)), each)
        within = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        ca, cb = below[a[of]] + within // nb[of], below[b[of]] + within % nb[of]
        up = ca <= cb
        of, ca, cb = of[up], ca[up], cb[up]
        x = (values[starts[k + 1][ca]] ^ values[starts[k + 1][cb]]) >> np.uint64(64 - levels[k + 1])
        width = levels[k + 1] - levels[k]
        e = err[of] + np.bitwise_count(x & np.uint64((1 << width) - 1)).astype(np.int64)
        keep = e <= most
        stack.append((k + 1, ca[keep], cb[keep], e[keep]))
    return made


def layout(m: int, most: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """The m blocks as (first bit from the top, width), and the choices of m - most of them."""
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], list(combinations(range(m), m - most))


def permuted(fp: np.ndarray, blocks: list[tuple[int, int]], chosen: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """fp with the chosen blocks' bits first, and their number."""
    out = np.zeros_like(fp)
    for i in [*chosen, *(i for i in range(len(blocks)) if i not in chosen)]:
        at, width = blocks[i]
        out = (out << np.uint64(width)) | ((fp >> np.uint64(64 - at - width)) & np.uint64((1 << width) - 1))
    return out, sum(blocks[i][1] for i in chosen)


def blocks_for(n: int, most: int, subtrie: int = 256) -> int:
    """The least m whose subtries hold about subtrie fingerprints at most."""
    m = most + 1
    while m < most + 4 and n >> (64 * (m - most) // m) > subtrie:
        m += 1
    return m


def linked(fps: DataFrame, *, most: int = 4, m: int | None = None, most_rows: int = 50_000) -> DataFrame:
    """fps: _tf_fp (distinct), _tf_rep. Returns u, v: representatives; a spanning forest of each task's links."""
    n = fps.count()
    m = m or blocks_for(n, most)
    blocks, choices = layout(m, most)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for k, chosen in enumerate(choices):
                perm, width = permuted(fp, blocks, chosen)
                key = (perm >> np.uint64(64 - width)).astype(np.int64) * len(choices) + k
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(perm.view(np.int64)), b.column(1)], names=["key", "perm", "rep"])

    dealt = fps.select("_tf_fp", "_tf_rep").mapInArrow(deal, "key bigint, perm bigint, rep bigint")
    if most_rows and n > most_rows:
        large = dealt.groupBy("key").count().where(F.col("count") > most_rows).select(F.col("key").alias("_k"), F.ceil(F.col("count") / most_rows).cast("int").alias("chunks"))
        dealt = dealt.join(materialize(large, "simhash-large"), F.col("key") == F.col("_k"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        own = F.pmod(F.xxhash64("perm"), F.col("chunks")).cast("int")
        dealt = dealt.withColumn("chunk", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    else:
        dealt = dealt.withColumns({"chunk": F.lit(0), "other": F.lit(0)})
    lo, hi = F.least("chunk", "other"), F.greatest("chunk", "other")
    dealt = dealt.select("key", "perm", "rep", "chunk", lo.alias("lo"), hi.alias("hi"))
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    widths = [sum(blocks[i][1] for i in c) for c in choices]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        key, perm, rep, chunk, lo_, hi_ = (t.column(i).combine_chunks().to_numpy() for i in range(6))
        perm, group = perm.view(np.uint64), (key % len(choices)) << 40 | lo_.astype(np.int64) << 20 | hi_
        out: list[tuple[int, int]] = []
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            at = at[np.argsort(perm[at])]
            side = chunk[at] if (g >> 20) & 0xFFFFF != g & 0xFFFFF else None
            out += [(int(rep[at[a]]), int(rep[at[b]])) for a, b in trie_links(perm[at], widths[g >> 40], most, side)]
        if out:
            u, v = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return dealt.repartition(parts, "key", "lo", "hi").mapInArrow(join, "u bigint, v bigint")


def near_groups(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", most: int = 4, **params) -> DataFrame:
    """id, _tf_fp, _tf_component for each row of df."""
    fps = materialize(fingerprints(df, id_col=id_col, text=text), "simhash-fingerprints")
    # a fingerprint's node is its least id
    reps = materialize(fps.groupBy("_tf_fp").agg(F.min("_tf_id").alias("_tf_rep")), "simhash-distinct")
    found = components(linked(reps.where("_tf_rep IS NOT NULL"), most=most, **params), "simhash-links")
    named = reps.join(found, F.col("_tf_rep") == F.col("u"), "left").select(F.col("_tf_fp").alias("_fp"), F.coalesce("component", "_tf_rep").alias("_tf_component"))
    named = materialize(named, "simhash-components")
    return fps.join(named, F.col("_tf_fp") == F.col("_fp")).select("_tf_id", "_tf_fp", "_tf_component")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", **params) -> DataFrame:
    """A row for each row of df: its id, fingerprint (16 hexadecimal digits), component_id (least id reachable)."""
    out = near_groups(df, id_col=id_col, **params)
    return out.select(F.col("_tf_id").alias(id_col), F.lower(F.lpad(F.hex("_tf_fp"), 16, "0")).alias("fingerprint"), F.col("_tf_component").alias("component_id"))


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", most: int = 4, **params) -> DataFrame:
    """One row of df for each component of fingerprints, that of the least id, with df's columns. Rows without an id stay.

    Rows are judged by id and text: an id that comes with several texts is a row of each text's component.
    """
    fps = materialize(fingerprints(df, id_col=id_col, text=text, signed=True), "simhash-fingerprints").where("_tf_id IS NOT NULL")
    # a fingerprint is its own node here: texts that share an id only are not linked
    nodes = materialize(fps.groupBy("_tf_fp").agg(F.min(F.struct("_tf_id", "_tf_sig")).alias("_tf_least")), "simhash-distinct")
    found = components(linked(nodes.select("_tf_fp", F.col("_tf_fp").alias("_tf_rep")), most=most, **params), "simhash-links")
    named = materialize(nodes.join(found, F.col("_tf_fp") == F.col("u"), "left").select(F.col("_tf_fp").alias("_fp"), F.coalesce("component", "_tf_fp").alias("_tf_component"), "_tf_least"), "simhash-components")
    first = named.groupBy(F.col("_tf_component").alias("_c")).agg(F.min("_tf_least").alias("_tf_first"))
    first = materialize(named.join(first, F.col("_tf_component") == F.col("_c")).select("_fp", "_tf_first"), "simhash-firsts")
    judged = fps.join(first, F.col("_tf_fp") == F.col("_fp")).groupBy("_tf_id", "_tf_sig").agg((F.struct("_tf_id", "_tf_sig") != F.min("_tf_first")).alias("_tf_copy"), F.count("*").alias("_tf_n"))
    drop = materialize(judged.where("_tf_copy OR _tf_n > 1"), "simhash-drop")
    same = (F.col(id_col) == F.col("_tf_id")) & (signature(text) == F.col("_tf_sig"))
    kept = df.join(drop.where("_tf_copy").select("_tf_id", "_tf_sig"), same, "left_anti")
    again = drop.where("NOT _tf_copy").select("_tf_id", "_tf_sig")
    if again.isEmpty():
        return kept
    once = kept.join(again, same, "left_semi").withColumn("_tf_s", signature(text)).dropDuplicates([id_col, "_tf_s"]).drop("_tf_s")
    return kept.join(again, same, "left_anti").unionByName(once)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
