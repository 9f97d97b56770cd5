"""Approximate nearest neighbours by a permutation index.

A vector is represented by its pivots in order of nearness. The pivots come from a bounded sample (``sample`` rows, those
of least hashed id); every vector is indexed. Vectors of unequal length are lifted by one coordinate to the greatest
length, which makes nearness by inner product nearness by angle. The index is cut into shards by hashed id; in a shard
each pivot has an inverted file, the ranks at which the shard's vectors list it (those beyond ``prefix`` standing after
all others). A query adds up, file by file, how far those ranks are from its own (Spearman's footrule); the ``share`` of a
shard that comes first, and ``FLOOR`` times k at least, is reranked by the inner product of the original vectors in double
precision, and the best of all shards are merged.

The queries are a stated set against all rows, in blocks: each task has one block of queries and one shard.

Vectors that are null, zero, of another than the most common dimension, or hold null or non-finite components, and rows
without an id, take no part. A query's own id is no candidate for it, repeated rows of it neither; repeated rows of
others count each; a repeated query is asked once. No valid vector: an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeframe.llm.common import materialize, table

PIVOTS, PREFIX, SHARE, SAMPLE, FLOOR = 256, 256, 0.1, 4096, 8


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The prefix nearest pivots of each row, nearest first; ties to the first pivot."""
    near = -(x @ pivots.T)
    m = min(prefix, len(pivots))
    return np.argsort(near, axis=1, kind="stable")[:, :m].astype(np.int16)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, most * most - (x * x).sum(axis=1)))
    return np.c_[x, rest] / most


class Files:
    """Inverted files of a shard: of each pivot the rank at which each vector lists it, prefix if it doesn't."""

    def __init__(self, perms: np.ndarray, pivots: int):
        n, self.m = perms.shape
        self.files = np.full((pivots, n), self.m, np.int16)
        rows = np.arange(n)
        for rank in range(self.m):
            self.files[perms[:, rank], rows] = rank

    def distances(self, perm: np.ndarray) -> np.ndarray:
        """Footrule from a query's permutation."""
        own = np.full(len(self.files), self.m, np.int16)
        own[perm] = np.arange(self.m, dtype=np.int16)
        out = np.zeros(self.files.shape[1], np.int32)
        for file, rank in zip(self.files, own, strict=True):
            out += np.abs(file - rank)
        return out


def search(df: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", is_query: Column, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, sample: int = SAMPLE, shard_rows: int = 16_384, query_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by largest inner product, ties to the smaller id."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.where(usable(F.col(vector)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), v.alias("_v"), is_query.alias("_q"))
    rows = materialize(rows, "ann-vectors")
    common = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return empty
    rows = rows.where(F.size("_v") == common["d"])
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    n, n_queries, most = rows.agg(F.count("*"), F.count(F.when(F.col("_q"), 1)), F.max(norm)).first()
    some = rows.orderBy(F.xxhash64("_id"), "_id").limit(sample).select("_v").collect()  # bounded by sample
    some = np.unique(lifted(np.array([r[0] for r in some]), most), axis=0)
    pivot = some[np.random.default_rng(5).permutation(len(some))[:pivots]]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).flatten()).reshape(b.num_rows, -1)
            p = permutations(lifted(x, most), pivot, prefix) if b.num_rows else np.zeros((0, 1), np.int16)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists], names=["_id", "_v", "_q", "_p"])

    indexed = materialize(rows.mapInArrow(index, "_id bigint, _v array<double>, _q boolean, _p array<smallint>"), "ann-index")
    shards, blocks = -(-n // shard_rows), max(1, -(-n_queries // query_rows))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = indexed.select("_id", "_v", "_p", F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(shards)).cast("int").alias("_s")).withColumn("_b", each(blocks))
    asked = indexed.where("_q").dropDuplicates(["_id"]).select("_id", "_v", F.pmod(F.xxhash64("_id", F.lit(4)), F.lit(blocks)).cast("int").alias("_b")).withColumn("_s", each(shards))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def matrix(t: pa.Table, c: str) -> np.ndarray:
        return np.array(t[c].combine_chunks().flatten()).reshape(t.num_rows, -1)

    def near(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        vectors = vectors.sort_by("_id")
        ids, x = np.array(vectors["_id"]), matrix(vectors, "_v")
        files, take = Files(matrix(vectors, "_p"), len(pivot)), min(len(ids), max(FLOOR * k, int(np.ceil(share * len(ids)))))
        q_ids, q = np.array(queries["_id"]), matrix(queries, "_v")
        zero = np.c_[q, np.zeros(len(q))] / np.sqrt((q * q).sum(axis=1))[:, None]
        out: list[list[np.ndarray]] = [[], [], []]
        for i, perm in enumerate(permutations(zero, pivot, prefix)):
            key = files.distances(perm).astype(np.int64) * len(ids) + np.arange(len(ids))  # ties by id
            found = np.argpartition(key, take - 1)[:take] if take < len(ids) else np.arange(len(ids))
            found = found[ids[found] != q_ids[i]]
            score = x[found] @ q[i]
            best = np.lexsort((ids[found], -score))[:k]
            for to, part in zip(out, (np.full(len(best), q_ids[i]), ids[found[best]], score[best]), strict=True):
                to.append(part)
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=schema)

    found = left.groupBy("_s", "_b").cogroup(asked.groupBy("_s", "_b")).applyInArrow(near, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0)
