"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeframe.llm.common import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or, with large=False, smaller) neighbours to the least of them and itself.

    The least neighbour is a partial aggregation and comes back by a join whose hot keys Spark splits: no node's
    neighbours meet in one task.
    """
    if large:
        edges = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    joined = edges.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    own = least.select("u", F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).where("u <> v").distinct()


def components(edges: DataFrame, tag: str = "components", most_rounds: int = 60) -> DataFrame:
    """edges: u, v (bigint, u > v after ordering). Returns u, component: the least node that u reaches, for each u not least itself.

    Each round is written to the shared folder; the driver sees a count and a checksum only. Self links and nulls are dropped.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e, seen = materialize(e, tag), None
    for _ in range(most_rounds):
        # large star: v > u links to m = min(neighbours and u); small star: smaller neighbours link to their least
        e = materialize(_stars(_stars(e, True), False), tag)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select("u", F.col("v").alias("component"))
