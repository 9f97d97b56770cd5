"""Small helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and U+0009 to U+000D.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RUN = r"[\x20\x09-\x0D]+"


#: The folder, below the shared one, of tables that are being made; see scratch.
_FOLDER: ContextVar[str] = ContextVar("folder", default="treeframe")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset and all is one machine (tests), a temporary folder serves; a cluster without it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="treeframe-")
        shared_dir.own = found
    return found.rstrip("/")


@contextmanager
def scratch() -> Iterator[str]:
    """Tables that are materialized within go to one folder of their own, whose name this gives; discard() removes it."""
    name = f"treeframe/{uuid.uuid4().hex}"
    token = _FOLDER.set(name)
    try:
        yield name
    finally:
        _FOLDER.reset(token)


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes folders below the shared one. Only tables that nothing will read again may go."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{p}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation. The reread table also has a known
    size, so that Spark itself decides from it whether a join may broadcast.
    """
    return stored(df, tag)[0]


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """As materialize; also the table's place, for discard()."""
    spark = df.sparkSession
    place = f"{_FOLDER.get()}/{tag}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{place}"
    df.write.parquet(path)
    _collect(spark)
    return spark.read.schema(df.schema).parquet(path), place


def _collect(spark: SparkSession) -> None:
    """Spark removes the shuffle files behind finished tables once the driver's garbage is collected; with a small heap that may be late."""
    gc.collect()
    spark.range(1).count()  # what the last job holds is let go by the next
    spark.sparkContext._jvm.System.gc()


def keys_of_partitions(n: int) -> np.ndarray:
    """An int for each of n partitions that repartition(n, column) deals to it, so that packed rows spread evenly.

    This is Spark's hash of an int (Murmur3, seed 42). If another number of partitions is used, the keys still serve, less evenly.
    """
    out, todo, first = np.full(n, -1, np.int64), n, 0
    rot = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    while todo:
        k = np.arange(first, first + 4 * n, dtype=np.uint32)
        h = rot(rot(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593) ^ np.uint32(42), 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        at = (h ^ h >> np.uint32(16)).view(np.int32).astype(np.int64) % n
        found, index = np.unique(at, return_index=True)
        fresh = out[found] < 0
        out[found[fresh]] = k[index[fresh]]
        todo, first = int((out < 0).sum()), first + 4 * n
    return out.astype(np.int32)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(text: Column, chars: str) -> Column:
    """text without any of the characters; byte searches, no regular expression."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
