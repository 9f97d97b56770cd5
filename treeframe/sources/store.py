"""Node tables that are read more than once: written to the shared folder, or to a bucketed table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset (tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="treeframe-")
        shared_dir.own = found
    return found


def stored(nodes: DataFrame) -> DataFrame:
    """nodes, read back from Parquet: documents are parsed once, and scans read only the columns and kinds they need."""
    path = f"{shared_dir(nodes.sparkSession).rstrip('/')}/treeframe/nodes-{uuid.uuid4().hex}"
    nodes.write.parquet(path)
    return nodes.sparkSession.read.schema(nodes.schema).parquet(path)


def save_bucketed(nodes: DataFrame, name: str, buckets: int) -> DataFrame:
    """A table bucketed by doc_id and sorted in document order. With spark.sql.requireAllClusterKeysForCoPartition=false its axis joins need no shuffle."""
    nodes.write.bucketBy(buckets, "doc_id").sortBy("doc_id", "pre").format("parquet").saveAsTable(name)
    return nodes.sparkSession.table(name)
