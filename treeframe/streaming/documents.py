"""Documents from streams: whole ones, and ones that arrive in chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from treeframe.sources import shred


def read_files(spark: SparkSession, path: str, *, html: bool = False) -> DataFrame:
    """A streaming node table of the files that arrive in a folder; doc_id is the file's path. Parsing keeps no state between batches."""
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    docs = files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    return shred.read_html(docs, text="text") if html else shred.read_xml(docs, text="text", mode="permissive")


def assemble_chunks(chunks: DataFrame) -> DataFrame:
    """chunks (streaming): doc_id string, seq bigint, chunk string, last boolean. Whole documents: doc_id, text.

    Chunks may come in any order and over any number of batches; a document is given out when all up to its last are
    there, and its state goes. Until then the state holds what came, so a document must fit in memory.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get[:2], strict=True)) if state.exists else {}
        end = state.get[2] if state.exists else -1
        for f in frames:
            for seq, chunk, last in zip(f["seq"], f["chunk"], f["last"], strict=True):
                held[int(seq)] = chunk or ""
                end = int(seq) if last else end
        if end >= 0 and all(i in held for i in range(end + 1)):
            if state.exists:
                state.remove()
            yield pd.DataFrame({"doc_id": [key[0]], "text": ["".join(held[i] for i in range(end + 1))]})
        else:
            state.update((list(held), list(held.values()), end))

    return chunks.groupBy("doc_id").applyInPandasWithState(step, "doc_id string, text string", "seqs array<bigint>, chunks array<string>, last bigint", "append", GroupStateTimeout.NoTimeout)


def read_chunks(chunks: DataFrame, **options) -> DataFrame:
    """The streaming node table of documents that arrive in chunks."""
    return shred.read_xml(assemble_chunks(chunks), text="text", **options)


