"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
documents. Between stages the rows are written to the shared folder and read again, so a lost executor costs at most the
stage it was lost in. By then nothing reads the tables any more that the stage before made on its way: a stage begins by
removing those, and so its caller has to write a stage's rows before it calls the next.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treeframe.llm import mixing, packing, quality, repeats, simhash
from treeframe.llm.common import discard, scratch, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: By application: the folder of tables that the last stage has made on its way.
_LEFT: dict[str, str] = {}

#: A corpus that was cleaned of duplicates is mixed without repeating documents.
EPOCHS, BUDGET_PERCENT = 1, 90


def _stage(work: Stage) -> Stage:
    """The stage, after removing what the stage before has left."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        if app in _LEFT:
            discard(spark, _LEFT.pop(app))
        with scratch() as folder:
            out = work(spark, docs, sf_dir)
        _LEFT[app] = folder
        return out

    return run


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


@_stage
def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


@_stage
def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(docs)


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs, max_epochs=EPOCHS, budget_percent=BUDGET_PERCENT)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer=packing.default_tokenizer(), added=True)


STAGES = [
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("repeats", repeats_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't tokenize or follow the curve; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), ""
    for name, stage in STAGES[:-1]:
        docs, place = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            discard(spark, before)
        before = place
    return STAGES[-1][1](spark, docs, sf_dir)
