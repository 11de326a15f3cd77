"""The corpus pipeline: toxic documents and near copies go, leaked benchmark passages too, and what stays is
mixed and sharded.

    spark-submit corpus_pipeline.py <folder of tables> <folder of shards>
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from functools import wraps
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession

from marketlens.llm.common import folders, noted, read, release, stage
from marketlens.llm.decontaminate import decontaminate
from marketlens.llm.mixing import mixed_documents
from marketlens.llm.sharding import assign
from marketlens.llm.simhash import drop_near_copies
from marketlens.llm.toxicity import drop_toxic


Step = Callable[[SparkSession, DataFrame, str], DataFrame]
# By run, tables that its stages have staged and the results of these may still read: number of the stage, when it returned, table.
_left: dict[tuple, list[tuple[int, float, DataFrame]]] = {}


def _written(spark: SparkSession, docs: DataFrame) -> float:
    """When the stored table ``docs`` was written, in seconds; 0 for a frame that is none."""
    newest = 0.0
    for folder in folders(docs):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        newest = max(newest, status.getModificationTime() / 1000)
    return newest


def _stage_of(step: Step) -> Step:
    """What a stage has staged, a copy of its rows among it, goes when the next stage begins.

    It does so only if the documents of the next stage were written after the earlier stage had returned and don't read it:
    then its result has been stored. What the last stage left stays, as nothing tells when its result is written.
    """

    @wraps(step)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        place = [name for name, _ in STAGES].index(step.__name__)
        key = (spark.sparkContext.applicationId, get_ident(), sf_dir)
        earlier = [left for left in _left.pop(key, []) if left[0] < place]  # others are of another run
        written, read_by_docs = _written(spark, docs) if earlier else 0.0, folders(docs) if earlier else set()
        done = [left for left in earlier if left[1] < written and not folders(left[2]) & read_by_docs]
        release(*[table for _, _, table in done])
        with noted() as made:
            result = step(spark, docs, sf_dir)
        kept = [left for left in earlier if not any(left is x for x in done)]
        _left[key] = kept + [(place, time.time(), table) for table in made]
        return result

    return run_stage


@_stage_of
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under a half."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


@_stage_of
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints that differ in at most two bits."""
    return drop_near_copies(docs)


@_stage_of
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


@_stage_of
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


@_stage_of
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and place in it."""
    return assign(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# No SQL: decoding, classifier, fingerprints and components can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs, staged = read(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if staged is not None:
            release(staged)  # nothing reads it any more
        staged = docs
    return STAGES[-1][1](spark, docs, sf_dir)


if __name__ == "__main__":
    session = SparkSession.builder.appName("corpus-pipeline").getOrCreate()
    run(session, sys.argv[1]).write.partitionBy("shard").parquet(sys.argv[2])
