"""What the corpus operators share: staged tables and digests."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.session import new_table_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_noted: ContextVar[list[DataFrame] | None] = ContextVar("_noted", default=None)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A lost executor then costs a re-read. The shuffle files of the write are
    dropped as soon as it has ended, so that the rounds of an operator don't add
    up on disk; nothing reads them again.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    staged = spark.read.schema(df.schema).parquet(path)
    if (made := _noted.get()) is not None:
        made.append(staged)
    return staged


@contextmanager
def noted() -> Iterator[list[DataFrame]]:
    """Collects the tables that are staged inside, as the frame an operator returns may still read them."""
    token = _noted.set(made := [])
    try:
        yield made
    finally:
        _noted.reset(token)


def stored_row() -> Column:
    """What tells apart the rows of a table that ``read`` gave, also where ids repeat or are missing; the same in every scan."""
    return F.struct("_metadata.file_path", "_metadata.row_index")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def hex_sha256(column: Column) -> Column:
    """Lower-case hex digest of a string's UTF-8 bytes."""
    return F.sha2(column.cast("binary"), 256)


def folders(df: DataFrame) -> set[str]:
    """Of the files that ``df`` reads."""
    return {file.rsplit("/", 1)[0] for file in df.inputFiles()}


def release(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in folders(df):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that names an operator adds can't clash."""
    return F.struct(*[F.col(f"`{name}`") for name in df.columns])


def unpacked(df: DataFrame, row: str, columns: list[str], *added: str) -> DataFrame:
    """Undo ``packed``; an added column takes the place of an input column of its name."""
    taken = {name.lower() for name in added}
    kept = [F.col(row).getField(name).alias(name) for name in columns if name.lower() not in taken]
    return df.select(*kept, *added)
