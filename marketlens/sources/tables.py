"""Parquet tables: writing, layout of the fact, registration as views."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH_KEY = "order_year_month"
CODEC = "zstd"  # of the large tables: written once and read often


def write_table(df: DataFrame, folder: str, name: str) -> str:
    """Replace ``<folder>/<name>.parquet``."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    df.write.mode("overwrite").parquet(path)
    return path


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    return {name: write_table(df, folder, name) for name, df in tables.items()}


def balanced(df: DataFrame) -> DataFrame:
    """Even out what each task will write: rows of a month meet in few files, a large month is split."""
    return df.hint("rebalance", F.col(MONTH_KEY))


def write_fact(df: DataFrame, path: str, *order: str) -> DataFrame:
    """Write a ``balanced`` table once for all queries and read it back.

    It has a folder per purchase month, which date filters prune. Rows are sorted by ``order`` in each
    file, so that a filter on it skips row groups.
    """
    sorted_ = df.sortWithinPartitions(MONTH_KEY, *order) if order else df
    sorted_.write.mode("overwrite").option("compression", CODEC).partitionBy(MONTH_KEY).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_months(df: DataFrame, path: str, months: Iterable[date], *order: str) -> DataFrame:
    """Write the rows of some months in place of what a table of ``write_fact`` has of them; other folders stay untouched.

    New files are moved in when all are written, so a write that fails leaves the table as it was. Months that have no
    rows any more lose their folder. Returns the rows of these months as stored.
    """
    spark, wanted = df.sparkSession, sorted(set(months))
    rows = df.where(F.col(MONTH_KEY).isin(*wanted))
    sorted_ = rows.sortWithinPartitions(MONTH_KEY, *order) if order else rows
    writer = sorted_.write.mode("overwrite").option("compression", CODEC)
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(MONTH_KEY).parquet(path)
    left = {row[0] for row in rows.select(MONTH_KEY).distinct().collect()}  # at most the months asked for
    for month in wanted:
        if month not in left:
            fs, folder = _files(spark, f"{path.rstrip('/')}/{MONTH_KEY}={month.isoformat()}")
            fs.delete(folder, True)
    return spark.read.schema(df.schema).parquet(path).where(F.col(MONTH_KEY).isin(*wanted))


def _files(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def table_names(spark: SparkSession, folder: str) -> list[str]:
    """Stems of the ``*.parquet`` files or folders in ``folder``, on any file system."""
    fs, pattern = _files(spark, f"{folder.rstrip('/')}/*.parquet")
    return sorted(status.getPath().getName().removesuffix(".parquet") for status in fs.globStatus(pattern) or [])


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder has finished and is still there."""
    fs, marker = _files(spark, f"{path.rstrip('/')}/_SUCCESS")
    return fs.exists(marker)


def register_views(spark: SparkSession, folder: str, names: Iterable[str] | None = None) -> list[str]:
    """Make every Parquet table in ``folder`` a view named by its stem."""
    found = sorted(names) if names is not None else table_names(spark, folder)
    for name in found:
        spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").createOrReplaceTempView(name)
    return found


def query(spark: SparkSession, sql: str) -> DataFrame:
    """SQL over the registered views; nothing runs until an action."""
    return spark.sql(sql)
