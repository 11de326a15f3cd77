"""Session settings and stored intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that may change on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A seller, product or order may hold a large share of all items. Splitting
    # its join partition must also happen where that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # What a task reads and a file of a stored table is made from, compressed as in a shuffle. Rows take up to seven
    # times as much when sorted, so that a task's share of the memory holds them.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "48m",
}

# Starting size of a shuffle partition, in bytes of the tables read.
SHUFFLE_BYTES = 512 * 1024**2
# The same where the fact is put together: a shuffle of items has about five times the bytes of their table.
JOIN_BYTES = 16 * 1024**2

_local_dirs: dict[str, str] = {}


def build_session(
    app_name: str = "marketlens", master: str | None = None, tables: str | None = None, **conf: str
) -> SparkSession:
    """Get or create a session with the settings above and any others given.

    ``tables`` is a folder of tables the session will read; its shuffles are sized for them.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    return size_for(spark, stored_bytes(spark, tables)) if tables else spark


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file or folder, on any file system."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop_path).getLength()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def size_for(spark: SparkSession, input_bytes: int, shuffle_bytes: int | None = None) -> SparkSession:
    """Start shuffles with enough partitions for tables of this size; adaptive execution joins small ones.

    To be called once, at the start of a session or job.
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(least, -(-input_bytes // (shuffle_bytes or SHUFFLE_BYTES)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="marketlens-")
    return _local_dirs[app]


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/marketlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    For frames that feed both a summary and the rows it is applied to: the
    inputs are scanned once, and a lost executor costs a re-read, not a re-run.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in staged:
        spark = df.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
