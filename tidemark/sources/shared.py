"""Tables written once and read again, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folders that this process has made, for ``clear``.
_made: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). A folder of our own only where none is set and all tasks run on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made[path] = None
    return path


def clear(spark: SparkSession) -> int:
    """Deletes the tables that this process has made in the shared folder, once their readers are done with them; returns how many there were."""
    n = 0
    for path in list(_made):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        n += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
        del _made[path]
    return n


@atexit.register
def _clear_at_exit() -> None:
    """What is left goes with the process, if its session is still there."""
    with contextlib.suppress(Exception):
        spark = SparkSession.getActiveSession() if _made else None
        if spark is not None:
            clear(spark)


def materialize(df: DataFrame, what: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    Unlike a cache this survives the loss of any executor, and unlike a checkpoint it is columnar,
    compressed, and lets later scans prune columns and partitions.
    """
    path = shared_path(df.sparkSession, what)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(path).select(*df.columns)
