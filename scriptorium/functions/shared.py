"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local master (as in tests) gets a temporary folder, and a cluster an error: its executors would
    write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders made since the last drop_temporary.
_MADE: list[str] = []


def temporary_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for what can go once a result is stored."""
    _MADE.append(shared_path(spark, name))
    return _MADE[-1]


def drop_temporary(spark: SparkSession) -> int:
    """Delete the folders of temporary_path that this Python process made; their number."""
    n = len(_MADE)
    for path in _MADE:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _MADE.clear()
    return n


def text_files(lines: DataFrame, name: str) -> str:
    """The path of a temporary folder with one column of strings as lines of text, compressed: a file is what one task writes, so it need not be split."""
    path = temporary_path(lines.sparkSession, name)
    lines.write.option("compression", "gzip").text(path)
    return path
