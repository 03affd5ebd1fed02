"""Shared pieces of the corpus operators: the shared folder, written tables and text columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Tables written since the last drop_written, with their folders.
_WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage ends there,
    so a lost executor costs no recomputation before this point. The table stays until drop_written."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    _WRITTEN.append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # this query's shuffle files serve no one once the table is written
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def track(path: str) -> str:
    """A folder that goes with the written tables."""
    _WRITTEN.append(path)
    return path


def drop_written(spark: SparkSession) -> int:
    """Delete the tables that the operators wrote in this Python process, for when the results of all of them are stored; their number."""
    n = len(_WRITTEN)
    for path in _WRITTEN:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.clear()
    return n


#: What this Python worker holds: its name, and the object.
_HELD: list = [None, None]


def held(name, make: Callable):
    """A large object of a worker (a tokenizer and its words, a model and its code lengths): made when it is first asked for, and let go when another one is
    asked for, so that a worker which serves several stages has one of them."""
    if _HELD[0] != name:
        _HELD[:] = [None, None]
        _HELD[:] = [name, make()]
    return _HELD[1]


def utf8(text: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")


def n_words(text: str = "text") -> Column:
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
