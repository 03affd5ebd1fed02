"""Operator 6: packing by concatenation and cutting.

First pass: a range exchange puts the documents in the order of their ids (and of a text hash among equal ids); each task
turns its texts into ids once and keeps, with each document, the number of ids before it in the task. Totals by
task, one row each, are summed up to give every task its global offset. Second pass: each document's ids are cut where the
global position is a multiple of the sequence length. A document that crosses such a border gives a piece on either side.
Only the last sequence has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .tokens import chunk_tokenizer

SEQUENCE = 2048
END = 1


def ordered_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, _text) in ascending order of the key over and within partitions; a null text is empty."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).alias("_key"), body.alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    return rows.repartitionByRange("_key", "_tie").sortWithinPartitions("_key", "_tie").select("_key", "_text")


def task_starts(sizes: DataFrame, task: str, n: str) -> DataFrame:
    """(task, _base): prefix sums of n over tasks, whose number is that of the partitions."""
    totals = sizes.groupBy(task).agg(F.sum(n).alias("_total"))
    before = Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(task, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))


def _tokenized(path: str, kind: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, close = TaskContext.get().partitionId(), 0, np.array([end], dtype="<u2").tobytes()
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                ids = [x + close for x in chunk_tokenizer(path, kind).encoded(part.column(1).to_pylist())]
                n = np.array([len(x) // 2 for x in ids], dtype=np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(len(n), task, dtype=np.int64)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                    names=["_key", "_task", "_start", "_n", "_ids"],
                )

    return run


def _pieces(sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, start, length, crc, total, seq, offset = [], [], [], [], [], [], []
            rows = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            for i, (base, raw) in enumerate(rows):
                ids = np.frombuffer(raw, dtype="<u2").astype("<u4")
                at = 0
                while at < len(ids):
                    n = min(len(ids) - at, sequence - (base + at) % sequence)
                    which.append(i), start.append(at), length.append(n), total.append(len(ids))
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                    seq.append((base + at) // sequence), offset.append((base + at) % sequence)
                    at += n
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total, seq, offset)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), *numbers],
                                             names=["_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(df: DataFrame, tokenizer: str, kind: str = "word", sequence: int = SEQUENCE, end: int = END,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text has the end id alone. Rows that repeat a key are documents of their own, next to each other (the
    null key first). An empty table gives an empty result; other columns are ignored."""
    kept = [T.StructField("_key", df.schema[key].dataType)]
    numbers = [T.StructField(c, T.LongType()) for c in ("_task", "_start", "_n")]
    docs = ordered_texts(df, key, text).mapInArrow(_tokenized(tokenizer, kind, end), T.StructType([*kept, *numbers, T.StructField("_ids", T.BinaryType())]))
    docs = written(docs, "packing")
    # one row of two numbers for each task of the first pass: bounded by the number of partitions
    based = docs.join(F.broadcast(task_starts(docs, "_task", "_n")), "_task")
    out = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    pieces = based.select("_key", (F.col("_base") + F.col("_start")).alias("_at"), "_ids").mapInArrow(_pieces(sequence), T.StructType([*kept, *out]))
    return pieces.withColumnRenamed("_key", key)
