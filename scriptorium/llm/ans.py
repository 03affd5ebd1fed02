"""Operator 8: token ids in a binary format, coded by a static range asymmetric numeral system (rANS).

The file format is a table of blocks, written and read by Spark. Rows, in ascending order of (task, block):

    task long, block long     the part of the corpus, and the block's number in it
    first long, n long        ids of the part before the block, ids in the block
    crc long                  CRC-32 of the block's ids (little-endian unsigned 32-bit integers)
    states binary             final coder states of the block's lanes: the checkpoint from which decoding starts
    words binary              the coded stream, little-endian unsigned 32-bit words
    keys, numbers, starts, pieces, totals   arrays: for each document in the block its key, its number in the part, its ids
                              in earlier blocks, its ids here, and its ids in all

Each block stands alone: `LANES` interleaved coders (lane i has the ids i, i + LANES, ...) share the word stream, and numpy
takes one step for all lanes at once. All blocks share one frequency table, counted over the whole corpus and scaled
to 2**SCALE slots, which is a table of its own beside the blocks. A lost task is repeated for its own blocks alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .packing import ordered_texts, task_starts
from .tokens import chunk_tokenizer

BLOCK = 131072
LANES = 1024
SCALE = 20
END = 2
_LOW = np.uint64(1 << 31)  # least state


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE; what occurs has at least one slot."""
    total, slots = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), dtype=np.uint64)
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (slots / total))), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    off, k = slots - int(freq.sum()), 0
    while off:  # the largest take what rounding left over, or give what it took
        i = order[k % len(order)]
        step = off if off > 0 else max(off, -(int(freq[i]) // 2))
        freq[i] += step
        off -= step
        k += 1
    return freq.astype(np.uint64)


class Coder:
    """Encodes and decodes blocks under one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(states, words) of a block."""
        steps = -(-len(ids) // LANES)
        state, words = np.full(LANES, _LOW, dtype=np.uint64), []
        for k in range(steps - 1, -1, -1):
            s = ids[k * LANES : (k + 1) * LANES]
            x, f, c = state[: len(s)], self.freq[s], self.start[s]
            full = x >= f << np.uint64(63 - SCALE)
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[: len(s)] = (q << np.uint64(SCALE)) + (x - q * f) + c
        return state.astype("<u8").tobytes(), b"".join(w.tobytes() for w in reversed(words))

    def decode(self, states: bytes, words: bytes, n: int) -> np.ndarray:
        state, stream, at = np.frombuffer(states, dtype="<u8").copy(), np.frombuffer(words, dtype="<u4").astype(np.uint64), 0
        out = np.empty(n, dtype=np.uint32)
        for k in range(0, n, LANES):
            m = min(LANES, n - k)
            x = state[:m]
            slot = x & np.uint64((1 << SCALE) - 1)
            s = self.symbol[slot]
            out[k : k + m] = s
            x = self.freq[s] * (x >> np.uint64(SCALE)) + slot - self.start[s]
            need = np.flatnonzero(x < _LOW)
            x[need] = (x[need] << np.uint64(32)) | stream[at : at + len(need)]
            at += len(need)
            state[:m] = x
        return out


def _times(matrix: list[int], v: int) -> int:
    """A vector of 32 bits times a matrix over them."""
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= matrix[i]
        v, i = v >> 1, i + 1
    return out


@lru_cache(maxsize=64)
def _zeros(power: int) -> tuple[int, ...]:
    """What 2**power zero bits do to a CRC-32."""
    if power == 0:
        return (0xEDB88320, *[1 << i for i in range(31)])
    half = _zeros(power - 1)
    return tuple(_times(half, v) for v in half)


def crc32_combine(a: int, b: int, n: int) -> int:
    """CRC-32 of two byte strings one after the other, from theirs and the second one's length n."""
    power = 3
    while n:
        if n & 1:
            a = _times(_zeros(power), a)
        n, power = n >> 1, power + 1
    return a ^ b


_DOCS = ("numbers", "starts", "pieces", "totals")


def _blocks(tokenizer: str, kind: str, end: int, block: int):
    """Texts in order → blocks of raw ids with their documents, and last a row of the task's id counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, close = TaskContext.get().partitionId(), np.array([end], dtype="<u2").tobytes()
        held, held_n, first, number, name = [], 0, 0, 0, 0
        docs: list[tuple] = []
        counts = np.zeros(1 << 16, dtype=np.int64)
        key_type = None

        def made() -> pa.RecordBatch:
            raw = b"".join(held)
            counts[:] += np.bincount(np.frombuffer(raw, dtype="<u2"), minlength=1 << 16)
            columns = list(zip(*docs, strict=True))
            data = {"task": pa.array([task]), "block": pa.array([name]), "first": pa.array([first]), "n": pa.array([held_n]),
                    "raw": pa.array([raw], pa.binary()), "keys": pa.array([list(columns[0])], pa.list_(key_type))}
            data |= {c: pa.array([list(v)], pa.list_(pa.int64())) for c, v in zip(_DOCS, columns[1:], strict=True)}
            return pa.RecordBatch.from_pydict(data | {"counts": pa.nulls(1, pa.binary())})

        for b in batches:
            key_type = b.column(0).type
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                for key, ids in zip(part.column(0).to_pylist(), chunk_tokenizer(tokenizer, kind).encoded(part.column(1).to_pylist()), strict=True):
                    ids, at = ids + close, 0
                    total = len(ids) // 2
                    while at < total:
                        m = min(total - at, block - held_n)
                        held.append(ids[2 * at : 2 * (at + m)])
                        docs.append((key, number, at, m, total))
                        at, held_n = at + m, held_n + m
                        if held_n == block:
                            yield made()
                            first, name, held, held_n, docs = first + held_n, name + 1, [], 0, []
                    number += 1
        if held_n:
            yield made()
        if key_type is not None:
            data = {c: pa.nulls(1, pa.int64()) for c in ("task", "block", "first", "n")} | {"raw": pa.nulls(1, pa.binary()), "keys": pa.nulls(1, pa.list_(key_type))}
            data |= {c: pa.nulls(1, pa.list_(pa.int64())) for c in _DOCS}
            yield pa.RecordBatch.from_pydict(data | {"counts": pa.array([counts.astype("<i8").tobytes()], pa.binary())})

    return run


def _histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(1 << 16, dtype=np.int64)
    for b in batches:
        for raw in b["counts"]:
            total += np.frombuffer(raw, dtype="<i8")
    at = np.flatnonzero(total)
    yield pd.DataFrame({"id": at, "n": total[at]})


def _encoded(freq):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq.value)
        for b in batches:
            ids = [np.frombuffer(raw, dtype="<u2") for raw in b.column("raw").to_pylist()]
            coded = [coder.encode(x) for x in ids]
            data = {c: b.column(c) for c in ("task", "block", "first", "n", "keys", *_DOCS)}
            data |= {"crc": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                     "states": pa.array([s for s, _ in coded], pa.binary()), "words": pa.array([w for _, w in coded], pa.binary())}
            yield pa.RecordBatch.from_pydict(data)

    return run


def encode_documents(df: DataFrame, tokenizer: str, kind: str = "byte", end: int = END, block: int = BLOCK,
                     key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write the ids of all documents in ascending key order; gives the tables of blocks and of frequencies, as written."""
    spark = df.sparkSession
    keys = T.ArrayType(df.schema[key].dataType)
    base = T.StructType().add("task", "long").add("block", "long").add("first", "long").add("n", "long")
    docs = T.StructType([T.StructField("keys", keys), *[T.StructField(c, T.ArrayType(T.LongType())) for c in _DOCS]])
    raw = T.StructType([*base, T.StructField("raw", T.BinaryType()), *docs, T.StructField("counts", T.BinaryType())])
    blocks = written(ordered_texts(df, key, text).mapInArrow(_blocks(tokenizer, kind, end, block), raw), "ids")
    counts = blocks.filter(F.col("counts").isNotNull()).select("counts").mapInPandas(_histogram, "id long, n long")
    counts = counts.groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # as many rows as the vocabulary has ids, at most
    table = np.zeros(1 << 16, dtype=np.int64)
    table[counts["id"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
    freq = scaled(table)
    at = np.flatnonzero(freq)
    frequencies = spark.createDataFrame(pd.DataFrame({"id": at, "slots": freq[at].astype(np.int64)}), "id long, slots long")
    coded = T.StructType([*base, *docs, T.StructField("crc", T.LongType()), T.StructField("states", T.BinaryType()), T.StructField("words", T.BinaryType())])
    coded = blocks.filter(F.col("raw").isNotNull()).mapInArrow(_encoded(spark.sparkContext.broadcast(freq)), coded)
    return written(coded, "coded"), written(frequencies, "frequencies")


def _decoded(freq):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq.value)
        for b in batches:
            for i, row in enumerate(b.select(["n", "crc", "states", "words", "pieces"]).to_pylist()):
                ids = coder.decode(row["states"], row["words"], row["n"]).astype("<u4")
                if zlib.crc32(ids.tobytes()) != row["crc"]:
                    raise ValueError("a block's checksum differs")
                m = np.array(row["pieces"], dtype=np.int64)
                to = np.cumsum(m)
                crc = [zlib.crc32(ids[x - y : x].tobytes()) for x, y in zip(to, m, strict=True)]
                data = {c: pa.array(np.full(len(m), b.column(c)[i].as_py(), dtype=np.int64)) for c in ("task", "first")}
                data |= {"key": b.column("keys")[i].values} | {c: b.column(c)[i].values for c in _DOCS}
                yield pa.RecordBatch.from_pydict(data | {"at": pa.array(to - m), "crc": pa.array(crc, pa.int64())})

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of documents and positions → one row for each document, that of its first piece with the CRC-32 of all."""
    last = None
    for b in batches:
        done = []
        for row in b.to_pylist():
            if last and (row["task"], row["numbers"]) == (last["task"], last["numbers"]):
                last["crc"] = crc32_combine(last["crc"], row["crc"], 4 * row["pieces"])
            else:
                if last:
                    done.append(last)
                last = row
        schema = b.schema
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if last:
        yield pa.RecordBatch.from_pylist([last], schema)


def read_documents(blocks: DataFrame, frequencies: DataFrame, key: str = "doc_id") -> DataFrame:
    """From the tables alone, one row per document: key, start, n_tokens, ids_crc32. Every block is decoded and checked."""
    spark = blocks.sparkSession
    found = frequencies.toPandas()  # one row for each id of the vocabulary, at most
    freq = np.zeros(1 << 16, dtype=np.uint64)
    freq[found["id"].to_numpy(dtype=np.int64)] = found["slots"].to_numpy(dtype=np.uint64)
    schema = T.StructType().add("task", "long").add("first", "long").add("key", blocks.schema["keys"].dataType.elementType)
    for c in (*_DOCS, "at", "crc"):
        schema = schema.add(c, "long")
    pieces = written(blocks.mapInArrow(_decoded(spark.sparkContext.broadcast(freq)), schema), "pieces")
    whole = pieces.filter(F.col("pieces") == F.col("totals"))
    parts = pieces.filter(F.col("pieces") != F.col("totals")).repartition("task", "numbers").sortWithinPartitions("task", "numbers", "starts")
    parts = parts.mapInArrow(_joined, schema)
    starts = task_starts(blocks.select("task", "n"), "task", "n")
    docs = whole.unionByName(parts).join(F.broadcast(starts), "task")  # one row of two numbers for each part
    return docs.select(
        F.col("key").alias(key), (F.col("_base") + F.col("first") + F.col("at")).alias("start"),
        F.col("totals").alias("n_tokens"), F.col("crc").alias("ids_crc32"),
    )


def coded_round_trip(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write, read back, and give one row per document: key, start, n_tokens, ids_crc32.

    A null or empty text has the end id alone. Rows that repeat a key are documents of their own, next to each other (the
    null key first). An empty table gives an empty result; other columns are ignored."""
    return read_documents(*encode_documents(df, tokenizer, key=key, text=text), key=key)
