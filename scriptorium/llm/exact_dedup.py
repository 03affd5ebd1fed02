"""Operator 7: exact deduplication by deterministic block naming.

A text's UTF-8 bytes are cut into fixed-size blocks. All blocks are sorted, and equal blocks get one integer name: their
rank. Then adjacent names are paired, the pairs sorted and named likewise, until each text has one name. Two texts are
equal if and only if block count and name agree: names come from comparing contents, so nothing can collide.

Sorting is a range exchange over (short form of the block, row), so that a block which a third of all rows share spreads over many tasks.
Each task ranks its own run; a task whose first block equals the last one before it continues that rank. The
prefix sums over tasks have one row per task. Texts cross the network once, whatever the number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import utf8, written

BLOCK_BYTES = 16384


def _rank_runs(keys: list[str], carried: list[str]):
    """Ranks within a task's sorted run; at its end one further row with the run's first and last key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rank, first, last, fields = TaskContext.get().partitionId(), -1, None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            key = [b.column(b.schema.get_field_index(k)) for k in keys]
            now = [k[0] for k in key]
            new = np.zeros(b.num_rows, dtype=bool)
            new[0] = last is None or any(not x.equals(y) for x, y in zip(now, last, strict=True))
            for k in key:
                new[1:] |= pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
            ranks = rank + np.cumsum(new)
            rank, last, first = int(ranks[-1]), [k[-1] for k in key], first or now
            data = {c: b.column(b.schema.get_field_index(c)) for c in carried}
            fields = {c: v.type for c, v in data.items()}
            data |= {"_task": pa.array(np.full(b.num_rows, task, dtype=np.int64)), "_rank": pa.array(ranks.astype(np.int64))}
            for k, v in zip(keys, key, strict=True):
                data |= {f"_first_{k}": pa.nulls(b.num_rows, v.type), f"_last_{k}": pa.nulls(b.num_rows, v.type)}
            yield pa.RecordBatch.from_pydict(data)
        if last is not None:
            data = {c: pa.nulls(1, t) for c, t in fields.items()} | {"_task": pa.array([task], pa.int64()), "_rank": pa.array([rank], pa.int64())}
            for k, x, y in zip(keys, first, last, strict=True):
                data |= {f"_first_{k}": pa.array([x.as_py()], x.type), f"_last_{k}": pa.array([y.as_py()], y.type)}
            yield pa.RecordBatch.from_pydict(data)

    return run


def name_by_sorting(df: DataFrame, keys: list[str], tie: str, carried: list[str], label: str, short: list[Column] | None = None) -> DataFrame:
    """`carried` columns of df plus _name: the rank of the row's keys (not null) among all distinct keys. short: what to sort by
    first, if the keys are long: the exchange samples these columns instead, and a sample reaches the driver."""
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in carried]).add("_task", "long").add("_rank", "long")
    for k in keys:
        schema = schema.add(f"_first_{k}", df.schema[k].dataType).add(f"_last_{k}", df.schema[k].dataType)
    run = df.select(*keys, tie, *[c for c in carried if c not in (*keys, tie)], *[c.alias(f"_s{i}") for i, c in enumerate(short or [])])
    by = [f"_s{i}" for i in range(len(short or []))]
    run = run.repartitionByRange(*(by or keys), tie).sortWithinPartitions(*by, *keys, tie).drop(*by)
    run = written(run.mapInArrow(_rank_runs(keys, carried), schema), label)
    ends = run.filter(F.col(f"_first_{keys[0]}").isNotNull())
    by_task = Window.orderBy("_task")  # one row for each task that had rows
    same = F.lit(True)
    for k in keys:
        same &= F.coalesce(F.lag(f"_last_{k}").over(by_task) == F.col(f"_first_{k}"), F.lit(False))
    ends = ends.select("_task", (F.col("_rank") + F.when(same, 0).otherwise(1)).alias("_n"), same.alias("_same"))
    before = F.coalesce(F.sum("_n").over(by_task.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ends.select("_task", (before - F.when(F.col("_same"), 1).otherwise(0)).alias("_start"))
    rows = run.filter(F.col(f"_first_{keys[0]}").isNull())
    # One row of two numbers for each task of the sort: bounded by the number of partitions.
    return rows.join(F.broadcast(starts), "_task").select(*carried, (F.col("_start") + F.col("_rank")).alias("_name"))


def text_identities(df: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of df: _rid, key, text_sha256, _n (blocks), _name. Equal texts agree in _n and _name; null is empty."""
    rows = df.select(F.monotonically_increasing_id().alias("_rid"), F.col(key).alias("_key"), utf8(text).alias("_bytes"))
    rows = rows.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.length("_bytes") / F.lit(block_bytes))).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
    first = F.col("_i") == 0
    rows = rows.select(
        "_rid", "_i", "_n",
        F.when(first, F.col("_key")).alias("_key"),
        F.when(first, F.unhex(F.sha2("_bytes", 256))).alias("_sha"),
        F.substring(F.col("_bytes"), F.col("_i") * block_bytes + 1, F.lit(block_bytes)).alias("_block"),
    )
    # Equal blocks have equal short forms, so they stay together; their names come from the blocks themselves.
    short = [F.substring("_block", 1, 16), F.xxhash64("_block"), F.xxhash64("_block", F.lit(1))]
    named = name_by_sorting(rows, ["_block"], "_rid", ["_rid", "_i", "_n", "_key", "_sha"], "blocks", short)
    heads = named.filter(F.col("_i") == 0)
    longest = heads.agg(F.max("_n")).first()[0] or 1
    done, level, left = [heads.filter(F.col("_n") == 1).select("_rid", "_name")], named.filter(F.col("_n") > 1), longest
    level = level.select("_rid", "_i", "_name", F.col("_n").alias("_left"))
    while left > 1:  # the number of blocks halves: a text of b bytes takes log2(b / block_bytes) rounds
        pair = level.groupBy("_rid", F.expr("_i div 2").cast("int").alias("_i"), F.ceil(F.col("_left") / 2).cast("int").alias("_left")).agg(
            F.max(F.when(F.col("_i") % 2 == 0, F.col("_name"))).alias("_a"),
            F.coalesce(F.max(F.when(F.col("_i") % 2 == 1, F.col("_name"))), F.lit(-1)).alias("_b"),
        )
        level = name_by_sorting(pair, ["_a", "_b"], "_rid", ["_rid", "_i", "_left"], "pairs")
        done.append(level.filter(F.col("_left") == 1).select("_rid", "_name"))
        level = level.filter(F.col("_left") > 1)
        left = (left + 1) // 2
    names = done[0]
    for more in done[1:]:
        names = names.unionByName(more)
    heads = heads.select("_rid", F.col("_key").alias(key), F.lower(F.hex("_sha")).alias("text_sha256"), "_n")
    return heads.join(names, "_rid")


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical byte for byte; null counts as empty. The row with the largest key stays (a null key is
    smallest); of rows that also repeat the key, the last in input order. An empty table gives an empty result; other
    columns are ignored."""
    rows = text_identities(df, key, text, block_bytes)
    groups = rows.groupBy("_n", "_name").agg(
        F.max(F.struct(F.col(key).alias("id"), F.col("_rid").alias("rid"))).alias("_keep"), F.count("*").alias("group_size")
    )
    groups = written(groups, "groups")  # so that both sides of the join are plain exchanges, which Spark can split at a hot group
    return rows.join(groups, ["_n", "_name"]).select(
        key, F.col("_keep.id").alias("keep_id"), "group_size", (F.col("_rid") == F.col("_keep.rid")).alias("kept"), "text_sha256"
    )


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that exact_dedup keeps, with the columns of df (of any names).

    One row stays of each distinct text, null and empty texts being one: that with the largest key, a null key only where there is no
    other. Of rows that repeat text and key, any one stays, with its other columns. An empty table stays empty."""
    kept = exact_dedup(df, key, text).filter("kept").select(F.struct(F.col(key).alias("_key")).alias("_id"), F.col("text_sha256").alias("_text"))
    # In a struct a null key equals itself, and the window below finds the rows where the join has dealt them.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.struct(F.col(key).alias("_key")).alias("_id"), F.sha2(utf8(text), 256).alias("_text"))
    rows = rows.join(kept, ["_id", "_text"], "left_semi")
    one = Window.partitionBy("_id", "_text").orderBy(F.lit(0))  # repeated rows only; nearly every group is one row
    return rows.withColumn("_r", F.row_number().over(one)).filter("_r = 1").select("_row.*")
