"""Operator 4: weighted rendezvous hashing of stable record keys over shards.

Each (key, shard) pair gets a number u in (0, 1] from an MD5 digest; the shard with the least
-ln(u) / weight takes the record. Nothing but the key and the shard list decides, so a further shard
takes records only into itself, and takes its share of the total weight. The work per row is one
expression of built-in functions; the only shuffle carries (key, size, checksum) without texts, and deals
each shard's rows over `SUBS` sub-ranges so that no shard is one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Two hexadecimal digits of the key's digest part each shard in 256 ranges for numbering.
SUBS = 256


def _score(key: Column, shard: Column, weight: Column) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit("/"), shard.cast("string"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(1)).cast("double") / F.lit(float(1 << 52))
    return -F.log(u) / weight


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Array of (score, shard) of a string key, one for each shard; its array_min is the choice."""
    shards = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    return F.transform(shards, lambda x: F.struct(_score(key, x["s"], x["w"]).alias("score"), x["s"].alias("shard")))


def assign_shards(
    df: DataFrame, weights: Sequence[float], grown_weight: float = 1.0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    - size: UTF-8 bytes plus 16; a null text has none. A null key counts as the empty key.
    - slot: gapless number from 0 in its shard, in the order of (MD5 of key, key, size, text_crc32); rows equal
      in all of these are interchangeable. Rows that repeat a key go to one shard, each with its own slot.
    - grown_shard: the choice with one shard more. An empty table gives an empty result; other columns are ignored.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    n = len(weights)

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    extra = F.struct(_score(F.col("_key"), F.lit(n), F.lit(float(grown_weight))).alias("score"), F.lit(n).alias("shard"))
    rows = df.select(F.col(key), name.alias("_key"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("_best", F.array_min(rendezvous(F.col("_key"), weights))).withColumn("_h", F.md5(F.col("_key").cast("binary")))
    sub = F.conv(F.substring("_h", 1, 2), 16, 10).cast("int").alias("_sub")
    # Placed once and written, without texts: the sums and the slots read the same rows.
    rows = written(rows.select(key, "size", "text_crc32", F.col("_best.shard").alias("shard"), F.least(F.col("_best"), extra)["shard"].alias("grown_shard"), "_h", sub), "shards")
    sums = rows.groupBy("shard", "_sub").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("shard", "_sub").orderBy("_h", key, "size", "text_crc32")
    return (
        rows.withColumn("_r", F.row_number().over(order))
        .join(starts, ["shard", "_sub"])
        .select(
            key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("_start") + F.col("_r") - 1).cast("long").alias("slot"), "grown_shard",
        )
    )
