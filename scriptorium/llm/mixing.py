"""Operator 10: mixing sources to target weights by capped water-filling.

Targets: every source gets level * weight, clamped at `epochs` times its size; the level is the one at which the
targets add up to the whole. It is found from the sources in ascending order of cap / weight, by running sums.
Taking: a target of r epochs takes every row floor(r) times, and the rest from a seeded order of the source's rows:
whole rows while the running sum of words stays within the rest, and at the border a part of one row.

The running sum in seeded order has two passes: sums by (source, digest range), whose prefix sums are a small table,
then a running sum inside each range. A source that holds a third of all rows is thus 4096 groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, n_words

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
EPOCHS = 3


def _source_key(source: str) -> Column:
    """'=' + source; null is the empty string, so that it equals itself in joins."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def water_fill(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes(_s, source_size), one row per source → with target (double). Sources by code point, null last.

    One task orders the sources (not the rows): one row for each source reaches it."""
    by_name = Window.orderBy((F.col("_s") == "").cast("int"), "_s")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * epochs)
    df = df.withColumn("_ratio", F.col("_cap").cast("double") / F.col("_w"))
    order = Window.orderBy("_ratio", (F.col("_s") == "").cast("int"), "_s")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    df = df.withColumn("_level", left.cast("double") / F.sum("_w").over(after))
    # Levels rise up to the first source below its cap and fall from there on: that source's level holds for the rest.
    level = F.max(F.when(F.col("_level") < F.col("_ratio"), F.col("_level"))).over(everything)
    first = F.min(F.when(F.col("_level") < F.col("_ratio"), F.col("_ratio"))).over(everything)
    target = F.when(F.col("_ratio") >= first, F.least(F.col("_cap").cast("double"), level * F.col("_w")))
    return df.select("_s", "source_size", F.coalesce(target, F.col("_cap").cast("double")).alias("target"))


def _planned(rows: DataFrame, seed: str, weights: Sequence[int], epochs: int) -> DataFrame:
    """rows(_key, _text, _source, more) with _size, source_size, target, _whole (repetitions of all of a source's rows)
    and _part (words of one repetition more). The scan for the ranges' sums reads no other column."""
    digest = F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col("_key").cast("string"), F.lit(""))))
    rows = rows.withColumns({"_h": digest, "_s": _source_key("_source"), "_size": n_words("_text")})
    rows = rows.withColumn("_range", F.substring("_h", 1, 3))
    ranges = rows.groupBy("_s", "_range").agg(F.sum("_size").alias("_sum"))
    targets = water_fill(ranges.groupBy("_s").agg(F.sum("_sum").alias("source_size")), weights, epochs)
    before = Window.partitionBy("_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum").join(targets, "_s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - F.col("_whole") * F.col("source_size") + F.lit(0.5)).cast("long")
    ranges = ranges.withColumn("_whole", whole).withColumn("_rest", rest)
    name = F.xxhash64("_text")  # rows that repeat a key and its size: by their texts, so that reruns cut the same one
    order = Window.partitionBy("_s", "_range").orderBy("_h", "_key", "_size", name).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_size").over(order), F.lit(0))).join(ranges, ["_s", "_range"])
    part = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_before") - F.col("_in")))
    return rows.withColumn("_part", part.cast("long"))


def mix(df: DataFrame, seed: str = "mix", weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS,
        key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per input row: key, size, source_size, target, taken (words, repeats counted).

    Null text: size 0, taken 0. A null source is a source of its own, ordered last. Rows that repeat a key follow each
    other in the seeded order, the smaller first, and of one size by a hash of their texts. A source's taken words are its target, rounded; no row is taken more
    than `epochs` times its size. An empty table gives an empty result; other columns are ignored."""
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(source).alias("_source"))
    taken = (F.col("_whole") * F.col("_size") + F.col("_part")).alias("taken")
    return _planned(rows, seed, weights, epochs).select(
        F.col("_key").alias(key), F.col("_size").alias("size"), "source_size", "target", taken
    )


def mixed_documents(df: DataFrame, seed: str = "mix", weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS,
                    key: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """The mix itself, with the columns of df (of any names): a row for each repetition taken. The border row's last
    repetition has the first words it gives, up to the end of the last of them, and n_chars (if there is such a column)
    counts its characters. Rows without words are repeated as often as their source as a whole. Null sources, repeated keys and empty
    tables are as in mix."""
    columns = df.columns
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
        F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(source).alias("_source"),
    )
    done = _planned(rows, seed, weights, epochs)
    copies = F.concat(
        F.array_repeat(F.col("_size"), F.col("_whole").cast("int")),
        F.when(F.col("_part") > 0, F.array("_part")).otherwise(F.array().cast("array<bigint>")),
    )
    done = done.withColumn("_words", F.explode(copies))
    pieces = F.regexp_extract_all(F.col("_text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("_words").cast("int")), "")
    partly = F.col("_words") < F.col("_size")
    done = done.withColumn("_text", F.when(partly, cut).otherwise(F.col("_text")))
    own = {text: F.col("_text")}
    if n_chars in columns:
        own[n_chars] = F.when(partly, F.char_length("_text")).otherwise(F.col(f"_row.`{n_chars}`"))
    return done.select(*[own.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns])
