"""Operator 13: fill-in-middle transformation, cut at ranks that an indexable skip list finds.

A text's units (code points, or the matches of a pattern) are the nodes of a skip list. Every lane above the lowest holds about a quarter
of the nodes of the lane below; a node knows how many units and how many code points lie between it and the next node of its lane. A
descent adds up these widths: it goes on in a lane while the units do not exceed the rank, then one lane down, and ends at the
rank's unit with its place in code points. Two descents find both cuts. Which nodes rise is a hash of their number, so reruns agree.

A task holds a batch of texts and one list at a time: about 40 bytes for each unit of a pattern, 11 for each code point.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = "1"
#: Of a hundred texts that many stay plain, and of a hundred others that many have the suffix first.
PLAIN_PERCENT = 10
SUFFIX_FIRST_PERCENT = 20
#: Signs of prefix, suffix and middle. None may overlap itself or another, so that the first one found is the one written.
SIGNS = ("<P>", "<S>", "<M>")
#: One node in 2**RISE rises to the next lane.
RISE = 2
#: Lanes with fewer nodes carry no further lane.
TOP = 8


def _risen(power: int, lane: int) -> np.ndarray:
    """Numbers, below 2**power, of the nodes in a lane; 0 is in all of them. Those for usual texts are kept."""
    return (_kept if power <= 20 else _rise)(power, lane)


def _rise(power: int, lane: int) -> np.ndarray:
    below = np.arange(1 << power, dtype=np.uint64) if lane == 1 else _risen(power, lane - 1).astype(np.uint64)
    mixed = below * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    coin = mixed >> np.uint64(64 - RISE * lane)
    return below[(coin == 0) | (below == 0)].astype(np.int64)


_kept = lru_cache(maxsize=256)(_rise)


class SkipList:
    """Units in their order; widths: the code points of each. Lanes are (units, code points, place in the lane below) of their nodes."""

    def __init__(self, widths: np.ndarray):
        self.n = len(widths)
        self.lanes: list[tuple] = [(np.broadcast_to(np.int64(1), self.n), widths, None)]
        power, at = max(10, (max(1, self.n) - 1).bit_length()), None  # the numbers of the lane's nodes; None: all
        while len(self.lanes[-1][0]) > TOP:
            risen = _risen(power, len(self.lanes))
            nodes = risen[: np.searchsorted(risen, self.n)]
            down = nodes if at is None else np.searchsorted(at, nodes)
            units, points, _ = self.lanes[-1]
            if len(down) == len(units):
                break
            self.lanes.append((np.diff(nodes, append=self.n), np.add.reduceat(points, down), down))
            at = nodes

    def offset(self, rank: int) -> int:
        """Code points before the unit of that rank (0..n)."""
        left, points, node = rank, 0, 0
        for units, width, down in reversed(self.lanes):
            while node < len(units) and units[node] <= left:
                left -= int(units[node])
                points += int(width[node])
                node += 1
            if node == len(units):
                break
            if down is not None:
                node = int(down[node])
        return points


def unit_widths(text: str, unit: str | None) -> np.ndarray:
    """Code points of each unit: one each, or up to the end of each match of the pattern; what follows the last match is one more."""
    if unit is None:
        return np.broadcast_to(np.int64(1), len(text))
    ends = [m.end() for m in re.finditer(unit, text) if m.end() > m.start()]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return np.diff(np.array(ends, dtype=np.int64), prepend=0)


def cuts(unit: str | None = None):
    """A column function: text, h1, h2 → struct(n units, code points before the first and before the second cut)."""

    @F.pandas_udf("n long, first long, second long")
    def find(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, one, two in batches:
            out = np.zeros((len(texts), 3), dtype=np.int64)
            for k, (text, h1, h2) in enumerate(zip(texts, one, two, strict=True)):
                units = SkipList(unit_widths(text, unit))
                ranks = sorted((int(h1) % (units.n + 1), int(h2) % (units.n + 1)))
                out[k] = (units.n, units.offset(ranks[0]), units.offset(ranks[1]))
            yield pd.DataFrame(out, columns=["n", "first", "second"])

    return find


def fill_in_middle(df: DataFrame, seed: str = SEED, unit: str | None = None, plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
                   signs: tuple[str, str, str] = SIGNS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    psm: sign and prefix, sign and suffix, sign and middle; spm: the suffix before the prefix. A text that is null (as empty), empty or has
    one of the signs stays plain; others by a digest of seed and key, which also gives the cuts. Rows that repeat a key are cut by the
    same digest, each in its own text; a null key counts as empty. Texts of any length are cut whole, one at a time. An empty table
    gives an empty result; other columns are ignored."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), digest.alias("_digest"))
    rows = rows.select("_key", "_text", *[x.alias(f"_h{k + 1}") for k, x in enumerate(h)])
    rows = rows.select("*", cuts(unit)("_text", "_h1", "_h2").alias("_cut"))
    plain = (F.col("_text") == "") | (F.col("_h3") % 100 >= 100 - plain_percent)
    for sign in signs:
        plain |= F.contains(F.col("_text"), F.lit(sign))
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < suffix_first_percent, "spm").otherwise("psm")
    rows = rows.select("_key", "_text", F.col("_cut.n").alias("_n"), F.col("_cut.first").cast("int").alias("_first"), F.col("_cut.second").cast("int").alias("_second"), form.alias("_form"))
    first, second, middle = F.col("_first"), F.col("_second"), F.col("_second") - F.col("_first")
    p, s, m = map(F.lit, signs)
    prefix = F.concat(p, F.substring("_text", F.lit(1), first))
    suffix = F.concat(s, F.substring("_text", second + 1, F.char_length("_text")))
    middle_text = F.concat(m, F.substring("_text", first + 1, middle))
    output = (
        F.when(F.col("_form") == "psm", F.concat(prefix, suffix, middle_text))
        .when(F.col("_form") == "spm", F.concat(suffix, prefix, middle_text))
        .otherwise(F.col("_text"))
    )
    cut = F.col("_form") != "plain"
    return rows.select(
        F.col("_key").alias(key), F.col("_n").alias("n"), F.col("_form").alias("form"),
        F.when(cut, first.cast("long")).alias("prefix_chars"), F.when(cut, middle.cast("long")).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column, signs: tuple[str, str, str] = SIGNS) -> Column:
    """The text that an output of that form was made from: cut texts have each sign exactly once."""
    p, s, m = signs
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)

    def parts(one: str, two: str) -> tuple[Column, Column]:
        body = F.substring(head, F.lit(len(one) + 1), F.char_length(head))
        return F.substring_index(body, two, 1), F.substring_index(body, two, -1)

    prefix, suffix = parts(p, s)
    suffix_first, prefix_second = parts(s, p)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(prefix_second, middle, suffix_first))
        .otherwise(output)
    )
