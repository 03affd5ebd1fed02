"""Text proposals: duplicates, confirmation, budgets, unclaimed words, second readings and recovered lines."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.geometry import box, intersection
from ..functions.grid import Grid
from ..functions.grouped import per_batch, per_group
from ..functions.text import word_key
from .localization import classify_blocks
from .merge import gathered, level, read_words
from .spatial import _REGION, _arrays, _over, coverages, page_items, word_pairs


def comparable(text: str) -> str:
    """Compatibility form, folded, letters and digits alone."""
    return "".join(c for c in unicodedata.normalize("NFKC", text or "").casefold() if c.isalnum())


def _says_nothing_new(new: tuple, known: tuple) -> bool:
    """Whether a proposal (x, y, w, h, key) repeats what is known: in the same place, as a part or with a part of its text where they
    touch, or as an inexact fragment of it."""
    wide, high = (min(new[k] + new[k + 2], known[k] + known[k + 2]) - max(new[k], known[k]) for k in (0, 1))
    common, least = max(0, wide) * max(0, high), min(new[2] * new[3], known[2] * known[3])
    if common / max(1, least) > 0.4:
        return True
    mine, theirs = new[4], known[4]
    if common > 0 and min(len(mine), len(theirs)) >= 3 and (mine in theirs or theirs in mine):
        return True
    if common > 0.08 * least and 4 <= len(mine) < 0.85 * len(theirs):
        found = difflib.SequenceMatcher(None, mine, theirs, autojunk=False).get_matching_blocks()
        return sum(m.size for m in found) >= 0.8 * len(mine)
    return False


def dedupe_proposals(proposals: DataFrame, regions: DataFrame) -> DataFrame:
    """proposals(page_id, ord, text, box), regions(page_id, text, box) → proposals that say something new, in order; the same word
    elsewhere on the page is new."""
    both = regions.select("page_id", F.lit(-1).cast("long").alias("ord"), "text", *"xywh").unionByName(proposals.select("page_id", "ord", "text", *"xywh"))

    def choose(rows: list[tuple]) -> list[tuple]:
        known, out, index = [], [], Grid(0)
        for r in rows:
            block = (*r[3:7], comparable(r[2]))
            if r[1] >= 0:
                if any(_says_nothing_new(block, k) for k in map(known.__getitem__, index.near(block[:4]))):  # all its rules ask for a common area
                    continue
                out.append(r)
            index.add(len(known), block[:4])
            known.append(block)
        return out

    return per_group(both, ["page_id"], ["ord", "x", "y", "text"], choose, both.schema)


def confirm_proposals(proposals: DataFrame, located: DataFrame, readings: DataFrame) -> DataFrame:
    """proposals(proposal_id, key, complete, box, plain), located(proposal_id, key, box), readings(proposal_id, key, plain) → proposal_ids with
    exactly one place whose words agree, confirmed by the reading. plain: the text in compatibility form without blanks, by which signs
    without letters (an empty key) are confirmed."""
    p, c = box(table="p"), box(table="c")
    size = lambda b: F.greatest(b.w, F.lit(0)) * F.greatest(b.h, F.lit(0))
    within = F.col("p.complete") & (F.length("p.key") >= 3) & F.contains("c.key", "p.key") & (F.length("c.key") <= F.greatest(F.lit(24), 3 * F.length("p.key"))) \
        & (size(c) <= 6 * size(p)) & (c.w <= 3 * p.w) & (c.h <= 3 * p.h)
    agree = proposals.alias("p").join(located.alias("c"), "proposal_id").filter((F.col("p.key") == F.col("c.key")) | within)
    one = agree.groupBy("proposal_id").agg(F.count("*").alias("n"), *[F.first(x).alias(y) for x, y in (("p.key", "wanted"), ("p.plain", "own"), ("c.key", "expected"))]).filter("n = 1")
    df = one.join(readings.alias("r"), "proposal_id").filter(F.col("r.plain") != "")
    return df.filter(F.when(F.col("wanted") != "", F.col("r.key") == F.col("expected")).otherwise(F.col("r.plain") == F.col("own"))).select("proposal_id")


def budget_candidates(candidates: DataFrame, tiles: DataFrame, total: int = 24) -> DataFrame:
    """candidates(page_id, tile, ord, text), tiles(page_id, tile): each tile of a page, with candidates or without, takes an even share of what is
    left of the budget, short words first; what a tile does not use goes to the later ones."""
    sizes = tiles.withColumn("at", F.row_number().over(Window.partitionBy("page_id").orderBy("tile"))).withColumn("tiles", F.count("*").over(Window.partitionBy("page_id")))
    df = candidates.select("page_id", "tile", "ord", "text").join(sizes.select("page_id", "tile", "at", "tiles"), ["page_id", "tile"])
    short_first = Window.partitionBy("page_id", "tile").orderBy(F.length("text"), "ord")
    df = df.withColumn("r", F.row_number().over(short_first)).filter(F.col("r") <= total)  # no tile takes more
    df = df.select("page_id", "tile", "ord", "text", "at", "tiles", "r")

    def choose(rows: Iterator[tuple]) -> Iterator[tuple]:
        left = total
        for (at, tiles), own in groupby(rows, key=lambda r: r[4:6]):
            share = left // (tiles - at + 1)
            for r in own:
                if r[6] <= share:
                    left -= 1
                    yield r[:4]

    return per_group(df, ["page_id"], ["at", "r"], choose, candidates.select("page_id", "tile", "ord", "text").schema)


def squeezed(c) -> F.Column:
    return F.regexp_replace(c, r"(.)\1+", "$1")


def unclaimed_words(words: DataFrame, regions: DataFrame, most: int = 64) -> DataFrame:
    """words(page_id, word_id, text, box, confidence, angle), regions(page_id, text, box, manual, edited, translation, kind, rotation): sure words of
    4 to 20 letters that no text of the page holds, not even misread by a letter, away from regions made or edited by hand, over a region that
    was laid out by rule (kind bubble or free) at another angle than the word's (degrees)."""
    key = word_key("text")
    w = words.filter(F.col("confidence") >= 0.98).withColumn("key", key).filter(F.col("key").rlike(r"^\p{L}{4,20}$"))
    known = regions.select("page_id", key.alias("whole")).distinct()
    free = w.alias("w").join(known.alias("k"), (F.col("w.page_id") == F.col("k.page_id")) & F.contains("k.whole", "w.key"), "left_anti")
    tokens = regions.select("page_id", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("token")).select("page_id", word_key("token").alias("token")).filter("token <> ''").distinct()
    within = F.contains("w.key", "t.token") & (F.length("t.token") >= 3) & (2 * F.length("t.token") >= F.length("w.key"))
    same = (squeezed(F.col("t.token")) == squeezed(F.col("w.key"))) | within | (F.levenshtein("t.token", "w.key") <= 1)
    free = free.alias("w").join(tokens.alias("t"), (F.col("w.page_id") == F.col("t.page_id")) & same, "left_anti")
    over = (F.col("w.page_id") == F.col("r.page_id")) & (intersection(box(table="w"), box(table="r")) > 0)
    by_hand = F.col("r.manual") | F.col("r.edited")
    free = free.alias("w").join(regions.alias("r"), over & by_hand, "left_anti")
    apart = F.abs(F.pmod(F.col("w.angle") - F.col("r.rotation") + 90, F.lit(180.0)) - 90) > 3
    owner = ~by_hand & (F.trim("r.translation") != "") & F.col("r.kind").isin("bubble", "free") & apart
    found = free.alias("w").join(regions.alias("r"), over & owner, "left_semi")
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("page_id").orderBy("word_id"))).filter(F.col("_r") <= most).select("page_id", "word_id", "key")


def verify_reads(reads: DataFrame, crops: DataFrame, alike: float = 0.6) -> DataFrame:
    """reads(page_id, region_id, text, confidence; a null text was not returned), crops(page_id, region_id, text): pages whose first or last filled
    text reads otherwise on its own, and regions to read again: all of such pages, those not returned, repeated texts, and empty ones of
    some confidence."""

    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        norm = lambda t: " ".join((t or "").split()).casefold()
        pairs = [(norm(x), norm(y)) for x, y in zip(a, b, strict=True)]
        return pd.Series([1.0 if x == y else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in pairs])

    likeness = F.pandas_udf(ratio, "double")
    ends = reads.filter(F.trim("text") != "").groupBy("page_id").agg(F.array_distinct(F.array(F.min("region_id"), F.max("region_id"))).alias("ids"))
    ends = ends.select("page_id", F.explode("ids").alias("region_id"))
    pairs = reads.join(ends, ["page_id", "region_id"]).join(crops.withColumnRenamed("text", "crop"), ["page_id", "region_id"], "left")
    off = pairs.withColumn("ok", likeness("text", "crop") >= alike).groupBy("page_id").agg((~F.bool_and("ok")).alias("reread"))
    n = F.count("*").over(Window.partitionBy("page_id", "text"))
    df = reads.withColumn("n", n).join(off, "page_id", "left")
    again = F.coalesce("reread", F.lit(False)) | F.col("text").isNull() | ((F.trim("text") != "") & (F.col("n") > 1)) | ((F.trim("text") == "") & (F.col("confidence") >= 0.5))
    return df.select("page_id", "region_id", again.alias("again"))


def recover_lines(words: DataFrame, regions: DataFrame, sounds: DataFrame | None = None, direction: str = "ltr") -> DataFrame:
    """words(page_id, word_id, text, box, confidence), regions(page_id, region_id, text, box): words that no region has, as lines of two or more, or
    alone if their text is that of a sound by itself (sounds: see classify_blocks): (page_id, text, n, box). A hyphenated single letter is
    put before the first such sound that it partly overlaps."""
    words = words.select("page_id", "word_id", "text", *"xywh", "confidence")
    return recover_items(page_items(words, regions, ("text",)), sounds, direction)


def recover_items(items: DataFrame, sounds: DataFrame | None = None, direction: str = "ltr") -> DataFrame:
    """As recover_lines, of a table of page_items with r_text."""
    df = classify_blocks(_loose_words(items), sounds).select("page_id", "word_id", "text", *"xywh", "usable", "scrap", (F.col("block_type") == "sfx").alias("sound"))

    def lines(rows: list[tuple]) -> list[tuple]:
        free: list[tuple] = []
        index = Grid()
        for b in rows:
            if b[7] and not any(b[2].casefold() == o[2].casefold() and _over(b[3:7], o[3:7]) > 0.8 for o in map(free.__getitem__, index.near(b[3:7]))):
                index.add(len(free), b[3:7])
                free.append(b)
        boxes, out, alone = [b[3:7] for b in free], [], []
        order = sorted(range(len(free)), key=lambda i: (boxes[i][1] + boxes[i][3] / 2, boxes[i][0]))
        for g in gathered(boxes, order, level, last_first=True) if len(free) > 1 else [order] * len(free):
            if len(g) > 1:
                order = read_words([boxes[i] for i in g], [None] * len(g), direction)
                out.append([" ".join(free[g[k]][2] for k in order), len(g), united([boxes[i] for i in g])])
            elif free[g[0]][9]:
                alone.append([free[g[0]][2], 1, boxes[g[0]]])
        sounds_at = Grid()
        for k, sound in enumerate(alone):
            sounds_at.add(k, sound[2])
        for b in rows if alone else ():
            if b[8]:
                for k in sorted(sounds_at.near(b[3:7])):
                    sound = alone[k]
                    x = sound[2]
                    if 0.2 < _over(b[3:7], x) < 0.8 and b[5] <= 1.5 * x[2] and b[6] <= 1.5 * x[3]:
                        sound[:] = [f"{b[2]} {sound[0]}", sound[1] + 1, united([x, b[3:7]])]
                        sounds_at.add(k, sound[2])
                        break
        return [(rows[0][0], text, n, *where) for text, n, where in out + alone]

    return per_group(df, ["page_id"], ["word_id"], lines, "page_id long, text string, n long, x long, y long, w long, h long")


def _loose_words(items: DataFrame) -> DataFrame:
    """The words whose center no region holds and that are a line's or a scrap of one. Of a line's no region has much, or some with the same text."""
    df = items.withColumn("is_word", F.col("is_word") & (F.col("confidence") >= 0.5)).filter("is_word OR r_x IS NOT NULL")  # less is of no use
    df = df.select("page_id", "is_word", "word_id", "text", *"xywh", "confidence", F.lower("text").alias("low"), *[f"r_{c}" for c in "xywh"], F.lower("r_text").alias("r_low"))
    kept = ["page_id", "word_id", "text", *"xywh", "confidence"]

    def choose(batch: pa.RecordBatch, page: np.ndarray) -> pa.RecordBatch:
        words = np.flatnonzero(np.asarray(batch.column("is_word").fill_null(False)))
        held, owned = np.zeros((2, batch.num_rows), bool)
        for w, _ in word_pairs(batch, page, words):
            held[w] = True
        words = words[~held[words]]
        for w, r in word_pairs(batch, page, words, inside=False):
            share = coverages(_arrays(batch, w), _arrays(batch, r, _REGION))
            some = share > 0.4
            w, r, share = w[some], r[some], share[some]
            same = pc.fill_null(pc.equal(batch.column("low").take(pa.array(w)), batch.column("r_low").take(pa.array(r))), False)
            owned[w[(share > 0.8) | np.asarray(same)]] = True
        found = batch.select(kept).take(pa.array(words))
        return pa.RecordBatch.from_arrays([*found.columns, pa.array(owned[words])], names=[*kept, "owned"])

    loose = per_batch(df, ["page_id"], [], choose, StructType([*(df.schema[c] for c in kept), StructField("owned", BooleanType())]))
    n = F.regexp_count("text", F.lit(r"\p{L}"))
    usable = (F.col("confidence") >= 0.55) & ~F.col("owned") & ~F.col("text").rlike("[@_]") & (n >= 2) & (2 * n >= F.length(F.trim("text")))
    scrap = F.contains("text", F.lit("-")) & (n == 1)
    return loose.withColumns({"usable": usable, "scrap": scrap, "in_bubble": F.lit(False)}).filter("usable OR scrap")


def united(boxes: list[tuple]) -> tuple:
    """The box around boxes (x, y, w, h)."""
    x, y = min(b[0] for b in boxes), min(b[1] for b in boxes)
    return x, y, max(b[0] + b[2] for b in boxes) - x, max(b[1] + b[3] for b in boxes) - y
