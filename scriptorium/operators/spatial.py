"""Joins and windows over boxes. Every theta join has the page as its equality, so pages are dealt out and pairs are made within
a page alone; a page has tens of boxes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.geometry import area, box, center_within, contains, coverage, intersection
from ..functions.grid import Grid, near_pairs
from ..functions.grouped import per_batch, per_group, starts


def assign_to_bubbles(texts: DataFrame, bubbles: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """texts(page_id, det_id, x, y, w, h, confidence), bubbles(page_id, bubble_id, x, y, w, h) → (one dialogue region for each
    bubble that holds texts, texts of no bubble). The best bubble has the most coverage, and one more if it holds the center;
    ties go to the lowest bubble."""
    t, b = box(table="t"), box(table="b")
    inside = center_within(t, b)
    score = coverage(t, b) + inside.cast("int")
    pairs = texts.alias("t").join(bubbles.alias("b"), (F.col("t.page_id") == F.col("b.page_id")) & (inside | (coverage(t, b) >= least)))
    best = pairs.groupBy("t.page_id", "t.det_id").agg(F.max(F.struct(score.alias("score"), (-F.col("b.bubble_id")).alias("id"))).alias("m"))
    owned = best.select("page_id", "det_id", (-F.col("m.id")).alias("bubble_id"))
    c = box()
    regions = texts.join(owned, ["page_id", "det_id"]).groupBy("page_id", "bubble_id").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(c.right).alias("right"), F.max(c.bottom).alias("bottom"),
        F.max("confidence").alias("confidence"), F.count("*").alias("n"),
    )
    regions = regions.select("page_id", "bubble_id", "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("bottom") - F.col("y")).alias("h"),
                             "confidence", "n", F.lit("dialogue").alias("block_type"))
    return regions, texts.join(owned, ["page_id", "det_id"], "left_anti")


def page_items(words: DataFrame, regions: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Words and regions in one table, for folds over pages: page_id, is_word, the words' columns, and the regions' region_id, box and others named as
    r_<name>. Where words are rows of the regions' table, one row may be both, and the table is dealt once."""
    own = regions.select("page_id", F.lit(False).alias("is_word"), *[F.col(c).alias(f"r_{c}") for c in ("region_id", *"xywh", *also)])
    return words.withColumn("is_word", F.lit(True)).unionByName(own, allowMissingColumns=True)


def assign_words(words: DataFrame, regions: DataFrame) -> DataFrame:
    """words(page_id, word_id, box) with the region_id of the smallest region (by area, then id) that holds their center, or null."""
    return assign_items(page_items(words, regions))


def assign_items(items: DataFrame) -> DataFrame:
    """As assign_words, of a table of page_items."""
    kept = [c for c in items.columns if c != "is_word" and not c.startswith("r_")]

    def choose(batch: pa.RecordBatch, page: np.ndarray) -> pa.RecordBatch:
        words = np.flatnonzero(np.asarray(batch.column("is_word").fill_null(False)))
        best = np.full(batch.num_rows, -1)
        for w, r in word_pairs(batch, page, words):
            # Rows of a page are in order of their regions' ids.
            size = _area(*_arrays(batch, r, ("r_w", "r_h")))
            order = np.lexsort((r, size, w))
            w, r = w[order], r[order]
            first = np.flatnonzero(np.diff(w, prepend=-1))
            best[w[first]] = r[first]
        best = best[words]
        region = batch.column("r_region_id").take(pa.array(best, mask=best < 0))
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(words)) for c in kept), region], names=[*kept, "region_id"])

    schema = StructType([*(items.schema[c] for c in kept), StructField("region_id", items.schema["r_region_id"].dataType)])
    return per_batch(items, ["page_id"], ["r_region_id"], choose, schema)


def word_pairs(batch: pa.RecordBatch, page: np.ndarray, words: np.ndarray, inside: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (word, region) of a batch of page_items where the region holds the word's center; or else all of one page that may touch. All pairs of a
    word are in one part."""
    paged = np.asarray(batch.column("page_id").is_valid())
    a, b = np.intersect1d(words, _boxed(batch)), _boxed(batch, _REGION)
    a, b = a[paged[a]], b[paged[b]]
    x, y, w, h = _arrays(batch, a)
    rx, ry, rw, rh = boxes = _arrays(batch, b, _REGION)
    none = np.zeros(len(a))
    cx, cy = x + w / 2, y + h / 2
    for i, k in near_pairs(page[a], (cx, cy, none, none) if inside else (x, y, w, h), page[b], boxes):
        if inside:
            fits = (cx[i] >= rx[k]) & (cx[i] <= rx[k] + rw[k]) & (cy[i] >= ry[k]) & (cy[i] <= ry[k] + rh[k])
            i, k = i[fits], k[fits]
        yield a[i], b[k]


_REGION = ("r_x", "r_y", "r_w", "r_h")


def coverages(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> np.ndarray:
    """Share of each box of a in that of b at its place, as coverage."""
    (x, y, w, h), (bx, by, bw, bh) = a, b
    common = _area(np.minimum(x + w, bx + bw) - np.maximum(x, bx), np.minimum(y + h, by + bh) - np.maximum(y, by))
    size = _area(w, h)
    return np.where(size > 0, common / np.where(size > 0, size, 1), 0.0)


def _area(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.maximum(w, 0) * np.maximum(h, 0)


def resolve_containment(detections: DataFrame, sheets: DataFrame, big: float = 0.12, covered: float = 0.55) -> DataFrame:
    """Without one side of each conflict between a big text box and the boxes in it: the big one goes if they fill enough of it,
    else they go."""
    o, i = box(table="o"), box(table="i")
    # Shares of areas as decimals: 0.55 of 100 is 55, and not a little more.
    big, covered = F.lit(Decimal(str(big))), F.lit(Decimal(str(covered)))
    large = detections.join(sheets.select("page_id", (F.col("width") * F.col("height")).alias("pa")), "page_id").filter(area(box()) >= big * F.col("pa"))
    pairs = large.alias("o").join(detections.alias("i"), (F.col("o.page_id") == F.col("i.page_id")) & (F.col("o.det_id") != F.col("i.det_id"))
                                  & (coverage(i, o) >= 0.8) & (area(o) > 1.5 * area(i)))
    pairs = pairs.select(F.col("o.page_id").alias("page_id"), F.col("o.det_id").alias("outer_id"), area(o).alias("outer_area"), F.col("i.det_id").alias("inner_id"), area(i).alias("a"))
    sums = pairs.groupBy("page_id", "outer_id").agg((F.sum("a") >= covered * F.max("outer_area")).alias("full"))
    pairs = pairs.join(sums, ["page_id", "outer_id"])
    gone = pairs.select("page_id", F.when(F.col("full"), F.col("outer_id")).otherwise(F.col("inner_id")).alias("det_id")).distinct()
    return detections.join(gone, ["page_id", "det_id"], "left_anti")


def _over(a: tuple, b: tuple) -> float:
    """Share of box a in box b, as (x, y, w, h)."""
    if a[2] <= 0 or a[3] <= 0:
        return 0.0
    wide, high = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return max(0, wide) * max(0, high) / (a[2] * a[3])


def _arrays(batch: pa.RecordBatch, rows: np.ndarray, names: Sequence[str] = "xywh") -> list[np.ndarray]:
    return [batch.column(n).take(pa.array(rows)).to_numpy(zero_copy_only=False) for n in names]


def _boxed(batch: pa.RecordBatch, names: Sequence[str] = "xywh") -> np.ndarray:
    """Places of the rows that have a box."""
    return np.flatnonzero(np.logical_and.reduce([np.asarray(batch.column(n).is_valid()) for n in names]))


def drop_contained(regions: DataFrame) -> DataFrame:
    """(page_id, region_id, box) without lines that repeat a larger one of the same height on the page; a dropped line drops no other."""

    def choose(batch: pa.RecordBatch, page: np.ndarray) -> pa.RecordBatch:
        rows = _boxed(batch)
        x, y, w, h = boxes = _arrays(batch, rows)
        middle, size = y + h / 2, w * h
        pairs = []
        for r, o in near_pairs(page[rows], boxes, page[rows], boxes):
            fits = size[o] > size[r]
            r, o = r[fits], o[fits]
            fits = np.abs(middle[o] - middle[r]) <= 0.45 * np.maximum(np.maximum(h[o], h[r]), 8)
            r, o = r[fits], o[fits]
            fits = coverages([c[r] for c in boxes], [c[o] for c in boxes]) >= 0.7
            pairs.append((r[fits], o[fits]))
        # Rows of one id go together.
        ids = np.cumsum(starts(batch.column("page_id"), batch.column("region_id")))
        own = ids[rows]
        pairs = sorted((r, o) for part in pairs for r, o in zip(*(c.tolist() for c in part), strict=True))
        gone: set[int] = set()
        for r, o in pairs:
            if own[o] not in gone:
                gone.add(own[r])
        return batch.filter(pa.array(~np.isin(ids, list(gone)))) if gone else batch

    df = regions.select("page_id", "region_id", "x", "y", "w", "h")
    return per_batch(df, ["page_id"], ["region_id"], choose, df.schema)


def add_second_source(first: DataFrame, second: DataFrame, most: float = 0.3) -> DataFrame:
    """first and second(page_id, region_id, box): first, and those of second that lie apart from all of first, from the bubble boxes
    (bx, by, bw, bh) that first has, and from each other, in order; their ids go on from the page's largest."""
    occupied = first.select("page_id", *"xywh")
    if "bx" in first.columns:
        occupied = occupied.unionByName(first.filter("bx is not null").select("page_id", *[F.col(f"b{c}").alias(c) for c in "xywh"]))
    a, b = box(table="a"), box(table="b")
    near = (F.col("a.page_id") == F.col("b.page_id")) & (F.greatest(coverage(a, b), coverage(b, a)) > most)
    apart = second.alias("b").join(occupied.alias("a"), near, "left_anti").select("page_id", "region_id", "x", "y", "w", "h")
    largest = first.groupBy("page_id").agg(F.max("region_id").alias("top"))

    def choose(rows: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        index = Grid()
        for r in rows:
            if all(max(_over(r[2:6], k[2:6]), _over(k[2:6], r[2:6])) <= most for k in map(kept.__getitem__, index.near(r[2:6]))):
                index.add(len(kept), r[2:6])
                kept.append(r)
        return [(r[0], r[6] + i, *r[2:6]) for i, r in enumerate(kept, 1)]

    numbered = apart.join(largest, "page_id", "left").fillna(0, ["top"])
    added = per_group(numbered, ["page_id"], ["region_id"], choose, "page_id long, region_id long, x long, y long, w long, h long")
    return first.select("page_id", "region_id", "x", "y", "w", "h").unionByName(added)


def _pair(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """What the rules of mergeable regions look at: numbers as floats with NaN for null, which fmin and fmax pass over as least and greatest do."""
    found = {c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (*"xywh", *[f"b{c}" for c in "xywh"])}
    found["sfx"] = np.asarray(pc.fill_null(pc.equal(batch.column("block_type"), "sfx"), True))  # or unknown
    found["page"] = np.asarray(pc.fill_null(pc.invert(batch.column("document")), False))
    return found | {"held": np.asarray(batch.column("bx").is_valid())}


def _lines(kind: str, a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Whether pairs of regions are lines of one paragraph or column."""
    low, wide, narrow = np.fmin(a["h"], b["h"]), np.fmax(a["w"], b["w"]), np.fmin(a["w"], b["w"])
    left = np.abs(a["x"] - b["x"])
    (a_end, a_foot), (b_end, b_foot) = ((r["x"] + r["w"], r["y"] + r["h"]) for r in (a, b))
    common = np.fmax(np.fmin(a_end, b_end) - np.fmax(a["x"], b["x"]), 0)
    common = np.where(narrow > 0, common / np.where(narrow > 0, narrow, 1), 0.0)
    gap = np.where(b["y"] >= a_foot, b["y"] - a_foot, np.where(a["y"] >= b_foot, a["y"] - b_foot, -1))
    ok = ~a["held"] & ~b["held"] & (low > 0) & ~((low >= 72) & ~(left <= 0.18 * wide))
    if kind == "paragraph":
        return ok & (np.fmax(a["h"], b["h"]) / np.where(low > 0, low, 1) <= 1.7) & (gap <= 0.7 * low) & ((left <= 0.25 * wide) | (common >= 0.4))
    alike = wide / np.where(narrow > 0, narrow, 1) <= 1.8
    return ok & (narrow > 0) & alike & (gap <= np.fmax(20, np.floor(0.35 * low))) & ((left <= 0.2 * wide) | (common >= 0.45))


def _in_bubble(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Share of a's area in b's bubble, as coverage."""
    over = [np.fmin(a[c] + a[n], b[f"b{c}"] + b[f"b{n}"]) - np.fmax(a[c], b[f"b{c}"]) for c, n in ("xw", "yh")]
    size = np.fmax(a["w"], 0) * np.fmax(a["h"], 0)
    return np.where(size > 0, np.fmax(over[0], 0) * np.fmax(over[1], 0) / np.where(size > 0, size, 1), 0.0)


def _collinear(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Whether pairs of regions continue one line of text."""
    low = np.fmin(a["h"], b["h"])
    loose = np.where(a["held"], _in_bubble(b, a), np.where(b["held"], _in_bubble(a, b), 1.0))
    sound = (a["sfx"] & b["held"]) | (b["sfx"] & a["held"])
    ok = a["page"] & b["page"] & ~(a["held"] & b["held"]) & (loose >= 0.85) & ~sound & (np.fmin(low, np.fmin(a["w"], b["w"])) > 0) & (np.fmax(a["h"], b["h"]) <= 2.2 * low)
    gap = [np.fmax(np.fmax(a[c] - b[c] - b[n], b[c] - a[c] - a[n]), 0) for c, n in ("xw", "yh")]
    ok &= np.sqrt(gap[0] ** 2 + gap[1] ** 2) <= 0.4 * low
    # The line between the centers: u along it, (-u.y, u.x) across.
    x, y = (b[c] + b[n] / 2 - a[c] - a[n] / 2 for c, n in ("xw", "yh"))
    apart = np.sqrt(x * x + y * y)
    ok &= apart >= 1
    far = np.where(apart >= 1, apart, 1)
    x, y, t = x / far, y / far, np.arctan2(y, x)
    upright = np.where(np.abs(t) > np.pi / 2, t - np.sign(t) * np.pi, t)

    def one(r: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        turn = np.abs(upright - np.where(r["w"] >= r["h"], 0.0, np.pi / 2))
        half, side = (np.abs(x) * r["w"] + np.abs(y) * r["h"]) / 2, (np.abs(y) * r["w"] + np.abs(x) * r["h"]) / 2
        cx, cy = r["x"] + r["w"] / 2, r["y"] + r["h"] / 2
        return np.minimum(turn, np.pi - turn), half, cx * x + cy * y, side, cy * x - cx * y

    (turn, half, at, side, beside), (turn_b, half_b, at_b, side_b, beside_b) = one(a), one(b)
    common = np.minimum(at + half, at_b + half_b) - np.maximum(at - half, at_b - half_b)
    across = np.minimum(beside + side, beside_b + side_b) - np.maximum(beside - side, beside_b - side_b)
    shorter = 2 * np.minimum(half, half_b)
    ok &= (np.maximum(turn, turn_b) <= np.radians(40.0)) & ~((low >= 80) & (shorter > 0) & (common > 0.12 * shorter))
    return ok & (-common <= low) & (across >= 0.55 * 2 * np.minimum(side, side_b))


#: What merge_pairs looks at.
PAIRED = ("page_id", "region_id", "block_type", "document", *"xywh", *[f"b{c}" for c in "xywh"])


def pairs_of_pages(batch: pa.RecordBatch, page: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of regions of one page that may become one; those of a page lie in order of their ids, a before b, with another id."""
    if kind not in ("paragraph", "column", "collinear"):
        raise ValueError(kind)
    own, ids = _pair(batch), np.cumsum(starts(batch.column("page_id"), batch.column("region_id")))
    rows = np.asarray(batch.column("page_id").is_valid()) & np.asarray(batch.column("region_id").is_valid())
    if kind == "collinear":
        rows = np.flatnonzero(rows & own["page"] & (np.minimum(own["w"], own["h"]) > 0) & ~np.isnan(own["x"] + own["y"]))
        reach = 0.4 * own["h"][rows] + 1
        boxes = own["x"][rows], own["y"][rows], own["w"][rows], own["h"][rows]
        wider = boxes[0] - reach, boxes[1] - reach, boxes[2] + 2 * reach, boxes[3] + 2 * reach
    else:
        rows = np.flatnonzero(rows)
        boxes = wider = tuple(np.zeros(len(rows)) for _ in range(4))  # all pairs of a page
    found = []
    for i, k in near_pairs(page[rows], wider, page[rows], boxes):
        i, k = rows[i], rows[k]
        later = ids[k] > ids[i]
        i, k = i[later], k[later]
        a, b = ({c: v[at] for c, v in own.items()} for at in (i, k))
        fits = _collinear(a, b) if kind == "collinear" else _lines(kind, a, b)
        found.append((i[fits], k[fits]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *side]) for side in (zip(*found, strict=True) if found else ((), ())))


def merge_pairs(regions: DataFrame, kind: str) -> DataFrame:
    """(page_id, a, b) with a < b: pairs of a page that may become one region; kind: paragraph, column or collinear. Pages are dealt once and compared by
    arrays."""

    def find(batch: pa.RecordBatch, page: np.ndarray) -> pa.RecordBatch:
        a, b = (pa.array(rows) for rows in pairs_of_pages(batch, page, kind))
        ids = batch.column("region_id")
        return pa.RecordBatch.from_arrays([batch.column("page_id").take(a), ids.take(a), ids.take(b)], names=["page_id", "a", "b"])

    df = regions.select(*PAIRED)
    kept = df.schema["region_id"].dataType
    return per_batch(df, ["page_id"], ["region_id"], find, StructType([df.schema["page_id"], StructField("a", kept), StructField("b", kept)]))


def layout_collisions(placed: DataFrame, regions: DataFrame, sheets: DataFrame, slack: int) -> DataFrame:
    """placed(page_id, region_id, x, y, w, h): where a drawn text enters a neighbour's box beyond its own, or leaves the page."""
    p, own, other = box(table="p"), box(table="o"), box(table="n")
    df = placed.alias("p").join(regions.alias("o"), (F.col("p.page_id") == F.col("o.page_id")) & (F.col("p.region_id") == F.col("o.region_id")))
    beyond = (p.x < own.x - slack) | (p.y < own.y - slack) | (p.right > own.right + slack) | (p.bottom > own.bottom + slack)
    hits = df.filter(beyond).join(regions.alias("n"), (F.col("p.page_id") == F.col("n.page_id")) & (F.col("p.region_id") != F.col("n.region_id")) & (intersection(p, other) > 0))
    hits = hits.select(F.col("p.page_id").alias("page_id"), F.col("p.region_id").alias("region_id"), F.col("n.region_id").alias("other_id"))
    b, out = box(), placed.join(sheets.select("page_id", "width", "height"), "page_id")
    out = out.filter((b.x < -slack) | (b.y < -slack) | (b.right > F.col("width") + slack) | (b.bottom > F.col("height") + slack))
    return hits.unionByName(out.select("page_id", "region_id", F.lit(None).cast("long").alias("other_id")))


def expand_boxes(regions: DataFrame, words: DataFrame, sheets: DataFrame, conf: float = 0.8) -> DataFrame:
    """Regions grown to the words they own, within the page, if that at most doubles their area. Those that are skipped, made or edited by hand,
    or (placed, where there is such a column) laid out, moved, turned or warped, stay."""
    w, r = box(table="w"), box(table="r")
    free = ~(F.col("r.skip") | F.col("r.manual") | F.col("r.edited"))
    if "placed" in regions.columns:
        free &= ~F.col("r.placed")
    in_bubble = F.when(F.col("r.bx").isNull(), True).otherwise(coverage(w, box("b", "r")) >= 0.7)
    on = (F.col("w.page_id") == F.col("r.page_id")) & (F.col("w.confidence") >= conf) & (coverage(w, r) >= 0.5) & in_bubble & free
    grown = words.alias("w").join(regions.alias("r"), on).groupBy("r.page_id", "r.region_id").agg(
        F.min(w.x).alias("l"), F.min(w.y).alias("t"), F.max(w.right).alias("m"), F.max(w.bottom).alias("n"))
    df = regions.join(grown, ["page_id", "region_id"], "left").join(sheets.select("page_id", "width", "height"), "page_id")
    b = box()
    left, top = F.greatest(F.least(b.x, F.coalesce("l", b.x)), F.lit(0)), F.greatest(F.least(b.y, F.coalesce("t", b.y)), F.lit(0))
    right, bottom = F.least(F.greatest(b.right, F.coalesce("m", b.right)), F.col("width")), F.least(F.greatest(b.bottom, F.coalesce("n", b.bottom)), F.col("height"))
    ok = F.col("l").isNotNull() & ((right - left) * (bottom - top) <= 2 * area(b))
    new = {"x": left, "y": top, "w": right - left, "h": bottom - top}
    return df.select("page_id", "region_id", *[F.when(ok, v).otherwise(F.col(c)).alias(c) for c, v in new.items()], ok.alias("expanded"))


_TARGET = ("t_x", "t_y", "t_w", "t_h")


def locate_words(targets: DataFrame, words: DataFrame, regions: DataFrame, least: int = 3) -> DataFrame:
    """targets(page_id, target_id, key, box), words(page_id, word_id, key, box), regions(page_id, region_id, box): for each target the nearest
    word, or pair of near words, with its whole key, in reach of the target's longer side; none where the second nearest is about as near,
    or over another region than the target's own."""
    wanted = targets.select("page_id", "target_id", *[F.col(c).alias(f"t_{c}") for c in ("key", *"xywh")])
    return locate_items(page_items(words.select("page_id", "word_id", "key", *"xywh"), regions).unionByName(wanted, allowMissingColumns=True), least)


def locate_items(items: DataFrame, least: int = 3) -> DataFrame:
    """As locate_words, of a table of page_items with the words' key and, as target_id, t_key and t_<box>, the targets. One row may be a word, a region and a
    target, so that a table of all three is dealt once."""

    def choose(batch: pa.RecordBatch, page: np.ndarray) -> pa.RecordBatch:
        paged = np.asarray(batch.column("page_id").is_valid())
        rows = lambda key, names: (r := _boxed(batch, names))[(np.asarray(batch.column(key).is_valid()) & paged)[r]]
        t = rows("t_key", _TARGET)
        t_key = batch.column("t_key").take(pa.array(t)).to_pylist()
        t, t_key = _kept(t, t_key, lambda k: 2 <= len(k) <= 40)
        w = rows("key", tuple("xywh"))
        by_key: dict[tuple, list[tuple]] = {}
        lengths: dict[int, set[int]] = {}  # of the words' keys of a page
        w_key, ids = (batch.column(c).take(pa.array(w)).to_pylist() for c in ("key", "word_id"))
        for k, g, *word in zip(w_key, page[w].tolist(), ids, *(c.tolist() for c in _arrays(batch, w)), strict=True):
            by_key.setdefault((g, k), []).append(tuple(word))
            if len(k) >= 2:
                lengths.setdefault(g, set()).add(len(k))
        found: dict[tuple, np.ndarray] = {}  # boxes that a page has for a key
        held, many, fitting = [], 0, []
        for row, of in zip(t.tolist(), zip(page[t].tolist(), t_key, strict=True), strict=True):
            if of not in found:
                g, key = of
                some = {v[1:] for v in by_key.get(of, ())}
                for n in lengths.get(g, ()):
                    if n < len(key) and (first := by_key.get((g, key[:n]))) and (second := by_key.get((g, key[n:]))):
                        some.update(_joined(a, b) for a, b in _halves(first, second) if _near(a, b))
                found[of] = np.array(list(some), np.int64).reshape(-1, 4)
            if len(found[of]):
                held.append((row, found[of]))
                many += len(found[of])
            if many > 500_000:
                fitting.append(_in_reach(batch, page, held, least))
                held, many = [], 0
        fitting.append(_in_reach(batch, page, held, least))
        at, boxes, distance, pad = (np.concatenate(c) for c in zip(*fitting, strict=True))
        target = batch.column("target_id").dictionary_encode().indices.fill_null(-1).to_numpy()[at]
        order = np.lexsort((*boxes.T[::-1], distance, target, page[at]))
        at, boxes, distance, pad, target = (v[order] for v in (at, boxes, distance, pad, target))
        new = (np.diff(page[at], prepend=-1) != 0) | (np.diff(target, prepend=-2) != 0)
        second = np.where(np.r_[new[1:], True], np.inf, np.r_[distance[1:], np.inf]) if len(at) else distance
        best = np.flatnonzero(new & (second - distance >= np.maximum(8.0, 0.2 * pad)))
        own = pa.array(at[best])
        return pa.RecordBatch.from_arrays([batch.column("page_id").take(own), batch.column("target_id").take(own), pa.array(distance[best]), *map(pa.array, boxes[best].T)], names=["page_id", "target_id", "distance", *"xywh"])

    schema = StructType([items.schema["page_id"], items.schema["target_id"]]).add("distance", "double")
    for c in "xywh":
        schema.add(c, items.schema[c].dataType)
    return per_batch(items, ["page_id"], ["r_region_id"], choose, schema)


def _kept(rows: np.ndarray, values: list, of) -> tuple[np.ndarray, list]:
    keep = [i for i, v in enumerate(values) if of(v)]
    return rows[keep], [values[i] for i in keep]


def _in_reach(batch: pa.RecordBatch, page: np.ndarray, held: list[tuple[int, np.ndarray]], least: int) -> tuple[np.ndarray, ...]:
    """Rows of targets and the boxes of their keys → (row, box, distance, longer side) of those that a target may have."""
    boxes = np.concatenate([np.zeros((0, 4), np.int64), *[b for _, b in held]])
    at = np.repeat(np.array([row for row, _ in held], np.int64), [len(b) for _, b in held])
    x, y, wide, high = boxes.T
    tx, ty, tw, th = _arrays(batch, at, _TARGET)
    pad, ratio = np.maximum(tw, th), _area(wide, high) / np.maximum(_area(tw, th), 1)
    distance = np.sqrt((tx + tw / 2 - x - wide / 2) ** 2 + (ty + th / 2 - y - high / 2) ** 2)
    ok = np.flatnonzero((ratio >= 0.1) & (ratio <= 6.0) & (distance <= 1.5 * pad) & (np.minimum(wide, high) >= least))
    ok = ok[~_taken(batch, page, at[ok], boxes[ok])]
    return at[ok], boxes[ok], distance[ok], pad[ok]


def _halves(first: list[tuple], second: list[tuple]) -> Iterator[tuple[tuple, tuple]]:
    """Pairs of words (id, box) that may be near: all of few, and of many those that an index gives."""
    if len(first) * len(second) <= 4096:
        return product(first, second)
    boxes = []
    for words in (first, second):
        x, y, w, h = np.array([v[1:] for v in words], float).T
        reach = 0.8 * np.maximum(h, 0) + 1
        boxes.append((x - reach, y - reach, np.maximum(w, 0) + 2 * reach, np.maximum(h, 0) + 2 * reach))
    none = [np.zeros(len(words), np.int64) for words in (first, second)]
    return ((first[i], second[k]) for a, b in near_pairs(none[0], boxes[0], none[1], boxes[1]) for i, k in zip(a.tolist(), b.tolist(), strict=True))


def _near(v: tuple, w: tuple) -> bool:
    """Whether two words (id, box) may be the halves of one."""
    (i, x, y, a, b), (k, u, z, c, d) = v, w
    tall = 0.8 * max(b, d)
    if i is None or k is None or i == k or max(0, u - x - a, x - u - c) > tall or max(0, z - y - b, y - z - d) > tall:
        return False
    return ((x + a / 2 - u - c / 2) ** 2 + (y + b / 2 - z - d / 2) ** 2) ** 0.5 <= 1.5 * max(a, b, c, d)


def _joined(v: tuple, w: tuple) -> tuple[int, int, int, int]:
    (_, x, y, a, b), (_, u, z, c, d) = v, w
    left, top = min(x, u), min(y, z)
    return left, top, max(x + a, u + c) - left, max(y + b, z + d) - top


def _taken(batch: pa.RecordBatch, page: np.ndarray, at: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Whether boxes found for the targets of rows `at`, which are in order, lie over another region of the page."""
    ids, target = batch.column("r_region_id"), batch.column("target_id")
    both = pa.concat_arrays([ids.cast(target.type), target]).dictionary_encode().indices.fill_null(-1).to_numpy()
    ids, target = both[: len(page)], both[len(page) :]
    known = np.flatnonzero((ids >= 0) & np.asarray(batch.column("page_id").is_valid()))
    # Nulls as NaN, which fmin and fmax pass over as least and greatest do. A region with one, or of less than no area, is compared with all of its page.
    region = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in _REGION]
    odd = ~(region[2] * region[3] >= 0) | np.isnan(region[0] + region[1])
    out = np.zeros(len(at), bool)
    for some, all_pairs in ((known[~odd[known]], False), (known[odd[known]], True)):
        none = [np.zeros(n) for n in (len(at), len(some))]
        a, b = ([none[0]] * 4, [none[1]] * 4) if all_pairs else (list(boxes.T), [c[some] for c in region])
        for i, k in near_pairs(page[at], a, page[some], b) if len(some) and len(at) else ():
            k = some[k]
            over = [np.fmin(boxes[i, c] + boxes[i, c + 2], region[c][k] + region[c + 2][k]) - np.fmax(boxes[i, c], region[c][k]) for c in (0, 1)]
            common = np.fmax(over[0], 0) * np.fmax(over[1], 0)
            hit = (common > 0.4 * np.fmin(boxes[i, 2] * boxes[i, 3], region[2][k] * region[3][k])) & (target[at[i]] >= 0) & (target[at[i]] != ids[k])
            out[i[hit]] = True
    return out


def union_box(df: DataFrame, keys: list[str]) -> DataFrame:
    b = box()
    out = df.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(b.right).alias("r"), F.max(b.bottom).alias("d"))
    return out.select(*keys, "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("d") - F.col("y")).alias("h"))


def pad_box(regions: DataFrame, sheets: DataFrame, pad: int) -> DataFrame:
    """Boxes wider by pad on every side, within the page."""
    b, df = box(), regions.join(sheets.select("page_id", "width", "height"), "page_id")
    left, top = F.greatest(b.x - pad, F.lit(0)), F.greatest(b.y - pad, F.lit(0))
    new = {"x": left, "y": top, "w": F.least(b.right + pad, F.col("width")) - left, "h": F.least(b.bottom + pad, F.col("height")) - top}
    return df.select("page_id", "region_id", *[v.alias(c) for c, v in new.items()])


def split_paragraphs(lines: DataFrame) -> DataFrame:
    """Lines of a page from top to bottom with their paragraph: a new one where the gap is over 12 and over 1.15 median heights."""
    page = Window.partitionBy("page_id")
    order = page.orderBy("y", "region_id")
    gap = F.col("y") - F.lag(F.col("y") + F.col("h")).over(order)
    df = lines.withColumn("median", F.percentile("h", 0.5).over(page)).withColumn("gap", gap)
    new = F.coalesce(F.col("gap") > F.greatest(F.lit(12.0), 1.15 * F.col("median")), F.lit(False)).cast("long")
    return df.withColumn("new", new).withColumn("paragraph", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new", "gap", "median")


def plan_tiles(sheets: DataFrame, max_side: int, whole: int = 1500) -> DataFrame:
    """Tiles of a page. A page of at most max_side is one tile if it is below `whole` or nearly square. Others get squares of one side,
    at most 3 x 3: the shorter side, or max_side if that is less, but so much that three of them overlap by a fifth over the longer side.
    The first and the last tile lie flush."""
    long_side, short_side = F.greatest("width", "height"), F.least("width", "height")
    alone = (long_side <= max_side) & ((long_side < whole) | (long_side <= 1.25 * short_side))
    square = F.greatest(F.least(F.lit(max_side), short_side), F.ceil((long_side + 2) / 2.6)).cast("long")
    df = sheets.select("page_id", "width", "height", F.when(alone, long_side).otherwise(square).cast("long").alias("side"))

    def starts(extent: str) -> Column:
        rest = F.greatest(F.col(extent) - F.col("side"), F.lit(0))
        steps = F.least(F.lit(2), F.ceil(rest / (F.col("side") * 0.8))).cast("int")
        return F.transform(F.sequence(F.lit(0), steps), lambda k: F.bround(k * rest / F.greatest(steps, F.lit(1))).cast("long"))

    df = df.select("*", F.explode(starts("width")).alias("x")).select("*", F.explode(starts("height")).alias("y"))
    order = Window.partitionBy("page_id").orderBy("y", "x")
    return df.select("page_id", F.row_number().over(order).cast("long").alias("tile"), "x", "y", (F.least("width", F.col("x") + F.col("side")) - F.col("x")).alias("w"),
                     (F.least("height", F.col("y") + F.col("side")) - F.col("y")).alias("h"))


def boxes_in_tiles(regions: DataFrame, tiles: DataFrame) -> DataFrame:
    on = (F.col("r.page_id") == F.col("t.page_id")) & contains(box(table="t"), box(table="r"))
    return regions.alias("r").join(tiles.alias("t"), on).select("r.page_id", "t.tile", "r.region_id")

