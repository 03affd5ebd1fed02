"""Merging of regions, reading order, and order of words."""

from __future__ import annotations

import math
import statistics
from collections.abc import Callable, Iterable, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..functions.grouped import per_batch, per_group, starts
from .spatial import PAIRED, pairs_of_pages


def page_components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """nodes(page_id, region_id), pairs(page_id, a, b) → (page_id, region_id, root): the least id of each component. Pairs never leave
    a page, so each page is settled by itself: one exchange and no rounds."""
    return with_roots(nodes.select("page_id", "region_id"), pairs)


def with_roots(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """nodes with all their columns and the root of each. Pairs alone go through the fold; a node without pairs is its own root."""

    def settle(rows: list[tuple]) -> list[tuple]:
        parent: dict = {}

        def find(n):
            parent.setdefault(n, n)
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        for _, a, b in rows:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return [(rows[0][0], n, find(n)) for n in list(parent)]

    roots = per_group(pairs.select("page_id", "a", "b"), ["page_id"], [], settle, "page_id long, region_id long, root long")
    return nodes.join(roots, ["page_id", "region_id"], "left").withColumn("root", F.coalesce("root", "region_id"))


def merge_regions(regions: DataFrame, kind: str) -> DataFrame:
    """Each component of mergeable regions as one region; single ones stay as they are. Members are in the order of x, then center. Pages are dealt once:
    pairs, components and what becomes of them are one fold."""
    texts, bubble = ("text", "translation"), [f"b{c}" for c in "xywh"]
    names = ["page_id", "region_id", *"xywh", "confidence", "n", "block_type", "class_name", *texts, "document", *bubble]

    def merged(batch: pa.RecordBatch, page: np.ndarray) -> pa.RecordBatch:
        # Rows of one id go together; an id's number grows with the id.
        ids = np.cumsum(starts(batch.column("page_id"), batch.column("region_id"))) - 1
        parent = np.arange(ids[-1] + 1)
        for a, b in zip(*(ids[rows].tolist() for rows in pairs_of_pages(batch, page, kind)), strict=True):
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            parent[max(a, b)] = min(a, b)
        while (parent != parent[parent]).any():
            parent = parent[parent]
        root = parent[ids]
        alone = np.bincount(root)[root] == 1
        single = batch.filter(pa.array(alone))
        col, out = single.column, {"n": pa.array(np.ones(single.num_rows, np.int64))}
        none = {c: pa.nulls(single.num_rows, col(c).type) for c in (*"wh", *bubble)}
        out |= {n: pc.if_else(col(c).is_valid(), col(n), none[n]) for c, n in ("xw", "yh", *[("bx", c) for c in bubble])}
        out = pa.RecordBatch.from_arrays([out[c] if c in out else col(c) for c in names], names=names)
        if alone.all():
            return out
        several = np.flatnonzero(~alone)
        several = several[np.argsort(root[several], kind="stable")]
        rows = batch.take(pa.array(several)).to_pylist()
        made = [_one([m for _, m in own], texts, bubble) for _, own in groupby(zip(root[several].tolist(), rows, strict=True), key=lambda m: m[0])]
        return pa.concat_batches([out, pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], f.type) for c, f in zip(names, out.schema, strict=True)], schema=out.schema)])

    df = regions.select(*PAIRED, "confidence", "class_name", *texts)
    whole = regions.select("page_id", "region_id", "x", "y", (F.col("x") + F.col("w") - F.col("x")).alias("w"), (F.col("y") + F.col("h") - F.col("y")).alias("h"), "confidence",
                           F.lit(0).cast("long").alias("n"), "block_type", "class_name", *texts, "document", *bubble)
    return per_batch(df, ["page_id"], ["region_id"], merged, whole.schema)


def _one(members: list[dict], texts: Sequence[str], bubble: Sequence[str]) -> dict:
    """Several rows of regions as one; null comes first where rows are ordered, and is passed over where values are put together."""

    def known(values: Iterable) -> list:
        return [v for v in values if v is not None]

    def center(m: dict):
        return None if m["y"] is None or m["h"] is None else m["y"] + m["h"] / 2

    keys = [(m["x"], center(m), m["region_id"], m["block_type"], m["class_name"], *[m[c] for c in texts]) for m in members]
    order = sorted(range(len(members)), key=lambda i: [(v is not None, v if v is not None else 0) for v in keys[i]])
    members = [members[i] for i in order]
    first, out = members[0], {"n": len(members)}
    for c, n in ("xw", "yh"):
        out[c] = min(known(m[c] for m in members), default=None)
        end = max((m[c] + m[n] for m in members if None not in (m[c], m[n])), default=None)
        out[n] = None if end is None else end - out[c]
    nan = [v for v in known(m["confidence"] for m in members) if v != v]
    held = sum(m["bx"] is not None for m in members) == 1
    flags = known(m["document"] for m in members)
    return out | {
        "page_id": first["page_id"], "region_id": first["region_id"], "confidence": nan[0] if nan else max(known(m["confidence"] for m in members), default=None),
        "block_type": "dialogue" if any(m["block_type"] == "dialogue" for m in members) else first["block_type"],
        "class_name": "text_bubble" if any(m["class_name"] == "text_bubble" for m in members) else first["class_name"],
        **{c: " ".join(t for t in (v.strip(" ") for v in known(m[c] for m in members)) if t) for c in texts},
        "document": all(flags) if flags else None, **{c: max(known(m[c] for m in members), default=None) if held else None for c in bubble},
    }


def reading_order(regions: DataFrame, direction: str = "ltr") -> DataFrame:
    """(page_id, region_id, box) with ord, from 0 in each page: boxes by center from top to bottom, in rows of which each takes what
    is about level with its first box (the first such row in the order they were begun); within a row by x."""

    def number(boxes: list[tuple]) -> list[tuple]:
        rows: list[list[tuple]] = []
        index = Grid()  # of what is level with the rows' first boxes, as strips
        for r in sorted(boxes, key=lambda r: (r[3] + r[5] / 2, r[1])):
            center, reach = r[3] + r[5] / 2, 0.35 * max(r[5], 8)
            strip = (0, center - reach, 1, 2 * reach)
            for k in sorted(index.near(strip)):
                first = rows[k][0]
                if abs(center - (first[3] + first[5] / 2)) <= 0.35 * max(r[5], first[5], 8):
                    rows[k].append(r)
                    break
            else:
                index.add(len(rows), strip)
                rows.append([r])
        order = [r for row in rows for r in sorted(row, key=lambda r: -r[2] if direction == "rtl" else r[2])]
        return [(*r, i) for i, r in enumerate(order)]

    df = regions.select("page_id", "region_id", "x", "y", "w", "h")
    return per_group(df, ["page_id"], ["region_id"], number, "page_id long, region_id long, x long, y long, w long, h long, ord long")


def level(a: Sequence[float], b: Sequence[float]) -> bool:
    """Whether two boxes (x, y, w, h) have half of the lower one's height in common."""
    low = min(a[3], b[3])
    return low > 0 and min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]) >= 0.5 * low


def stacked(a: Sequence[float], b: Sequence[float]) -> bool:
    """Whether two boxes have half of the narrower one's width in common."""
    narrow = min(a[2], b[2])
    return narrow > 0 and min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]) >= 0.5 * narrow


def gathered(boxes: Sequence[Sequence[float]], order: Sequence[int], alike: Callable, last_first: bool = False) -> list[list[int]]:
    """Numbers of boxes, taken in that order, in groups: each joins the first group begun (or the last) of which any member is alike (level or
    stacked). Members with the same extent are alike to the same boxes, so each extent is looked at once, for the group that goes first."""
    groups: list[list[int]] = []
    axis = 1 if alike is level else 0
    index, best = Grid(), {}  # extents, and their first (or last) group
    for i in order:
        extent = (boxes[i][axis], boxes[i][axis + 2])
        strip = (0, extent[0], 1, extent[1])
        own = [best[e] for e in index.near(strip) if alike(boxes[i], (e[0], e[0], e[1], e[1]))]
        if own:
            g = max(own) if last_first else min(own)
            groups[g].append(i)
        else:
            g = len(groups)
            groups.append([i])
        if extent not in best:
            index.add(extent, strip)
            best[extent] = g
        else:
            best[extent] = max(g, best[extent]) if last_first else min(g, best[extent])
    return groups


def any_stacked(boxes: Sequence[Sequence[float]]) -> bool:
    """Whether two of the boxes lie above each other."""
    index, seen = Grid(), set()
    for b in boxes:
        extent = (b[0], b[2])
        if any(stacked(b, (e[0], e[0], e[1], e[1])) for e in index.near((0, b[0], 1, b[2]))):
            return True
        if extent not in seen:
            seen.add(extent)
            index.add(extent, (0, b[0], 1, b[2]))
    return False


def straightened(boxes: list[tuple], quads: list) -> list[tuple]:
    """Boxes turned back by the median angle of the quads' upper edges, if that is over 3 degrees; else as they are."""
    slopes = []
    for q in quads:
        if q is not None:
            dx, dy = q[1][0] - q[0][0], q[1][1] - q[0][1]
            if abs(dx) > abs(dy):
                slopes.append(math.atan2(dy, dx))
    angle = statistics.median(slopes) if slopes else 0.0
    if abs(angle) <= math.radians(3):
        return boxes
    cosine, sine, out = math.cos(angle), math.sin(angle), []
    for b, q in zip(boxes, quads, strict=True):
        x, y, w, h = b
        corners = q if q is not None else [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        across, down = [cosine * u + sine * v for u, v in corners], [cosine * v - sine * u for u, v in corners]
        wide, high = max(across) - min(across), max(down) - min(down)
        out.append(b if wide < 2 or high < 2 else (int(min(across)), int(min(down)), int(wide), int(high)))
    return out


def read_words(boxes: list[tuple], quads: list, direction: str) -> list[int]:
    """Numbers of a region's words in reading order. In columns, where 60 % of the words (two at least) are clearly tall and two words lie
    above each other; else in lines, with a common slant taken out."""
    n = range(len(boxes))
    tall = sum(b[3] > 1.15 * b[2] for b in boxes)
    if len(boxes) > 1 and tall >= max(2, round(0.6 * len(boxes))) and any_stacked(boxes):
        columns = gathered(boxes, sorted(n, key=lambda i: boxes[i][:2]), stacked)
        columns.sort(key=lambda g: statistics.fmean(boxes[i][0] + boxes[i][2] / 2 for i in g), reverse=direction == "rtl")
        return [i for g in columns for i in sorted(g, key=lambda i: boxes[i][1] + boxes[i][3] / 2)]
    flat = straightened(boxes, quads)
    rows = gathered(flat, sorted(n, key=lambda i: (flat[i][1] + flat[i][3] / 2, flat[i][0])), level, last_first=True)
    rows.sort(key=lambda g: statistics.fmean(flat[i][1] for i in g))
    return [i for g in rows for i in sorted(g, key=lambda i: flat[i][0], reverse=direction == "rtl")]


def order_words(words: DataFrame, direction: str = "ltr") -> DataFrame:
    """words(page_id, region_id, word_id, text, box, and quad where there is one) → (page_id, region_id, text, n): the words of a region in
    reading order."""
    quad = F.col("quad").cast("array<array<double>>") if "quad" in words.columns else F.lit(None).cast("array<array<double>>")

    def texts_of(batch: pa.RecordBatch, region: np.ndarray) -> pa.RecordBatch:
        n, first = np.bincount(region), np.flatnonzero(np.diff(region, prepend=-1))
        texts = [(t or "").strip() for t in batch.column("text").to_pylist()]
        found = [texts[k] for k in first]
        # Most regions have one word; the others' boxes alone leave the arrays.
        several = np.flatnonzero(n > 1)
        rows = np.flatnonzero(n[region] > 1)
        *boxes, quads = (batch.column(c).take(pa.array(rows)).to_pylist() for c in (*"xywh", "quad"))
        boxes, start = list(zip(*boxes, strict=True)), 0
        for k, size, at in zip(several.tolist(), n[several].tolist(), first[several].tolist(), strict=True):
            order = read_words(boxes[start : start + size], quads[start : start + size], direction)
            found[k] = " ".join(t for i in order if (t := texts[at + i]))
            start += size
        keys = [batch.column(c).take(pa.array(first)) for c in ("page_id", "region_id")]
        return pa.RecordBatch.from_arrays([*keys, pa.array(found, pa.string()), pa.array(n)], names=["page_id", "region_id", "text", "n"])

    df = words.select("page_id", "region_id", "word_id", "text", "x", "y", "w", "h", quad.alias("quad"))
    return per_batch(df, ["page_id", "region_id"], ["word_id"], texts_of, "page_id long, region_id long, text string, n long")
