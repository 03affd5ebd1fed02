"""Measures over pixel tables, quality rows and runs.

A table of pixels that a generator makes looks as small to Spark as what it is made from, so joins with pixels say how: what is few to a page (boxes,
medians) is hashed within its part of the pages and pixels stream past it; pixels meet pixels by sorting. Nothing of them is broadcast."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box
from .filters import STORY_TYPES, filled


def _share(a, b):
    return F.round(F.try_divide(a, b), 6)


def mask_metrics(pixels: DataFrame, margin: int = 0, change: int = 12) -> DataFrame:
    """pixels(page_id, x, y, r, r2, gt, pred): r2 is the first channel after cleaning; with g2 and b2 the channel that differs most counts. Recall (null
    without ink), spill outside the truth widened by margin, IoU, precision, F1, damage."""
    if margin:
        df = near_truth(pixels, pixels, margin)
    else:
        df = pixels.withColumn("near", F.col("gt"))
    c = F.count_if
    differs = [F.abs(F.col(k) - F.col(f"{k}2")) for k in "rgb" if f"{k}2" in pixels.columns]
    change_of = F.greatest(*differs) if len(differs) > 1 else differs[0]
    df = df.groupBy("page_id").agg(
        c("gt").alias("ink"), c(F.col("gt") & F.col("pred")).alias("hit"), c("pred").alias("n_pred"), c(F.col("gt") | F.col("pred")).alias("either"),
        c(F.col("pred") & ~F.col("near")).alias("out"), c(~F.col("near") & (change_of > change)).alias("damage"),
    )
    return df.select("page_id", _share(F.col("hit"), F.col("ink")).alias("recall"), _share(F.col("hit"), F.col("n_pred")).alias("precision"), _share(F.col("hit"), F.col("either")).alias("iou"),
                     _share(2 * F.col("hit"), F.col("ink") + F.col("n_pred")).alias("f1"), _share(F.col("out"), F.col("n_pred")).alias("spill"), "damage")


def extract_ink(pixels: DataFrame, floor: int = 28, faint: int = 4, least: int = 8) -> DataFrame:
    """pixels(page_id, comp_id, x, y, r, g, b, gt): by component of the truth, the distance to the background's median colour, its Otsu threshold
    (the first best), and the ink above the larger of it and the floor; status measured, no_ink or undetermined."""
    background = pixels.filter("not gt").groupBy("page_id").agg(*[F.percentile(c, 0.5).alias(f"m{c}") for c in "rgb"])
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"m{c}"), 2) for c in "rgb"), F.lit(0.0)))
    df = pixels.filter("gt").join(background.hint("shuffle_hash"), "page_id").withColumn("d", F.least(F.lit(255), F.floor(d)).cast("long"))
    keys = ["page_id", "comp_id"]
    bins = df.groupBy(*keys, "d").agg(F.count("*").alias("n"))
    every, up = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumns({"n0": F.sum("n").over(up), "s0": F.sum(F.col("n") * F.col("d")).over(up), "nt": F.sum("n").over(every), "st": F.sum(F.col("n") * F.col("d")).over(every)})
    w, mu, total = F.col("n0") / F.col("nt"), F.col("s0") / F.col("nt"), F.col("st") / F.col("nt")
    between = F.when(w * (1 - w) > 1e-9, F.round(F.pow(total * w - mu, 2) / (w * (1 - w)), 9))
    bins = bins.withColumn("v", between)
    otsu = F.max_by("d", F.struct("v", -F.col("d"))).over(every)
    bins = bins.withColumn("threshold", F.greatest(F.lit(floor), F.coalesce(otsu, F.lit(floor))))
    of = lambda wanted: F.coalesce(F.sum(F.when(wanted, F.col("n"))), F.lit(0))
    out = bins.groupBy(*keys, "threshold").agg(of(F.col("d") > F.col("threshold")).alias("ink"), of(F.col("d") >= faint).alias("faint"))
    status = F.when(F.col("ink") > 0, "measured").when(F.col("faint") >= least, "undetermined").otherwise("no_ink")
    return out.select(*keys, "threshold", "ink", status.alias("status"))


def cleanup_residue(pixels: DataFrame, rest: int = 60, halo: int = 20) -> DataFrame:
    """Ink pixels that differ from the median of the ring around the truth, and ring pixels that do; r2 is the cleaned channel."""
    df = near_truth(pixels, pixels, 3).withColumn("ring", F.col("near") & ~F.col("gt"))
    median = df.filter("ring").groupBy("page_id").agg(F.percentile("r2", 0.5).alias("m"))
    df = df.join(median.hint("shuffle_hash"), "page_id").withColumn("d", F.abs(F.col("r2") - F.col("m")))
    df = df.groupBy("page_id").agg(F.count_if("gt").alias("ink"), F.count_if("ring").alias("ring"), F.count_if(F.col("gt") & (F.col("d") > rest)).alias("left"), F.count_if(F.col("ring") & (F.col("d") > halo)).alias("lit"))
    return df.select("page_id", _share(F.col("left"), F.col("ink")).alias("residue"), _share(F.col("lit"), F.col("ring")).alias("halo"))


#: Side of the squares by which boxes and pixels of a page are brought together.
CELL = 64


def _in_boxes(pixels: DataFrame, regions: DataFrame, pad: int, *columns: str) -> DataFrame:
    """Pixels with the regions whose padded boxes they lie in: joined by page and square, so a pixel meets the boxes near it alone."""
    b = box()
    left, top, right, bottom = b.x - pad, b.y - pad, b.right + pad - 1, b.bottom + pad - 1
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / CELL), F.floor(high / CELL)))
    seen = regions.join(pixels.select("page_id").distinct().hint("merge"), "page_id", "left_semi")  # boxes of pages without pixels make no squares
    boxes = seen.filter((b.w + 2 * pad > 0) & (b.h + 2 * pad > 0)).select("page_id", "region_id", *columns, left.alias("_l"), top.alias("_t"), right.alias("_r"), bottom.alias("_b"))
    boxes = boxes.select("*", cells(F.col("_l"), F.col("_r")).alias("_cx")).select("*", cells(F.col("_t"), F.col("_b")).alias("_cy"))
    df = pixels.withColumns({"_cx": F.floor(F.col("x") / CELL), "_cy": F.floor(F.col("y") / CELL)})
    inside = F.col("x").between(F.col("_l"), F.col("_r")) & F.col("y").between(F.col("_t"), F.col("_b"))
    return df.join(boxes.hint("shuffle_hash"), ["page_id", "_cx", "_cy"]).filter(inside).drop("_cx", "_cy", "_l", "_t", "_r", "_b")


def half_widths(margin: int) -> list[tuple[int, int]]:
    """An ellipse of 2 * margin + 1 pixels each way, row by row: (rows from the middle, pixels to either side)."""
    rows = range(-margin, margin + 1)
    return [(dy, round(margin * math.sqrt((margin * margin - dy * dy) / (margin * margin))) if margin else 0) for dy in rows]


def runs(pixels: DataFrame) -> DataFrame:
    """Pixels of the truth (page_id, x, y, gt) → runs of neighbours in a row: page_id, y, lo, hi."""
    row = Window.partitionBy("page_id", "y").orderBy("x")
    df = pixels.filter("gt").select("page_id", "x", "y").distinct().withColumn("_run", F.col("x") - F.row_number().over(row))
    return df.groupBy("page_id", "y", "_run").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).drop("_run")


def widened(pixels: DataFrame, margin: int) -> DataFrame:
    """Intervals (page_id, y, lo, hi) of what lies within an ellipse of that margin around the truth: every run gives a wider one to each row of the ellipse.
    The work grows with the runs, not with pixels times places of the ellipse."""
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dy, w in half_widths(margin)]))
    wide = runs(pixels).select("page_id", "y", "lo", "hi", steps.alias("s"))
    return wide.select("page_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("lo") - F.col("s.w")).alias("lo"), (F.col("hi") + F.col("s.w")).alias("hi"))


def dilated(pixels: DataFrame, margin: int) -> DataFrame:
    """The same as disjoint intervals: those of a row that meet are one."""
    wide = widened(pixels, margin)
    row = Window.partitionBy("page_id", "y").orderBy("lo", "hi")
    reached = F.max("hi").over(row.rowsBetween(Window.unboundedPreceding, -1))
    wide = wide.withColumn("_new", F.coalesce((F.col("lo") > reached + 1).cast("int"), F.lit(1)))
    wide = wide.withColumn("_part", F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return wide.groupBy("page_id", "y", "_part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_part")


def near_truth(pixels: DataFrame, truth: DataFrame, margin: int) -> DataFrame:
    """pixels with near: whether they lie within margin of the truth, that is, whether an interval that begins at or before them in their row ends at or after
    them. One pass over the rows, from left to right; where pixels lie dealt by page they stay there, as a join by page and row would not let them."""
    wide = widened(truth, margin).select("page_id", "y", F.col("lo").alias("x"), F.col("hi").alias("_hi"), F.lit(0).alias("_pixel"))
    rows = pixels.withColumn("_pixel", F.lit(1)).unionByName(wide, allowMissingColumns=True)
    row = Window.partitionBy("page_id", "y").orderBy("x", "_pixel").rowsBetween(Window.unboundedPreceding, 0)
    near = F.coalesce(F.max("_hi").over(row) >= F.col("x"), F.lit(False))
    return rows.withColumn("near", near).filter("_pixel = 1").drop("_pixel", "_hi")


def scoped_hits(pixels: DataFrame, regions: DataFrame, scope: str = "all", pad: int = 12, margin: int = 0) -> DataFrame:
    """Components of the mask with the region whose padded box has most of their pixels (ties: the first), if there is one and it is of the
    scope (all, sfx, or text: no sfx), and the share of their pixels within margin of the truth."""
    mask = pixels.filter("pred")
    owned = _in_boxes(mask.select("page_id", "comp_id", "x", "y"), regions, pad, "block_type").groupBy("page_id", "comp_id", "region_id", "block_type").agg(F.count("*").alias("n"))
    owner = owned.groupBy("page_id", "comp_id").agg(F.max_by(F.struct("region_id", "block_type"), F.struct("n", -F.col("region_id"))).alias("o"))
    wanted = {"all": F.lit(True), "sfx": F.col("o.block_type") == "sfx", "text": F.col("o.block_type") != "sfx"}[scope]
    hits = near_truth(mask, pixels, margin).groupBy("page_id", "comp_id").agg(_share(F.count_if("near"), F.count("*")).alias("rate"))
    return hits.join(owner.filter(wanted).hint("merge"), ["page_id", "comp_id"]).select("page_id", "comp_id", F.col("o.region_id").alias("region_id"), "rate")


def false_regions(pixels: DataFrame, regions: DataFrame, least: int = 12) -> DataFrame:
    """(page_id, region_id, n, inside) of the regions whose box has `least` pixels of the mask, more than half of them outside the truth."""
    df = _in_boxes(pixels.filter("pred").select("page_id", "x", "y", "gt"), regions, 0).groupBy("page_id", "region_id").agg(F.count("*").alias("n"), F.count_if("gt").alias("inside"))
    return df.filter((F.col("n") >= least) & (2 * F.col("inside") < F.col("n")))


def proposal_recall(pixels: DataFrame, second: DataFrame) -> DataFrame:
    """second(page_id, x, y): what another detector marks → its share of each page's truth; null without ink."""
    marked = second.select("page_id", "x", "y").distinct().withColumn("seen", F.lit(True))
    df = pixels.filter("gt").select("page_id", "x", "y").join(marked.hint("merge"), ["page_id", "x", "y"], "left")
    found = df.groupBy("page_id").agg(F.round(F.try_divide(F.count("seen"), F.count("*")), 4).alias("recall"))
    return pixels.select("page_id").distinct().join(found.hint("merge"), "page_id", "left")


def region_errors(pixels: DataFrame, least: int = 12, missed: int = 30) -> DataFrame:
    """Components of the prediction (comp_id) that lie mostly outside the truth, and of the truth that it hardly covers."""
    g = pixels.groupBy("page_id", "comp_id").agg(F.count_if("pred").alias("n_pred"), F.count_if(F.col("pred") & ~F.col("gt")).alias("out"), F.count_if("gt").alias("n_gt"), F.count_if(F.col("gt") & F.col("pred")).alias("hit"))
    return g.select("page_id", "comp_id", ((F.col("n_pred") >= least) & (2 * F.col("out") > F.col("n_pred"))).alias("false_region"), ((F.col("n_gt") >= missed) & (5 * F.col("hit") < F.col("n_gt"))).alias("missed"))


def cer(hypotheses: DataFrame, references: DataFrame) -> DataFrame:
    """(page_id, ord, text) of both → edits over the length of the page's whole reference, 0 where that is empty."""

    def whole(df: DataFrame, name: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
        return df.groupBy("page_id").agg(F.lower(F.array_join(F.transform(parts, lambda x: x["text"]), " ")).alias(name))

    df = whole(references, "ref").join(whole(hypotheses, "hyp"), "page_id", "left").withColumn("hyp", F.coalesce("hyp", F.lit("")))
    return df.select("page_id", F.when(F.length("ref") > 0, F.round(F.levenshtein("hyp", "ref") / F.length("ref"), 6)).otherwise(0.0).alias("cer"))


def run_summary(run_pages: DataFrame) -> DataFrame:
    df = run_pages.groupBy("run_id").agg(
        F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "error").alias("failed"), F.count("*").alias("total"),
        F.round(F.sum("seconds"), 6).alias("seconds"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("error") != "", F.col("error")))), ",").alias("errors"), F.sum("n_warnings").alias("warnings"),
    )
    return df.withColumn("exit", F.when(F.col("failed") == 0, "success").when(F.col("done") > 0, "partial").otherwise("failed"))


def stage_timings(docs: DataFrame, by: str) -> DataFrame:
    """docs(page, timings map, by) → seconds by stage, and totals over all of `by`, by grouping sets."""
    df = docs.select(by, F.explode("timings").alias("stage", "seconds"))
    return df.groupingSets([[by, "stage"], ["stage"]], by, "stage").agg(
        F.round(F.sum("seconds"), 6).alias("total"), F.round(F.percentile("seconds", 0.5), 6).alias("p50"), F.round(F.percentile("seconds", 0.95), 6).alias("p95"))


def compare_runs(before: DataFrame, after: DataFrame, metrics: list[str], report: float = 0.005) -> DataFrame:
    """Differences of metrics by page of at least `report`, and whether recall fell by more."""
    df = before.alias("b").join(after.alias("a"), "page").select("page", *[(F.col(f"a.{m}") - F.col(f"b.{m}")).alias(m) for m in metrics])
    df = df.unpivot("page", metrics, "metric", "delta").filter(F.col("delta").isNotNull() & (F.round(F.abs("delta"), 9) >= report))
    return df.select("page", "metric", F.round("delta", 6).alias("delta"), ((F.col("metric") == "recall") & (F.round("delta", 9) < -report)).alias("regression"))


def ab_verdict(quality: DataFrame, variants: tuple[str, ...], pair: str, slack: float = 0.005, time: float = 1.02) -> DataFrame:
    """quality(variant, page, recall, hit6: null where not measured, seconds) → one row: choice, and weak_pages. The choice is the first single
    variant that takes no longer than the pair, by 2 %, and loses no page by more than the slack; else the pair, with the weak pages of the
    closest single one."""
    rank = F.create_map(*[x for i, v in enumerate(variants) for x in (F.lit(v), F.lit(i))])
    singles = quality.filter(F.col("variant").isin(list(variants))).withColumn("rank", rank[F.col("variant")])
    took = quality.filter(F.col("variant") == pair).agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds")).scalar()
    both = quality.filter((F.col("variant") == pair) & F.coalesce("recall", "hit6").isNotNull()).select("page", F.coalesce("recall", F.lit(0.0)).alias("r"), F.coalesce("hit6", F.lit(0.0)).alias("h"))
    measured = F.coalesce("recall", "hit6").isNotNull() & F.col("r").isNotNull()
    weak = measured & ((F.col("r") - F.coalesce("recall", F.lit(0.0)) > slack) | (F.col("h") - F.coalesce("hit6", F.lit(0.0)) > slack))
    df = singles.join(both, "page", "left").groupBy("variant", "rank").agg(F.sum("seconds").alias("seconds"), F.array_sort(F.collect_set(F.when(weak, F.col("page")))).alias("weak"))
    # a row for each single variant from here on
    fast = df.withColumn("pair_seconds", took).filter((F.col("pair_seconds") == 0) | (F.col("seconds") <= time * F.col("pair_seconds")))
    best = fast.agg(F.min_by("variant", F.when(F.size("weak") == 0, F.col("rank"))).alias("single"), F.min(F.struct(F.size("weak").alias("n"), "rank", "weak")).alias("closest"))
    pages = F.when(F.col("single").isNull(), F.array_join(F.col("closest.weak").cast("array<string>"), ","))
    return best.select(F.coalesce("single", F.lit(pair)).alias("choice"), F.coalesce(pages, F.lit("")).alias("weak_pages"))


def page_rollup(regions: DataFrame, warnings: DataFrame) -> DataFrame:
    """regions(page_id, region_id, text, translation, block_type, skip, overflow, font_size), warnings(page_id, text) → counts, overflowing ids, the
    least size among regions that are drawn (0: none) and the number of warnings by page."""
    ids = F.array_sort(F.collect_list(F.when(F.col("overflow"), F.col("region_id"))))
    drawn = ~F.col("skip") & filled("text") & filled("translation") & F.col("block_type").isin(*STORY_TYPES, "sfx") & (F.col("font_size") > 0)
    df = regions.groupBy("page_id").agg(
        F.count("*").alias("n"), F.count_if(filled("translation")).alias("translated"), F.array_join(ids.cast("array<string>"), ",").alias("overflow"),
        F.coalesce(F.min(F.when(drawn, F.col("font_size"))), F.lit(0)).alias("min_font"))
    noted = warnings.groupBy("page_id").agg(F.count("*").alias("warnings"))
    return df.join(noted, "page_id", "left").withColumn("warnings", F.coalesce("warnings", F.lit(0)))


def reference_similarity(pixels: DataFrame) -> DataFrame:
    """1 - mean |automatic - reference| / mean |original - reference| over the truth; null where little changed (r2 automatic, b reference)."""
    df = pixels.filter("gt").groupBy("page_id").agg(F.avg(F.abs(F.col("r2") - F.col("b"))).alias("a"), F.avg(F.abs(F.col("r") - F.col("b"))).alias("o"))
    return df.select("page_id", F.round(F.when(F.col("o") >= 1, 1 - F.col("a") / F.col("o")), 6).alias("similarity"))


def contrast_audit(colours: DataFrame, least: float = 4.5) -> DataFrame:
    """colours(page_id, r, g, b, r2, g2, b2) → share of pairs whose contrast is below `least`."""

    def light(names: tuple[str, ...]):
        linear = lambda c: F.when(F.col(c) / 255 <= 0.03928, F.col(c) / 255 / 12.92).otherwise(F.pow((F.col(c) / 255 + 0.055) / 1.055, 2.4))
        return sum((k * linear(c) for k, c in zip((0.2126, 0.7152, 0.0722), names, strict=True)), F.lit(0.0))

    df = colours.withColumns({"_a": light(("r", "g", "b")), "_b": light(("r2", "g2", "b2"))})
    ratio = (F.greatest("_a", "_b") + 0.05) / (F.least("_a", "_b") + 0.05)
    return df.groupBy("page_id").agg(_share(F.count_if(ratio < least), F.count("*")).alias("low_share"))


def review_summary(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("rating").agg(F.count("*").alias("n"))


def review_totals(reviews: DataFrame) -> DataFrame:
    """reviews(status, rating: null or 0 if unrated) → one row: done, total, rated, unrated."""
    rated = F.coalesce(F.col("rating") > 0, F.lit(False))
    return reviews.agg(F.count_if(F.col("status") == "done").alias("done"), F.count("*").alias("total"), F.count_if(rated).alias("rated"), F.count_if(~rated).alias("unrated"))


#: Fixed value: how a comment names a part of the page, in percent.
_AREA = r"\[Область \(%\): x1=(\d+(?:\.\d+)?), y1=(\d+(?:\.\d+)?), x2=(\d+(?:\.\d+)?), y2=(\d+(?:\.\d+)?)\]"


def comment_boxes(reviews: DataFrame) -> DataFrame:
    """reviews(image, comment) → (image, n, x1, y1, x2, y2): the boxes that a comment names, those that are some part of the page."""
    corners = [F.regexp_extract_all("comment", F.lit(_AREA), F.lit(k)).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"), 1)]
    df = reviews.select("image", *corners).select("image", F.posexplode(F.arrays_zip("x1", "y1", "x2", "y2")).alias("n", "b"))
    df = df.select("image", F.col("n").cast("long").alias("n"), *[F.col(f"b.{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return df.filter("x2 <= 100 AND y2 <= 100 AND x2 > x1 AND y2 > y1")


def compare_pixels(a: DataFrame, b: DataFrame) -> DataFrame:
    """(page_id, x, y, v) of two runs → changed pixels and the largest difference by page."""
    df = a.join(b.withColumnRenamed("v", "v2").hint("merge"), ["page_id", "x", "y"])
    return df.groupBy("page_id").agg(F.count_if(F.col("v") != F.col("v2")).alias("changed"), F.max(F.abs(F.col("v") - F.col("v2"))).alias("largest"))


def validate_resume(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """manifest(id, image, source_sha), records(id, image, source_sha, status, result_sha, found_sha) → what to do with each page."""
    df = manifest.alias("m").join(records.alias("r"), "id", "left")
    same = F.col("m.image").eqNullSafe(F.col("r.image")) & F.col("m.source_sha").eqNullSafe(F.col("r.source_sha"))
    action = F.when(F.col("r.status").isNull(), "pending").when(~same, "error").when(F.col("r.status") != "done", "pending") \
        .when(F.col("r.result_sha").eqNullSafe(F.col("r.found_sha")), "done").otherwise("error")
    return df.select("id", action.alias("action"))


def pair_annotations(files: DataFrame) -> DataFrame:
    """files(path) → (stem, image, mask, zones): pages that have an image and a mask. `-mask` or `_mask`, `-2` for zones; png first."""
    name, suffix = F.regexp_extract("path", r"^(.*)\.([A-Za-z]+)$", 1), F.lower(F.regexp_extract("path", r"^(.*)\.([A-Za-z]+)$", 2))
    df = files.withColumns({"name": name, "suffix": suffix}).filter(F.col("suffix").isin("png", "jpg", "jpeg", "webp"))
    stem = F.regexp_replace("name", r"[-_]mask(-2)?$", "")
    kind = F.when(F.col("name").rlike(r"[-_]mask-2$"), "zones").when(F.col("name").rlike(r"[-_]mask$"), "mask").otherwise("image")
    first = F.struct(F.array_position(F.array(*map(F.lit, ("png", "jpg", "jpeg", "webp"))), F.col("suffix")).alias("p"), "path")
    df = df.withColumns({"stem": stem, "kind": kind}).groupBy("stem").agg(*[F.min(F.when(F.col("kind") == k, first)).getField("path").alias(k) for k in ("image", "mask", "zones")])
    return df.filter(F.col("image").isNotNull() & F.col("mask").isNotNull())


def intake_registry(files: DataFrame, run_pages: DataFrame) -> DataFrame:
    """files(image, sha, has_mask) with the run's status, or `missing`."""
    return files.join(run_pages.select("image", "status"), "image", "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def page_scope(pages: DataFrame, overrides: DataFrame) -> DataFrame:
    """pages(page_id, name), overrides(prio, part, scope): the first override whose part is in the name, else by directory. Overrides are
    a handful of settings and are held as one array."""
    rules = overrides.agg(F.array_sort(F.collect_list(F.struct("prio", "part", "scope"))).alias("r")).scalar()
    df = pages.withColumn("_rules", rules)
    hit = F.get(F.filter("_rules", lambda r: F.contains(F.col("name"), r["part"])), F.lit(0))["scope"]
    return df.withColumn("scope", F.coalesce(hit, F.when(F.col("name").rlike("(^|/)sfx/"), "sfx").otherwise("text"))).drop("_rules")


def top_blobs(components: DataFrame, n: int = 8, least: int = 12) -> DataFrame:
    """components(page_id, comp_id, size): the n largest of each page."""
    w = Window.partitionBy("page_id").orderBy(F.desc("size"), "comp_id")
    return components.filter(F.col("size") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def verify_artifacts(manifest: DataFrame, reports: DataFrame, files: DataFrame) -> DataFrame:
    """manifest(id, input_sha, settings), reports(id, input_sha, settings, artifacts map of path to sha), files(path, sha) → reasons against: no report,
    other input, other settings, other languages (source_lang and target_lang, where both sides have them), other artifacts."""
    df = manifest.alias("m").join(reports.withColumn("_there", F.lit(True)).alias("r"), "id", "left")
    other = lambda *cs: F.array_contains(F.array(F.lit(False), *[~F.col(f"m.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cs if c in manifest.columns and c in reports.columns]), True)
    reason = F.when(F.col("r._there").isNull(), "report").when(other("input_sha"), "input").when(other("settings"), "settings").when(other("source_lang", "target_lang"), "languages")
    off = df.select("id", reason.alias("reason")).filter("reason is not null")
    own = reports.select("id", F.explode("artifacts").alias("path", "wanted")).join(files, "path", "left")
    bad = own.filter(~F.col("wanted").eqNullSafe(F.col("sha"))).select("id", F.lit("artifact").alias("reason")).distinct()
    return off.unionByName(bad)
