"""Row-wise jobs: what may be translated, drawn, admitted or kept, and repairs with counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import area, box

#: Fixed values of the data model.
STORY_TYPES = ("dialogue", "narration", "title")
BLOCK_TYPES = (*STORY_TYPES, "sfx", "sign", "noise")
GENDERS = ("male", "female", "unknown")
MAX_BYTES = 64 * 1024 * 1024
MAX_PIXELS = 40_000_000


def filled(c: str | Column) -> Column:
    """Not null and more than blanks."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def translatable(regions: DataFrame, sfx: bool = False) -> DataFrame:
    types = [*STORY_TYPES, "sfx"] if sfx else list(STORY_TYPES)
    return regions.filter(~F.col("skip") & filled("text") & F.col("block_type").isin(types))


def drawable(regions: DataFrame, sfx: bool = False) -> DataFrame:
    return translatable(regions, sfx).filter(filled("translation"))


def validate_proposals(proposals: DataFrame, sheets: DataFrame, most: int = 100, side: int = 4) -> DataFrame:
    """Every proposal with its reason ('' if valid) and, if valid, its box in pixels (halves to even)."""
    good_type = F.col("type").isin(list(BLOCK_TYPES))
    numbers = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    finite = ~F.coalesce(numbers[0] + numbers[1] + numbers[2] + numbers[3], F.lit(float("nan"))).isin(float("nan"), float("inf"), float("-inf"))
    ranged = (numbers[0] >= 0) & (numbers[0] < numbers[2]) & (numbers[2] <= 1000) & (numbers[1] >= 0) & (numbers[1] < numbers[3]) & (numbers[3] <= 1000)
    df = proposals.join(sheets.select("page_id", "width", "height"), "page_id")
    place = lambda c, of: F.bround(F.col(c) * F.col(of) / 1000).cast("long")
    df = df.withColumns({"x": place("x0", "width"), "y": place("y0", "height")})
    df = df.withColumns({"w": place("x1", "width") - F.col("x"), "h": place("y1", "height") - F.col("y")})
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))
    reason = (
        F.when(order > most, "surplus").when(~good_type, "type").when(~filled("text") | (F.length("text") > 8000), "text")
        .when(~finite, "number").when(~ranged, "range").when(F.least("w", "h") < side, "small").otherwise("")
    )
    return df.withColumn("reason", reason).select("page_id", "ord", "reason", *[F.when(F.col("reason") == "", F.col(c)).alias(c) for c in "xywh"])


def normalize_boxes(regions: DataFrame, sheets: DataFrame) -> DataFrame:
    """Corners in 0..1000, halves to even."""
    b, df = box(), regions.join(sheets.select("page_id", "width", "height"), "page_id")
    part = lambda v, of: F.bround(1000 * v / F.greatest(F.col(of), F.lit(1))).cast("long")
    return df.select("page_id", "region_id", part(b.x, "width").alias("x0"), part(b.y, "height").alias("y0"),
                     part(b.right, "width").alias("x1"), part(b.bottom, "height").alias("y1"))


def rescale_regions(regions: DataFrame, sheets: DataFrame, target: int) -> DataFrame:
    """Pixel quantities times target / long side where the page is smaller, those that regions has of: boxes (sides stay 1 or more), bubble boxes,
    sizes (1 or more, 0 is none), spacings, positions, and arrays of points (6 decimals)."""
    long_side = F.greatest("width", "height")
    factor = F.when((long_side < target) & (long_side > 0), target / long_side).otherwise(1.0)
    df = regions.join(sheets.select("page_id", factor.alias("factor")), "page_id")
    whole = lambda c: F.bround(F.col(c) * F.col("factor")).cast("long")
    fine = lambda v: F.round(v * F.col("factor"), 6)
    rules = {
        ("x", "y", "bx", "by"): whole,
        ("w", "h", "bw", "bh"): lambda c: F.when(F.col(c).isNotNull(), F.greatest(whole(c), F.lit(1))),
        ("font_size", "font_size_override", "line_height"): lambda c: F.when(F.col(c) > 0, F.greatest(whole(c), F.lit(1))).otherwise(F.col(c).cast("long")),
        ("stroke_width", "letter_spacing", "line_spacing", "pos_x", "pos_y"): lambda c: fine(F.col(c)),
        ("quad", "mesh", "contour"): lambda c: F.transform(c, lambda p: F.transform(p, fine)),
    }
    return df.withColumns({c: F.when(F.col("factor") == 1, F.col(c)).otherwise(rule(c)) for names, rule in rules.items() for c in names if c in regions.columns}).drop("factor")


def _within(c: str, low: float, high: float, kind: str) -> Column:
    return F.least(F.greatest(F.coalesce(F.col(c).cast(kind), F.lit(0)), F.lit(low)), F.lit(high)).cast(kind)


def coerce_regions(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions in range, one row of repairs by field), for those fields that there are: gender and type among the known, confidence in 0..1,
    progress and tolerance in 0..100, and three colour channels in 0..255 (missing ones are 0)."""
    channel = lambda v: F.least(F.greatest(F.coalesce(v, F.lit(0)), F.lit(0)), F.lit(255)).cast("int")
    colour = lambda c: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: channel(F.get(F.col(c), k)))
    fixes = {
        "speaker_gender": F.when(F.lower("speaker_gender").isin(list(GENDERS)), F.lower("speaker_gender")).otherwise("unknown"),
        "block_type": F.when(F.col("block_type").isin(list(BLOCK_TYPES)), F.col("block_type")).otherwise("dialogue"),
        "confidence": _within("confidence", 0.0, 1.0, "double"),
        "progress": _within("progress", 0, 100, "long"), "tolerance": _within("tolerance", 0, 100, "long"),
        "fill_rgb": colour("fill_rgb"), "stroke_rgb": F.when(F.col("stroke_rgb").isNotNull(), colour("stroke_rgb")),
    }
    fixes = {c: f for c, f in fixes.items() if c in regions.columns}
    audit = regions.agg(*[F.count_if(~F.col(c).eqNullSafe(f)).alias(f"{c}_repaired") for c, f in fixes.items()])
    return regions.withColumns(fixes), audit


def admit(submissions: DataFrame, max_bytes: int = MAX_BYTES, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """Every submission with its reason, '' if admitted."""
    reason = (
        F.when(~filled("target_lang"), "target").when(F.coalesce("bytes", F.lit(0)) <= 0, "empty").when(F.col("bytes") > max_bytes, "bytes")
        .when((F.col("width") < 0) | (F.col("height") < 0), "size").when(F.col("width") * F.col("height") > max_pixels, "pixels").otherwise("")
    )
    return submissions.withColumn("reason", reason)


def drop_oversize(detections: DataFrame, sheets: DataFrame, bubble: float = 0.45, text: float = 0.6) -> DataFrame:
    df = detections.join(sheets.select("page_id", (F.col("width") * F.col("height")).alias("page_area")), "page_id")
    most = F.when(F.col("class_name") == "bubble", bubble).otherwise(text)
    return df.filter(area(box()) <= most * F.col("page_area")).drop("page_area")


def usable_words(words: DataFrame, min_conf: float, side: float = 2, letters: bool = False) -> DataFrame:
    """Words of enough confidence, with the bounds of their quad (an array of points)."""
    xs, ys = F.transform("quad", lambda p: p[0]), F.transform("quad", lambda p: p[1])
    df = words.withColumns({"x": F.array_min(xs), "y": F.array_min(ys), "w": F.array_max(xs) - F.array_min(xs), "h": F.array_max(ys) - F.array_min(ys)})
    ok = (F.col("confidence") >= min_conf) & filled("text") & (F.col("w") >= side) & (F.col("h") >= side)
    if letters:
        n = F.regexp_count("text", F.lit(r"\p{L}"))
        ok &= (n >= 2) & (2 * n >= F.length(F.trim("text"))) & ~F.col("text").rlike("[@_]")
    return df.filter(ok)


#: What counts as a secret in a log line, by rule, in the order in which the rules apply. Of an address the user info, and all
#: from the query or fragment on, go.
REDACTIONS = (
    ("user_info", r"(?i)(https?://)[^\s/?#\"<>]*@", "$1"),
    ("query_fragment", r"(?i)(https?://[^\s\"<>?#]*)[?#][^\s\"<>]*", "$1"),
    ("bearer", r"(?i)(bearer\s+)[^\s\"']+", "$1***"),
    ("assignment", r"(?i)((?:api[_-]?key|key|token|password|secret)\s*[=:]\s*)(?:\"[^\"]*\"|[^\s,\"']+)", "$1***"),
)


def redact(df: DataFrame, column: str, secrets: tuple[str, ...] = ()) -> DataFrame:
    """The column without secrets, n_redacted (matches of all rules) and redacted_by_rule (matches of known secrets and of each rule). Of known
    secrets the longest goes first, so that none leaves the rest of a wider one."""
    text, n = F.coalesce(F.col(column), F.lit("")), F.lit(0)
    for s in sorted(filter(None, set(secrets)), key=lambda s: (-len(s), s)):
        n = n + ((F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))) / len(s)).cast("int")
        text = F.replace(text, F.lit(s), F.lit("***"))
    counts = {"secret": n}
    for rule, pattern, by in REDACTIONS:
        counts[rule], text = F.regexp_count(text, F.lit(pattern)), F.regexp_replace(text, pattern, by)
    by_rule = F.struct(*[v.cast("long").alias(k) for k, v in counts.items()])
    return df.withColumns({column: text, "n_redacted": sum(counts.values(), F.lit(0)).cast("long"), "redacted_by_rule": by_rule})


def reset_computed(regions: DataFrame, computed: dict[str, Column]) -> DataFrame:
    """Computed columns back to their defaults, but on rows that a person made or edited, or that are frozen."""
    keep = F.col("manual") | F.col("edited") | F.col("translation_locked")
    return regions.withColumns({c: F.when(keep, F.col(c)).otherwise(v) for c, v in computed.items()})


def keep_reads(regions: DataFrame, reader: str) -> DataFrame:
    if reader == "model":
        return regions.filter((F.regexp_count("text", F.lit(r"\p{L}")) >= 2) & ~F.col("block_type").isin("noise", "sign"))
    return regions.filter(F.col("block_type") == "sfx")


def long_sfx_candidates(regions: DataFrame, words: int = 6, distinct: int = 4) -> DataFrame:
    parts = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    return regions.filter((F.col("block_type") == "sfx") & (F.size(parts) >= words) & (F.size(F.array_distinct(F.transform(parts, F.lower))) >= distinct))


def accept_review(regions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewed types (page_id, region_id, reviewed) in place of sfx, where they are story types."""
    df = regions.join(reviews, ["page_id", "region_id"], "left")
    return df.withColumn("block_type", F.when(F.col("reviewed").isin(list(STORY_TYPES)), F.col("reviewed")).otherwise(F.col("block_type"))).drop("reviewed")
