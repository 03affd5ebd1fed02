"""Page documents as tables and back, without loss: typed columns beside the objects that they were read from, so that keys nobody knows survive."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Flags of a region.
FLAGS = ("skip", "manual", "edited", "overflow", "translation_locked", "document")
#: Texts of a region and what stands for a missing one.
TEXTS = {"class_name": "text_free", "text": "", "translation": "", "speaker": "", "speaker_gender": ""}
_OBJECT = "map<string,variant>"


def _at(of: str, key: str) -> Column:
    return F.try_element_at(F.col(of), F.lit(key))


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _text(v: Column, default: str) -> Column:
    return F.coalesce(_as(v, "string"), F.lit(default))


def _whole(v: Column) -> Column:
    """A number without its fraction, or the number in a text."""
    return F.coalesce(_as(v, "long"), _as(v, "double").try_cast("long"))


def _flag(v: Column) -> Column:
    """What is true: true, numbers but 0, texts, lists and objects that are not empty."""

    def told(kind: Column) -> Column:
        other = F.when(kind.startswith("ARRAY"), F.to_json(v) != "[]").when(kind.startswith("OBJECT"), F.to_json(v) != "{}").when(kind == "STRING", _as(v, "string") != "")
        return F.when(kind == "BOOLEAN", _as(v, "boolean")).otherwise(F.coalesce(other, _as(v, "double") != 0))

    # Named once: the kind is a text made of the whole value.
    return F.when(v.isNotNull(), F.coalesce(F.get(F.transform(F.array(F.schema_of_variant(v)), told), F.lit(0)), F.lit(False))).otherwise(False)


def _filled(v: Column) -> Column:
    """A text that is not empty, else null."""
    return F.nullif(_as(v, "string"), F.lit(""))


def _box(v: Column, i: int) -> Column:
    at = lambda kind: F.try_variant_get(v, f"$[{i}]", kind)
    return F.coalesce(at("long"), at("double").try_cast("long"))


#: The keys of a region that columns are made of.
KEYS = ("id", "bbox", *TEXTS, "confidence", "type", "block_type", "bubble_bbox", "order", *FLAGS)


def _spread(df: DataFrame) -> DataFrame:
    """df(raw) with what raw says under each key, looked up once, as columns for _fields. The flags are one list: a projection with a function of list items
    stays out of Spark's one method for a stage, which with all these columns is longer than the JVM compiles."""
    flags = F.transform(F.array(*[_at("raw", c) for c in FLAGS]), _flag)
    return df.withColumns({f"_v_{key}": _at("raw", key) for key in KEYS if key not in FLAGS} | {"_flags": flags})


def _fields(place: Column) -> dict[str, Column]:
    """The typed columns of a region by what its object says."""
    v = lambda key: F.col(f"_v_{key}")
    return {
        "region_id": F.coalesce(_whole(v("id")), place),
        **{c: F.coalesce(_box(v("bbox"), i), F.lit(0).cast("long")) for i, c in enumerate("xywh")},
        **{c: _text(v(c), default) for c, default in TEXTS.items()},
        "confidence": F.coalesce(_as(v("confidence"), "double"), F.lit(0.0)),
        "block_type": F.coalesce(_filled(v("type")), _filled(v("block_type")), F.lit("dialogue")),
        **{c: _box(v("bubble_bbox"), i) for i, c in enumerate(("bx", "by", "bw", "bh"))},
        "order": F.coalesce(_whole(v("order")), F.lit(0).cast("long")),
        **{c: F.col("_flags")[i] for i, c in enumerate(FLAGS)},
    }


def read_pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON documents, one a file or one a line: path, body, raw (the object by key, null where there is none), version, reading_direction, warnings,
    timings, ocr_engine, translator_engine, and strokes as they are."""
    text = spark.read.text(path, wholetext=not lines).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    raw = F.try_variant_get(F.try_parse_json("body"), "$", _OBJECT)
    docs = text.withColumn("raw", F.when(F.trim("body").startswith("{"), raw))
    v = lambda key: _at("raw", key)
    return docs.select(
        "path", "body", "raw", F.coalesce(_whole(v("version")), F.lit(1).cast("long")).alias("version"),
        F.coalesce(_filled(v("reading_direction")), F.lit("ltr")).alias("reading_direction"),
        F.coalesce(F.transform(_as(v("warnings"), "array<variant>"), lambda w: F.coalesce(_as(w, "string"), F.to_json(w))), F.array().cast("array<string>")).alias("warnings"),
        F.coalesce(_as(v("timings"), "map<string,double>"), F.create_map().cast("map<string,double>")).alias("timings"),
        _text(v("ocr_engine"), "").alias("ocr_engine"), _text(v("translator_engine"), "").alias("translator_engine"),
        F.coalesce(_as(v("strokes"), "array<variant>"), F.array().cast("array<variant>")).alias("strokes"),
    )


def page_regions(pages: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Regions of pages(raw), with `keys` of the page: pos, the typed columns and raw, the region's object by key. What is no object is skipped. A
    missing field gets its default, `type` goes before `block_type`, empty ones fall through, and a missing id is the region's place."""
    # A filter over what a document says would parse it once more: what has no regions gives no rows.
    items = F.posexplode(F.transform(_as(_at("raw", "regions"), "array<variant>"), lambda v: F.try_variant_get(v, "$", _OBJECT))).alias("pos", "raw")
    rows = _spread(pages.select(*keys, items).filter("raw IS NOT NULL"))
    return rows.select(*keys, "pos", *[c.alias(name) for name, c in _fields(F.col("pos").cast("long")).items()], "raw")


def _variant(c: Column) -> Column:
    return c.cast("variant")


def _list(names: tuple[str, ...]) -> Column:
    return F.when(F.col(names[0]).isNotNull(), F.to_variant_object(F.array(*[F.col(c) for c in names])))


def changed_regions(regions: DataFrame) -> DataFrame:
    """page_regions whose typed columns may have been changed, or rows of new regions (raw null) → the same with raw as the columns now say. A key is put
    over only where its column differs from what raw says, so an object that nobody changed stays as it was; a bubble that is gone is null."""
    was = _fields(F.col("pos").cast("long"))
    differs = lambda *names: reduce(or_, [~F.equal_null(F.col(c), was[c]) for c in names]) | F.col("raw").isNull()
    box, bubble = ("x", "y", "w", "h"), ("bx", "by", "bw", "bh")
    none = F.parse_json(F.lit("null"))
    news = {
        "id": (("region_id",), _variant(F.col("region_id"))), "bbox": (box, _list(box)), "bubble_bbox": (bubble, F.coalesce(_list(bubble), none)),
        "type": (("block_type",), _variant(F.col("block_type"))),
        **{c: ((c,), _variant(F.col(c))) for c in (*TEXTS, "confidence", "order", *FLAGS)},
    }
    over = F.map_filter(F.create_map(*[x for key, (of, v) in news.items() for x in (F.lit(key), F.when(differs(*of), F.coalesce(v, none)))]), lambda k, v: v.isNotNull())
    df = _spread(regions).select(*regions.columns, over.alias("_over"))  # empty where nothing has changed
    kept = F.map_filter(F.coalesce("raw", F.create_map().cast(_OBJECT)), lambda k, v: ~F.map_contains_key("_over", k))
    return df.withColumn("raw", F.when(F.size("_over") == 0, F.col("raw")).otherwise(F.map_concat(kept, "_over"))).drop("_over")


def page_bodies(pages: DataFrame, regions: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """pages(keys, raw) and their regions, changed or not → (keys, body): JSON with the regions in the order of pos, new ones (pos null) last by id. All
    other keys of a page are as they were read; a page without regions has an empty list if it had one."""
    rows = changed_regions(regions).select(*keys, F.struct(F.col("pos").isNull().alias("new"), "pos", "region_id", F.to_json("raw").alias("json")).alias("r"))
    # One page's regions are one value, as in its document; they are texts before they are shuffled, as each variant would bring its page's keys along.
    whole = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("r"), lambda a, b: _later(a, b)).alias("_regions"))
    objects = pages.select(*keys, F.explode(F.filter(F.array("raw"), lambda o: o.isNotNull())).alias("raw"))
    df = objects.select(*keys, _opened(F.to_json(F.map_filter("raw", lambda k, v: k != "regions"))).alias("_own"),
                                                F.map_contains_key("raw", F.lit("regions")).alias("_had")).join(whole, list(keys), "left")
    listed = F.concat(F.lit('"regions":['), F.array_join(F.transform("_regions", lambda r: r["json"]), ","), F.lit("]"))
    listed = F.when(F.col("_regions").isNotNull(), listed).when(F.col("_had"), F.lit('"regions":[]'))
    comma = F.when((F.col("_own") != "{") & listed.isNotNull(), ",").otherwise("")
    return df.select(*keys, F.concat("_own", comma, F.coalesce(listed, F.lit("")), F.lit("}")).alias("body"))


def _opened(text: Column) -> Column:
    """An object as text without its closing bracket."""
    return F.regexp_replace(text, r"\}$", "")


def _later(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for key in ("region_id", "pos", "new"):
        x, y = a[key].cast("long"), b[key].cast("long")
        out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def write_pages(pages: DataFrame, regions: DataFrame, path: str) -> None:
    """One document a line, in files of text."""
    page_bodies(pages, regions).select("body").write.text(path)


def result_payloads(pages: DataFrame, regions: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """What a finished page reports, (keys, payload) as JSON: pages(keys, source_path, reading_direction, ocr_engine, translator_engine, timings, warnings)
    with all their regions as objects, in the order of `order` and id: every typed column under its key, confidence to four places, and what else raw
    has. A page without regions has an empty list."""
    array = lambda *names: F.when(F.col(names[0]).isNotNull(), F.array(*[F.col(c) for c in names]))
    own = {"id": F.col("region_id"), "bbox": array("x", "y", "w", "h"), "bubble_bbox": array("bx", "by", "bw", "bh"), "type": F.col("block_type"),
           **{c: F.col(c) for c in (*TEXTS, "confidence", "order", *FLAGS)}, "confidence": F.round("confidence", 4)}
    typed = _opened(F.to_json(F.struct(*[v.alias(c) for c, v in own.items()]), {"ignoreNullFields": "false"}))
    more = F.to_json(F.map_filter("raw", lambda k, v: ~k.isin(*own)))
    more = F.when(more == "{}", "}").otherwise(F.concat(F.lit(","), F.substring(more, 2, 1 << 30)))
    rows = regions.select(*keys, F.struct("order", "region_id", F.concat(typed, F.coalesce(more, F.lit("}"))).alias("json")).alias("r"))
    whole = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["json"]), ",").alias("_regions"))  # one page's
    head = F.to_json(F.struct("source_path", "reading_direction", "ocr_engine", "translator_engine", "timings", "warnings"))
    listed = F.concat(F.lit('"regions":['), F.coalesce("_regions", F.lit("")), F.lit("]}"))
    rows = pages.select(*keys, _opened(head).alias("_head")).join(whole, list(keys), "left")
    return rows.select(*keys, F.concat("_head", F.when(F.col("_head") == "{", "").otherwise(","), listed).alias("payload"))


def translation_pairs(regions: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keys, n, text, translation) in reading order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("order", "region_id"))
    return regions.select(*keys, place.cast("long").alias("n"), "text", "translation")
