"""Documents read, changed and written."""

import json

from pyspark.sql import functions as F

from scriptorium.sources import documents, readers

PAGES = [
    {"version": 3, "regions": [
        {"id": 4, "bbox": [1, 2.9, "3", 4], "type": "", "block_type": "sfx", "new": {"deep": [1, {"k": None}]}, "skip": 1, "edited": "false", "manual": None, "bubble_bbox": [0, 0, 9, 9]},
        7, None, {"text": "x", "type": "narration", "block_type": "sign", "confidence": 0.25, "style": {"size": 12.5, "color": [1, 2, 3]}, "overflow": [], "document": {"a": 1}}],
     "strokes": [{"mode": "brush", "radius": 3}], "reading_direction": "rtl", "warnings": ["w", 5], "timings": {"ocr": 1.5}, "extra": {"nested": True}, "big": 12345678901234567890},
    {"regions": [], "note": "ü"},
    {"version": None},
    {"regions": [{"id": 1, "bbox": [0, 0, 5, 5], "text": "a\nb\"c", "translation": "t", "order": 2, "confidence": 1, "speaker": "S"}]},
]


def write(folder, docs):
    folder.mkdir()
    for k, doc in enumerate(docs):
        (folder / f"{k}.json").write_text(doc if isinstance(doc, str) else json.dumps(doc))
    return str(folder)


def named(df):
    return {r.path.rsplit("/", 1)[1][0]: r for r in df.collect()}


def test_fields_and_defaults(spark, tmp_path):
    path = write(tmp_path / "in", [*PAGES, "[1]", "{broken", ""])
    pages = documents.read_pages(spark, path)
    got = named(pages)
    assert (got["0"].version, got["0"].reading_direction, got["0"].warnings, got["0"].timings) == (3, "rtl", ["w", "5"], {"ocr": 1.5})
    assert (got["2"].version, got["2"].reading_direction, got["2"].warnings, got["2"].ocr_engine) == (1, "ltr", [], "")
    regions, bad = readers.read_regions(spark, path)
    assert sorted(r.path[-6] for r in bad.collect()) == ["4", "5"] or bad.count() == 3  # an empty file may give no row
    rows = {(r.path[-6], r.region_id): r for r in regions.collect()}
    assert sorted(rows) == [("0", 3), ("0", 4), ("3", 1)]
    a, b, c = rows["0", 4], rows["0", 3], rows["3", 1]
    assert (a.x, a.y, a.w, a.h, a.block_type, a.class_name, a.bw) == (1, 2, 3, 4, "sfx", "text_free", 9)
    assert (a.skip, a.edited, a.manual, a.overflow) == (True, True, False, False)
    assert (b.block_type, b.confidence, b.overflow, b.document, b.x, b.bx) == ("narration", 0.25, False, True, 0, None)
    assert (c.text, c.order, c.speaker, c.translation_locked) == ('a\nb"c', 2, "S", False)


def objects_only(doc):
    return {**doc, "regions": [r for r in doc["regions"] if isinstance(r, dict)]} if "regions" in doc else doc


def test_untouched_documents_are_written_as_they_were(spark, tmp_path):
    pages = documents.read_pages(spark, write(tmp_path / "in", PAGES))
    got = {k: json.loads(r.body) for k, r in named(documents.page_bodies(pages, documents.page_regions(pages))).items()}
    assert got == {str(k): objects_only(doc) for k, doc in enumerate(PAGES)}
    documents.write_pages(pages, documents.page_regions(pages), str(tmp_path / "out"))
    again = documents.read_pages(spark, str(tmp_path / "out"), lines=True)
    assert sorted(r.body for r in again.collect()) == sorted(r.body for r in documents.page_bodies(pages, documents.page_regions(pages)).collect())


def test_changes_keep_what_nobody_knows(spark, tmp_path):
    pages = documents.read_pages(spark, write(tmp_path / "in", PAGES))
    r = documents.page_regions(pages)
    r = r.withColumn("translation", F.when(F.col("region_id") == 4, "новый").otherwise(F.col("translation"))).withColumn("skip", F.col("skip") & (F.col("region_id") != 4))
    r = r.withColumn("x", F.when(F.col("region_id") == 1, 9).otherwise(F.col("x"))).withColumn("block_type", F.when(F.col("region_id") == 3, "title").otherwise(F.col("block_type")))
    added = r.filter("region_id = 1").withColumns({"region_id": F.lit(50).cast("long"), "pos": F.lit(None).cast("int"), "raw": F.lit(None).cast("map<string,variant>"), "bx": F.lit(None).cast("long")})
    got = {k: json.loads(b.body) for k, b in named(documents.page_bodies(pages, r.unionByName(added))).items()}
    want = [json.loads(json.dumps(objects_only(p))) for p in PAGES]
    want[0]["regions"][0] |= {"translation": "новый", "skip": False}
    want[0]["regions"][1]["type"] = "title"
    want[3]["regions"][0]["bbox"] = [9, 0, 5, 5]
    new = got["3"]["regions"].pop()
    assert got == {str(k): doc for k, doc in enumerate(want)}
    assert (new["id"], new["bbox"], new["text"], new["skip"], new["bubble_bbox"]) == (50, [9, 0, 5, 5], 'a\nb"c', False, None)
    empty = {k: json.loads(b.body) for k, b in named(documents.page_bodies(pages, r.limit(0))).items()}
    assert empty["3"]["regions"] == [] and "regions" not in empty["2"]
