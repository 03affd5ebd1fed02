"""Models in tasks: loads, closes, failures by row, routes; and dilation by ellipses against the definition."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import localization, models, quality

BLOCK = "page_id long, region_id long, text string, translation string, translation_locked boolean, speaker_gender string"


def blocks(spark, rows):
    return spark.createDataFrame([(1, i, t, "old", locked, "") for i, (t, locked) in enumerate(rows)], BLOCK)


def test_one_load_for_each_task_and_route(spark):
    loads, closes, calls = (spark.sparkContext.accumulator(0) for _ in range(3))

    class Model:
        def __init__(self, route):
            if route == "bad":
                raise OSError("no file")
            loads.add(1)
            self.route = route

        def __call__(self, b):
            calls.add(1)
            return b.assign(out=self.route + b.text)

        def close(self):
            closes.add(1)

    rows = [(r, f"{r}{k}") for r in ("a", "b", "bad") for k in range(3000)]
    df = spark.createDataFrame(rows, "route string, text string").repartition(2).sortWithinPartitions("route")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        got = models.apply_loaded_model(df, Model, "text string, out string", "route").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 9000 and loads.value == closes.value == 4 and calls.value >= 12
    assert all((r.out, r.error) == (r.text[0] + r.text, None) for r in got if not r.text.startswith("bad"))
    assert {(r.out, r.error) for r in got if r.text.startswith("bad")} == {(None, "load: OSError: no file")}
    fallen = models.apply_loaded_model(df, Model, "text string, out string", "route", fallback=lambda b: b.assign(out="f")).filter("text LIKE 'bad%'")
    assert {(r.out, r.error) for r in fallen.collect()} == {("f", None)}


def test_failures_are_told_by_row(spark):
    def load(_):
        def model(b):
            if (b.x % 100 == 7).any():
                raise ValueError("seven")
            return b.assign(y=b.x * 2)

        return model

    got = models.apply_loaded_model(spark.range(1000).withColumnRenamed("id", "x").repartition(3), load, "x long, y long").collect()
    assert len(got) == 1000 and all((r.y is None and r.error == "ValueError: seven") if r.x % 100 == 7 else (r.y == 2 * r.x and r.error is None) for r in got)
    assert models.apply_loaded_model(spark.range(0), load, "id long, y long").count() == 0


def test_translation_by_pairs(spark):
    seen = spark.sparkContext.accumulator(0)

    def load(route):
        if route == "en":
            return lambda texts: texts.map(lambda t: (seen.add(1), "" if t == "empty" else f"{route}>{t}")[1])
        raise RuntimeError("no such pair")

    rows = [("hello", False), ("hello", False), ("hello", True), ("empty", False), (" a ", False), ("…!", False), ("日本語", False), ("", False), ("known one", False), (None, False)]
    df = blocks(spark, rows)
    memory = spark.createDataFrame([("known one", "en", "de", "K"), ("known one", "en", "de", "L"), ("hello", "en", "fr", "no"), ("hello", "ru", "de", "no")], "text string, source string, target string, translation string")
    got = {r.region_id: (r.translation, r.warning, r.speaker_gender) for r in models.translate(df, load, "de", memory=memory).collect()}
    assert got == {0: ("en>hello", None, "unknown"), 1: ("en>hello", None, "unknown"), 2: ("old", None, ""), 3: ("empty", None, "unknown"), 4: (" a ", None, "unknown"), 5: ("…!", None, "unknown"),
                   6: ("old", "uncovered", ""), 7: ("", None, "unknown"), 8: ("K", None, "unknown"), 9: (None, None, "unknown")}
    assert seen.value == 2  # hello and empty, once each
    russian = {r.region_id: (r.translation, r.warning) for r in models.translate(blocks(spark, [("привет", False), ("hi there", False)]), load, "de").collect()}
    assert russian == {0: ("old", "no pair ru-de"), 1: ("en>hi there", None)}
    own = models.translate(df, load, "en", source="en").collect()
    assert all(r.translation == (("old" if r.region_id == 2 else rows[r.region_id][0])) for r in own)


def test_memory_by_pair(spark):
    df = spark.createDataFrame([("x y", "en"), ("x y", "fr"), (" a", "en"), ("zz", "en")], "text string, source string")
    memory = spark.createDataFrame([("x y", "en", "T"), ("zz", "fr", "no")], "text string, source string, translation string")
    hits, rest = localization.with_memory(df, memory, pair=("source",))
    assert sorted(map(tuple, hits.collect()), key=repr) == [(" a", "en", " a"), ("x y", "en", "T"), ("x y", "fr", None), ("zz", "en", None)]
    assert sorted(map(tuple, rest.collect())) == [("x y", "fr"), ("zz", "en")]


def test_roles_that_are_set_stay(spark):
    rows = [(1, "mine", False, False, "sfx", "boom"), (2, "kept", True, False, "sfx", "boom"), (3, "", True, False, "sfx", "boom"), (4, None, False, False, "sfx", "ЛОЛ"), (5, " ", False, False, "sfx", "х а х а"), (6, "", False, False, "sign", "a")]
    df = spark.createDataFrame(rows, "id long, role string, manual boolean, edited boolean, block_type string, text string").withColumns({"document": F.lit(False), "bx": F.lit(None).cast("long")})
    catalog = spark.createDataFrame([("sfx",), ("sfx_comedy",)], "role string")
    assert {r.id: r.role for r in localization.assign_roles(df, catalog).collect()} == {1: "mine", 2: "kept", 3: "", 4: "sfx_comedy", 5: "sfx_comedy", 6: ""}


@pytest.mark.parametrize("margin", [0, 1, 2, 3, 6])
def test_dilation_is_by_ellipses(spark, margin):
    # rows of the kernels of 3, 5, 7 and 13 pixels, from the definition: a column j of row i is set within round(r * sqrt(r² - dy²) / r) of the middle
    assert {1: [1, 3, 1], 2: [1, 5, 5, 5, 1], 3: [1, 5, 7, 7, 7, 5, 1]}.get(margin, [2 * w + 1 for _, w in quality.half_widths(margin)]) == [2 * w + 1 for _, w in quality.half_widths(margin)]
    rng = random.Random(margin)
    truth = {(p, rng.randrange(40), rng.randrange(40)) for p in range(3) for _ in range(30 * p)} | {(2, x, 20) for x in range(30)}
    places = [(p, x, y, (p, x, y) in truth) for p in range(3) for x in range(-8, 48) for y in range(-8, 48)]
    df = spark.createDataFrame(places, "page_id long, x long, y long, gt boolean")
    half = lambda dy: round(margin * math.sqrt(margin * margin - dy * dy) / margin) if margin else 0
    want = {(p, x + dx, y + dy) for p, x, y in truth for dy in range(-margin, margin + 1) for dx in range(-half(dy), half(dy) + 1)}
    got = quality.near_truth(df, df, margin).collect()
    assert len(got) == len(places) and {(r.page_id, r.x, r.y) for r in got if r.near} == {w for w in want if -8 <= w[1] < 48 and -8 <= w[2] < 48}
