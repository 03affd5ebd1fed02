"""Merging of regions is one fold over pages that are dealt once."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import grid
from scriptorium.operators import merge, spatial
from scriptorium.plans import registry

SF = "/root/testdata/sf0.001"
SCHEMA = ("page_id long, region_id long, x long, y long, w long, h long, confidence double, block_type string, class_name string, text string, translation string, document boolean, "
          "bx long, by long, bw long, bh long")  # fmt: skip


@pytest.mark.parametrize("name", ["a01_merge_regions", "j07_merge_collinear"])
def test_regions_are_dealt_once(spark, capsys, name):
    registry.QUERIES[name](spark, SF).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1  # several before


def test_rows_of_one_id_and_rows_without(spark):
    none = (None,) * 4
    rows = [
        (1, 1, 0, 0, 50, 20, 0.5, "sign", "text_free", " a ", "A", False, *none), (1, 1, 0, 40, 50, 20, None, "dialogue", None, None, "", None, *none),
        (1, 2, 52, 0, 50, 20, 0.9, "title", "text_free", "b", "B", False, *none), (1, 3, 104, 0, None, 20, 0.1, "sign", "text_free", "c", "C", False, *none),
        (1, None, 52, 0, 50, 20, 0.2, None, "text_bubble", "d", "D", True, 1, None, 3, 4), (None, 1, 5, 5, 9, 9, None, None, None, None, None, None, None, 7, 7, 7),
    ]
    got = merge.merge_regions(spark.createDataFrame(rows, SCHEMA), "collinear").select("page_id", "region_id", *"xywh", "confidence", "n", "block_type", "class_name", "text", "document", "bx", "by").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([
        (1, 1, 0, 0, 102, 60, 0.9, 3, "dialogue", "text_free", "a b", False, None, None), (1, 3, 104, 0, None, 20, 0.1, 1, "sign", "text_free", "c", False, None, None),
        (1, None, 52, 0, 50, 20, 0.2, 1, None, "text_bubble", "d", True, 1, None), (None, 1, 5, 5, 9, 9, None, 1, None, None, None, None, None, None),
    ], key=repr)


def test_pairs_by_the_index_and_without(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(p, i, rng.randrange(200), rng.randrange(150), rng.randrange(0, 60), rng.randrange(0, 30), 0.5, "sign", "text_free", "t", "t", False, *(None,) * 4) for p in range(4) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = []
    for small in (128, 5):
        monkeypatch.setattr(grid, "SMALL", small)
        found.append({k: sorted(map(tuple, spatial.merge_pairs(df, k).collect())) for k in ("paragraph", "column", "collinear")})
    assert found[0] == found[1] and all(found[0].values())


def test_a_large_page_takes_no_square_of_its_boxes(spark):
    n = 40_000
    df = spark.range(0, n, 1, 4).selectExpr("1L AS page_id", "id AS region_id", "id % 200 * 70 AS x", "id div 200 * 30 AS y", "60L AS w", "20L AS h", "false AS document", "'sign' AS block_type", *[f"cast(null as long) AS b{c}" for c in "xywh"])
    assert spatial.merge_pairs(df, "collinear").count() == 0  # 800 million pairs before
    near = df.withColumn("x", F.expr("x - region_id % 2 * 8"))
    assert spatial.merge_pairs(near, "collinear").count() == n // 2
