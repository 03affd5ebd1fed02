"""Derived tables are dealt by page once, texts for readers are compressed, and pairs alone go through the fold of components."""

import os

from pyspark.sql import functions as F

from scriptorium.functions.shared import drop_temporary, text_files
from scriptorium.operators import merge
from scriptorium.plans.fixtures import table

SF = "/root/testdata/sf0.001"


def test_regions_are_dealt_by_page_once(spark, capsys):
    table(spark, SF, "regions").groupBy("page_id").agg(F.collect_list("region_id")).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1  # 2 before


def test_texts_are_compressed(spark):
    path = text_files(spark.range(0, 5000, 1, 2).selectExpr("concat('line ', id) AS value"), "lines")
    names = [n for n in os.listdir(path.removeprefix("file://")) if n.startswith("part-")]
    assert names and all(n.endswith(".gz") for n in names) and spark.read.text(path).distinct().count() == 5000
    drop_temporary(spark)


def test_nodes_without_pairs_are_their_own_roots(spark, capsys):
    nodes = spark.createDataFrame([(p, i) for p in (1, 2) for i in range(1, 6)], "page_id long, region_id long")
    pairs = spark.createDataFrame([(1, 2, 4), (1, 4, 5)], "page_id long, a long, b long")
    found = merge.page_components(nodes, pairs)
    assert {(r.page_id, r.region_id): r.root for r in found.collect()} == {(p, i): 2 if (p, i) in ((1, 4), (1, 5)) else i for p in (1, 2) for i in range(1, 6)}
    found.explain()
    assert "Union" not in capsys.readouterr().out  # all nodes went through the fold before
