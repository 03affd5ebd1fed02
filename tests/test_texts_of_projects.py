"""Blocks of names, the same for all pages of a project, lie together in the files that a result is written to."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import localization as loc


def tables(spark, names=4000, pages=4000):
    glossary = spark.range(0, 10 * names, 1, 4).selectExpr("id % 10 AS project_id", "id AS ord", "concat('N', id) AS source", "concat('T', id) AS target")
    return spark.range(0, pages, 1, 4).selectExpr("id AS page_id", "CASE WHEN id % 7 > 0 THEN id % 11 END AS project_id"), glossary


def test_files_hold_a_project_s_text_once(spark, tmp_path):
    pages, glossary = tables(spark)  # 10 texts of 70 kB
    before = F.concat(F.lit("Glossary, use these translations exactly:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.expr("concat('- ', source, ' = ', target)").alias("t")))), lambda r: r["t"]), "\n"))
    want = pages.join(glossary.groupBy("project_id").agg(before.alias("block")), "project_id", "left").select("page_id", F.sha2(F.coalesce("block", F.lit("No glossary.")), 256).alias("b"))
    loc.glossary_blocks(pages, glossary).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(got.select("page_id", F.sha2("block", 256)).collect()) == sorted(want.collect())
    size = sum(map(os.path.getsize, glob.glob(f"{tmp_path}/out/*.parquet")))
    assert size < 10_000_000 < got.agg(F.sum(F.octet_length("block"))).first()[0] / 20


@pytest.mark.parametrize("most", [1 << 10, 1 << 14])
def test_a_large_project_has_several_tasks(spark, monkeypatch, most):
    pages, glossary = tables(spark, 5, 500)
    want = sorted(map(tuple, loc.glossary_blocks(pages, glossary).collect()))
    monkeypatch.setattr(loc, "BLOCKS_BYTES", most)
    monkeypatch.setattr(loc, "BLOCKS_TASK", 1 << 10)
    found = loc.glossary_blocks(pages, glossary)
    assert sorted(map(tuple, found.collect())) == want and len(want) == 500
    own = found.withColumn("task", F.spark_partition_id()).join(pages, "page_id").groupBy("project_id").agg(F.count_distinct("task").alias("n"))
    assert max(r.n for r in own.collect()) > (2 if most < 2000 else 0)
    assert loc.glossary_blocks(pages.limit(0), glossary).count() == 0
