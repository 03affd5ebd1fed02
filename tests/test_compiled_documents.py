"""Documents are read and written in methods that the JVM compiles: those of over 8000 bytes stay interpreted."""

import json
import re

from pyspark.sql import functions as F

from scriptorium.sources import documents


def test_no_method_is_too_long_to_compile(spark, tmp_path, capsys):
    (tmp_path / "in.json").write_text('{"regions": [{"id": 1, "skip": true}]}\n')
    pages = documents.read_pages(spark, str(tmp_path / "in.json"), lines=True)
    r = documents.page_regions(pages).withColumn("translation", F.concat(F.lit("«"), "text", F.lit("»")))
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # its plans show no code before they run
    try:
        documents.page_bodies(pages, r).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    found = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert len(found) > 2 and max(found) < 8000  # 33,758 before


def test_flags_of_all_kinds(spark, tmp_path):
    values = [True, False, 0, 1, 0.0, 0.5, "", "0", "false", [], [0], {}, {"a": 0}, None]
    (tmp_path / "in.json").write_text(json.dumps({"regions": [{"id": i, "skip": v} for i, v in enumerate(values)] + [{"id": 99}]}))
    r = documents.page_regions(documents.read_pages(spark, str(tmp_path / "in.json")))
    assert {x.region_id: x.skip for x in r.collect()} == {i: bool(v) for i, v in enumerate(values)} | {99: False}
