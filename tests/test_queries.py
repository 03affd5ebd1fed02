"""Every registered query against its SQL on the smallest tables, and invariance to row order and partitions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import merge, spatial
from scriptorium.plans import registry
from scriptorium.plans.fixtures import table

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 8)
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


def rows(found, columns, names):
    at = [names.index(c) for c in columns]
    return sorted(repr(tuple(norm(r[i]) for i in at)) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(df.columns)
    assert rows(df.collect(), columns, df.columns) == rows(result.fetchall(), columns, names)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("run", [
    lambda r: spatial.drop_contained(r), lambda r: merge.reading_order(r, "rtl"), lambda r: merge.merge_regions(r, "paragraph"),
    lambda r: spatial.add_second_source(r.filter("region_id % 2 = 0").select("page_id", "region_id", *"xywh"), r.filter("region_id % 2 = 1").select("page_id", "region_id", *"xywh")),
])
def test_order_and_partitions_do_not_matter(spark, run):
    r = table(spark, SF, "regions").filter("page_id < 60").cache()
    a = sorted(map(repr, run(r).collect()))
    b = sorted(map(repr, run(r.orderBy(F.xxhash64("page_id", "region_id")).repartition(7)).collect()))
    assert a == b and a
