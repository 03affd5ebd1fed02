"""Tables of the localization model, derived from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REGIONS = """
SELECT page_id, region_id, x, y, w, h, confidence, text, block_type, speaker, speaker_gender, skip, translation_locked,
  CASE WHEN region_id % 5 = 0 THEN '' ELSE CONCAT('t ', text) END AS translation,
  CASE WHEN region_id % 3 = 0 THEN x - 12 END AS bx, CASE WHEN region_id % 3 = 0 THEN y - 9 END AS by,
  CASE WHEN region_id % 3 = 0 THEN w + 24 END AS bw, CASE WHEN region_id % 3 = 0 THEN h + 18 END AS bh,
  CASE WHEN region_id % 4 = 0 THEN 'text_bubble' ELSE 'text_free' END AS class_name,
  region_id % 11 = 0 AS manual, region_id % 13 = 0 AS edited, region_id % 17 = 0 AS overflow, region_id % 7 = 0 AS document
FROM (
  SELECT CAST(FLOOR(l_orderkey / 4) AS BIGINT) AS page_id,
    CAST(ROW_NUMBER() OVER (PARTITION BY CAST(FLOOR(l_orderkey / 4) AS BIGINT)
         ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS region_id,
    CAST((l_partkey * 37 + l_linenumber * 11) % 300 AS BIGINT) AS x,
    CAST((l_suppkey * 53 + l_linenumber * 41) % 400 AS BIGINT) AS y,
    CAST(60 + l_partkey % 80 AS BIGINT) AS w, CAST(18 + l_suppkey % 22 AS BIGINT) AS h,
    CAST(l_quantity AS DOUBLE) / 50.0 AS confidence,
    COALESCE(CASE WHEN l_partkey % 7 = 0 THEN '' WHEN l_linenumber % 4 = 1 THEN UPPER(p_name) ELSE p_name END, '') AS text,
    CASE l_linenumber % 5 WHEN 0 THEN 'sfx' WHEN 1 THEN 'dialogue' WHEN 2 THEN 'narration' WHEN 3 THEN 'title' ELSE 'sign' END AS block_type,
    CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE CONCAT('S', CAST(l_suppkey % 9 AS STRING)) END AS speaker,
    CASE l_partkey % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE '' END AS speaker_gender,
    l_returnflag = 'R' AS skip, l_linestatus = 'F' AS translation_locked
  FROM {lineitem} LEFT JOIN {part} ON p_partkey = l_partkey) r
"""
BUBBLES = """
SELECT CAST(FLOOR(o_orderkey / 4) AS BIGINT) AS page_id, CAST(o_orderkey AS BIGINT) AS bubble_id,
  CAST((o_custkey * 29) % 260 AS BIGINT) AS x, CAST((o_custkey * 47) % 360 AS BIGINT) AS y,
  CAST(120 + o_custkey % 100 AS BIGINT) AS w, CAST(60 + o_custkey % 60 AS BIGINT) AS h FROM {orders}
"""
PAGES = """
SELECT page_id, CAST(page_id % 50 AS STRING) AS project_id, page_id AS pos, CAST(400 + page_id % 3 * 37 AS BIGINT) AS width,
  CAST(460 + page_id % 5 * 23 AS BIGINT) AS height, CONCAT('/src/page', CAST(page_id AS STRING), '.png') AS source_path,
  CASE page_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'offline' WHEN 2 THEN 'error' WHEN 3 THEN 'running' ELSE 'idle' END AS status
FROM (SELECT DISTINCT CAST(FLOOR(o_orderkey / 4) AS BIGINT) AS page_id FROM {orders}) p
"""
PROPOSALS = """
SELECT CAST(FLOOR(l_orderkey / 4) AS BIGINT) AS page_id, CAST(ROW_NUMBER() OVER (PARTITION BY CAST(FLOOR(l_orderkey / 4) AS BIGINT)
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS ord,
  CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE CONCAT('w', CAST(l_partkey % 50 AS STRING)) END AS text,
  CASE l_linenumber % 6 WHEN 0 THEN 'noise?' WHEN 1 THEN 'sfx' WHEN 2 THEN 'dialogue' WHEN 3 THEN 'narration' WHEN 4 THEN 'title' ELSE 'sign' END AS type,
  CAST((l_partkey * 37) % 1040 - 20 AS DOUBLE) AS x0, CAST((l_suppkey * 53) % 1000 AS DOUBLE) + 0.5 AS y0,
  CAST((l_partkey * 37) % 1040 + l_linenumber * 20 - 40 AS DOUBLE) AS x1, CAST((l_suppkey * 53) % 1000 + 30 AS DOUBLE) AS y1
FROM {lineitem}
"""
JOB_EVENTS = """
SELECT event_id, ts, CONCAT(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS job_id, user_id AS device_id,
  CASE event_type WHEN 'view' THEN 'job.started' WHEN 'click' THEN 'job.progress' WHEN 'purchase' THEN 'job.finished'
    WHEN 'error' THEN 'job.failed' ELSE 'job.cancelled' END AS type,
  LEAST(100, GREATEST(0, CAST(FLOOR(value) AS BIGINT))) AS progress FROM {events}
"""
CACHE_ACCESS = """
SELECT event_id, ts, CONCAT('k', CAST(event_id % 97 AS STRING)) AS token, CONCAT('c', CAST(user_id % 5 AS STRING)) AS cache_id,
  CAST(1 + FLOOR(value * 10) AS BIGINT) AS size FROM {events}
"""
VERSIONS = """
SELECT CAST(o_custkey AS BIGINT) AS page_id, CAST(o_orderkey AS BIGINT) AS edit_id, o_orderdate AS ts,
  CAST(o_custkey % 3 AS BIGINT) AS base_version, o_orderstatus AS payload FROM {orders}
"""
QUALITY = """
SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'before' ELSE 'after' END AS run_id, CAST(l_orderkey AS BIGINT) AS page,
  CAST(COUNT(*) AS BIGINT) AS n, ROUND(MAX(CAST(l_quantity AS DOUBLE)) / 50.0, 4) AS recall,
  ROUND(MIN(CAST(l_quantity AS DOUBLE)) / 50.0, 4) AS hit6, ROUND(SUM(CAST(l_discount AS DOUBLE)), 4) AS seconds
FROM {lineitem} GROUP BY 1, 2
"""
SUBMISSIONS = """
SELECT event_id AS sub_id, ts, user_id AS device_id, CONCAT('https://h', CAST(user_id % 7 AS STRING), '.example/p', CAST(event_id % 31 AS STRING), '#f', CAST(event_id AS STRING)) AS page_url,
  CASE WHEN event_id % 41 = 0 THEN 'blob:x' ELSE CONCAT('/i', CAST(event_id % 23 AS STRING), '.png') END AS image_url,
  CONCAT('sha', CAST(event_id % 211 AS STRING)) AS image_sha, CASE WHEN event_id % 3 = 0 THEN ' EN' ELSE 'ja ' END AS source_lang,
  CASE WHEN event_id % 19 = 0 THEN '' ELSE 'ru' END AS target_lang, CONCAT('fp', CAST(user_id % 4 AS STRING)) AS fingerprint,
  CAST(FLOOR(value * 1000000) AS BIGINT) AS bytes, CAST(1000 + event_id % 9000 AS BIGINT) AS width, CAST(800 + event_id % 7000 AS BIGINT) AS height,
  event_id % 10 = 0 AS fresh, event_type FROM {events}
"""
RUN_PAGES = """
SELECT CAST(o_custkey % 20 AS STRING) AS run_id, CAST(o_orderkey AS STRING) AS id, CONCAT('img', CAST(o_orderkey AS STRING)) AS image,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'error' ELSE 'pending' END AS status, CAST(o_orderkey % 97 AS DOUBLE) / 4 AS seconds,
  CASE WHEN o_orderstatus = 'O' THEN CONCAT('e', CAST(o_orderkey % 5 AS STRING)) ELSE '' END AS error, CAST(o_orderkey % 3 AS BIGINT) AS n_warnings,
  CONCAT('s', CAST(o_custkey AS STRING)) AS source_sha, CONCAT('r', CAST(o_custkey % 11 AS STRING)) AS result_sha FROM {orders}
"""
MIXED_DOCS = """
SELECT doc_id, lang, source, CASE doc_id % 4
  WHEN 0 THEN TRANSLATE(text, 'aeinorst', 'аеинорст')
  WHEN 1 THEN TRANSLATE(text, 'abcdefghiklmnoprstu', 'абцдефгхиклмнопрсту')
  WHEN 2 THEN TRANSLATE(text, 'aehilnoprstu', 'あえひいるのおぷらさたう')
  ELSE text END AS text FROM {documents}
"""
#: One row per pixel of 16 x 16 pixels a page.
PIXELS = """
SELECT page_id, CAST(i % 16 AS BIGINT) AS x, CAST(FLOOR(i / 16) AS BIGINT) AS y,
  CAST((page_id * 31 + i * 17) % 256 AS BIGINT) AS r, CAST((page_id * 7 + i * 29) % 256 AS BIGINT) AS g, CAST((i * 13) % 256 AS BIGINT) AS b,
  CAST((page_id * 31 + i * 17 + i % 3 * 9) % 256 AS BIGINT) AS r2,
  (i % 16 BETWEEN 4 AND 11) AND (i BETWEEN 64 AND 191) AS gt, (page_id * 13 + i * 7) % 5 < 2 AS pred, CAST(FLOOR(i / 64) AS BIGINT) AS comp_id
FROM (SELECT page_id, {each_pixel} AS i FROM (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS page_id FROM {orders}) p) z
"""
#: Lines of documents; the two engines split differently.
BLOCKS_SPARK = """
SELECT page_id, CAST(ord AS BIGINT) AS ord, text, lang FROM (SELECT doc_id AS page_id, p.pos AS ord, p.col AS text, lang
  FROM {documents} LATERAL VIEW POSEXPLODE(SPLIT(text, '\\n')) p AS pos, col) t WHERE LENGTH(TRIM(text)) > 0
"""
BLOCKS_DUCK = """
SELECT page_id, CAST(ord AS BIGINT) AS ord, text, lang FROM (SELECT doc_id AS page_id, UNNEST(RANGE(LEN(STRING_SPLIT(text, CHR(10))))) AS ord,
  UNNEST(STRING_SPLIT(text, CHR(10))) AS text, lang FROM documents) t WHERE LENGTH(TRIM(text)) > 0
"""

_SQL = {
    "regions": REGIONS, "bubbles": BUBBLES, "sheets": PAGES, "proposals": PROPOSALS, "job_events": JOB_EVENTS, "cache_access": CACHE_ACCESS,
    "versions": VERSIONS, "quality": QUALITY, "submissions": SUBMISSIONS, "run_pages": RUN_PAGES, "mixed_docs": MIXED_DOCS, "pixels": PIXELS,
}
_TABLES = ("lineitem", "part", "orders", "events", "documents", "nation", "customer", "supplier", "pages", "conversations", "labels", "benchmark")


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Orders whose pages make one part of the pixels: some 850,000 pixels, which a task sorts in memory.
PART = 50_000


def pixel_parts(spark: SparkSession, sf_dir: str) -> int:
    """In how many parts the pixels' pages are dealt: by the rows they come from, as the page numbers alone look small to Spark."""
    return max(spark.sparkContext.defaultParallelism, -(-given(spark, sf_dir, "orders").count() // PART))


_PAGE = "CAST(FLOOR(l_orderkey / 4) AS BIGINT)"


def _paged(sql: str) -> str:
    """The same rows by a plan that knows them to be dealt by page_id: the page is worked out below the window, as a column that the window and the
    result share. So what goes by page after it needs no second shuffle."""
    rows = next(r for r in ("{lineitem} LEFT JOIN {part} ON p_partkey = l_partkey", "{lineitem}") if r in sql)
    sql = sql.replace(f"{_PAGE} AS page_id", "page_id").replace(f"PARTITION BY {_PAGE}", "PARTITION BY page_id")
    return sql.replace(f"FROM {rows}", f"FROM (SELECT *, {_PAGE} AS page_id FROM {rows}) p")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table in Spark. Pixels are dealt by page before they are 256 rows each; what goes by page needs no other shuffle of them."""
    sql = BLOCKS_SPARK if name == "blocks" else _SQL[name]
    sql = sql.replace("{each_pixel}", "EXPLODE(SEQUENCE(0, 255))")
    if name in ("regions", "proposals"):
        sql = _paged(sql)
    found = {t: given(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in sql}
    if name == "pixels":
        found["orders"] = found["orders"].select("o_custkey").repartition(pixel_parts(spark, sf_dir), "o_custkey")
    return spark.sql(sql, **found)


def duck(*names: str) -> str:
    """The WITH clause of derived tables for DuckDB."""
    parts = [f"{n} AS MATERIALIZED ({BLOCKS_DUCK if n == 'blocks' else _SQL[n].format(each_pixel='UNNEST(RANGE(256))', **{t: t for t in _TABLES})})" for n in names]
    return "WITH " + ",\n".join(parts)
