"""The corpus operators as registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ans, exact_dedup, fill_middle, lang_id, mixing, packing, quality, sharding, simhash, suffix_dedup, token_counts, warc

N_SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_strings(_table(spark, sf_dir, "documents")).drop("spans")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), [1.0] * N_SHARDS)


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op8_ans_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ans.coded_round_trip(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_quality, op3_simhash, op4_sharding, op5_token_counts, op6_packing, op7_exact_dedup, op8_ans_coding, op9_language_id, op10_mixing, op11_alignment, op12_warc, op13_fill_middle)}

#: CRC-32 as in zlib: the polynomial EDB88320 in a table of 256 made by its rule, folded over the bytes.
_CRC_SQL = """
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i)))
"""
_CRC_OF = """xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: CAST('0x' || p AS BIGINT))),
    lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295)"""

ORACLE_SQL = {
    "op4_sharding": f"""
WITH {_CRC_SQL},
docs AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, strlen(coalesce(text, '')) + 16 AS size, {_CRC_OF} AS text_crc32
         FROM documents, crc_table),
scores AS (SELECT doc_id, k, size, text_crc32, s,
             -ln(CAST(CAST('0x' || substr(md5(k || '/' || s), 1, 13) AS BIGINT) + 1 AS DOUBLE) / 4503599627370496.0) AS score
           FROM docs, range(41) r(s)),
best AS (SELECT doc_id, k, size, text_crc32, arg_min(s, score) FILTER (s < 40) AS shard, arg_min(s, score) AS grown_shard
         FROM scores GROUP BY ALL)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM best""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op10_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
weighted AS (
  SELECT source, sum(size) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM docs GROUP BY source),
ratios AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / w AS ratio, sum(source_size) OVER () AS whole FROM weighted),
levels AS (
  SELECT *, CAST(whole - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ratios WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
targets AS (
  SELECT source, source_size, CASE WHEN ratio >= min(ratio) FILTER (level < ratio) OVER ()
    THEN least(CAST(cap AS DOUBLE), max(level) FILTER (level < ratio) OVER () * w) ELSE CAST(cap AS DOUBLE) END AS target
  FROM levels),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
rests AS (SELECT *, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) AS rest FROM parts),
sums AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM docs)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM sums JOIN rests ON sums.source IS NOT DISTINCT FROM rests.source""",
    "op12_warc": r"""
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS body, lower(trim(coalesce(url, ''))) AS low,
    regexp_extract(lower(trim(coalesce(url, ''))), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www[0-9]*[.])?([^/:?#]+)(?::([0-9]+))?([^#]*)', ['host', 'port', 'rest']) AS p
  FROM pages),
keyed AS (
  SELECT page_id, body, CASE WHEN p.host = '' THEN low ELSE
    array_to_string(list_reverse(string_split(p.host, '.')), ',') || CASE WHEN p.port IN ('', '80', '443') THEN '' ELSE ':' || p.port END
    || ')' || CASE WHEN p.rest = '' THEN '/' ELSE p.rest END END AS url_key,
    sha1(body) AS d, max(page_id) OVER (PARTITION BY body) AS last
  FROM rows)
SELECT page_id, strlen(body) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(d, CAST(10 * (i // 8) + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS INTEGER) + 1, 1)
    for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to,
  url_key, row_number() OVER (ORDER BY url_key, page_id) - 1 AS position
FROM keyed""",
    "op13_fill_middle": """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
drawn AS (SELECT doc_id, t, n, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (n + 1) AS c2,
            CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 AS h4 FROM docs),
formed AS (SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
           FROM drawn),
cut AS (SELECT *, '<P>' || substr(t, 1, a) AS p, '<S>' || substr(t, b + 1) AS s, '<M>' || substr(t, a + 1, b - a) AS m FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN p || s || m WHEN 'spm' THEN s || p || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM cut""",
}
