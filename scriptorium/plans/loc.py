"""Queries over texts, replies, glossaries and memory with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import localization as loc
from ..operators import models
from .fixtures import duck, given, table

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return put


_KEYS = ("page_id", "region_id")
_C, _L = r"\x{0400}-\x{052F}\x{1C80}-\x{1C8F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}", r"A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}"


def _scripts(t: str) -> str:
    letters = f"regexp_replace(coalesce({t}, ''), '[^\\p{{L}}]', '', 'g')"
    return f"length(regexp_replace({letters}, '[^{_C}]', '', 'g')) AS cyr, length(regexp_replace({letters}, '[^{_L}]', '', 'g')) AS lat, length({letters}) AS letters"


_COUNTED = duck("mixed_docs") + f", n AS (SELECT *, {_scripts('text')} FROM mixed_docs), c AS (SELECT *, letters - cyr - lat AS other FROM n)"
_ROUTE = "CASE WHEN other > cyr AND other > lat THEN 'uncovered' WHEN cyr = 0 AND lat = 0 THEN 'skip' WHEN cyr >= lat THEN 'skip' ELSE 'en' END"
_LEAK = "(lat + other > 0 AND (cyr = 0 OR (lat + other >= 4 AND 4 * (lat + other) >= letters)))"


@query("a05_route_blocks", _COUNTED + f" SELECT lang, {_ROUTE} AS route, count(*) AS n, CAST(sum(cyr) AS BIGINT) AS cyr, CAST(sum(lat) AS BIGINT) AS lat, CAST(sum(other) AS BIGINT) AS other FROM c GROUP BY ALL")
def route(s, d):
    df = loc.route_blocks(table(s, d, "mixed_docs"), "ru")
    return df.groupBy("lang", "route").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("cyr", "lat", "other")])


#: The leak rule by tokens: what is looked over, tokens with the part before them, and their letters that count.
_OVERLOOKED = r"(?i)https?://[^ \t\n\x0b\f\r]+|www\.[^ \t\n\x0b\f\r]+|[\p{L}\p{N}_-]+\.(?:com|net|org|ru|io|me|dev|art|adult|co)(?:/[^ \t\n\x0b\f\r]*)?"


def _own(t: str) -> str:
    return f"""regexp_replace(regexp_replace(coalesce({t}, ''), '«[^»]*»|“[^”]*”|"[^"]*"', ' ', 'g'), '{_OVERLOOKED}', ' ', 'g')"""


def _tokens(source: str, text: str, keys: str) -> str:
    """CTEs from a table to k: keys, cyr, lat, other by tokens."""
    letters = "regexp_replace(tok, '[^\\p{L}]', '', 'g')"
    return f"""o AS MATERIALIZED (SELECT *, regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_''’]+|[.!?…\\n\\r]') AS parts FROM {source}), i AS (SELECT {keys}, unnest(parts) AS tok, unnest(range(len(parts))) AS k FROM o),
l AS (SELECT {keys}, tok, lag(tok) OVER (PARTITION BY {keys} ORDER BY k) AS prev, {letters} AS ls, regexp_replace({letters}, '[^{_L}]', '', 'g') AS lt FROM i),
c AS (SELECT {keys}, length(regexp_replace(ls, '[^{_C}]', '', 'g')) AS cyr, length(ls) AS ls, length(lt) AS lt, CASE WHEN length(lt) >= 4 AND NOT regexp_matches(tok, '[\\p{{N}}_]') AND length(regexp_replace(lt, '[^\\p{{Lu}}]', '', 'g')) < length(lt)
  AND NOT (prev IS NOT NULL AND NOT regexp_matches(prev, '^[.!?…\\n\\r]$') AND regexp_matches(lt, '^\\p{{Lu}}')) THEN length(lt) ELSE 0 END AS lat FROM l),
k AS (SELECT {', '.join('o.' + x.strip() for x in keys.split(','))}, coalesce(sum(cyr), 0) AS cyr, coalesce(sum(lat), 0) AS lat, coalesce(sum(ls - cyr - lt), 0) AS other FROM o LEFT JOIN c USING ({keys}) GROUP BY ALL)"""


_FOREIGN = "(lat + other > 0 AND (cyr = 0 OR (lat + other >= 4 AND 4 * (lat + other) >= cyr + lat + other)))"


@query("a06_leak_audit", duck("mixed_docs") + f", s AS (SELECT doc_id, {_own('text')} AS t FROM mixed_docs), {_tokens('s', 't', 'doc_id')} SELECT lang, source, count(*) AS n, CAST(count_if({_FOREIGN}) AS BIGINT) AS n_leak, round(avg(CAST({_FOREIGN} AS INTEGER)), 6) AS rate FROM k JOIN mixed_docs USING (doc_id) GROUP BY ALL")
def _(s, d):
    return loc.leak_audit(table(s, d, "mixed_docs"), "ru", ["lang", "source"])


@query("a06_leak_tokens", duck("mixed_docs") + f", s AS (SELECT doc_id, replace({_own('text')}, 'ther', ' ') AS t FROM mixed_docs), {_tokens('s', 't', 'doc_id')} SELECT doc_id, CAST(cyr AS BIGINT) AS cyr, CAST(lat AS BIGINT) AS lat, CAST(other AS BIGINT) AS other, {_FOREIGN} AS leak FROM k")
def _(s, d):
    return loc.leak_tokens(table(s, d, "mixed_docs"), "ru", ("ther",)).select("doc_id", "cyr", "lat", "other", "leak")


_SAID = "CASE region_id % 4 WHEN 0 THEN concat('\"', text, '\" ok') WHEN 1 THEN concat(text, ' www.', text) WHEN 2 THEN concat('x ', lower(text)) ELSE concat('red.com/', text) END"


@query("u04_unchanged_words", duck("regions") + f""", t AS (SELECT page_id, region_id, {_own('text')} AS a, {_own(_SAID)} AS b FROM regions)
SELECT page_id, region_id, len(list_intersect(list_transform(regexp_extract_all(a, '\\b(?:[A-Z]{{4,}}|[a-z]{{4,}})\\b'), lambda w: lower(w)), list_transform(regexp_extract_all(b, '\\b[A-Za-z]{{4,}}\\b'), lambda w: lower(w)))) > 0 AS unchanged FROM t""")
def _(s, d):
    return loc.unchanged_words(table(s, d, "regions").withColumn("translation", F.expr(_SAID)), "ru").select(*_KEYS, "unchanged")


_SFX = "sfx AS (SELECT DISTINCT upper(p_name) AS source, first('s' || p_partkey ORDER BY p_partkey) AS value FROM part WHERE p_partkey % 3 = 0 GROUP BY upper(p_name))"


def _sfx(s, d):
    part = given(s, d, "part").filter("p_partkey % 3 = 0")
    return part.groupBy(F.upper("p_name").alias("source")).agg(F.min_by(F.concat(F.lit("s"), "p_partkey"), "p_partkey").alias("value"))


@query("j08_lookup_sfx", duck("regions") + f", {_SFX}" + r""", k AS (SELECT r.*, value FROM regions r LEFT JOIN sfx ON block_type = 'sfx' AND source = upper(regexp_replace(text, '^[\s.!?,;:…-]+|[\s.!?,;:…-]+$', '', 'g')))
SELECT page_id, region_id, value, 'hit' AS kind FROM k WHERE value IS NOT NULL UNION ALL SELECT page_id, region_id, NULL, 'pending' FROM k WHERE value IS NULL AND NOT translation_locked""")
def _(s, d):
    hit, pending = loc.lookup_sfx(table(s, d, "regions"), _sfx(s, d), "ru")
    return hit.select(*_KEYS, "value", F.lit("hit").alias("kind")).unionByName(pending.select(*_KEYS, F.lit(None).cast("string").alias("value"), F.lit("pending").alias("kind")))


@query("j09_overlay_glossary", """SELECT coalesce(a.source, b.source) AS source, coalesce(b.target, a.target) AS target FROM (SELECT c_name AS source, 'b' || c_nationkey AS target FROM customer) a
FULL JOIN (SELECT s_name AS source, 'u' || s_nationkey AS target FROM supplier UNION ALL SELECT c_name, 'u' || c_custkey FROM customer WHERE c_custkey % 3 = 0) b ON a.source = b.source""")
def _(s, d):
    c, sup = given(s, d, "customer"), given(s, d, "supplier")
    user = sup.selectExpr("s_name AS source", "'u' || s_nationkey AS target").unionByName(c.filter("c_custkey % 3 = 0").selectExpr("c_name AS source", "'u' || c_custkey AS target"))
    return loc.overlay_glossary(c.selectExpr("c_name AS source", "'b' || c_nationkey AS target"), user)


@query("a03_build_glossary", duck("regions") + """, e AS (SELECT * FROM (VALUES ('S1', 'T1', '', 'n1'), ('S2', 'T2', 'unknown', ''), ('Zoe', 'Z', '', 'by hand')) v(source, target, gender, note)),
f AS (SELECT trim(speaker) AS source, first(speaker_gender ORDER BY page_id, region_id) FILTER (speaker_gender <> '') AS found FROM regions WHERE trim(speaker) <> '' GROUP BY 1)
SELECT source, coalesce(target, '') AS target, CASE WHEN trim(gender) <> '' THEN gender ELSE coalesce(found, '') END AS gender, coalesce(note, '') AS note FROM f FULL JOIN e USING (source)""")
def _(s, d):
    existing = s.createDataFrame([("S1", "T1", "", "n1"), ("S2", "T2", "unknown", ""), ("Zoe", "Z", "", "by hand")], "source string, target string, gender string, note string")
    return loc.build_glossary(table(s, d, "regions"), existing)


@query("a03_normalize_glossary", "SELECT 'Name ' || c_custkey % 97 AS source, first(t ORDER BY c_custkey) AS target, first(g ORDER BY c_custkey) AS gender, '' AS note FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'T' || c_custkey ELSE '' END AS t, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE '' END AS g FROM customer WHERE c_custkey % 7 > 0) GROUP BY 1")
def _(s, d):
    e = given(s, d, "customer").selectExpr("c_custkey AS ord", "CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE concat(' Name ', c_custkey % 97, ' ') END AS source", "CASE WHEN c_custkey % 3 > 0 THEN concat('T', c_custkey) END AS target", "CASE WHEN c_custkey % 2 = 0 THEN ' male' END AS gender", "CAST(NULL AS STRING) AS note")
    return loc.normalize_glossary(e)


@query("a04_glossary_blocks", duck("sheets") + """, g AS (SELECT (c_custkey % 60)::VARCHAR AS project_id, 'Glossary, use these translations exactly:' || chr(10) || string_agg('- N' || c_custkey || ' = T' || c_custkey, chr(10) ORDER BY c_custkey) AS block FROM customer WHERE c_custkey % 60 <> 7 GROUP BY 1)
SELECT page_id, coalesce(block, 'No glossary.') AS block FROM sheets LEFT JOIN g USING (project_id)""")
def _(s, d):
    g = given(s, d, "customer").filter("c_custkey % 60 <> 7").selectExpr("CAST(c_custkey % 60 AS STRING) AS project_id", "c_custkey AS ord", "concat('N', c_custkey) AS source", "concat('T', c_custkey) AS target")
    return loc.glossary_blocks(table(s, d, "sheets"), g)


@query("a04_page_script", duck("regions") + """, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x, region_id) - 1 AS ord FROM regions WHERE block_type IN ('dialogue', 'narration', 'title'))
SELECT page_id, string_agg(region_id || '. [' || block_type || '] ' || text, chr(10) ORDER BY ord) AS script FROM o GROUP BY page_id""")
def _(s, d):
    return loc.page_script(loc.story_order(table(s, d, "regions")))


@query("a04_conversation_script", "SELECT conv_id AS page_id, string_agg(turn || '. [' || role || '] ' || coalesce(text, ''), chr(10) ORDER BY turn, role || '. ') AS script FROM (SELECT conv_id, turn, role, min(text) AS text FROM conversations GROUP BY ALL) GROUP BY 1")
def _(s, d):
    c = given(s, d, "conversations").groupBy("conv_id", "turn", "role").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    return loc.page_script(c.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("region_id"), F.col("turn").alias("ord"), F.col("role").alias("block_type"), "text"))


_REPLIES = """replies AS (SELECT page_id, region_id - region_id % 2 AS region_id, region_id AS ord, CASE WHEN region_id % 6 = 1 THEN '  ' ELSE ' r' || ord_ || ' ' END AS translation,
  speaker, CASE WHEN region_id % 4 = 1 THEN 'FEMALE' ELSE speaker_gender END AS speaker_gender FROM (SELECT *, region_id AS ord_ FROM regions) q WHERE region_id % 5 < 3)"""


def _replies(r):
    return r.filter("region_id % 5 < 3").selectExpr(
        "page_id", "region_id - region_id % 2 AS region_id", "region_id AS ord", "CASE WHEN region_id % 6 = 1 THEN '  ' ELSE concat(' r', region_id, ' ') END AS translation",
        "speaker", "CASE WHEN region_id % 4 = 1 THEN 'FEMALE' ELSE speaker_gender END AS speaker_gender")


@query("j10_apply_replies", duck("regions") + f", {_REPLIES}" + """, l AS (SELECT page_id, region_id, arg_max(translation, ord) AS t, arg_max(speaker, ord) AS s, arg_max(speaker_gender, ord) AS g, true AS got FROM replies GROUP BY ALL)
SELECT page_id, region_id, CASE WHEN got AND NOT translation_locked THEN trim(t) ELSE translation END AS translation, CASE WHEN got AND NOT translation_locked THEN trim(s) ELSE speaker END AS speaker,
  CASE WHEN got AND NOT translation_locked THEN CASE WHEN lower(g) IN ('male', 'female', 'unknown') THEN lower(g) ELSE 'unknown' END ELSE speaker_gender END AS speaker_gender FROM regions LEFT JOIN l USING (page_id, region_id)""")
def _(s, d):
    r = table(s, d, "regions")
    return loc.apply_replies(r, _replies(r)).select(*_KEYS, "translation", "speaker", "speaker_gender")


@query("j11_missing_replies", duck("regions") + f", {_REPLIES}" + """ SELECT page_id, string_agg(region_id::VARCHAR, ',' ORDER BY region_id) AS untranslated FROM regions ANTI JOIN (SELECT * FROM replies WHERE trim(translation) <> '') x USING (page_id, region_id) GROUP BY 1""")
def _(s, d):
    r = table(s, d, "regions")
    return loc.missing_by_page(r, _replies(r))


#: A memory of pairs of languages; a third of the texts has another source.
_PAIRS = "CASE WHEN region_id % 3 = 0 THEN 'fr' ELSE 'en' END AS source"
_MEMORY = """m AS (SELECT p_name AS text, CASE WHEN p_partkey % 4 = 0 THEN 'fr' ELSE 'en' END AS source, min('m' || p_partkey) AS t FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL),
r AS (SELECT page_id, region_id, CASE region_id % 7 WHEN 0 THEN concat(' ', substr(text, 1, 1), ' ') ELSE text END AS text, """ + _PAIRS + " FROM regions)"


def _remembered(s, d):
    memory = given(s, d, "part").filter("p_partkey % 2 = 0").selectExpr("p_name AS text", "CASE WHEN p_partkey % 4 = 0 THEN 'fr' ELSE 'en' END AS source", "concat('m', p_partkey) AS translation")
    blocks = table(s, d, "regions").selectExpr(*_KEYS, "CASE region_id % 7 WHEN 0 THEN concat(' ', substr(text, 1, 1), ' ') ELSE text END AS text", _PAIRS)
    return loc.with_memory(blocks, memory, pair=("source",))


@query("j12_memory", duck("regions") + f", {_MEMORY} SELECT page_id, region_id, CASE WHEN length(trim(r.text)) < 2 THEN r.text ELSE t END AS translated FROM r LEFT JOIN m ON r.text = m.text AND r.source = m.source")
def _(s, d):
    return _remembered(s, d)[0].select(*_KEYS, "translated")


@query("j12_to_translate", duck("regions") + f", {_MEMORY} SELECT DISTINCT text, source FROM r WHERE length(trim(text)) >= 2 AND NOT EXISTS (SELECT 1 FROM m WHERE m.text = r.text AND m.source = r.source)")
def _(s, d):
    return _remembered(s, d)[1]


_STYLED = "*, region_id % 5 AS auto_layout, concat(region_id % 7, ',1') AS text_position, concat('s', region_id % 3) AS style"
_NEW = """page_id, region_id, CASE WHEN page_id % 6 = 1 AND region_id = 2 THEN x + 1 ELSE x END AS x, y, w, h, CASE WHEN page_id % 11 = 2 AND region_id = 3 THEN bx + 1 ELSE bx END AS bx, p.by, bw, bh, skip, block_type, text,
  CASE WHEN page_id % 13 = 3 AND region_id = 1 THEN 9 ELSE auto_layout END AS auto_layout, CASE WHEN page_id % 3 = 1 AND region_id % 4 = 1 THEN 'new' ELSE translation END AS translation,
  CASE WHEN page_id % 7 = 4 AND region_id = 2 THEN NULL ELSE text_position END AS text_position, speaker, speaker_gender, CASE WHEN page_id % 5 = 3 AND region_id = 1 THEN 'bold' ELSE style END AS style"""
#: The fields that _NEW changes.
_AFTER = {m[1]: m[0].removesuffix(f" AS {m[1]}") for m in re.findall(r"(CASE WHEN (?:(?!CASE).)* END AS (\w+))", _NEW, re.S)}
_PAPER = "page_id, concat('k', page_id % 9) AS strokes, 'ltr' AS direction"
_NEW_PAPER = "page_id, CASE WHEN page_id % 17 = 5 THEN 'k' ELSE concat('k', page_id % 9) END AS strokes, CASE WHEN page_id % 19 = 6 THEN 'rtl' ELSE 'ltr' END AS direction"
_KEPT = "NOT (page_id % 31 = 7 AND region_id = 1)"
_C_FIELDS, _T_FIELDS = (", ".join(f"{{t}}.{c}" for c in f) for f in (loc.CLEAN_FIELDS, loc.TYPESET_FIELDS))


@query("j13_diff_documents", duck("regions", "sheets") + f""", p AS MATERIALIZED (SELECT {_STYLED} FROM regions), n AS MATERIALIZED (SELECT {_NEW} FROM p WHERE {_KEPT}),
d AS (SELECT coalesce(p.page_id, n.page_id) AS page_id, coalesce(p.region_id, n.region_id) AS id, p.x IS NULL OR n.x IS NULL AS lone, ({_C_FIELDS.format(t='p')}) IS DISTINCT FROM ({_C_FIELDS.format(t='n')}) AS c,
  ({_T_FIELDS.format(t='p')}) IS DISTINCT FROM ({_T_FIELDS.format(t='n')}) AS t FROM p FULL JOIN n ON p.page_id = n.page_id AND p.region_id = n.region_id),
g AS (SELECT page_id, bool_or(lone) AS lone, bool_or(c) AS c, bool_or(t) AS t, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (t), '') AS some_, string_agg(id::VARCHAR, ',' ORDER BY id) AS all_ FROM d GROUP BY 1),
s AS (SELECT page_id, page_id % 17 = 5 AS drawn, page_id % 19 = 6 AS turned FROM sheets)
SELECT page_id, CASE WHEN drawn OR coalesce(lone, false) OR coalesce(c, false) THEN 'clean' WHEN turned OR coalesce(t, false) THEN 'typeset' ELSE 'none' END AS plan,
  CASE WHEN coalesce(lone, false) THEN '' WHEN turned THEN coalesce(all_, '') ELSE coalesce(some_, '') END AS ids FROM s FULL JOIN g USING (page_id)""")
def _(s, d):
    r, sheets = s.sql(f"SELECT {_STYLED} FROM {{r}}", r=table(s, d, "regions")), table(s, d, "sheets")
    # Both versions come from one table, which is dealt once.
    old, new = (f"named_struct({', '.join(f'{c!r}, {_AFTER.get(c, c) if n else c}' for c in (*loc.CLEAN_FIELDS, *loc.TYPESET_FIELDS))})" for n in (False, True))
    both = r.selectExpr("page_id", "region_id", f"inline(array(struct({old} AS p, NULL AS n), struct(NULL AS p, CASE WHEN {_KEPT} THEN {new} END AS n)))")
    both = both.filter("p IS NOT NULL OR n IS NOT NULL")
    return loc.diff_versions(both, s.sql(f"SELECT {_PAPER} FROM {{p}}", p=sheets), s.sql(f"SELECT {_NEW_PAPER} FROM {{p}}", p=sheets))


_TOKEN = "sha256('v2|' || lower(trim(image_sha)) || '|' || lower(trim(source_lang)) || '|' || lower(trim(target_lang)) || '|' || lower(trim(fingerprint)))"


@query("j14_cache_lookup", duck("submissions") + f", t AS (SELECT *, {_TOKEN} AS token FROM submissions), c AS (SELECT DISTINCT token FROM t WHERE sub_id % 7 = 0) SELECT sub_id, token, token IN (SELECT token FROM c) AND NOT fresh AS hit FROM t")
def _(s, d):
    subs = table(s, d, "submissions")
    token = loc.cache_token([F.col(c) for c in ("image_sha", "source_lang", "target_lang", "fingerprint")])
    return loc.cache_lookup(subs, subs.filter("sub_id % 7 = 0").select(token.alias("token"))).select("sub_id", "token", "hit")


@query("j14_settings_fingerprint", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'plain ' || event_id ELSE
  sha256('{"alpha":"ü \\" ' || user_id || '","conf":' || CASE event_id % 4 WHEN 0 THEN '0.5' WHEN 1 THEN '2' WHEN 2 THEN '0.25' ELSE '17' END || ',"nested":{"a":[null,true,' || event_id || '],"b":{"y":1,"z":"' || event_type || '"}},"zeta":' || event_id || '}') END AS fingerprint FROM events""")
def _(s, d):
    conf = "CASE event_id % 4 WHEN 0 THEN '0.50' WHEN 1 THEN '2' WHEN 2 THEN '0.25' ELSE '17' END"
    first = f"""concat('{{ "zeta": ', event_id, ', "nested": {{"b": {{"z": "', event_type, '", "y": 1}}, "a": [null, true, ', event_id, ']}},  "conf": ', {conf}, ', "alpha": "ü \\\\" ', user_id, '"}}')"""
    second = f"""concat('{{"alpha":"\\\\u00fc \\\\" ', user_id, '","nested":{{"a":[null,true,', event_id, '],"b":{{"y":1,"z":"', event_type, '"}}}},"zeta":', event_id, ',"conf":', {conf}, '}}')"""
    e = given(s, d, "events").selectExpr("event_id", f"CASE event_id % 5 WHEN 0 THEN concat(' plain ', event_id, ' ') WHEN 1 THEN {first} ELSE {second} END AS settings")
    return e.select("event_id", loc.settings_fingerprint("settings").alias("fingerprint"))


@query("j15_skip_existing", duck("sheets") + " SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'skipped' ELSE 'todo' END AS kind FROM sheets")
def _(s, d):
    p = table(s, d, "sheets")
    todo, done = loc.skip_existing(p, p.filter("page_id % 4 = 0").select("page_id"))
    return todo.select("page_id", F.lit("todo").alias("kind")).unionByName(done.select("page_id", F.lit("skipped").alias("kind")))


@query("j27_stale_layouts", duck("regions") + """ SELECT page_id, region_id, NOT (region_id % 9 <> 0 AND region_id % 4 <> 0 AND region_id % 6 > 0 AND region_id % 5 > 0) AS stale FROM regions""")
def _(s, d):
    r = table(s, d, "regions").withColumns({
        "version": F.expr("CASE WHEN region_id % 9 = 0 THEN 2 ELSE 1 END"), "size": F.expr("region_id % 6"), "lines": F.expr("region_id % 5"),
        "stored": F.when(F.expr("region_id % 4 = 0"), F.to_json(F.struct("w", "h"))).otherwise(F.to_json(F.struct("text", "w", "h"))),
    })
    return loc.stale_layouts(r, ["text", "w", "h"]).select(*_KEYS, "stale")


_PUNCT = "' .!?,;:-…'"


_TYPED = "CASE region_id % 7 WHEN 0 THEN concat(text, '!') WHEN 1 THEN upper(split_part(text, ' ', 1)) WHEN 2 THEN concat('see www.', text) WHEN 3 THEN concat(text, ' and so it went on…') WHEN 4 THEN 'nod' WHEN 5 THEN upper(concat(text, ' ', text)) ELSE text END"
#: The dictionary of sounds: all names, their first words, and short second ones.
_DICT = "SELECT upper(p_name) AS word FROM {part} UNION SELECT upper(split_part(p_name, ' ', 1)) FROM {part} UNION SELECT upper(split_part(p_name, ' ', 2)) FROM {part} WHERE length(split_part(p_name, ' ', 2)) <= 4"
_BARE = f"upper(trim(w, {_PUNCT}))"


@query("f01_classify_blocks", duck("regions") + f""", k AS MATERIALIZED ({_DICT.format(part='part')}), t AS (SELECT page_id, region_id, bx IS NOT NULL AS in_bubble, trim({_TYPED}) AS t FROM regions),
u AS MATERIALIZED (SELECT *, list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '') AS ws FROM t), e AS (SELECT page_id, region_id, unnest(ws) AS w FROM u),
f AS (SELECT page_id, region_id, bool_and({_BARE} IN (SELECT word FROM k)) AS all_known FROM e GROUP BY ALL),
v AS (SELECT u.*, len(ws) AS n, list_distinct(list_transform(ws, lambda w: lower(trim(w, {_PUNCT})))) AS tok, coalesce(all_known, false) AS all_known, {_BARE.replace('trim(w', 'trim(t')} IN (SELECT word FROM k) AS known FROM u LEFT JOIN f USING (page_id, region_id))
SELECT page_id, region_id, CASE WHEN in_bubble THEN 'dialogue' WHEN regexp_matches(t, '@[\\w.-]+') OR regexp_matches(t, '(?i)https?://|www\\.|\\b[\\w.-]+\\.(com|net|org|ru|io|me|tv|gg)(/|\\b)') THEN 'sign'
  WHEN (regexp_matches(t, '\\p{{L}}') AND upper(t) = t AND length(t) <= 24 AND (n <= 2 OR len(tok) = 1 OR all_known))
    OR lower(trim(t, {_PUNCT})) IN ('startle','shake','whisper','squeeze','pull','kiss','glance','jiggle','shiver','tremble','nod','gulp','nudge','poke','pat','blush','giggle','sniff','sob') OR known THEN 'sfx'
  WHEN n >= 3 AND upper(t) = t THEN 'narration' WHEN regexp_matches(t, '(!|\\?|…|\\.\\.\\.)$') THEN CASE WHEN n = 1 THEN 'sfx' ELSE 'narration' END
  WHEN regexp_matches(t, '\\p{{L}}') AND (length(t) <= 12 OR (n <= 3 AND length(t) <= 24)) THEN 'sign' ELSE 'narration' END AS block_type FROM v""")
def _(s, d):
    r = table(s, d, "regions").withColumns({"text": F.expr(_TYPED), "in_bubble": F.col("bx").isNotNull()})
    return loc.classify_blocks(r, s.sql(_DICT, part=given(s, d, "part"))).select(*_KEYS, "block_type")


@query("f02_assign_roles", duck("regions") + """, r AS (SELECT *, CASE region_id % 5 WHEN 0 THEN text || CASE WHEN region_id % 2 = 0 THEN ' HaHa' ELSE ' ха Ха' END WHEN 1 THEN 'X' || region_id ELSE text END AS t, CASE region_id % 6 WHEN 0 THEN 'mine' WHEN 1 THEN ' ' END AS given FROM regions),
k AS (SELECT *, CASE WHEN document THEN NULL WHEN block_type = 'sfx' THEN CASE WHEN regexp_matches(lower(regexp_replace(t, '\\s', '', 'g')), 'хаха|хихи|хех|хохо|haha|hehe|hihi|lol|лол|кек') THEN 'sfx_comedy'
    WHEN trim(t) <> '' AND length(trim(t)) <= 8 AND (length(regexp_replace(t, '[^0-9]', '', 'g')) >= 2 OR (length(regexp_replace(t, '[^0-9]', '', 'g')) >= 1 AND regexp_matches(trim(t), '[A-Za-z]'))) THEN 'sfx_tech' ELSE 'sfx' END
  WHEN bx IS NOT NULL AND block_type IN ('dialogue', 'narration', '') THEN 'dialogue' WHEN block_type = 'title' THEN 'title' WHEN block_type = 'sign' THEN CASE WHEN regexp_matches(t, '\\p{L}') AND upper(t) = t THEN 'stencil' ELSE 'handwritten' END
  WHEN block_type = 'noise' THEN 'pixel' WHEN bx IS NOT NULL THEN 'dialogue' WHEN regexp_matches(t, '\\p{L}') AND upper(t) = t THEN 'shout' ELSE 'handwritten' END AS role FROM r)
SELECT page_id, region_id, CASE WHEN coalesce(trim(given), '') <> '' OR manual OR edited THEN given WHEN role IN ('dialogue', 'sfx', 'sfx_comedy', 'shout', 'handwritten') THEN role WHEN role = 'title' THEN 'shout' ELSE given END AS role FROM k""")
def _(s, d):
    r = table(s, d, "regions").withColumn("text", F.expr("CASE region_id % 5 WHEN 0 THEN concat(text, IF(region_id % 2 = 0, ' HaHa', ' ха Ха')) WHEN 1 THEN concat('X', region_id) ELSE text END"))
    r = r.withColumn("role", F.expr("CASE region_id % 6 WHEN 0 THEN 'mine' WHEN 1 THEN ' ' END"))
    catalog = s.createDataFrame([(x,) for x in ("dialogue", "sfx", "sfx_comedy", "shout", "handwritten")], "role string")
    return loc.assign_roles(r, catalog).select(*_KEYS, "role")


@query("f03_parse_replies", """SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'bad' ELSE 'ok' END AS kind, CASE WHEN turn % 5 <> 4 THEN coalesce(length(text), 0) END AS n FROM conversations""")
def _(s, d):
    c = given(s, d, "conversations")
    obj = F.to_json(F.struct(F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n")))
    fence, k = F.lit("```"), F.col("turn") % 5
    body = F.when(k == 0, obj).when(k == 1, F.concat(F.lit('<THINK>{"n": -1}</Think> '), obj)).when(k == 2, F.concat(F.lit("so: "), fence, F.lit("json\n"), obj, F.lit("\n"), fence)) \
        .when(k == 3, F.concat(F.lit('lost {"n": -2}</THINK> answer '), obj, F.lit(" done"))).otherwise(F.lit("no object"))
    ok, bad = loc.parse_replies(c.withColumn("body", body), "n long")
    return ok.select("conv_id", "turn", F.lit("ok").alias("kind"), F.col("reply.n").alias("n")).unionByName(bad.select("conv_id", "turn", F.lit("bad").alias("kind"), F.lit(None).cast("long").alias("n")))


@query("f04_rewrite_set", duck("mixed_docs") + f", s AS (SELECT doc_id, {_own('text')} AS t FROM mixed_docs), {_tokens('s', 't', 'doc_id')} SELECT doc_id FROM k WHERE {_FOREIGN}")
def _(s, d):
    docs = table(s, d, "mixed_docs").select("doc_id", F.lit("").alias("text"), F.col("text").alias("translation"))
    return loc.rewrite_set(docs, "ru").select("doc_id")


@query("f04_accept_proofread", duck("regions") + """, v AS (SELECT page_id, region_id, arg_max(t, o) AS t FROM (SELECT page_id, region_id - region_id % 2 AS region_id, region_id AS o, CASE region_id % 4 WHEN 0 THEN 'перевод ' || region_id WHEN 1 THEN ' ' WHEN 2 THEN 'left as it is' ELSE 'готово' END AS t FROM regions) WHERE t LIKE 'перевод%' OR t = 'готово' GROUP BY ALL)
SELECT page_id, region_id, coalesce(t, translation) AS translation FROM regions LEFT JOIN v USING (page_id, region_id)""")
def _(s, d):
    r = table(s, d, "regions")
    revised = r.selectExpr("page_id", "region_id - region_id % 2 AS region_id", "region_id AS ord", "CASE region_id % 4 WHEN 0 THEN concat('перевод ', region_id) WHEN 1 THEN ' ' WHEN 2 THEN 'left as it is' ELSE 'готово' END AS revised")
    return loc.accept_proofread(r, revised, "ru").select(*_KEYS, "translation")


@query("f05_finish_status", duck("sheets") + " SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'offline' WHEN page_id % 7 > page_id % 5 THEN 'edited' ELSE 'done' END AS status FROM sheets")
def _(s, d):
    p = table(s, d, "sheets").selectExpr("page_id", "CASE WHEN page_id % 4 = 0 THEN array('slow', 'Offline engine') ELSE array('slow') END AS warnings", "page_id % 7 AS visual_version", "page_id % 5 AS result_version")
    return loc.finish_status(p).select("page_id", "status")


@query("x02_text_model", duck("regions") + " SELECT page_id, region_id, upper(text) AS translated FROM regions")
def _(s, d):
    return loc.apply_text_model(table(s, d, "regions"), lambda t: t.str.upper()).select(*_KEYS, "translated")


@query("x02_translate", _COUNTED + f""", b AS (SELECT *, {_ROUTE} AS route FROM c), m AS (SELECT DISTINCT text FROM mixed_docs WHERE doc_id % 5 = 0),
t AS (SELECT doc_id, route, CASE WHEN doc_id % 7 = 0 OR route = 'uncovered' THEN 'old' WHEN route = 'skip' OR length(trim(b.text)) < 2 THEN b.text WHEN m.text IS NOT NULL THEN 'known' WHEN length(b.text) % 3 = 0 THEN b.text ELSE 'en:' || length(b.text) END AS translation,
  CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 7 = 0 OR route = 'uncovered' THEN '' ELSE 'unknown' END ELSE 'male' END AS speaker_gender, CASE WHEN doc_id % 7 > 0 AND route = 'uncovered' THEN 'uncovered' END AS warning FROM b LEFT JOIN m ON m.text = b.text)
SELECT doc_id AS page_id, route, md5(translation) AS digest, speaker_gender, warning FROM t""")
def _(s, d):
    docs = table(s, d, "mixed_docs")
    blocks = docs.selectExpr("doc_id AS page_id", "text", "'old' AS translation", "doc_id % 7 = 0 AS translation_locked", "IF(doc_id % 3 = 0, '', 'male') AS speaker_gender")
    memory = docs.filter("doc_id % 5 = 0").selectExpr("text", "'en' AS source", "'ru' AS target", "'known' AS translation")

    def load(route):
        return lambda texts: texts.map(lambda t: f"{route}:{len(t)}" if len(t) % 3 else "")

    done = models.translate(blocks, load, "ru", memory=memory)
    return done.select("page_id", "route", F.md5("translation").alias("digest"), "speaker_gender", "warning")


@query("x03_model_with_retry", duck("regions") + " SELECT page_id, region_id, CASE WHEN length(text) % 3 = 0 THEN 'again ' || text ELSE upper(text) END AS translated FROM regions")
def _(s, d):
    once = lambda t: t.where(t.str.len() % 3 != 0, "").str.upper()
    return loc.apply_with_retry(table(s, d, "regions"), once, lambda t: "again " + t).select(*_KEYS, "translated")


@query("x01_page_model", duck("sheets") + " SELECT page_id, CASE WHEN page_id IS NULL THEN NULL ELSE width * height END AS area, CAST(NULL AS VARCHAR) AS error FROM sheets")
def _(s, d):
    def broken(b):
        raise RuntimeError("no model here")

    good = lambda b: b.assign(area=b.width * b.height)[["page_id", "area"]]
    return loc.apply_page_model(table(s, d, "sheets"), broken, "page_id long, area long", fallback=good, attempts=2)
