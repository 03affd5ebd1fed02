"""Queries over sources, import and export plans, proposals and the batch twins of the streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import temporary_path, text_files
from ..functions.text import word_key
from ..operators import proposals as pr
from ..sources import documents, plans, readers
from ..streaming import jobs as sj
from .fixtures import duck, given, table

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return put


_DOC_LINE = """CASE WHEN page_id % 10 = 0 THEN concat('[broken ', page_id) ELSE to_json(named_struct('version', 1, 'note', 'x', 'page', page_id, 'regions', regions)) END AS value"""
_DOC_REGION = """named_struct('id', page_id * 1000 + region_id, 'bbox', CASE WHEN region_id % 4 > 0 THEN array(x, y, w, h) END, 'text', CASE WHEN region_id % 5 > 0 THEN text END, 'type', CASE region_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE block_type END,
  'block_type', CASE region_id % 3 WHEN 0 THEN 'sign' WHEN 1 THEN '' END, 'confidence', CASE WHEN region_id % 7 > 0 THEN confidence END, 'skip', CASE WHEN region_id % 2 = 0 THEN skip END, 'edited', CASE WHEN region_id % 3 = 0 THEN region_id % 2 END,
  'speaker', speaker, 'bubble_bbox', CASE WHEN bx IS NOT NULL THEN array(bx, by, bw, bh) END, 'more', region_id, 'style', named_struct('size', w, 'font', 'f'))"""


def _page_files(s, d):
    docs = table(s, d, "regions").groupBy("page_id").agg(F.expr(f"collect_list({_DOC_REGION})").alias("regions"))
    return text_files(docs.selectExpr(_DOC_LINE), "documents")


def _pages_as_text(s, d):
    return readers.read_regions(s, _page_files(s, d), lines=True)


#: What a region's object says, by the rules of reading: `type` before `block_type`, empty ones fall through.
_READ = """page_id * 1000 + region_id AS region_id, CASE WHEN region_id % 4 > 0 THEN x ELSE 0 END AS x, CASE WHEN region_id % 4 > 0 THEN h ELSE 0 END AS h, CASE WHEN region_id % 5 > 0 THEN text ELSE '' END AS text,
  CASE WHEN region_id % 4 > 1 THEN block_type WHEN region_id % 3 = 0 THEN 'sign' ELSE 'dialogue' END AS block_type, CASE WHEN region_id % 7 > 0 THEN confidence ELSE 0 END AS confidence, region_id % 2 = 0 AND skip AS skip,
  region_id % 3 = 0 AND region_id % 2 = 1 AS edited, speaker, 'text_free' AS class_name, bx, bh"""


@query("s01_read_regions", duck("regions") + f" SELECT {_READ} FROM regions WHERE page_id % 10 > 0")
def _(s, d):
    return _pages_as_text(s, d)[0].select("region_id", "x", "h", "text", "block_type", "confidence", "skip", "edited", "speaker", "class_name", "bx", "bh")


@query("s01_change_and_write", duck("regions") + """ SELECT page_id * 1000 + region_id AS id, CASE WHEN region_id % 2 = 0 THEN '«' || CASE WHEN region_id % 5 > 0 THEN text ELSE '' END || '»' END AS translation,
  CASE WHEN region_id % 4 > 0 THEN json_array(x, y, w, h)::VARCHAR END AS bbox, CASE WHEN region_id % 4 > 1 THEN block_type WHEN region_id % 4 = 0 THEN '' END AS type, CASE WHEN region_id % 3 > 0 OR region_id % 2 = 1 THEN CASE WHEN bx IS NOT NULL THEN json_array(bx, "by", bw, bh)::VARCHAR END END AS bubble,
  region_id AS more, w AS size, 'x' AS note, page_id AS page FROM regions WHERE page_id % 10 > 0""")
def _(s, d):
    """Documents read, some translations set and bubbles taken away, written and read again as plain JSON."""
    pages = documents.read_pages(s, _page_files(s, d), lines=True)
    pages = pages.withColumn("page", F.try_variant_get(F.try_element_at("raw", F.lit("page")), "$", "long"))
    even = F.col("region_id") % 1000 % 2 == 0
    r = documents.page_regions(pages, ("page",)).withColumn("translation", F.when(even, F.concat(F.lit("«"), "text", F.lit("»"))).otherwise(F.col("translation")))
    gone = even & (F.col("region_id") % 1000 % 3 == 0)
    r = r.withColumns({c: F.when(~gone, F.col(c)) for c in ("bx", "by", "bw", "bh")})
    path = text_files(documents.page_bodies(pages, r, ("page",)).select("body"), "changed")
    plain = "note string, page long, regions array<struct<id:long,translation:string,bbox:array<long>,type:string,bubble_bbox:array<long>,more:long,style:struct<size:long>>>"
    again = s.read.schema(plain).json(path).select("note", "page", F.explode("regions").alias("r"))
    return again.select("r.id", "r.translation", F.to_json("r.bbox").alias("bbox"), "r.type", F.to_json("r.bubble_bbox").alias("bubble"), "r.more", F.col("r.style.size").alias("size"), "note", "page")


@query("s01_quarantine", duck("regions") + " SELECT DISTINCT '[broken ' || page_id AS body FROM regions WHERE page_id % 10 = 0")
def _(s, d):
    return _pages_as_text(s, d)[1].select("body")


@query("s06_read_events", """SELECT date_trunc('second', ts) AS "timestamp", event_type AS event, CAST(event_id AS VARCHAR) AS details FROM events WHERE event_id % 7 > 0""")
def _(s, d):
    line = "CASE WHEN event_id % 14 = 0 THEN 'no json' WHEN event_id % 7 = 0 THEN '{\"timestamp\": 5' ELSE to_json(named_struct('timestamp', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'event', event_type, 'details', CAST(event_id AS STRING), 'new', 1)) END AS value"
    return readers.read_events(s, text_files(given(s, d, "events").selectExpr(line), "events"))


@query("s07_read_glossary", "SELECT 'Name ' || c_custkey % 97 AS source, 'T' || max(c_custkey) AS target FROM customer WHERE c_custkey % 5 > 0 GROUP BY 1")
def _(s, d):
    line = "CASE c_custkey % 5 WHEN 0 THEN concat('# Name ', c_custkey % 97, ' = none') WHEN 1 THEN concat('  Name ', c_custkey % 97, ': T', c_custkey) ELSE concat('Name ', c_custkey % 97, ' = T', c_custkey, '  ') END AS value"
    lines = given(s, d, "customer").repartitionByRange("c_custkey").sortWithinPartitions("c_custkey").selectExpr(line)  # files in the order of their lines
    return readers.read_glossary(s, text_files(lines, "glossary"))


@query("s03_archive_members", duck("sheets") + """, m AS (SELECT page_id % 40 AS archive_id, CASE page_id % 8 WHEN 1 THEN 'a/p' || page_id || '.PNG' WHEN 3 THEN 'c/p' || page_id || '.jpg' ELSE 'twice.png' END AS path, min(page_id) AS n FROM sheets WHERE page_id % 8 IN (1, 3, 6) GROUP BY ALL)
SELECT archive_id, path, row_number() OVER (PARTITION BY archive_id ORDER BY substr(path, 1, 1), n) - 1 AS ord FROM m""")
def _(s, d):
    p = table(s, d, "sheets")
    name = "CASE page_id % 8 WHEN 0 THEN concat('../p', page_id, '.png') WHEN 1 THEN concat('a/./b/../p', page_id, '.PNG') WHEN 2 THEN concat('/abs/p', page_id, '.png') WHEN 3 THEN concat('c\\\\p', page_id, '.jpg') WHEN 4 THEN concat('p', page_id, '-mask.png') WHEN 5 THEN concat('1/2/3/4/5/p', page_id, '.png') WHEN 6 THEN 'twice.png' ELSE concat('p', page_id, '.txt') END"
    return plans.plan_archive_members(p.selectExpr("page_id % 40 AS archive_id", "page_id AS ord", f"{name} AS member"))


@query("s04_content_dedupe", "SELECT sha256(coalesce(text, '')) AS sha, min(doc_id) AS path, count(*) AS n, false AS conflict FROM documents GROUP BY 1")
def _(s, d):
    docs = given(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("doc_id").alias("pos"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return readers.content_dedupe(docs)


def _attr(name: str) -> str:
    pattern = rf"""(?i)[ \t\n\x0b\f\r]{name}[ \t\n\x0b\f\r]*=[ \t\n\x0b\f\r]*(?:"([^"]*)"|''([^'']*)''|([^"'' \t\n\x0b\f\r>]+))"""
    return "concat(" + ", ".join(f"regexp_extract(t, '{pattern}', {k})" for k in (1, 2, 3)) + ")"


def _assets(html: str, tag: str, attribute: str) -> str:
    return rf"""WITH l AS (SELECT page_id, regexp_extract_all({html}, '(?i)<{tag}\b[^>]*>') AS ts FROM pages), t AS (SELECT page_id, unnest(ts) AS t, unnest(range(len(ts))) AS n FROM l),
u AS (SELECT page_id, n, {_attr(attribute)} AS url, lower({_attr('class')} || ' ' || {_attr('id')} || ' ' || {_attr('alt')}) AS names, lower({_attr('role')}) AS role, lower({_attr('aria-hidden')}) AS hidden,
  TRY_CAST(regexp_extract({_attr('width')}, '^[0-9]{{1,8}}') AS BIGINT) AS wide, TRY_CAST(regexp_extract({_attr('height')}, '^[0-9]{{1,8}}') AS BIGINT) AS high FROM t)
SELECT page_id, n, url, CASE WHEN url = '' THEN 'none' WHEN url LIKE 'blob:%' THEN 'blob' WHEN regexp_matches(names, 'icon|sprite|emoji|avatar') THEN 'decoration' WHEN hidden = 'true' OR role IN ('presentation', 'none') THEN 'hidden'
  WHEN greatest(wide, high) < 160 OR least(wide, high) < 80 THEN 'small' ELSE '' END AS reason FROM u"""


@query("s05_page_assets", _assets("html", "a", "href"))
def _(s, d):
    return readers.page_assets(given(s, d, "pages"), "a", "href")


#: Links of the pages as images of many kinds.
_PICTURES = "html"
for _from, _to in (('<a href="/t', '<img width="150" src="/t'), ('<a href="/a', '<img alt="an Emoji" src="/a'), ('<a href="/o', '<img role=none src="/o'), ('<a href="/e', '<img width=900 height="900" src="blob:/e'),
                   ('<a href="/d', '<img width=900 height="60" src=/d'), ('<a href="/', '<img width=900 height="500px" src="/')):
    _PICTURES = f"replace({_PICTURES}, '{_from}', '{_to}')"


@query("s05_image_assets", _assets(_PICTURES, "img", "src"))
def _(s, d):
    return readers.page_assets(given(s, d, "pages").select("page_id", F.expr(_PICTURES).alias("html")))


_PAINTED = """replace(replace(html, '<a href="/t', '<i style="background:#fff url(/t'), '<a href="/a', '<i style="color:red;background-image: url(data:a')"""


@query("s05_backgrounds", rf"""WITH l AS (SELECT page_id, list_filter(regexp_extract_all({_PAINTED}, '(?i)background(?:-image)?\s*:[^;"''}}>]*?url\(\s*(?:&quot;|["''])?([^"'')\s&]+)', 1), lambda u: NOT regexp_matches(lower(u), '^(data|blob):')) AS us FROM pages)
SELECT page_id, unnest(range(len(us))) AS n, unnest(us) AS url FROM l""")
def _(s, d):
    return readers.background_assets(given(s, d, "pages").select("page_id", F.expr(_PAINTED).alias("html")))


_ART = "a AS (SELECT page_id, 'result' AS kind FROM sheets WHERE page_id % 6 > 0 UNION ALL SELECT page_id, 'clean' FROM sheets WHERE page_id % 8 > 0)"


def _artifacts(p):
    return p.filter("page_id % 6 > 0").select("page_id", F.lit("result").alias("kind")).unionByName(p.filter("page_id % 8 > 0").select("page_id", F.lit("clean").alias("kind")))


@query("s08_export_packed", duck("sheets") + """, k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY pos, page_id) AS i FROM sheets WHERE status IN ('done', 'offline', 'ready') AND page_id % 6 > 0 AND page_id % 8 > 0)
SELECT project_id, page_id, i AS "index", lpad(i::VARCHAR, 4, '0') || '.png' AS name, lpad(i::VARCHAR, 4, '0') || '-clean.png' AS clean FROM k""")
def _(s, d):
    p = table(s, d, "sheets")
    return plans.plan_export(p, _artifacts(p), ["result", "clean"])[0]


def _requested(s, d):
    """Half of the pages, backwards, and for each tenth one that is not there."""
    p = table(s, d, "sheets").withColumns({"chapter": F.expr("concat('ch', page_id % 3)"), "stem": F.expr("concat('..{s', page_id, '}')"), "name": F.lit("")})
    request = p.filter("page_id % 2 = 1").selectExpr("project_id", "page_id", "-pos AS pos").unionByName(p.filter("page_id % 10 = 0").selectExpr("project_id", "-page_id - 1 AS page_id", "pos"))
    return plans.plan_export(p, _artifacts(p), ["clean"], request=request, template="C:/{chapter}/../{index:03}_{stem}")


@query("s08_export_named", duck("sheets") + """, k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY -pos, page_id) AS i FROM sheets WHERE page_id % 2 = 1 AND status IN ('done', 'offline', 'ready'))
SELECT project_id, page_id, i AS "index", 'ch' || page_id % 3 || '/' || CASE WHEN i < 1000 THEN lpad(i::VARCHAR, 3, '0') ELSE i::VARCHAR END || '_..s' || page_id || '.png' AS name, 'ch' || page_id % 3 || '/' || CASE WHEN i < 1000 THEN lpad(i::VARCHAR, 3, '0') ELSE i::VARCHAR END || '_..s' || page_id || '-clean.png' AS clean FROM k""")
def _(s, d):
    return _requested(s, d)[0]


@query("s08_export_refused", duck("sheets") + """ SELECT project_id, page_id, 'not ready' AS reason FROM sheets WHERE page_id % 2 = 1 AND status NOT IN ('done', 'offline', 'ready') UNION ALL SELECT project_id, -page_id - 1, 'unknown' FROM sheets WHERE page_id % 10 = 0""")
def _(s, d):
    return _requested(s, d)[1]


@query("s12_run_report", duck("run_pages") + " SELECT run_id, CASE status WHEN 'done' THEN 'pages' WHEN 'error' THEN 'errors' ELSE 'skipped' END AS kind, id, image, CASE WHEN status = 'error' THEN error ELSE '' END AS note FROM run_pages")
def _(s, d):
    return plans.run_report(table(s, d, "run_pages"))


@query("s08_export_skipped", duck("sheets") + " SELECT project_id, page_id, CASE WHEN status NOT IN ('done', 'offline', 'ready') THEN 'not ready' ELSE 'missing' END AS reason FROM sheets WHERE NOT (status IN ('done', 'offline', 'ready') AND page_id % 6 > 0 AND page_id % 8 > 0)")
def _(s, d):
    p = table(s, d, "sheets")
    return plans.plan_export(p, _artifacts(p), ["result", "clean"])[1]


@query("s09_resolve_names")
def _(s, d):
    p = given(s, d, "part").selectExpr("CAST(p_partkey AS BIGINT) AS ord", "concat(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, '.png') AS name")
    return plans.resolve_names(p, p.filter("ord % 50 = 0").selectExpr("name", "ord % 100 = 0 AS protected").dropDuplicates(["name"]))


@query("s10_manifests", duck("sheets") + """ SELECT page_id AS package_id, CASE WHEN page_id % 7 = 0 THEN 'kind' WHEN page_id % 5 = 0 THEN 'version' WHEN page_id % 4 = 0 THEN 'duplicate' WHEN page_id % 3 = 0 THEN 'incomplete' ELSE '' END AS reason FROM sheets""")
def _(s, d):
    p = table(s, d, "sheets")
    ids = "CASE WHEN page_id % 4 = 0 THEN array('a', 'a') ELSE array('a', 'b') END"
    body = F.to_json(F.struct(F.expr("CASE WHEN page_id % 7 = 0 THEN 'other' ELSE 'project' END").alias("kind"), F.expr("CASE WHEN page_id % 5 = 0 THEN 9 ELSE 1 END").alias("schema_version"),
                              F.expr(f"transform({ids}, x -> named_struct('id', x))").alias("pages"), F.expr(ids).alias("wanted")))
    return plans.validate_manifests(p.select(F.col("page_id").alias("package_id"), body.alias("body"), F.expr(f"CASE WHEN page_id % 3 = 0 THEN array('b', 'a') ELSE {ids} END").alias("packed")))


@query("s11_artifact_inventory", duck("sheets") + " SELECT page_id, concat_ws(',', 'mask', CASE WHEN page_id % 8 = 0 THEN 'clean' END, CASE WHEN page_id % 6 = 0 THEN 'result' END) AS missing FROM sheets")
def _(s, d):
    p = table(s, d, "sheets")
    return plans.artifact_inventory(p, _artifacts(p), ["mask", "clean", "result"])


@query("a20_plan_chapters", duck("sheets") + """, f AS (SELECT project_id, page_id, CASE WHEN project_id::BIGINT % 3 = 0 THEN 'p' || page_id WHEN project_id::BIGINT % 3 = 1 THEN 'ch/p' || page_id ELSE CASE WHEN page_id % 100 < 50 THEN 'x' ELSE '' END || CASE WHEN page_id % 4 = 0 THEN 'r' || page_id ELSE '/p' || page_id END END AS path FROM sheets),
g AS (SELECT *, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS d FROM f) SELECT path, page_id, CASE WHEN min(d) OVER w = max(d) OVER w AND d = '' THEN 'arc' || project_id ELSE d END AS chapter FROM g WINDOW w AS (PARTITION BY project_id)""")
def _(s, d):
    path = "CASE WHEN CAST(project_id AS BIGINT) % 3 = 0 THEN concat('p', page_id) WHEN CAST(project_id AS BIGINT) % 3 = 1 THEN concat('ch/p', page_id) ELSE concat(CASE WHEN page_id % 100 < 50 THEN 'x' ELSE '' END, CASE WHEN page_id % 4 = 0 THEN concat('r', page_id) ELSE concat('/p', page_id) END) END AS path"
    files = table(s, d, "sheets").selectExpr("project_id AS source_id", "concat('arc', project_id, '.zip') AS source_name", "page_id", path)
    return plans.plan_chapters(files, "archive").select("path", "page_id", "chapter")


@query("j06_dedupe_proposals")
def _(s, d):
    r = table(s, d, "regions").select("page_id", F.col("region_id").alias("ord"), "text", *"xywh")
    return pr.dedupe_proposals(r.filter("ord % 2 = 0"), r.filter("ord % 2 = 1"))


_KEY = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_UNCLAIMED = "CASE WHEN region_id % 3 = 0 THEN concat(split_part(text, ' ', 2), 'xqzvw', region_id % 2) WHEN region_id % 3 = 1 THEN concat('Zz', upper(split_part(text, ' ', 1)), 'wwvq') ELSE split_part(text, ' ', 2) END"


def _squeezed(c: str) -> str:
    return f"array_to_string(list_transform(range(1, length({c}) + 1), lambda i: CASE WHEN i > 1 AND {c}[i] = {c}[i - 1] THEN '' ELSE {c}[i] END), '')"


@query("s12_write_report", duck("run_pages") + " SELECT run_id, CASE status WHEN 'done' THEN 'pages' WHEN 'error' THEN 'errors' ELSE 'skipped' END AS kind, count(*) AS n FROM run_pages GROUP BY ALL")
def _(s, d):
    path = temporary_path(s, "report")
    plans.write_report(plans.run_report(table(s, d, "run_pages")), path, ["kind"])
    return s.read.parquet(path).groupBy("run_id", "kind").agg(F.count("*").alias("n"))


def _page_results(s, d):
    style = F.parse_json(F.concat(F.lit('{"style":{"size":'), "w", F.lit("}}"))).cast("map<string,variant>")
    regions = table(s, d, "regions").selectExpr("*", "region_id * 7 % 11 AS `order`", "region_id AS pos").withColumn("raw", F.when(F.col("region_id") % 2 == 0, style))
    pages = table(s, d, "sheets").selectExpr("page_id", "source_path", "IF(page_id % 2 = 0, 'rtl', 'ltr') AS reading_direction", "'o' AS ocr_engine", "'t' AS translator_engine", "map('ocr', 1.5D) AS timings", "array(status) AS warnings")
    return pages, regions


@query("s12_result_payloads", duck("regions", "sheets") + """, g AS (SELECT page_id, count(*) AS n, string_agg(region_id || ':' || block_type || ':' || md5(translation) || ':' || CASE WHEN region_id % 2 = 0 THEN w::VARCHAR ELSE '-' END || ':' || CASE WHEN bx IS NULL THEN '-' ELSE bx::VARCHAR END || ':' || skip::VARCHAR, ' ' ORDER BY region_id * 7 % 11, region_id) AS regions FROM regions GROUP BY 1)
SELECT page_id, source_path, CASE WHEN page_id % 2 = 0 THEN 'rtl' ELSE 'ltr' END AS direction, status AS warning, coalesce(n, 0) AS n, coalesce(regions, '') AS regions FROM sheets LEFT JOIN g USING (page_id)""")
def _(s, d):
    """Payloads, read again as JSON."""
    found = documents.result_payloads(*_page_results(s, d))
    plain = "source_path string, reading_direction string, warnings array<string>, regions array<struct<id:long,type:string,translation:string,style:struct<size:long>,bubble_bbox:array<long>,skip:boolean>>"
    r = F.expr("array_join(transform(p.regions, r -> concat_ws(':', r.id, r.type, md5(r.translation), coalesce(cast(r.style.size AS STRING), '-'), coalesce(cast(r.bubble_bbox[0] AS STRING), '-'), r.skip)), ' ')")
    rows = found.select("page_id", F.from_json("payload", plain).alias("p"))
    return rows.select("page_id", "p.source_path", F.col("p.reading_direction").alias("direction"), F.expr("p.warnings[0]").alias("warning"), F.size("p.regions").cast("long").alias("n"), r.alias("regions"))


@query("s12_translation_pairs", duck("regions") + " SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY region_id * 7 % 11, region_id) AS n, text, translation FROM regions")
def _(s, d):
    return documents.translation_pairs(_page_results(s, d)[1])


@query("j17_unclaimed_words", duck("regions") + f""", w AS (SELECT page_id, region_id AS word_id, {_KEY.format(_UNCLAIMED)} AS key, x, y, w, h, region_id % 13 AS angle FROM regions WHERE region_id % 2 = 0 AND confidence >= 0.5),
k AS (SELECT *, {_squeezed('key')} AS s FROM w WHERE regexp_matches(key, '^[a-z]{{4,20}}$')), o AS MATERIALIZED (SELECT *, region_id % 4 AS rotation, region_id % 10 < 6 AS rule FROM regions WHERE region_id % 2 = 1),
n AS (SELECT DISTINCT page_id, {_KEY.format('text')} AS whole FROM o), t AS (SELECT DISTINCT page_id, {_KEY.format('token')} AS token FROM (SELECT page_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS token FROM o)), q AS MATERIALIZED (SELECT *, {_squeezed('token')} AS s FROM t WHERE token <> ''),
a AS (SELECT k.* FROM k ANTI JOIN n ON n.page_id = k.page_id AND contains(whole, key)), b AS (SELECT a.* FROM a ANTI JOIN q ON q.page_id = a.page_id AND (q.s = a.s OR levenshtein(token, key) <= 1 OR (contains(key, token) AND length(token) >= 3 AND 2 * length(token) >= length(key)))),
c AS (SELECT b.* FROM b ANTI JOIN o ON o.page_id = b.page_id AND (o.manual OR o.edited) AND least(o.x + o.w, b.x + b.w) > greatest(o.x, b.x) AND least(o.y + o.h, b.y + b.h) > greatest(o.y, b.y))
SELECT page_id, word_id, key FROM c SEMI JOIN o ON o.page_id = c.page_id AND NOT (o.manual OR o.edited) AND trim(o.translation) <> '' AND o.rule AND abs(c.angle - o.rotation) > 3 AND least(o.x + o.w, c.x + c.w) > greatest(o.x, c.x) AND least(o.y + o.h, c.y + c.h) > greatest(o.y, c.y)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY word_id) <= 64""")
def _(s, d):
    r = table(s, d, "regions")
    words = r.filter("region_id % 2 = 0 AND confidence >= 0.5").selectExpr("page_id", "region_id AS word_id", f"{_UNCLAIMED} AS text", *"xywh", "1D AS confidence", "CAST(region_id % 13 AS DOUBLE) AS angle")
    known = r.filter("region_id % 2 = 1").selectExpr("page_id", "text", *"xywh", "manual", "edited", "translation", "CASE WHEN region_id % 10 < 3 THEN 'bubble' WHEN region_id % 10 < 6 THEN 'free' ELSE '' END AS kind", "CAST(region_id % 4 AS DOUBLE) AS rotation")
    return pr.unclaimed_words(words, known)


@query("j21_verify_reads", duck("regions") + """, r AS (SELECT page_id, region_id, CASE WHEN region_id % 9 = 0 THEN NULL ELSE text END AS text, confidence FROM regions),
o AS (SELECT page_id, bool_or(page_id % 7 = 0 AND coalesce(trim(text), '') <> '') AS off FROM r GROUP BY 1), c AS (SELECT *, count(*) OVER (PARTITION BY page_id, text) AS n FROM r)
SELECT page_id, region_id, off OR text IS NULL OR (trim(text) <> '' AND n > 1) OR (trim(text) = '' AND confidence >= 0.5) AS again FROM c JOIN o USING (page_id)""")
def _(s, d):
    r = table(s, d, "regions").selectExpr("page_id", "region_id", "CASE WHEN region_id % 9 = 0 THEN NULL ELSE text END AS text", "confidence")
    return pr.verify_reads(r, r.selectExpr("page_id", "region_id", "CASE WHEN page_id % 7 = 0 THEN 'ЖЖЖЖ' ELSE concat(' ', upper(text)) END AS text"))


@query("j24_recover_lines")
def _(s, d):
    r = table(s, d, "regions")
    # Every second row is a word, the others are regions: the table is dealt once.
    word = "CASE WHEN region_id % 2 = 1 THEN NULL WHEN region_id % 10 = 0 THEN 'a-' WHEN region_id % 3 = 0 THEN upper(split_part(text, ' ', 1)) ELSE text END AS text"
    own = [f"CASE WHEN region_id % 2 = 1 THEN {c} END AS r_{c}" for c in ("region_id", *"xywh", "text")]
    items = r.selectExpr("page_id", "region_id % 2 = 0 AS is_word", "region_id AS word_id", word, *"xywh", "confidence", *own)
    return pr.recover_items(items, given(s, d, "part").selectExpr("upper(p_name) AS word"))


@query("j26_confirm_proposals", duck("regions") + f""", p AS MATERIALIZED (SELECT page_id * 1000 + region_id AS id, {_KEY.format('t')} AS key, replace(t, ' ', '') AS plain, complete, w, h FROM (SELECT *, CASE WHEN region_id % 10 = 0 THEN '? !' ELSE text END AS t, region_id % 2 = 0 AS complete FROM regions WHERE text <> '')),
c AS (SELECT id, CASE WHEN id % 5 = 0 THEN key || 'more' WHEN id % 13 = 0 THEN 'other' ELSE key END AS key, w * 2 AS w, h FROM p WHERE id % 7 > 0), b AS MATERIALIZED (SELECT * FROM c UNION ALL SELECT * FROM c WHERE id % 11 = 0 UNION ALL SELECT id, 'far', w, h FROM c WHERE id % 4 = 0),
a AS (SELECT id, any_value(p.key) AS wanted, any_value(plain) AS plain, any_value(b.key) AS expected FROM p JOIN b USING (id) WHERE p.key = b.key OR (complete AND length(p.key) >= 3 AND contains(b.key, p.key) AND length(b.key) <= greatest(24, 3 * length(p.key)) AND b.w * b.h <= 6 * p.w * p.h AND b.w <= 3 * p.w AND b.h <= 3 * p.h) GROUP BY id HAVING count(*) = 1)
SELECT id AS proposal_id FROM a WHERE CASE WHEN wanted <> '' THEN id % 3 > 0 ELSE id % 4 > 0 END""")
def _(s, d):
    r = table(s, d, "regions").filter("text <> ''").withColumn("t", F.expr("CASE WHEN region_id % 10 = 0 THEN '? !' ELSE text END"))
    p = r.select((F.col("page_id") * 1000 + F.col("region_id")).alias("proposal_id"), word_key("t").alias("key"), F.replace("t", F.lit(" "), F.lit("")).alias("plain"), F.expr("region_id % 2 = 0").alias("complete"), "x", "y", "w", "h")
    c = p.filter("proposal_id % 7 > 0").selectExpr("proposal_id", "CASE WHEN proposal_id % 5 = 0 THEN concat(key, 'more') WHEN proposal_id % 13 = 0 THEN 'other' ELSE key END AS key", "x", "y", "w * 2 AS w", "h", "plain")
    located = c.drop("plain").unionByName(c.drop("plain").filter("proposal_id % 11 = 0")).unionByName(c.drop("plain").filter("proposal_id % 4 = 0").withColumn("key", F.lit("far")))
    readings = c.selectExpr("proposal_id", "CASE WHEN proposal_id % 3 > 0 THEN key ELSE 'misread' END AS key", "CASE WHEN proposal_id % 4 > 0 THEN plain ELSE concat(plain, 'x') END AS plain")
    return pr.confirm_proposals(p, located, readings)


@query("t03_budget", duck("regions", "sheets").replace("WITH ", "WITH RECURSIVE ", 1) + """, c AS MATERIALIZED (SELECT page_id // 8 AS page_id, region_id * 7 % 4 AS tile, page_id * 1000 + region_id AS ord, text FROM regions),
n AS MATERIALIZED (SELECT t.page_id, t.tile, count(c.ord) AS n FROM (SELECT DISTINCT page_id // 8 AS page_id, tile FROM sheets, range(5) r(tile)) t LEFT JOIN c ON c.page_id = t.page_id AND c.tile = t.tile GROUP BY ALL),
st(page_id, tile, share, rest) AS (SELECT DISTINCT page_id, -1::BIGINT, 0::BIGINT, 24::BIGINT FROM n UNION ALL SELECT n.page_id, n.tile, st.rest // (5 - n.tile), st.rest - least(n.n, st.rest // (5 - n.tile)) FROM st JOIN n ON n.page_id = st.page_id AND n.tile = st.tile + 1),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, tile ORDER BY length(text), ord) AS r FROM c) SELECT page_id, tile, ord, text FROM k JOIN st USING (page_id, tile) WHERE r <= share""")
def _(s, d):
    c = table(s, d, "regions").selectExpr("page_id div 8 AS page_id", "region_id * 7 % 4 AS tile", "page_id * 1000 + region_id AS ord", "text")
    tiles = table(s, d, "sheets").selectExpr("page_id div 8 AS page_id", "explode(sequence(0L, 4L)) AS tile").distinct()
    return pr.budget_candidates(c, tiles)


_LIMIT = """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r(key, k, event_id, allowed, stamps) AS (SELECT key, k, event_id, true, [t] FROM e WHERE k = 1
  UNION ALL SELECT e.key, e.k, e.event_id, len(list_filter(r.stamps, lambda x: e.t - x < 86400000000)) < 2, CASE WHEN len(list_filter(r.stamps, lambda x: e.t - x < 86400000000)) < 2 THEN list_append(list_filter(r.stamps, lambda x: e.t - x < 86400000000), e.t) ELSE list_filter(r.stamps, lambda x: e.t - x < 86400000000) END
  FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1) SELECT key, event_id, allowed FROM r"""


@query("r02_rate_limit", _LIMIT)
def _(s, d):
    e = given(s, d, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", "ts")
    return sj.rate_limit(e, 2, 86400)


_KIND = "CASE event_type WHEN 'error' THEN 'hit' WHEN 'purchase' THEN 'end' WHEN 'signup' THEN 'end' ELSE 'submit' END AS kind"


@query("r05_admit_pending", f"""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS queue, event_id, {_KIND}, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r(queue, k, event_id, kind, admitted, busy) AS (SELECT queue, k, event_id, kind, true, CASE WHEN kind = 'submit' THEN 1 ELSE 0 END FROM e WHERE k = 1
  UNION ALL SELECT e.queue, e.k, e.event_id, e.kind, e.kind = 'hit' OR r.busy < 3, CASE e.kind WHEN 'end' THEN greatest(0, r.busy - 1) WHEN 'submit' THEN CASE WHEN r.busy < 3 THEN r.busy + 1 ELSE r.busy END ELSE r.busy END FROM r JOIN e ON e.queue = r.queue AND e.k = r.k + 1)
SELECT queue, event_id, admitted FROM r WHERE kind <> 'end'""")
def _(s, d):
    e = given(s, d, "events").selectExpr("CAST(user_id AS STRING) AS queue", "event_id", "ts", _KIND)
    return sj.admit_pending(e, 3)


@query("r03_stalls", duck("job_events") + """, n AS (SELECT job_id, ts, type, date_sub('second', ts, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id)) AS seconds FROM job_events)
SELECT job_id, ts AS since, CASE WHEN seconds > 1800 THEN 'timeout' ELSE 'beat' END AS kind, seconds FROM n WHERE type NOT IN ('job.finished', 'job.failed', 'job.cancelled') AND seconds > 30""")
def _(s, d):
    return sj.stalls(table(s, d, "job_events"))


_QUEUED = "CASE status WHEN 'idle' THEN 'queued' ELSE status END AS status"


@query("r03_close_pages", duck("job_events", "sheets") + f""", f AS (SELECT job_id, arg_min(type, {{'a': ts, 'b': event_id}}) AS type FROM job_events WHERE type IN ('job.finished', 'job.failed', 'job.cancelled') GROUP BY 1),
p AS (SELECT page_id, {_QUEUED}, page_id % 97 || '-' AS owner FROM sheets WHERE page_id % 5 > 0)
SELECT job_id, page_id, CASE WHEN status = 'queued' OR type = 'job.cancelled' THEN 'idle' ELSE 'error' END AS status FROM p JOIN f ON starts_with(job_id, owner) WHERE status IN ('queued', 'running')""")
def _(s, d):
    ended = table(s, d, "job_events").filter("type IN ('job.finished', 'job.failed', 'job.cancelled')").groupBy("job_id").agg(F.min_by("type", F.struct("ts", "event_id")).alias("type"))
    owners = ended.select("job_id", F.expr("split_part(job_id, '-', 1)").alias("owner"))
    sheets = table(s, d, "sheets")
    pages = sheets.selectExpr("page_id", _QUEUED, "CAST(page_id % 97 AS STRING) AS owner").join(owners, "owner").select("job_id", "page_id", "status")
    return sj.close_pages(pages, ended, sheets.filter("page_id % 5 = 0").select("page_id"))


@query("r04_dedupe_with_ends", duck("submissions").replace("WITH ", "WITH RECURSIVE ", 1) + """, k AS MATERIALIZED (SELECT sub_id, epoch_us(ts) AS t, regexp_replace(page_url, '#.*$', '') || '|' || image_url AS work_key, image_url ILIKE 'blob:%' AS blob, fresh FROM submissions),
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY work_key ORDER BY t, sub_id, status IS NOT NULL) AS n FROM (SELECT sub_id, t, work_key, blob, fresh, NULL AS status FROM k UNION ALL SELECT sub_id, t + 3600000000, work_key, blob, false, CASE sub_id % 4 WHEN 0 THEN 'error' ELSE 'done' END FROM k WHERE sub_id % 3 > 0)),
r(work_key, n, sub_id, action, job, live) AS (SELECT work_key, n, sub_id, CASE WHEN blob THEN 'error' ELSE 'new' END, CASE WHEN NOT blob THEN sub_id END, NOT blob FROM e WHERE n = 1
  UNION ALL SELECT e.work_key, e.n, e.sub_id, CASE WHEN e.status IS NOT NULL THEN NULL WHEN e.blob THEN 'error' WHEN e.fresh OR r.job IS NULL OR NOT r.live THEN 'new' ELSE 'reuse' END,
    CASE WHEN e.status IS NOT NULL OR e.blob THEN r.job WHEN e.fresh OR r.job IS NULL OR NOT r.live THEN e.sub_id ELSE r.job END,
    CASE WHEN e.status IS NOT NULL THEN CASE WHEN r.job = e.sub_id THEN e.status = 'done' ELSE r.live END WHEN e.blob THEN r.live ELSE true END FROM r JOIN e ON e.work_key = r.work_key AND e.n = r.n + 1)
SELECT sub_id, work_key, action FROM r WHERE action IS NOT NULL""")
def _(s, d):
    subs = table(s, d, "submissions")
    ends = subs.filter("sub_id % 3 > 0").selectExpr("sub_id", "ts + INTERVAL 1 HOUR AS ts", "page_url", "image_url", "CASE sub_id % 4 WHEN 0 THEN 'error' ELSE 'done' END AS status")
    return sj.dedupe_submissions(subs, ends)


@query("r04_dedupe_submissions", duck("submissions") + """, k AS (SELECT *, regexp_replace(page_url, '#.*$', '') || '|' || image_url AS work_key FROM submissions)
SELECT sub_id, work_key, CASE WHEN image_url ILIKE 'blob:%' THEN 'error' WHEN fresh OR row_number() OVER (PARTITION BY work_key ORDER BY ts, sub_id) = 1 THEN 'new' ELSE 'reuse' END AS action FROM k""")
def _(s, d):
    return sj.dedupe_submissions(table(s, d, "submissions"))
