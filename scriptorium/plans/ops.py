"""Queries over jobs, events, versions, caches, exports, runs and pixels with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as qu
from ..operators import state as st
from .fixtures import duck, given, table

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return put


_JOBS = """jobs AS (SELECT CAST(o_orderkey AS BIGINT) AS job_id, 'L' || (o_custkey % 9)::VARCHAR AS lane, CAST(o_custkey AS BIGINT) AS page_id, CAST(o_orderkey % 101 AS BIGINT) AS progress, CAST(o_orderkey % 97 AS DOUBLE) AS seconds,
  CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'done' END AS status, CASE o_orderkey % 5 WHEN 0 THEN 'export' WHEN 1 THEN 'edit' WHEN 2 THEN 'region' ELSE 'batch' END AS kind, o_orderdate AS submitted FROM orders)"""


def _jobs(s, d):
    return given(s, d, "orders").selectExpr(
        "CAST(o_orderkey AS BIGINT) AS job_id", "concat('L', o_custkey % 9) AS lane", "CAST(o_custkey AS BIGINT) AS page_id", "CAST(o_orderkey % 101 AS BIGINT) AS progress", "CAST(o_orderkey % 97 AS DOUBLE) AS seconds",
        "CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'done' END AS status", "CASE o_orderkey % 5 WHEN 0 THEN 'export' WHEN 1 THEN 'edit' WHEN 2 THEN 'region' ELSE 'batch' END AS kind",
        "o_orderdate AS submitted")


@query("w09_job_status", duck("job_events") + """, f AS (SELECT job_id, min({'ts': ts, 'e': event_id, 't': type}) FILTER (type IN ('job.finished', 'job.failed', 'job.cancelled')) AS x FROM job_events GROUP BY 1),
k AS (SELECT j.*, x, x IS NULL OR (ts, event_id) <= (x.ts, x.e) AS alive FROM job_events j JOIN f USING (job_id))
SELECT job_id, coalesce(any_value(x.t), 'job.running') AS status, arg_max(progress, {'a': ts, 'b': event_id}) FILTER (type = 'job.progress' AND alive) AS progress, CAST(count_if(NOT alive) AS BIGINT) AS n_ignored FROM k GROUP BY job_id""")
def _(s, d):
    return st.job_status(table(s, d, "job_events"))


@query("w04_queue_positions", "WITH " + _JOBS + " SELECT job_id, CASE WHEN status = 'queued' THEN CAST(count(*) FILTER (status = 'queued') OVER (PARTITION BY lane ORDER BY submitted, job_id ROWS UNBOUNDED PRECEDING) AS BIGINT) ELSE 0 END AS position FROM jobs")
def _(s, d):
    return st.queue_positions(_jobs(s, d)).select("job_id", "position")


@query("w04_running_first", "WITH " + _JOBS + """ SELECT job_id, CASE status WHEN 'running' THEN CAST(count(*) FILTER (status = 'running') OVER o AS BIGINT)
  WHEN 'queued' THEN CAST(count(*) FILTER (status = 'running') OVER (PARTITION BY lane) + count(*) FILTER (status = 'queued') OVER o AS BIGINT) ELSE 0 END AS position FROM jobs WINDOW o AS (PARTITION BY lane ORDER BY submitted, job_id ROWS UNBOUNDED PRECEDING)""")
def _(s, d):
    return st.queue_positions(_jobs(s, d), running_first=True).select("job_id", "position")


@query("w05_eta", "WITH " + _JOBS + """, l AS (SELECT lane, seconds FROM jobs WHERE status = 'done' QUALIFY row_number() OVER (PARTITION BY lane ORDER BY submitted DESC, job_id DESC) <= 20), m AS (SELECT lane, avg(seconds) AS mean FROM l GROUP BY 1)
SELECT job_id, CASE WHEN status IN ('queued', 'running') THEN round(mean * (100 - progress) / 100, 6) END AS eta FROM jobs LEFT JOIN m USING (lane)""")
def _(s, d):
    jobs = _jobs(s, d).withColumn("finished", F.when(F.col("status") == "done", F.col("submitted")))
    return st.eta(jobs).select("job_id", "eta")


@query("w06_keep_last", duck("job_events") + " SELECT device_id, event_id FROM job_events QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, event_id DESC) <= 5")
def _(s, d):
    return st.keep_last(table(s, d, "job_events"), ["device_id"], [F.desc("ts"), F.desc("event_id")], 5).select("device_id", "event_id")


_INDEX = "i AS MATERIALIZED (SELECT cache_id, token, arg_max(size, {'a': ts, 'b': event_id}) AS size, max(ts) AS last_used FROM cache_access GROUP BY ALL)"


def _index(s, d):
    return table(s, d, "cache_access").groupBy("cache_id", "token").agg(F.max_by("size", F.struct("ts", "event_id")).alias("size"), F.max("ts").alias("last_used"))


@query("w07_evict", duck("cache_access") + f", {_INDEX} SELECT cache_id, token, sum(size) OVER (PARTITION BY cache_id ORDER BY last_used DESC, token DESC ROWS UNBOUNDED PRECEDING) <= 9000 AS kept FROM i WHERE size <= 9000")
def _(s, d):
    return st.evict(_index(s, d), 9000).select("cache_id", "token", "kept")


@query("w07_evict_locked", duck("cache_access") + f""", {_INDEX}, k AS (SELECT *, token LIKE '%7' AS locked FROM i), f AS (SELECT cache_id, sum(size) AS fixed FROM k WHERE locked GROUP BY 1)
SELECT cache_id, token, locked OR coalesce(fixed, 0) + sum(CASE WHEN locked THEN 0 ELSE size END) OVER (PARTITION BY cache_id ORDER BY last_used DESC, token DESC ROWS UNBOUNDED PRECEDING) <= 9000 AS kept FROM k LEFT JOIN f USING (cache_id) WHERE locked OR size <= 9000""")
def _(s, d):
    return st.evict(_index(s, d).withColumn("locked", F.col("token").endswith("7")), 9000).select("cache_id", "token", "kept")


@query("w08_versions_chain", duck("versions").replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ts, edit_id) AS k FROM versions),
c(page_id, k, edit_id, accepted, version) AS (SELECT page_id, k, edit_id, base_version = 0, CAST(base_version = 0 AS BIGINT) FROM o WHERE k = 1
  UNION ALL SELECT o.page_id, o.k, o.edit_id, o.base_version = c.version, c.version + CAST(o.base_version = c.version AS BIGINT) FROM c JOIN o ON o.page_id = c.page_id AND o.k = c.k + 1) SELECT page_id, edit_id, accepted, version FROM c""")
def _(s, d):
    v = table(s, d, "versions")
    return st.apply_versions(v.filter("1 = 0").select("page_id", F.col("base_version").alias("version")), v)


@query("w08_versions_single", duck("versions") + """, e AS (SELECT page_id, max(edit_id) AS edit_id, arg_max(base_version, edit_id) AS b FROM versions GROUP BY 1)
SELECT page_id, edit_id, b = page_id % 2 AS accepted, page_id % 2 + CAST(b = page_id % 2 AS BIGINT) AS version FROM e""")
def _(s, d):
    e = table(s, d, "versions").groupBy("page_id").agg(F.max("edit_id").alias("edit_id"), F.max_by("base_version", "edit_id").alias("base_version"))
    return st.apply_single_edits(e.selectExpr("page_id", "page_id % 2 AS version"), e)


@query("w08_provenance", duck("sheets") + " SELECT page_id, page_id % 5 >= page_id % 3 AND page_id % 4 = page_id % 2 AS current FROM sheets")
def _(s, d):
    p = table(s, d, "sheets").selectExpr("page_id", "page_id % 5 AS result_version", "page_id % 3 AS visual_version", "page_id % 4 AS result_fingerprint", "page_id % 2 AS fingerprint")
    return st.provenance_current(p).select("page_id", "current")


@query("w10_last_failed", "WITH " + _JOBS + " SELECT kind, page_id, arg_max(job_id, {'a': submitted, 'b': job_id}) AS job_id FROM jobs WHERE status = 'failed' GROUP BY ALL")
def _(s, d):
    return st.last_failed(_jobs(s, d).withColumn("finished", F.col("submitted")))


@query("w10_active_jobs", "WITH " + _JOBS + " SELECT kind, page_id, first(job_id ORDER BY status = 'queued', submitted, job_id) AS job_id FROM jobs WHERE status IN ('queued', 'running') GROUP BY ALL")
def _(s, d):
    return st.active_jobs(_jobs(s, d))


@query("w11_queue_wait", duck("job_events") + " SELECT job_id, CAST(greatest(0, date_sub('second', min(ts) FILTER (type = 'job.started'), min(ts) FILTER (type = 'job.progress'))) AS BIGINT) AS wait FROM job_events GROUP BY 1")
def _(s, d):
    df = st.queue_wait(table(s, d, "job_events"), "job.started", "job.progress")
    return df


_STATES = """p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE status END AS status, CASE page_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'offline' ELSE 'idle' END AS previous, page_id % 5 > 0 AS has_result, page_id % 7 AS result_version, page_id % 6 AS visual_version FROM sheets)"""
_P = ["page_id", "CASE page_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE status END AS status", "CASE page_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'offline' ELSE 'idle' END AS previous", "page_id % 5 > 0 AS has_result", "page_id % 7 AS result_version", "page_id % 6 AS visual_version"]
_E = "page_id, CASE page_id % 5 WHEN 0 THEN 'export' WHEN 1 THEN 'apply' ELSE 'batch' END AS kind, CASE page_id % 9 WHEN 0 THEN 'failed' ELSE 'finished' END AS outcome, page_id % 18 = 0 AS is_current"


@query("w12_settle_pages", duck("sheets") + f", {_STATES}, e AS (SELECT {_E} FROM sheets WHERE page_id % 2 = 0 OR page_id % 5 < 3)" + """
SELECT page_id, CASE WHEN kind IS NOT NULL AND kind <> 'export' AND page_id % 11 <> 0 AND status IN ('queued', 'running') THEN CASE WHEN outcome = 'failed' AND (is_current OR status = 'running') THEN 'error' WHEN outcome = 'failed' THEN 'idle'
  WHEN kind = 'apply' THEN 'edited' WHEN has_result AND result_version >= visual_version THEN CASE WHEN previous IN ('done', 'offline') THEN previous ELSE 'done' END WHEN has_result THEN 'edited' ELSE 'idle' END ELSE status END AS status FROM p LEFT JOIN e USING (page_id)""")
def _(s, d):
    sheets = table(s, d, "sheets")
    ended = s.sql(f"SELECT {_E} FROM {{p}} WHERE page_id % 2 = 0 OR page_id % 5 < 3", p=sheets)
    return st.settle_pages(sheets.selectExpr(*_P), ended, sheets.filter("page_id % 11 = 0").select("page_id")).select("page_id", "status")


_EXPORT = "page_id, CASE page_id % 7 WHEN 0 THEN 'edited' WHEN 1 THEN 'queued' ELSE status END AS status, CASE WHEN page_id % 9 > 0 THEN page_id % 5 END AS result_version, CASE WHEN page_id % 10 > 0 THEN page_id % 4 END AS clean_version"
#: The rule in the order of its decisions, from what is asked of the worker that exports.
_EXPORT_RULE = """CASE WHEN p.page_id IS NULL THEN 'blocked:missing' WHEN status = 'error' THEN 'blocked:error' WHEN status IN ('queued', 'running') THEN 'pending:busy' WHEN coalesce(status, 'idle') = 'idle' THEN 'blocked:not done'
  WHEN NOT has_result THEN CASE WHEN finished THEN 'blocked:no result' ELSE 'pending:result to come' END WHEN result_version IS NULL AND NOT finished THEN 'pending:result unknown' WHEN result_version < coalesce(version, 0) THEN 'pending:result outdated'
  WHEN status = 'edited' THEN 'pending:edited' WHEN NOT has_clean THEN CASE WHEN finished THEN 'blocked:no clean' ELSE 'pending:clean to come' END WHEN clean_version IS NULL AND NOT finished THEN 'pending:clean unknown' WHEN clean_version < coalesce(version, 0) THEN 'pending:clean outdated'
  ELSE 'ready:' END"""


@query("w13_export_readiness", duck("sheets") + f""", p AS (SELECT *, status IN ('done', 'offline') AS finished, page_id % 6 > 0 AS has_result, page_id % 8 > 0 AS has_clean FROM (SELECT {_EXPORT} FROM sheets)),
v AS (SELECT page_id, 1 + page_id % 2 AS version FROM sheets WHERE page_id % 3 = 0 UNION ALL SELECT -1 - page_id, 1 FROM sheets WHERE page_id % 20 = 0),
r AS (SELECT coalesce(p.page_id, v.page_id) AS page_id, {_EXPORT_RULE} AS said FROM p FULL JOIN v ON p.page_id = v.page_id) SELECT page_id, split_part(said, ':', 1) AS state, split_part(said, ':', 2) AS reason FROM r""")
def _(s, d):
    p = table(s, d, "sheets")
    artifacts = p.filter("page_id % 8 > 0").select("page_id", F.lit("clean").alias("kind")).unionByName(p.filter("page_id % 6 > 0").select("page_id", F.lit("result").alias("kind")))
    versions = p.filter("page_id % 3 = 0").selectExpr("page_id", "1 + page_id % 2 AS version").unionByName(p.filter("page_id % 20 = 0").selectExpr("-1 - page_id AS page_id", "1L AS version"))
    return st.export_readiness(p.selectExpr(*_EXPORT.split(", C")[:1], *["C" + x for x in _EXPORT.split(", C")[1:]]), artifacts, ["clean", "result"], versions)


@query("a17_run_progress", duck("run_pages") + """ SELECT run_id, CAST(count_if(status = 'done') AS BIGINT) AS done, CAST(count_if(status = 'error') AS BIGINT) AS error, count(*) AS total,
  round(CASE WHEN count(*) > count_if(status <> 'pending') THEN greatest(0.0, avg(seconds) FILTER (status <> 'pending' AND seconds > 0) * (count(*) - count_if(status <> 'pending')) - 7.5) END, 6) AS eta FROM run_pages GROUP BY 1""")
def _(s, d):
    r = table(s, d, "run_pages")
    return st.run_progress(r, r.select("run_id", F.lit(7.5).alias("elapsed")).distinct())


_DIRTY = "SELECT page_id, region_id, CASE WHEN region_id % 3 = 0 THEN region_id % 2 END AS bubble_id, translation, x AS l, y AS t, x + w AS r, y + h AS b FROM regions"


@query("a18_dirty_bounds", duck("regions", "sheets") + f""", p AS ({_DIRTY}), n AS (SELECT page_id, region_id, bubble_id, CASE WHEN region_id % 6 = 0 THEN 'new' ELSE translation END AS translation, l + 2 AS l, t, r + 2 AS r, b FROM p WHERE NOT (page_id % 10 = 0 AND region_id = 1)),
j AS (SELECT coalesce(p.page_id, n.page_id) AS page_id, coalesce(n.bubble_id, p.bubble_id) AS bubble_id, n.l IS NULL OR p.l IS NULL AS lone, p.translation IS DISTINCT FROM n.translation AS changed, least(p.l, n.l) AS l, least(p.t, n.t) AS t, greatest(p.r, n.r) AS r, greatest(p.b, n.b) AS b FROM p FULL JOIN n ON p.page_id = n.page_id AND p.region_id = n.region_id),
k AS (SELECT *, changed OR coalesce(bool_or(changed) OVER (PARTITION BY page_id, bubble_id) AND bubble_id IS NOT NULL, false) AS dirty FROM j),
g AS (SELECT page_id, bool_or(lone) AS full_, min(l) FILTER (dirty) AS l, min(t) FILTER (dirty) AS t, max(r) FILTER (dirty) AS r, max(b) FILTER (dirty) AS b FROM k GROUP BY 1)
SELECT page_id, full_ AS "full", CASE WHEN NOT full_ THEN CASE WHEN l IS NULL THEN 0 ELSE greatest(l, 0) END END AS l, CASE WHEN NOT full_ THEN CASE WHEN t IS NULL THEN 0 ELSE greatest(t, 0) END END AS t, CASE WHEN NOT full_ THEN least(coalesce(r, width), width) END AS r, CASE WHEN NOT full_ THEN least(coalesce(b, height), height) END AS b FROM g JOIN sheets USING (page_id)""")
def _(s, d):
    p = s.sql(_DIRTY.replace("regions", "{regions}"), regions=table(s, d, "regions"))
    n = p.filter("NOT (page_id % 10 = 0 AND region_id = 1)").withColumns({"translation": F.expr("CASE WHEN region_id % 6 = 0 THEN 'new' ELSE translation END"), "l": F.expr("l + 2"), "r": F.expr("r + 2")})
    return st.dirty_bounds(p, n, table(s, d, "sheets"))


_SHORT = "substr(CASE region_id % 3 WHEN 0 THEN translation WHEN 1 THEN concat(substr(translation, 3, 3), ' ', upper(text)) ELSE concat('a? ', text) END, 1, CAST(region_id % 20 AS INTEGER))"


@query("a19_short_reply_cap", duck("regions") + f""", r AS MATERIALIZED (SELECT page_id, region_id, trim({_SHORT}) AS tr, 10 + region_id % 17 AS font, 18 + region_id % 5 AS high, h + 10 AS inner_, bx FROM regions),
q AS (SELECT * FROM r WHERE tr <> '' AND (length(regexp_replace(tr, '[^\\p{{L}}\\p{{N}}]', '', 'g')) <= 4 OR (len(string_split_regex(tr, ' +')) <= 2 AND length(tr) <= 8)))
SELECT a.page_id, a.region_id, least(any_value(a.high), greatest(14, CAST(round_even(coalesce(1.15::DOUBLE * quantile_cont(b.font, 0.5), 0.45::DOUBLE * any_value(a.inner_)), 0) AS BIGINT))) AS cap
FROM q a LEFT JOIN r b ON a.page_id = b.page_id AND b.bx IS NOT NULL AND b.font >= 14 AND b.region_id <> a.region_id GROUP BY ALL""")
def _(s, d):
    r = table(s, d, "regions").selectExpr("page_id", "region_id", f"{_SHORT} AS translation", "10 + region_id % 17 AS font", "18 + region_id % 5 AS high", "h + 10 AS interior_h", "bx")
    return st.short_reply_cap(r, 14)


@query("a21_storage_report", "SELECT source AS area, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def _(s, d):
    return st.storage_report(given(s, d, "documents").select(F.col("source").alias("area"), F.col("n_chars").alias("size")))


@query("a21_purge", "SELECT o_orderkey AS export_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0")
def _(s, d):
    o = given(s, d, "orders").selectExpr("o_orderkey AS export_id", "CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'open' END AS status")
    return st.purge_candidates(o, o.filter("export_id % 3 = 0").select("export_id")).select("export_id")


@query("a22_job_board", "WITH " + _JOBS + " SELECT job_id, CASE WHEN kind = 'export' THEN 'export' WHEN kind IN ('edit', 'apply', 'region') THEN 'edit' ELSE 'batch' END AS lane, kind IN ('translate', 'batch', 'region') AS needs_llm FROM jobs")
def _(s, d):
    return st.job_board(_jobs(s, d)).select("job_id", "lane", "needs_llm")


@query("a22_active_pages", "WITH " + _JOBS + ", o AS (SELECT * FROM jobs WHERE status <> 'done' AND kind <> 'export') SELECT page_id FROM o UNION SELECT page_id + 1 FROM o")
def _(s, d):
    return st.active_pages(_jobs(s, d).withColumns({"pages": F.array(F.col("page_id"), F.col("page_id") + 1), "finished": F.col("status") == "done"}))


@query("u01_restore_queue", "WITH " + _JOBS + """, s AS (SELECT job_id - job_id % 2 AS job_id, lane, job_id AS pos, CASE status WHEN 'running' THEN 0 WHEN 'queued' THEN 1 ELSE 2 END AS rank FROM jobs),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY rank, pos) = 1)
SELECT job_id, lane, CASE WHEN rank < 2 THEN 'queued' ELSE 'history' END AS state, CASE WHEN rank < 2 THEN row_number() OVER (PARTITION BY lane, rank < 2 ORDER BY rank, pos, job_id) END AS place FROM f""")
def _(s, d):
    j = _jobs(s, d).selectExpr("job_id - job_id % 2 AS job_id", "lane", "job_id AS pos", "CASE WHEN status IN ('running', 'queued') THEN status ELSE 'history' END AS state")
    return st.restore_queue(j)


@query("u02_check_reorder", duck("sheets") + " SELECT project_id, bool_and(CAST(project_id AS INTEGER) % 3 > 0 OR page_id % 7 > 0) AS valid FROM sheets GROUP BY 1")
def _(s, d):
    p = table(s, d, "sheets").select("project_id", "page_id")
    return st.check_reorder(p, p.filter("CAST(project_id AS INT) % 3 > 0 OR page_id % 7 > 0"))


@query("u03_retry_set", "WITH " + _JOBS + " SELECT job_id, lane, row_number() OVER (PARTITION BY lane ORDER BY submitted, job_id) AS place FROM jobs WHERE status = 'failed' AND page_id % 5 <> 0 AND page_id % 7 <> 0")
def _(s, d):
    j = _jobs(s, d)
    return st.retry_set(j, j.filter("page_id % 5 = 0").select("page_id").distinct(), j.filter("page_id % 7 = 0").select("page_id").distinct())


@query("u05_append_sources", duck("sheets") + """, f AS (SELECT project_id, CASE WHEN page_id % 3 = 0 THEN source_path ELSE '/new' || source_path END AS path, page_id AS ord FROM sheets)
SELECT f.project_id, path, l.last + row_number() OVER (PARTITION BY f.project_id ORDER BY ord, path) AS pos FROM f JOIN (SELECT project_id, max(pos) AS last FROM sheets GROUP BY 1) l USING (project_id) WHERE path LIKE '/new%'""")
def _(s, d):
    p = table(s, d, "sheets")
    return st.append_sources(p, p.selectExpr("project_id", "CASE WHEN page_id % 3 = 0 THEN source_path ELSE concat('/new', source_path) END AS path", "page_id AS ord"))


@query("t01_natural_sort", duck("sheets") + """ SELECT project_id, source_path, row_number() OVER (PARTITION BY project_id ORDER BY CAST(regexp_extract(source_path, '([0-9]+)', 1) AS BIGINT)) AS ord FROM sheets""")
def _(s, d):
    return st.natural_sort(table(s, d, "sheets").select("project_id", "source_path"), "source_path", ["project_id"])


_CODES = "i AS (SELECT user_id AS device_id, ts, event_id % 3 AS code FROM events WHERE event_type = 'view'), r AS (SELECT user_id AS device_id, ts, event_id % 3 AS code, event_id FROM events WHERE event_type = 'click')"


@query("j23_match_codes", f"""WITH {_CODES}, n AS (SELECT *, lead(ts) OVER (PARTITION BY device_id ORDER BY ts, code) AS nx FROM i),
h AS (SELECT n.device_id, n.ts AS issued, arg_min(r.event_id, {{'a': r.ts, 'b': r.event_id}}) AS event_id FROM n JOIN r ON r.device_id = n.device_id AND r.code = n.code AND r.ts >= n.ts AND r.ts < least(n.ts + INTERVAL 300000 SECOND, coalesce(nx, n.ts + INTERVAL 300000 SECOND)) GROUP BY ALL)
SELECT event_id, device_id, event_id IN (SELECT event_id FROM h) AS accepted FROM r""")
def _(s, d):
    e = given(s, d, "events")
    issued = e.filter("event_type = 'view'").selectExpr("user_id AS device_id", "ts", "event_id % 3 AS code")
    redeemed = e.filter("event_type = 'click'").selectExpr("user_id AS device_id", "ts", "event_id % 3 AS code", "event_id")
    return st.match_codes(issued, redeemed, 300_000)


# ---------------------------------------------------------------- quality


def _r(a: str, b: str) -> str:
    return f"round(({a})::DOUBLE / nullif({b}, 0), 6)"


def _wide(m: int) -> str:
    """Places within an ellipse of that margin: in a row dy away, round(m * sqrt(m² - dy²) / m) to either side."""
    return f"w AS (SELECT DISTINCT page_id, x + dx AS x, y + dy AS y FROM pixels, range(-{m}, {m + 1}) a(dx), range(-{m}, {m + 1}) b(dy) WHERE gt AND abs(dx) <= round({m} * sqrt(({m * m} - dy * dy) / {m * m}.0)))"


_WIDE = _wide(2)


@query("a07_mask_metrics", duck("pixels") + f""", {_WIDE}, p AS (SELECT pixels.*, w.x IS NOT NULL AS near FROM pixels LEFT JOIN w USING (page_id, x, y))
SELECT page_id, {_r('count_if(gt AND pred)', 'count_if(gt)')} AS recall, {_r('count_if(gt AND pred)', 'count_if(pred)')} AS "precision", {_r('count_if(gt AND pred)', 'count_if(gt OR pred)')} AS iou, {_r('2 * count_if(gt AND pred)', 'count_if(gt) + count_if(pred)')} AS f1,
  {_r('count_if(pred AND NOT near)', 'count_if(pred)')} AS spill, CAST(count_if(NOT near AND abs(r - r2) > 12) AS BIGINT) AS damage FROM p GROUP BY page_id""")
def _(s, d):
    return qu.mask_metrics(table(s, d, "pixels"), margin=2)


@query("a08_extract_ink", duck("pixels") + """, m AS (SELECT page_id, quantile_cont(r, 0.5) AS mr, quantile_cont(g, 0.5) AS mg, quantile_cont(b, 0.5) AS mb FROM pixels WHERE NOT gt GROUP BY 1),
d AS (SELECT page_id, comp_id, CAST(least(255, floor(sqrt((r - mr) ** 2 + (g - mg) ** 2 + (b - mb) ** 2))) AS BIGINT) AS d FROM pixels JOIN m USING (page_id) WHERE gt),
h AS (SELECT page_id, comp_id, d, count(*) AS n FROM d GROUP BY ALL), c AS (SELECT *, sum(n) OVER u AS n0, sum(n * d) OVER u AS s0, sum(n) OVER p AS nt, sum(n * d) OVER p AS st FROM h WINDOW u AS (PARTITION BY page_id, comp_id ORDER BY d ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY page_id, comp_id)),
v AS (SELECT *, n0::DOUBLE / nt AS om, s0::DOUBLE / nt AS mu, st::DOUBLE / nt AS tot FROM c), o AS (SELECT page_id, comp_id, arg_max(d, {'v': round((tot * om - mu) ** 2 / (om * (1 - om)), 9), 'd': -d}) FILTER (om * (1 - om) > 1e-9) AS otsu FROM v GROUP BY ALL),
t AS (SELECT d.page_id, d.comp_id, greatest(28, coalesce(any_value(otsu), 28)) AS threshold, count_if(d > greatest(28, coalesce(otsu, 28))) AS ink, count_if(d >= 4) AS faint FROM d JOIN o ON d.page_id = o.page_id AND d.comp_id = o.comp_id GROUP BY d.page_id, d.comp_id)
SELECT page_id, comp_id, CAST(threshold AS BIGINT) AS threshold, CAST(ink AS BIGINT) AS ink, CASE WHEN ink > 0 THEN 'measured' WHEN faint >= 8 THEN 'undetermined' ELSE 'no_ink' END AS status FROM t""")
def _(s, d):
    return qu.extract_ink(table(s, d, "pixels"))


@query("a09_cleanup_residue", duck("pixels") + f""", {_wide(3)}, p AS (SELECT pixels.*, w.x IS NOT NULL AND NOT gt AS ring FROM pixels LEFT JOIN w USING (page_id, x, y)), m AS (SELECT page_id, quantile_cont(r2, 0.5) AS m FROM p WHERE ring GROUP BY 1)
SELECT page_id, {_r('count_if(gt AND abs(r2 - m) > 60)', 'count_if(gt)')} AS residue, {_r('count_if(ring AND abs(r2 - m) > 20)', 'count_if(ring)')} AS halo FROM p JOIN m USING (page_id) GROUP BY page_id""")
def _(s, d):
    return qu.cleanup_residue(table(s, d, "pixels"))


@query("a10_scoped_hits", duck("regions", "pixels") + f""", i AS (SELECT p.page_id, comp_id, region_id, block_type, count(*) AS n FROM pixels p JOIN regions r ON p.page_id = r.page_id AND p.pred AND p.x BETWEEN r.x - 12 AND r.x + r.w + 11 AND p.y BETWEEN r.y - 12 AND r.y + r.h + 11 GROUP BY ALL),
o AS (SELECT page_id, comp_id, first(region_id ORDER BY n DESC, region_id) AS region_id, first(block_type ORDER BY n DESC, region_id) AS kind FROM i GROUP BY ALL), {_WIDE},
h AS (SELECT page_id, comp_id, {_r('count(w.x)', 'count(*)')} AS rate FROM pixels LEFT JOIN w USING (page_id, x, y) WHERE pred GROUP BY ALL) SELECT page_id, comp_id, region_id, rate FROM h JOIN o USING (page_id, comp_id) WHERE kind <> 'sfx'""")
def _(s, d):
    return qu.scoped_hits(table(s, d, "pixels"), table(s, d, "regions"), scope="text", margin=2)


_SMALL = "small AS (SELECT page_id, region_id, region_id % 9 - 1 AS x, region_id % 7 AS y, CAST(6 AS BIGINT) AS w, CAST(5 AS BIGINT) AS h FROM regions)"


@query("a11_false_regions", duck("regions", "pixels") + f""", {_SMALL}, n AS (SELECT r.page_id, r.region_id, count(*) AS n, count_if(gt) AS inside FROM pixels p JOIN small r ON p.page_id = r.page_id AND p.pred AND p.x BETWEEN r.x AND r.x + r.w - 1 AND p.y BETWEEN r.y AND r.y + r.h - 1 GROUP BY ALL)
SELECT page_id, region_id, n, CAST(inside AS BIGINT) AS inside FROM n WHERE n >= 10 AND 2 * inside < n""")
def _(s, d):
    small = table(s, d, "regions").selectExpr("page_id", "region_id", "region_id % 9 - 1 AS x", "region_id % 7 AS y", "6L AS w", "5L AS h")
    return qu.false_regions(table(s, d, "pixels"), small, 10)


@query("a11_proposal_recall", duck("pixels") + " SELECT page_id, round(count_if(gt AND g % 3 > 0)::DOUBLE / nullif(count_if(gt), 0), 4) AS recall FROM pixels GROUP BY 1")
def _(s, d):
    p = table(s, d, "pixels")
    return qu.proposal_recall(p, p.filter("g % 3 > 0"))


@query("a11_region_errors", duck("pixels") + " SELECT page_id, comp_id, count_if(pred) >= 12 AND 2 * count_if(pred AND NOT gt) > count_if(pred) AS false_region, count_if(gt) >= 30 AND 5 * count_if(gt AND pred) < count_if(gt) AS missed FROM pixels GROUP BY ALL")
def _(s, d):
    return qu.region_errors(table(s, d, "pixels"))


@query("a12_cer", duck("regions") + """, r AS (SELECT page_id, lower(string_agg(text, ' ' ORDER BY region_id)) AS ref, lower(string_agg(CASE WHEN region_id % 4 = 0 THEN replace(text, 'a', 'o') ELSE text END, ' ' ORDER BY region_id)) AS hyp FROM regions GROUP BY 1)
SELECT page_id, CASE WHEN length(ref) > 0 THEN round(levenshtein(hyp, ref)::DOUBLE / length(ref), 6) ELSE 0 END AS cer FROM r""")
def _(s, d):
    r = table(s, d, "regions").select("page_id", F.col("region_id").alias("ord"), "text")
    return qu.cer(r.withColumn("text", F.expr("CASE WHEN ord % 4 = 0 THEN replace(text, 'a', 'o') ELSE text END")), r)


@query("a13_run_summary", duck("run_pages") + """ SELECT run_id, CAST(count_if(status = 'done') AS BIGINT) AS done, CAST(count_if(status = 'error') AS BIGINT) AS failed, count(*) AS total, round(sum(seconds), 6) AS seconds, coalesce(string_agg(DISTINCT error, ',' ORDER BY error) FILTER (error <> ''), '') AS errors,
  CAST(sum(n_warnings) AS BIGINT) AS warnings, CASE WHEN count_if(status = 'error') = 0 THEN 'success' WHEN count_if(status = 'done') > 0 THEN 'partial' ELSE 'failed' END AS "exit" FROM run_pages GROUP BY 1""")
def _(s, d):
    return qu.run_summary(table(s, d, "run_pages"))


@query("a14_stage_timings", duck("quality") + """, t AS (SELECT run_id, 'ocr' AS stage, recall AS seconds FROM quality UNION ALL SELECT run_id, 'clean', hit6 FROM quality)
SELECT run_id, stage, round(sum(seconds), 6) AS total, round(quantile_cont(seconds, 0.5), 6) AS p50, round(quantile_cont(seconds, 0.95), 6) AS p95 FROM t GROUP BY GROUPING SETS ((run_id, stage), (stage))""")
def _(s, d):
    q = table(s, d, "quality").select("run_id", F.create_map(F.lit("ocr"), "recall", F.lit("clean"), "hit6").alias("timings"))
    return qu.stage_timings(q, "run_id")


_VARIANTS = """q AS MATERIALIZED (SELECT page, max(recall) AS recall, max(hit6) AS hit6, sum(seconds) AS seconds FROM quality GROUP BY 1),
v AS (SELECT 'a' AS variant, 0 AS rank, page, recall - CASE WHEN page % 50 = 0 THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS recall, hit6, seconds * 0.9::DOUBLE AS seconds FROM q
  UNION ALL SELECT 'b', 1, page, recall, hit6 - CASE WHEN page % {n} = 0 THEN 0.1::DOUBLE ELSE 0::DOUBLE END, seconds * 1.01::DOUBLE FROM q UNION ALL SELECT 'c', 2, page, recall, hit6, seconds * 1.5::DOUBLE FROM q)"""
_VERDICT = """, g AS (SELECT variant, rank, sum(v.seconds) AS s, sum(q.seconds) AS p, coalesce(list(page ORDER BY page) FILTER (q.recall - v.recall > 0.005 OR q.hit6 - v.hit6 > 0.005), []) AS weak FROM v JOIN q USING (page) GROUP BY ALL),
f AS (SELECT * FROM g WHERE p = 0 OR s <= 1.02::DOUBLE * p) SELECT coalesce(arg_min(variant, rank) FILTER (len(weak) = 0), 'pair') AS choice,
  CASE WHEN count_if(len(weak) = 0) > 0 THEN '' ELSE coalesce(array_to_string(arg_min(weak, len(weak) * 10 + rank), ','), '') END AS weak_pages FROM f"""


def _verdict(s, d, n):
    q = table(s, d, "quality").groupBy("page").agg(F.max("recall").alias("recall"), F.max("hit6").alias("hit6"), F.sum("seconds").alias("seconds"))
    rows = q.selectExpr("'pair' AS variant", "page", "recall", "hit6", "seconds")
    for v, recall, hit, time in (("a", "recall - CASE WHEN page % 50 = 0 THEN 0.1D ELSE 0D END", "hit6", 0.9), ("b", "recall", f"hit6 - CASE WHEN page % {n} = 0 THEN 0.1D ELSE 0D END", 1.01), ("c", "recall", "hit6", 1.5)):
        rows = rows.unionByName(q.selectExpr(f"'{v}' AS variant", "page", f"{recall} AS recall", f"{hit} AS hit6", f"seconds * {time}D AS seconds"))
    return qu.ab_verdict(rows, ("a", "b", "c"), "pair")


@query("a15_ab_verdict", duck("quality") + ", " + _VARIANTS.format(n=1_000_000_007) + _VERDICT)
def _(s, d):
    return _verdict(s, d, 1_000_000_007)


@query("a15_ab_verdict_pair", duck("quality") + ", " + _VARIANTS.format(n=70) + _VERDICT)
def _(s, d):
    return _verdict(s, d, 70)


@query("a16_page_rollup", duck("regions") + """, n AS (SELECT page_id, count(*) AS warnings FROM regions WHERE region_id % 4 = 0 GROUP BY 1)
SELECT page_id, count(*) AS n, CAST(count_if(trim(translation) <> '') AS BIGINT) AS translated, coalesce(string_agg(region_id::VARCHAR, ',' ORDER BY region_id) FILTER (overflow), '') AS overflow,
  coalesce(min(region_id % 17) FILTER (NOT skip AND trim(text) <> '' AND trim(translation) <> '' AND block_type IN ('dialogue', 'narration', 'title', 'sfx') AND region_id % 17 > 0), 0) AS min_font, coalesce(any_value(warnings), 0) AS warnings FROM regions LEFT JOIN n USING (page_id) GROUP BY 1""")
def _(s, d):
    r = table(s, d, "regions").withColumn("font_size", F.expr("region_id % 17"))
    return qu.page_rollup(r, r.filter("region_id % 4 = 0").select("page_id", "text"))


@query("a23_reference_similarity", duck("pixels") + " SELECT page_id, round(CASE WHEN avg(abs(r - b)) >= 1 THEN 1 - avg(abs(r2 - b)) / avg(abs(r - b)) END, 6) AS similarity FROM pixels WHERE gt GROUP BY 1")
def _(s, d):
    return qu.reference_similarity(table(s, d, "pixels"))


def _lin(c: str) -> str:
    return f"(CASE WHEN {c} / 255.0 <= 0.03928 THEN {c} / 255.0 / 12.92 ELSE (({c} / 255.0 + 0.055) / 1.055) ** 2.4 END)"


@query("a24_contrast_audit", duck("pixels") + f""", l AS (SELECT page_id, 0.2126 * {_lin('r')} + 0.7152 * {_lin('g')} + 0.0722 * {_lin('b')} AS a, 0.2126 * {_lin('r2')} + 0.7152 * {_lin('b')} + 0.0722 * {_lin('g')} AS b FROM pixels)
SELECT page_id, {_r('count_if((greatest(a, b) + 0.05) / (least(a, b) + 0.05) < 4.5)', 'count(*)')} AS low_share FROM l GROUP BY 1""")
def _(s, d):
    return qu.contrast_audit(table(s, d, "pixels").select("page_id", "r", "g", "b", "r2", F.col("b").alias("g2"), F.col("g").alias("b2")))


@query("a25_review_summary", "SELECT quality AS rating, count(*) AS n FROM labels GROUP BY 1")
def _(s, d):
    return qu.review_summary(given(s, d, "labels").select(F.col("quality").alias("rating")))


@query("a25_review_totals", "SELECT CAST(count_if(doc_id % 3 > 0) AS BIGINT) AS done, count(*) AS total, CAST(count_if(coalesce(quality, 0) > 0) AS BIGINT) AS rated, CAST(count_if(coalesce(quality, 0) = 0) AS BIGINT) AS unrated FROM labels")
def _(s, d):
    return qu.review_totals(given(s, d, "labels").selectExpr("CASE WHEN doc_id % 3 > 0 THEN 'done' ELSE 'error' END AS status", "quality AS rating"))


@query("a25_comment_boxes", "SELECT image, CAST(n AS BIGINT) AS n, x1, y1, x2, y2 FROM (SELECT doc_id AS image, 0 AS n, (doc_id % 90)::DOUBLE AS x1, 5.5::DOUBLE AS y1, (doc_id % 100)::DOUBLE AS x2, 50::DOUBLE AS y2 FROM labels UNION ALL SELECT doc_id, 1, 1, 2, 3, (doc_id % 120)::DOUBLE FROM labels) b WHERE x2 <= 100 AND y2 <= 100 AND x2 > x1 AND y2 > y1")
def _(s, d):
    comment = "concat('see [Область (%): x1=', doc_id % 90, ', y1=5.5, x2=', doc_id % 100, ', y2=50] and [Область (%): x1=1, y1=2.0, x2=3, y2=', doc_id % 120, '.0] [Область (%): x1=a]')"
    return qu.comment_boxes(given(s, d, "labels").selectExpr("doc_id AS image", f"{comment} AS comment"))


@query("g01_compare_pixels", duck("pixels") + " SELECT page_id, CAST(count_if(r <> r2) AS BIGINT) AS changed, max(abs(r - r2)) AS largest FROM pixels GROUP BY 1")
def _(s, d):
    p = table(s, d, "pixels")
    return qu.compare_pixels(p.select("page_id", "x", "y", F.col("r").alias("v")), p.select("page_id", "x", "y", F.col("r2").alias("v")))


@query("j19_compare_runs", duck("quality") + """, d AS (SELECT a.page, a.recall - b.recall AS recall, a.hit6 - b.hit6 AS hit6 FROM quality b JOIN quality a ON a.page = b.page AND b.run_id = 'before' AND a.run_id = 'after'), u AS (SELECT page, 'recall' AS metric, recall AS delta FROM d UNION ALL SELECT page, 'hit6', hit6 FROM d)
SELECT page, metric, round(delta, 6) AS delta, metric = 'recall' AND round(delta, 9) < -0.005::DOUBLE AS regression FROM u WHERE round(abs(delta), 9) >= 0.005::DOUBLE""")
def _(s, d):
    q = table(s, d, "quality")
    return qu.compare_runs(q.filter("run_id = 'before'"), q.filter("run_id = 'after'"), ["recall", "hit6"])


@query("j20_validate_resume", duck("run_pages") + """ SELECT id, CASE WHEN id::BIGINT % 13 = 0 THEN 'pending' WHEN id::BIGINT % 7 = 0 THEN 'error' WHEN status <> 'done' THEN 'pending' WHEN id::BIGINT % 5 = 0 THEN 'error' ELSE 'done' END AS action FROM run_pages""")
def _(s, d):
    r = table(s, d, "run_pages")
    records = r.filter("CAST(id AS BIGINT) % 13 <> 0").withColumns({"image": F.expr("CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN 'other' ELSE image END"), "found_sha": F.expr("CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'x' ELSE result_sha END")})
    return qu.validate_resume(r.select("id", "image", "source_sha"), records)


@query("j16_pair_annotations", duck("sheets") + """ SELECT 'p' || page_id AS stem, 'p' || page_id || CASE WHEN page_id % 2 = 0 THEN '.png' ELSE '.jpg' END AS image, 'p' || page_id || '-mask.png' AS mask, CASE WHEN page_id % 5 = 0 THEN 'p' || page_id || '_mask-2.png' END AS zones FROM sheets WHERE page_id % 3 > 0""")
def _(s, d):
    p = table(s, d, "sheets")
    kinds = (("page_id % 2 = 0", ".png"), (None, ".jpg"), ("page_id % 3 > 0", "-mask.png"), ("page_id % 3 > 0", "_mask.webp"), ("page_id % 5 = 0", "_mask-2.png"), (None, ".txt"))
    files = None
    for cond, tail in kinds:
        part = (p.filter(cond) if cond else p).select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(tail)).alias("path"))
        files = part if files is None else files.unionByName(part)
    return qu.pair_annotations(files)


@query("g02_intake_registry", duck("run_pages") + " SELECT image, id::BIGINT % 3 = 0 AS has_mask, CASE WHEN id::BIGINT % 4 = 0 THEN 'missing' ELSE status END AS status FROM run_pages")
def _(s, d):
    r = table(s, d, "run_pages")
    files = r.select("image", F.col("source_sha").alias("sha"), F.expr("CAST(id AS BIGINT) % 3 = 0").alias("has_mask"))
    return qu.intake_registry(files, r.filter("CAST(id AS BIGINT) % 4 <> 0")).select("image", "has_mask", "status")


@query("g03_page_scope", duck("sheets") + " SELECT page_id, CASE WHEN contains(n, 'page17') THEN 'all' WHEN contains(n, '9') THEN 'sfx' WHEN n LIKE 'sfx/%' THEN 'sfx' ELSE 'text' END AS scope FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'sfx/page' ELSE 'text/page' END || page_id AS n FROM sheets)")
def _(s, d):
    p = table(s, d, "sheets").selectExpr("page_id", "concat(CASE WHEN page_id % 4 = 0 THEN 'sfx/page' ELSE 'text/page' END, page_id) AS name")
    return qu.page_scope(p, s.createDataFrame([(2, "9", "sfx"), (1, "page17", "all")], "prio int, part string, scope string")).select("page_id", "scope")


@query("t02_top_blobs", duck("regions") + " SELECT page_id, region_id AS comp_id, row_number() OVER (PARTITION BY page_id ORDER BY w * h DESC, region_id) AS rank FROM regions WHERE w * h >= 1500 QUALIFY rank <= 8")
def _(s, d):
    c = table(s, d, "regions").selectExpr("page_id", "region_id AS comp_id", "w * h AS size")
    return qu.top_blobs(c, 8, 1500).select("page_id", "comp_id", F.col("rank").cast("long").alias("rank"))


@query("j28_verify_artifacts", duck("run_pages") + """ SELECT id, CASE WHEN id::BIGINT % 11 = 0 THEN 'report' WHEN id::BIGINT % 7 = 0 THEN 'input' WHEN id::BIGINT % 5 = 0 THEN 'settings' ELSE 'languages' END AS reason FROM run_pages WHERE id::BIGINT % 11 = 0 OR id::BIGINT % 7 = 0 OR id::BIGINT % 5 = 0 OR id::BIGINT % 9 = 0
UNION ALL SELECT id, 'artifact' FROM run_pages WHERE id::BIGINT % 11 <> 0 AND id::BIGINT % 4 = 0""")
def _(s, d):
    r = table(s, d, "run_pages").withColumn("k", F.col("id").cast("long"))
    manifest = r.select("id", F.col("source_sha").alias("input_sha"), F.lit("s").alias("settings"), F.lit("ja").alias("source_lang"), F.lit("ru").alias("target_lang"))
    reports = r.filter("k % 11 <> 0").select("id", F.expr("CASE WHEN k % 7 = 0 THEN 'z' ELSE source_sha END AS input_sha"), F.expr("CASE WHEN k % 5 = 0 THEN 't' ELSE 's' END AS settings"), F.create_map(F.col("image"), F.col("result_sha")).alias("artifacts"), F.expr("CASE WHEN k % 9 = 0 THEN NULL ELSE 'ja' END AS source_lang"), F.lit("ru").alias("target_lang"))
    files = r.select(F.col("image").alias("path"), F.expr("CASE WHEN k % 4 = 0 THEN 'q' ELSE result_sha END AS sha"))
    return qu.verify_artifacts(manifest, reports, files)
