"""Jobs, events, versions, caches and exports as tables. Windows always have keys; where these are few (lanes, caches), running sums have two
passes, so that a lane may have a third of all rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grouped import per_group_running

TERMINAL = ("job.finished", "job.failed", "job.cancelled")
READY = ("done", "offline", "ready")


def _up_to(w, before: bool = False):
    return w.rowsBetween(Window.unboundedPreceding, -1 if before else 0)


def job_status(events: DataFrame) -> DataFrame:
    """events(job_id, event_id, ts, type, progress) → the first terminal event decides; progress counts up to it."""
    at = F.struct("ts", "event_id")
    ended = F.col("type").isin(list(TERMINAL))
    first = events.groupBy("job_id").agg(F.min(F.when(ended, F.struct("ts", "event_id", "type"))).alias("end"))
    df = events.join(first, "job_id")
    alive = F.col("end").isNull() | (at <= F.struct("end.ts", "end.event_id"))
    moved = F.when((F.col("type") == "job.progress") & alive, at)
    return df.groupBy("job_id").agg(
        F.coalesce(F.first("end.type"), F.lit("job.running")).alias("status"), F.max_by("progress", moved).alias("progress"), F.count_if(~alive).alias("n_ignored"),
    )


def running_sum(df: DataFrame, keys: list[str], part: Column, order: list, value: Column, name: str, descending: bool = False) -> DataFrame:
    """df with name: the sum of value over the rows of the same keys up to this one. part: a coarse form of the order (a day, a range of
    numbers); sums by part are summed up first, and rows are ranked within their part alone."""
    rows = df.withColumns({"_part": part, "_value": value})
    sums = rows.groupBy(*keys, "_part").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(F.desc("_part") if descending else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_part").alias("_day"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    rows = rows.withColumn(name, F.sum("_value").over(_up_to(Window.partitionBy(*keys, "_part").orderBy(*order))))
    on = F.col("_part").eqNullSafe(F.col("_day"))
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return rows.join(starts, on).withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_value", "_day", "_start", *[f"_key{i}" for i in range(len(keys))])


def queue_positions(jobs: DataFrame, lane: str = "lane", running_first: bool = False) -> DataFrame:
    """Place among the queued of a lane by submission; 0 for others. With running_first, running jobs have the first places, by submission too."""
    part, order = F.to_date("submitted"), ["submitted", "job_id"]
    queued, running = F.col("status") == "queued", F.col("status") == "running"
    df = running_sum(jobs, [lane], part, order, queued.cast("long"), "_place")
    if not running_first:
        return df.withColumn("position", F.when(queued, F.col("_place")).otherwise(0)).drop("_place")
    df = running_sum(df, [lane], part, order, running.cast("long"), "_first")
    n = jobs.groupBy(F.col(lane).alias("_lane")).agg(F.count_if(running).alias("_n"))  # one row for each lane
    df = df.join(n, F.col(lane).eqNullSafe(F.col("_lane")))
    place = F.when(running, F.col("_first")).when(queued, F.col("_n") + F.col("_place")).otherwise(0)
    return df.withColumn("position", place).drop("_place", "_first", "_lane", "_n")


def eta(jobs: DataFrame, lane: str = "lane", last: int = 20) -> DataFrame:
    """jobs(job_id, lane, status, progress, seconds, finished: null while unfinished) with eta: the rest of queued and running jobs by the mean
    duration of the lane's last completions; null where there is none."""
    newest = Window.partitionBy(lane).orderBy(F.desc("finished"), F.desc("job_id"))
    recent = jobs.filter(F.col("finished").isNotNull()).select(lane, "seconds", F.row_number().over(newest).alias("_r")).filter(F.col("_r") <= last)
    means = recent.groupBy(F.col(lane).alias("_lane")).agg(F.avg("seconds").alias("_mean"))
    df = jobs.join(means, F.col(lane).eqNullSafe(F.col("_lane")), "left")
    rest = F.greatest(F.lit(0.0), F.col("_mean") * (100 - F.coalesce("progress", F.lit(0))) / 100)
    return df.withColumn("eta", F.when(F.col("status").isin("queued", "running") & F.col("_mean").isNotNull(), F.round(rest, 6))).drop("_lane", "_mean")


def keep_last(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def evict(index: DataFrame, max_bytes: int) -> DataFrame:
    """index(cache_id, token, size, last_used, and locked where there is such a column) with kept: the newest whose sizes add up to max_bytes;
    larger ones were never stored. Locked ones stay, of whatever size and age, and count."""
    locked = F.coalesce("locked", F.lit(False)) if "locked" in index.columns else F.lit(False)
    df = index.withColumn("_locked", locked).filter((F.col("size") <= max_bytes) | F.col("_locked"))
    free = F.when(F.col("_locked"), 0).otherwise(F.col("size"))
    df = running_sum(df, ["cache_id"], F.to_date("last_used"), [F.desc("last_used"), F.desc("token")], free, "_sum", descending=True)
    if "locked" in index.columns:
        fixed = df.filter("_locked").groupBy(F.col("cache_id").alias("_cache")).agg(F.sum("size").alias("_fixed"))
        df = df.join(fixed, F.col("cache_id").eqNullSafe(F.col("_cache")), "left").withColumn("_sum", F.col("_sum") + F.coalesce("_fixed", F.lit(0))).drop("_cache", "_fixed")
    return df.withColumn("kept", F.col("_locked") | (F.col("_sum") <= max_bytes)).drop("_locked", "_sum")


def apply_versions(current: DataFrame, edits: DataFrame) -> DataFrame:
    """current(page_id, version), edits(page_id, edit_id, ts, base_version) → each edit in order of arrival: accepted if its base is null or the
    version at that time, which it then raises by one."""
    df = edits.join(current, "page_id", "left").select("page_id", "edit_id", "ts", "base_version", F.coalesce("version", F.lit(0).cast("long")).alias("version"))

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        version = None
        for page, edit, _, base, first in rows:
            version = first if version is None else version
            ok = base is None or base == version
            version += ok
            yield page, edit, ok, version

    return per_group_running(df, ["page_id"], ["ts", "edit_id"], fold, "page_id long, edit_id long, accepted boolean, version long")


def apply_single_edits(current: DataFrame, edits: DataFrame) -> DataFrame:
    """As apply_versions where a page has one edit at most: a plain join."""
    df = edits.join(current, "page_id", "left")
    now = F.coalesce("version", F.lit(0).cast("long"))
    ok = F.col("base_version").isNull() | (F.col("base_version") == now)
    return df.select("page_id", "edit_id", ok.alias("accepted"), (now + ok.cast("long")).alias("version"))


def provenance_current(pages: DataFrame) -> DataFrame:
    """pages with current: the result is of the visual version and settings that hold now."""
    return pages.withColumn("current", F.coalesce((F.col("result_version") >= F.col("visual_version")) & (F.col("result_fingerprint") == F.col("fingerprint")), F.lit(False)))


def last_failed(jobs: DataFrame) -> DataFrame:
    failed = jobs.filter(F.col("status") == "failed")
    return failed.groupBy("kind", "page_id").agg(F.max_by("job_id", F.struct("finished", "job_id")).alias("job_id"))


def active_jobs(jobs: DataFrame) -> DataFrame:
    """The unfinished job of each kind and page: one that runs before one that waits, then the first submitted."""
    waits = jobs.filter(F.col("status").isin("running", "queued"))
    return waits.groupBy("kind", "page_id").agg(F.min_by("job_id", F.struct(F.col("status") == "queued", "submitted", "job_id")).alias("job_id"))


def queue_wait(events: DataFrame, queued: str, started: str) -> DataFrame:
    """Seconds from the first queued to the first started event, 0 at least."""
    first = lambda t: F.min(F.when(F.col("type") == t, F.col("ts")))
    df = events.groupBy("job_id").agg(first(queued).alias("q"), first(started).alias("s"))
    return df.select("job_id", F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col("q"), F.col("s"))).cast("long").alias("wait"))


def settle_pages(pages: DataFrame, ended: DataFrame, active: DataFrame) -> DataFrame:
    """pages(page_id, status, previous, has_result, result_version, visual_version), ended(page_id, kind, outcome, is_current), active(page_id):
    the status that pages of ended jobs get; other pages and those of active jobs keep theirs."""
    df = pages.join(ended, "page_id", "left").join(active.select("page_id", F.lit(True).alias("_busy")).distinct(), "page_id", "left")
    touched = F.col("kind").isNotNull() & (F.col("kind") != "export") & F.col("_busy").isNull() & F.col("status").isin("queued", "running")
    fresh = F.col("has_result") & (F.col("result_version") >= F.col("visual_version"))
    unfinished = F.when(F.col("has_result"), "edited").otherwise("idle")
    new = (
        F.when((F.col("outcome") == "failed") & (F.col("is_current") | (F.col("status") == "running")), "error").when(F.col("outcome") == "failed", "idle")
        .when(F.col("kind") == "apply", "edited").when(fresh & F.col("previous").isin("done", "offline"), F.col("previous")).when(fresh, "done").otherwise(unfinished)
    )
    return df.withColumn("status", F.when(touched, new).otherwise(F.col("status"))).select(*pages.columns)


def export_readiness(pages: DataFrame, artifacts: DataFrame, required: list[str], versions: DataFrame | None = None) -> DataFrame:
    """pages(page_id, status, result_version, clean_version: of the document that each was made from, null where nobody knows), artifacts(page_id,
    kind) → state (ready, pending, blocked) and reason. required: result, clean or both. versions(page_id, version): what the request asks
    for; pages that do not exist are blocked.

    Errors and pages that have not begun are blocked; queued and running ones are pending. What a finished page (done, offline) lacks blocks it, any
    other waits for it, as it does for a version that is too old, or not known. A clean image of an edited page is pending."""
    have = artifacts.filter(F.col("kind").isin(required)).groupBy("page_id").agg(F.collect_set("kind").alias("_kinds"))
    df = pages.withColumn("_there", F.lit(True)).join(have, "page_id", "left")
    if versions is not None:
        df = df.join(versions.select("page_id", F.col("version").alias("_version")), "page_id", "full_outer")
    else:
        df = df.withColumn("_version", F.lit(0))
    status, finished = F.coalesce("status", F.lit("idle")), F.col("status").isin("done", "offline")
    at_least = F.coalesce("_version", F.lit(0))
    reason = F.when(F.col("_there").isNull(), "missing").when(status == "error", "error").when(status.isin("queued", "running"), "busy").when(status == "idle", "not done")
    for kind in ("result", "clean"):
        if kind not in required:
            continue
        if kind == "clean":
            reason = reason.when(status == "edited", "edited")
        made = F.col(f"{kind}_version") if f"{kind}_version" in pages.columns else F.lit(None).cast("long")
        reason = reason.when(~F.coalesce(F.array_contains("_kinds", kind), F.lit(False)), F.when(finished, f"no {kind}").otherwise(f"{kind} to come"))
        reason = reason.when(made.isNull() & ~finished, f"{kind} unknown").when(made < at_least, f"{kind} outdated")
    reason = reason.otherwise("")
    state = F.when(reason == "", "ready").when(reason.isin("missing", "error", "not done", "no result", "no clean"), "blocked").otherwise("pending")
    return df.select("page_id", state.alias("state"), reason.alias("reason"))


def run_progress(run_pages: DataFrame, elapsed: DataFrame) -> DataFrame:
    """run_pages(run_id, status, seconds), elapsed(run_id, elapsed) → counts and the rest by the mean of positive durations."""
    df = run_pages.groupBy("run_id").agg(
        F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "error").alias("error"), F.count("*").alias("total"),
        F.avg(F.when((F.col("status") != "pending") & (F.col("seconds") > 0), F.col("seconds"))).alias("mean"),
    ).join(elapsed, "run_id", "left")
    rest = F.col("total") - F.col("done") - F.col("error")
    left = F.greatest(F.lit(0.0), F.col("mean") * rest - F.coalesce("elapsed", F.lit(0.0)))
    return df.select("run_id", "done", "error", "total", F.round(F.when(rest > 0, left), 6).alias("eta"))


def dirty_bounds(prev: DataFrame, new: DataFrame, sheets: DataFrame) -> DataFrame:
    """prev and new(page_id, region_id, bubble_id, translation, ink box l, t, r, b) → page_id, box to draw again (null: all of it)."""
    both = prev.alias("p").join(new.alias("n"), ["page_id", "region_id"], "full_outer").select(
        "page_id", "region_id", F.coalesce("n.bubble_id", "p.bubble_id").alias("bubble_id"), (F.col("p.l").isNull() | F.col("n.l").isNull()).alias("lone"),
        (~F.col("p.translation").eqNullSafe(F.col("n.translation"))).alias("changed"),
        *[f("p." + c, "n." + c).alias(c) for c, f in (("l", F.least), ("t", F.least), ("r", F.greatest), ("b", F.greatest))],
    )
    bubbles = both.filter(F.col("changed") & F.col("bubble_id").isNotNull()).select("page_id", "bubble_id").distinct().withColumn("hit", F.lit(True))
    df = both.join(bubbles, ["page_id", "bubble_id"], "left").withColumn("dirty", F.col("changed") | F.coalesce("hit", F.lit(False)))
    take = lambda f, c: f(F.when(F.col("dirty"), F.col(c)))
    df = df.groupBy("page_id").agg(F.bool_or("lone").alias("full"), take(F.min, "l").alias("l"), take(F.min, "t").alias("t"), take(F.max, "r").alias("r"), take(F.max, "b").alias("b"))
    df = df.join(sheets.select("page_id", "width", "height"), "page_id")
    clip = {"l": F.greatest("l", F.lit(0)), "t": F.greatest("t", F.lit(0)), "r": F.least("r", "width"), "b": F.least("b", "height")}
    return df.select("page_id", "full", *[F.when(~F.col("full"), v).alias(c) for c, v in clip.items()])


def short_reply_cap(regions: DataFrame, min_font: int) -> DataFrame:
    """regions(page_id, region_id, translation, font, high, interior_h, bx): for short replies (of four letters and digits at most, or of two
    words and eight characters) the size cap: 1.15 medians of the page's other bubble texts of readable size, or 0.45 of the inner height
    where there is none; min_font at least, and `high` at most."""
    text = F.trim("translation")
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    short = (text != "") & ((F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")) <= 4) | ((words <= 2) & (F.length(text) <= 8)))
    peers = regions.filter(F.col("bx").isNotNull() & (F.col("font") >= min_font)).select("page_id", F.col("region_id").alias("peer"), F.col("font").alias("peer_font"))
    df = regions.filter(short).join(peers, "page_id", "left")
    df = df.groupBy("page_id", "region_id", "high", "interior_h").agg(F.percentile(F.when(F.col("peer") != F.col("region_id"), F.col("peer_font")), 0.5).alias("median"))
    wanted = F.bround(F.coalesce(1.15 * F.col("median"), 0.45 * F.col("interior_h"))).cast("long")
    return df.select("page_id", "region_id", F.least(F.col("high"), F.greatest(F.lit(min_font), wanted)).cast("long").alias("cap"))


def storage_report(files: DataFrame) -> DataFrame:
    return files.groupBy("area").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def purge_candidates(exports: DataFrame, keep: DataFrame) -> DataFrame:
    return exports.filter(F.col("status") == "finished").join(keep, "export_id", "left_anti")


def job_board(jobs: DataFrame) -> DataFrame:
    """jobs(job_id, kind, page_id, pages, finished) with lane and needs_llm."""
    lane = F.when(F.col("kind") == "export", "export").when(F.col("kind").isin("edit", "apply", "region"), "edit").otherwise("batch")
    return jobs.withColumns({"lane": lane, "needs_llm": F.col("kind").isin("translate", "batch", "region")})


def active_pages(jobs: DataFrame) -> DataFrame:
    """Distinct pages, own and listed, of unfinished jobs that are no exports."""
    open_ = jobs.filter(~F.col("finished") & (F.col("kind") != "export"))
    return open_.select(F.explode(F.array_union(F.array("page_id"), "pages")).alias("page_id")).filter("page_id is not null").distinct()


def restore_queue(snapshot: DataFrame) -> DataFrame:
    """snapshot(job_id, state, lane, pos): each job once, by running > queued > history; running ones come back queued, in front."""
    rank = F.when(F.col("state") == "running", 0).when(F.col("state") == "queued", 1).otherwise(2)
    df = snapshot.withColumn("rank", rank)
    df = df.withColumn("_r", F.row_number().over(Window.partitionBy("job_id").orderBy("rank", "pos"))).filter("_r = 1")
    live = F.col("rank") < 2
    near = F.struct("rank", F.floor(F.col("pos") / 65536).alias("pos"))
    df = running_sum(df, ["lane"], near, ["rank", "pos", "job_id"], live.cast("long"), "_place")
    return df.select("job_id", "lane", F.when(live, "queued").otherwise("history").alias("state"), F.when(live, F.col("_place")).alias("place"))


def check_reorder(pages: DataFrame, request: DataFrame) -> DataFrame:
    """(project_id, page_id) of both → whether the request names each page of its project once."""
    a = pages.groupBy("project_id", "page_id").agg(F.count("*").alias("n"))
    b = request.groupBy("project_id", "page_id").agg(F.count("*").alias("m"))
    both = a.join(b, ["project_id", "page_id"], "full_outer")
    return both.groupBy("project_id").agg(F.bool_and((F.coalesce("n", F.lit(0)) == 1) & (F.coalesce("m", F.lit(0)) == 1)).alias("valid"))


def retry_set(jobs: DataFrame, active: DataFrame, ready: DataFrame) -> DataFrame:
    """Failed jobs to queue again at the end of their lane: none of pages that are busy or ready."""
    df = jobs.filter(F.col("status") == "failed").join(active, "page_id", "left_anti").join(ready, "page_id", "left_anti")
    return running_sum(df, ["lane"], F.to_date("submitted"), ["submitted", "job_id"], F.lit(1).cast("long"), "place").select("job_id", "lane", "place")


def append_sources(pages: DataFrame, files: DataFrame) -> DataFrame:
    """files(project_id, path, ord) that no page of the project has, with positions after its last."""
    new = files.join(pages.select("project_id", F.col("source_path").alias("path")), ["project_id", "path"], "left_anti")
    last = pages.groupBy("project_id").agg(F.max("pos").alias("last"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("ord", "path"))
    return new.join(last, "project_id", "left").select("project_id", "path", (F.coalesce("last", F.lit(-1)) + place).cast("long").alias("pos"))


def natural_key(name: str | Column) -> Column:
    """Sort key in which runs of digits, of any length, compare as numbers and come before text."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, r"^0+(?=[0-9])", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(F.concat(F.lit("1"), p))

    return F.array_join(F.transform(parts, part), "\x00")


def natural_sort(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return df.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy(natural_key(name), name)).cast("long"))


def match_codes(issued: DataFrame, redeemed: DataFrame, ttl: int = 300) -> DataFrame:
    """issued(device_id, ts, code), redeemed(device_id, ts, code, event_id): a code holds for ttl seconds, until the next one is issued, and
    for one success."""
    w = Window.partitionBy("device_id").orderBy("ts", "code")
    i = issued.withColumn("next", F.lead("ts").over(w)).alias("i")
    until = F.least(F.timestamp_add("SECOND", F.lit(ttl), F.col("i.ts")), F.coalesce("i.next", F.timestamp_add("SECOND", F.lit(ttl), F.col("i.ts"))))
    r = redeemed.alias("r")
    hits = r.join(i, (F.col("r.device_id") == F.col("i.device_id")) & (F.col("r.code") == F.col("i.code")) & (F.col("r.ts") >= F.col("i.ts")) & (F.col("r.ts") < until))
    first = hits.groupBy("i.device_id", F.col("i.ts").alias("issued")).agg(F.min(F.struct(F.col("r.ts").alias("ts"), F.col("r.event_id").alias("event_id"))).alias("m"))
    return redeemed.select("event_id", "device_id").join(first.select(F.col("m.event_id").alias("event_id"), F.lit(True).alias("_ok")), "event_id", "left").select("event_id", "device_id", F.coalesce("_ok", F.lit(False)).alias("accepted"))
