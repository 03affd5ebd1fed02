"""Streams of job events and requests. Each stateful job folds the rows of a key in the order of event time (see `timed`) and has a batch twin
that folds the same way. Rows without a time are left out of streams and folds; late events after a terminal one change nothing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grouped import per_group_running
from ..operators.state import TERMINAL
from .timed import SECOND, Fold, streamed

# ---------------------------------------------------------------- job states


def _us(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")).alias("us")


def _timed(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """df with a watermark, without rows that have no time."""
    return df.filter(F.col(ts).isNotNull()).withWatermark(ts, delay)


def job_state_stream(events: DataFrame, delay: str = "1 hour", forget_s: int = 3600) -> DataFrame:
    """events(job_id, event_id, ts, type, progress) → changes of (job_id, status, progress), by update. The terminal event that is first by
    (ts, event_id) decides, in whatever order batches bring them; progress, within 0..100, is that of the last event before it that
    tells one. By event time, a state goes `forget_s` after its last event."""

    def step(key, state, row):
        status, end, end_id, progress, at, at_id, newest = state
        us, i, kind, told = row
        place = (us, i)
        newest = max(newest, us)
        if end is None or place < (end, end_id):
            if kind in TERMINAL:
                status, (end, end_id) = kind, place
            elif end is None:
                status = "job.running"
            if kind == "job.progress" and told is not None and (at is None or place > (at, at_id)):
                progress, (at, at_id) = min(100, max(0, told)), place
        return (status, end, end_id, progress, at, at_id, newest), []

    def changed(key, before, after):
        if (before or ("queued", 0, 0, None))[:4:3] != after[:4:3]:
            yield key, after[0], after[3]

    fold = Fold(
        key="job_id", rows="us long, i long, type string, progress long", out="job_id string, status string, progress long",
        state="status string, end long, end_id long, progress long, at long, at_id long, newest long",
        start=lambda: ("queued", None, None, None, None, None, 0), step=step, due=lambda s: s[6] + forget_s * SECOND, expire=lambda key, s, now: (None, []), changed=changed,
    )
    rows = _timed(events, "ts", delay).select("job_id", "ts", _us("ts"), F.coalesce("event_id", F.lit(-1)).cast("long").alias("i"), "type", F.col("progress").cast("long"))
    return streamed(rows, fold, mode="update")


# ---------------------------------------------------------------- limits


def _limiter(limit: int, window_s: float) -> Fold:
    """`limit` accepted requests of a key in the last window; a state is the times of these."""
    window = round(window_s * SECOND)

    def step(key, state, row):
        us, event = row
        if not key:
            return None, [(key, event, False)]
        stamps = [t for t in state[0] if us - t < window]
        ok = len(stamps) < limit
        return ([*stamps, us] if ok else stamps,), [(key, event, ok)]

    return Fold(
        key="key", rows="us long, event_id long", out="key string, event_id long, allowed boolean", state="stamps array<long>",
        start=lambda: ([],), step=step, due=lambda s: max(s[0]) + window if s[0] else None, expire=lambda key, s, now: (None, []),
    )


def rate_limit(requests: DataFrame, limit: int = 30, window_s: float = 60) -> DataFrame:
    """requests(key, event_id, ts) → allowed: fewer than `limit` allowed ones in the last window; refused ones do not count, an empty key is refused."""
    fold = _limiter(limit, window_s)
    return per_group_running(requests.filter("ts IS NOT NULL").select("key", _us("ts"), "event_id"), ["key"], ["us", "event_id"], fold.over, fold.out)


def rate_limit_stream(requests: DataFrame, limit: int = 30, window_s: float = 60, delay: str = "1 minute", wait: bool = False, initial: DataFrame | None = None) -> DataFrame:
    """As rate_limit, request by request as batches bring them, or, if they shall wait, when the watermark has passed them: then late ones, within
    the delay, change nothing. A key's state goes when its last allowed request has left the window. initial(key, stamps: array of
    microseconds): what earlier requests left."""
    return streamed(_timed(requests, "ts", delay).select("key", "ts", _us("ts"), "event_id"), _limiter(limit, window_s), wait=wait, initial=initial)


def _admission(cap: int, forget_s: int | None) -> Fold:
    """Unfinished jobs of a queue."""

    def step(key, state, row):
        us, event, kind = row
        busy, newest = state[0], max(state[1], us)
        if kind == "end":
            return (max(0, busy - 1), newest), []
        ok = kind == "hit" or busy < cap
        return (busy + (ok and kind == "submit"), newest), [(key, event, ok)]

    return Fold(
        key="queue", rows="us long, event_id long, kind string", out="queue string, event_id long, admitted boolean", state="busy long, newest long",
        start=lambda: (0, 0), step=step, due=lambda s: None if forget_s is None else s[1] + forget_s * SECOND, expire=lambda key, s, now: (None, []),
    )


def admit_pending(events: DataFrame, cap: int = 8, forget_s: int | None = None) -> DataFrame:
    """events(queue, event_id, ts, kind in submit, hit, end) → submissions with admitted: refused where `cap` are unfinished; cache hits take no slot.
    Given forget_s, jobs of a queue without any event for so long count as ended."""
    fold = _admission(cap, forget_s)
    return per_group_running(events.filter("ts IS NOT NULL").select("queue", _us("ts"), "event_id", "kind"), ["queue"], ["us", "event_id"], fold.over, fold.out)


def admit_stream(events: DataFrame, cap: int = 8, delay: str = "1 minute", forget_s: int = 86400, wait: bool = False, initial: DataFrame | None = None) -> DataFrame:
    """As admit_pending, event by event as batches bring them, or, if they shall wait, when the watermark has passed them. Jobs of a queue
    without any event for `forget_s`, by event time, count as ended. initial(queue, busy, newest: microseconds): unfinished jobs of before."""
    return streamed(_timed(events, "ts", delay).select("queue", "ts", _us("ts"), "event_id", "kind"), _admission(cap, forget_s), wait=wait, initial=initial)


# ---------------------------------------------------------------- stalls


def stalls(events: DataFrame, beat_s: int = 30, timeout_s: int = 1800) -> DataFrame:
    """events(job_id, event_id, ts, type): gaps of a running job: (job_id, since, kind, seconds); kind is beat for those longer than beat_s, timeout
    for those longer than the timeout."""
    df = events.withColumn("next", F.lead("ts").over(Window.partitionBy("job_id").orderBy("ts", "event_id")))
    gap = F.timestamp_diff("SECOND", F.col("ts"), F.col("next"))
    df = df.withColumn("seconds", gap.cast("long")).filter(~F.col("type").isin(list(TERMINAL)) & (F.col("seconds") > beat_s))
    return df.select("job_id", F.col("ts").alias("since"), F.when(F.col("seconds") > timeout_s, "timeout").otherwise("beat").alias("kind"), "seconds")


def stall_alerts(events: DataFrame, beat_s: int = 30, timeout_s: int = 1800, until: Column | None = None) -> DataFrame:
    """What stall_stream tells, of a whole table: (job_id, since, kind), a beat and a timeout being rows of their own. A job's last event is followed by
    `until`, or by nothing."""
    order = Window.partitionBy("job_id").orderBy("ts", "event_id")
    end = F.lit(None).cast("long") if until is None else F.unix_micros(until)
    df = events.filter("ts IS NOT NULL").withColumn("_gap", F.coalesce(F.lead(F.unix_micros("ts")).over(order), end) - F.unix_micros("ts"))
    kinds = F.array_compact(F.array(F.when(F.col("_gap") > beat_s * SECOND, "beat"), F.when(F.col("_gap") > timeout_s * SECOND, "timeout")))
    return df.filter(~F.coalesce(F.col("type").isin(list(TERMINAL)), F.lit(False))).select("job_id", F.col("ts").alias("since"), F.explode(kinds).alias("kind"))


def stall_stream(events: DataFrame, beat_s: int = 30, timeout_s: int = 1800, delay: str = "1 minute") -> DataFrame:
    """Jobs that run without an event, by event time: (job_id, since, kind): beat once after beat_s, timeout after timeout_s; with a timeout the
    job is given up. A terminal event ends the watch, an event after it begins one. Events wait until the watermark has passed them, so
    those that come in another order, within the delay, change nothing."""

    def step(key, state, row):
        us, _, kind = row
        return None if kind in TERMINAL else (us, False), []

    def expire(key, state, now):
        at, beaten = state
        if not beaten:
            return (at, True), [(key, at, "beat")]
        return None, [(key, at, "timeout")]

    fold = Fold(
        key="job_id", rows="us long, i long, type string", out="job_id string, since long, kind string", state="at long, beaten boolean",
        start=lambda: None, step=step, due=lambda s: s[0] + (timeout_s if s[1] else beat_s) * SECOND, expire=expire,
    )
    rows = _timed(events, "ts", delay).select("job_id", "ts", _us("ts"), F.coalesce("event_id", F.lit(-1)).cast("long").alias("i"), "type")
    return streamed(rows, fold, wait=True).select("job_id", F.timestamp_micros("since").alias("since"), "kind")


def close_pages(pages: DataFrame, ended: DataFrame, busy: DataFrame) -> DataFrame:
    """pages(job_id, page_id, status), ended(job_id, type of its end), busy(page_id): pages that another job has → pages that a job left running or
    queued when it ended: (job_id, page_id, status), with what they become: idle if they had not begun or the job was cancelled, else
    error. pages may be a stream against tables of ends and of busy pages."""
    left = pages.filter(F.col("status").isin("running", "queued")).join(ended.select("job_id", "type"), "job_id").join(busy, "page_id", "left_anti")
    again = (F.col("status") == "queued") | (F.col("type") == "job.cancelled")
    return left.select("job_id", "page_id", F.when(again, "idle").otherwise("error").alias("status"))


# ---------------------------------------------------------------- submissions and codes


def _work_key(df: DataFrame) -> DataFrame:
    return df.withColumn("work_key", F.concat_ws("|", F.regexp_replace("page_url", "#.*$", ""), "image_url"))


def _is_blob(url: str) -> Column:
    return F.coalesce(F.lower(F.col(url)).startswith("blob:"), F.lit(False))


def _work(forget_s: int | None) -> Fold:
    """The job of a key: who asked for it first, and whether it is queued, running or done."""

    def step(key, state, row):
        us, i, kind, blob, fresh = row
        job, live, newest = state
        newest = max(newest, us)
        if kind is not None:  # the end of a job
            return (job, live if i != job else kind == "done", newest), []
        if blob:
            return (job, live, newest), [(i, key, "error")]
        again = fresh or job is None or not live
        return (i if again else job, True, newest), [(i, key, "new" if again else "reuse")]

    return Fold(
        key="work_key", rows="us long, i long, status string, blob boolean, fresh boolean", out="sub_id long, work_key string, action string",
        state="job long, live boolean, newest long", start=lambda: (None, False, 0), step=step,
        due=lambda s: None if forget_s is None else s[2] + forget_s * SECOND, expire=lambda key, s, now: (None, []),
    )


def _work_rows(submissions: DataFrame, ends: DataFrame | None, delay: str | None) -> DataFrame:
    """Submissions and ends of jobs as rows of one fold. At the same time ends come after submissions with lower numbers."""
    columns = lambda status, fresh: ["work_key", "ts", _us("ts"), F.col("sub_id").cast("long").alias("i"), status.alias("status"), _is_blob("image_url").alias("blob"), fresh.alias("fresh")]
    keep = (lambda df: _timed(df, "ts", delay)) if delay else (lambda df: df.filter("ts IS NOT NULL"))
    rows = keep(_work_key(submissions)).select(*columns(F.lit(None).cast("string"), F.coalesce("fresh", F.lit(False))))
    if ends is not None:
        rows = rows.unionByName(keep(_work_key(ends)).select(*columns(F.coalesce("status", F.lit("")), F.lit(False))))
    return rows


def dedupe_submissions(submissions: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """submissions(sub_id, ts, page_url, image_url, fresh) → action: error for blobs, new for the first of a key and for forced ones, else reuse.
    With ends(sub_id, ts, page_url, image_url, status) a key whose job ended otherwise than done is new again; the end of a job that a
    forced one has replaced changes nothing."""
    if ends is None:
        df = _work_key(submissions)
        first = F.row_number().over(Window.partitionBy("work_key").orderBy("ts", "sub_id")) == 1
        action = F.when(_is_blob("image_url"), "error").when(F.coalesce("fresh", F.lit(False)) | first, "new").otherwise("reuse")
        return df.select("sub_id", "work_key", action.alias("action"))
    fold = _work(None)
    return per_group_running(_work_rows(submissions, ends, None).drop("ts"), ["work_key"], ["us", "i", F.col("status").isNotNull()], fold.over, fold.out)


def dedupe_stream(submissions: DataFrame, delay: str = "1 hour", forget_s: int = 86400, ends: DataFrame | None = None, wait: bool = False) -> DataFrame:
    """As dedupe_submissions, row by row as batches bring them, or when the watermark has passed them: (sub_id, work_key, action). A key is forgotten
    `forget_s` after its last row, by event time."""
    return streamed(_work_rows(submissions, ends, delay), _work(forget_s), wait=wait)


def first_submissions(submissions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream without forced submissions: those that start work, the first to come of each key within the delay; without a fold of our own."""
    rows = _timed(_work_key(submissions), "ts", delay).filter(~_is_blob("image_url"))
    return rows.dropDuplicatesWithinWatermark(["work_key"]).select("sub_id", "ts", "work_key")


def redeem_stream(issued: DataFrame, redeemed: DataFrame, ttl_s: int = 300, delay: str = "10 minutes", wait: bool = False) -> DataFrame:
    """issued(device_id, ts, code), redeemed(event_id, device_id, ts, code) → (event_id, device_id, accepted), as match_codes says, attempt by attempt as
    batches bring them, or when the watermark has passed them: the code must be the device's last one, not older than ttl_s, and not used. By
    event time, a code is forgotten with its lifetime. An attempt without a code is refused."""

    def step(key, state, row):
        us, event, code = row
        held, at = state
        if event is None:
            return (code, us), []
        ok = held is not None and code == held and 0 <= us - at < ttl_s * SECOND
        return (None if ok else held, at), [(event, key, ok)]

    fold = Fold(
        key="device_id", rows="us long, event_id long, code string", out="event_id long, device_id long, accepted boolean", state="code string, at long",
        start=lambda: (None, 0), step=step, due=lambda s: s[1] + ttl_s * SECOND, expire=lambda key, s, now: (None, []), order=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or ""),
    )
    columns = lambda event: ["device_id", "ts", _us("ts"), event.alias("event_id"), F.col("code").cast("string").alias("code")]
    both = _timed(issued, "ts", delay).select(*columns(F.lit(None).cast("long")))
    both = both.unionByName(_timed(redeemed, "ts", delay).select(*columns(F.col("event_id").cast("long"))))
    return streamed(both, fold, wait=wait)


# ---------------------------------------------------------------- sink


def publish_progress(stream: DataFrame, path: str, checkpoint: str, summary):
    """Writes each batch and its summary under the batch's number, so that a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        summary(batch).write.mode("overwrite").parquet(f"{path}/summary/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_totals(stream: DataFrame, path: str, checkpoint: str, keys: list[str], sums: dict[str, str]):
    """Writes each batch's rows and the totals of all batches so far: sums (a name → an SQL expression of a row) by keys. A batch writes its rows, then the
    totals, each under its number, and last its line in the ledger. Totals go on from those of the last batch in the ledger before it, so a batch that
    failed between its writes, or after them, counts once when it is repeated."""
    spark = stream.sparkSession

    def totals_at(number: int) -> DataFrame | None:
        try:
            done = spark.read.schema("batch long").json(f"{path}/ledger/*")
        except AnalysisException:  # no batch yet
            return None
        last = done.filter(F.col("batch") < number).agg(F.max("batch")).first()[0]
        return None if last is None else spark.read.parquet(f"{path}/totals/batch={last}")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        rows = spark.read.parquet(f"{path}/rows/batch={number}")
        new = rows.groupBy(*keys).agg(*[F.sum(F.expr(x)).alias(n) for n, x in sums.items()])
        before = totals_at(number)
        if before is not None:
            new = before.unionByName(new).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])
        new.write.mode("overwrite").parquet(f"{path}/totals/batch={number}")
        spark.range(1).select(F.lit(number).cast("long").alias("batch")).write.mode("overwrite").json(f"{path}/ledger/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def published_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals of the last batch in the ledger."""
    last = spark.read.schema("batch long").json(f"{path}/ledger/*").agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{path}/totals/batch={last}")
