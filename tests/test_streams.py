"""Streams over several batches, with late and repeated rows, against their batch twins."""

import random
import time

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import state
from scriptorium.streaming import jobs


@pytest.fixture
def streamed(spark, tmp_path):
    """rows of (seconds, ...) in batches → a stream of them, a batch at a time, with ts in place of the seconds."""
    made = iter(range(100))

    def make(batches, schema):
        path = str(tmp_path / f"in{next(made)}")
        for rows in batches:
            df = spark.createDataFrame(rows, f"s long, {schema}")
            df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s").coalesce(1).write.mode("append").parquet(path)
            time.sleep(0.05)
        return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)

    return make


@pytest.fixture
def collected(spark, tmp_path):
    made = iter(range(100))

    def run(out, mode="append"):
        name = f"out{next(made)}_{time.time_ns()}"
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        return [tuple(r) for r in spark.table(name).collect()]

    return run


def test_stalls(spark, streamed, collected):
    schema = "job_id string, event_id long, type string"
    go, end = "job.progress", "job.finished"
    stream, whole = streamed([
        [(0, "a", 1, go), (10, "a", 2, go), (0, "b", 3, go), (0, "c", 4, go), (5, "c", 5, end)],
        [(100, "a", 6, go), (110, "a", 7, end), (10, "a", 2, go), (200, "tick", 8, go)],  # the second event again
        [(230, "d", 9, go), (4000, "tick", 10, end)],
        [(1, "b", 11, end), (6000, "tick2", 12, end)],  # b's end is too late
        [(9000, "tick3", 13, end)],
    ], schema)
    got = sorted((j, int(t.timestamp()), k) for j, t, k in collected(jobs.stall_stream(stream, 30, 1800, "1 minute")) if not j.startswith("tick"))
    zero = spark.sql("SELECT timestamp_seconds(1000000)").first()[0].timestamp()
    got = [(j, t - int(zero), k) for j, t, k in got]
    assert [g for g in got if g[0] in "bd" and g[2] == "timeout"] == [("b", 0, "timeout"), ("d", 230, "timeout")]
    assert not any(g[0] == "c" for g in got)
    twin = {(r.job_id, r.kind) for r in jobs.stalls(whole.dropDuplicates()).collect() if r.job_id == "a"}
    assert {(j, k) for j, _, k in got if j == "a"} <= twin == {("a", "beat")}


def test_submissions(spark, streamed, collected):
    rng = random.Random(1)
    rows = [(10 * i, i, f"https://h/p{rng.randrange(4)}#f{i}", rng.choice(["/a.png", "/b.png", "blob:x"]), rng.random() < 0.2) for i in range(60)]
    stream, whole = streamed([rows[:20], rows[20:45], rows[45:]], "sub_id long, page_url string, image_url string, fresh boolean")
    got = collected(jobs.dedupe_stream(stream, "1 hour"))
    assert sorted(got) == sorted((r.sub_id, r.work_key, r.action) for r in jobs.dedupe_submissions(whole).collect())
    assert {a for _, _, a in got} == {"new", "reuse", "error"}


def test_late_and_forgotten_submissions(spark, streamed, collected):
    row = lambda s, i, p: (s, i, p, "/a.png", False)
    stream, _ = streamed([[row(0, 1, "x")], [row(500_000, 2, "y")], [row(500_010, 3, "x"), row(5, 4, "x")]], "sub_id long, page_url string, image_url string, fresh boolean")
    got = {i: a for i, _, a in collected(jobs.dedupe_stream(stream, "1 hour", forget_s=600))}
    assert got == {1: "new", 2: "new", 3: "new", 4: "reuse"}  # x was forgotten at the third row, but not at the time of the late one


def test_codes(spark, streamed, collected):
    rng = random.Random(2)
    times = sorted(rng.sample(range(3000), 120))
    issued = [(t, rng.randrange(3), rng.randrange(4)) for t in times[::2]]
    tries = [(t, rng.randrange(3), rng.randrange(4), t) for t in times[1::2]]
    cut = lambda rows: [[r for r in rows if lo <= r[0] < lo + 1000] for lo in (0, 1000, 2000)]
    i_stream, i_whole = streamed(cut(issued), "device_id long, code long")
    r_stream, r_whole = streamed(cut(tries), "device_id long, code long, event_id long")
    got = collected(jobs.redeem_stream(i_stream, r_stream, 200, "10 minutes"))
    want = [(r.event_id, r.device_id, r.accepted) for r in state.match_codes(i_whole, r_whole, 200).collect()]
    assert sorted(got) == sorted(want) and 0 < sum(a for _, _, a in got) < len(got)


def test_limits_over_batches(spark, streamed, collected):
    rows = [(i * 7, "k" if i % 3 else "m", i) for i in range(60)]
    stream, whole = streamed([rows[:15], rows[15:40], rows[40:]], "key string, event_id long")
    assert sorted(collected(jobs.rate_limit_stream(stream, 2, 60))) == sorted(map(tuple, jobs.rate_limit(whole, 2, 60).collect()))


def test_admission_over_batches(spark, streamed, collected):
    rng = random.Random(3)
    rows = [(i, "q" if i % 4 else "r", i, rng.choice(["submit", "submit", "hit", "end"])) for i in range(80)]
    stream, whole = streamed([rows[:30], rows[30:50], rows[50:]], "queue string, event_id long, kind string")
    assert sorted(collected(jobs.admit_stream(stream, 3))) == sorted(map(tuple, jobs.admit_pending(whole, 3).collect()))


def test_first_end_decides_in_any_order_of_batches(spark, streamed, collected):
    job = lambda s, i, t, p=None: (s, "j", i, t, p)
    rows = [[job(1, 1, "job.started"), job(9, 5, "job.failed")], [job(5, 3, "job.progress", 140), job(7, 4, "job.finished")], [job(8, 6, "job.progress", 3)]]
    stream, whole = streamed(rows, "job_id string, event_id long, type string, progress long")
    got = collected(jobs.job_state_stream(stream), "update")
    assert got[-1] == ("j", "job.finished", 100)
    assert state.job_status(whole).first().status == "job.finished"


def test_pages_of_ended_jobs_are_closed(spark):
    pages = spark.createDataFrame([("a", 1, "running"), ("a", 2, "done"), ("a", 5, "queued"), ("a", 6, "running"), ("b", 3, "running"), ("c", 4, "running")], "job_id string, page_id long, status string")
    ended = spark.createDataFrame([("a", "job.finished"), ("b", "job.cancelled")], "job_id string, type string")
    busy = spark.createDataFrame([(6,)], "page_id long")
    assert sorted(map(tuple, jobs.close_pages(pages, ended, busy).collect())) == [("a", 1, "error"), ("a", 5, "idle"), ("b", 3, "idle")]


# ---------------------------------------------------------------- true time, late rows, nulls, restarts

#: Seconds around which clocks of America/Los_Angeles are put forward and back.
SPRING, AUTUMN = 1_615_716_000 - 1_000_000, 1_636_275_600 - 1_000_000


@pytest.fixture(params=["UTC", "America/Los_Angeles", "Asia/Tokyo"])
def zone(spark, request, monkeypatch):
    """Session zone, and another zone for the driver's process."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    monkeypatch.setenv("TZ", {"UTC": "Asia/Tokyo", "Asia/Tokyo": "America/Los_Angeles"}.get(request.param, "UTC"))
    time.tzset()
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)
    monkeypatch.undo()
    time.tzset()


def mixed_up(rows, seed, within=50):
    """Rows in another order, none later than `within` seconds; and in batches."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[0] + rng.uniform(0, within))
    third = len(rows) // 3
    return [rows[:third], rows[third : 2 * third], rows[2 * third :]]


def test_streams_equal_their_twins_in_any_zone(spark, streamed, collected, zone):
    rng = random.Random(7)
    times = sorted(rng.choice([SPRING, AUTUMN]) + rng.randrange(-3000, 3000) for _ in range(150))
    rows = [(t, rng.choice(["a", "b", None]), i, rng.choice(["job.progress"] * 5 + ["job.finished"])) for i, t in enumerate(times)]
    late = [*mixed_up(rows, 1), [(AUTUMN + 9000, "tick", 900, "job.finished")]]
    stream, whole = streamed(late, "job_id string, event_id long, type string")
    # what follows the last event is the watermark, a minute before the tick
    want = jobs.stall_alerts(whole, 30, 900, F.timestamp_seconds(F.lit(1_000_000 + AUTUMN + 9000 - 60))).filter("job_id IS NULL OR job_id <> 'tick'")
    micros = lambda df: sorted(map(tuple, df.select("job_id", F.unix_micros("since"), "kind").collect()), key=repr)
    out = jobs.stall_stream(stream, 30, 900, "1 minute").withColumn("since", F.unix_micros("since"))
    got = sorted(collected(out), key=repr)
    assert got == micros(want) and {k for *_, k in got} == {"beat", "timeout"}
    keyed = lambda df: df.withColumnRenamed("job_id", "key")
    got = collected(jobs.rate_limit_stream(keyed(stream), 3, 400, "1 minute", wait=True))
    want = jobs.rate_limit(keyed(whole.filter("job_id IS NULL OR job_id <> 'tick'")), 3, 400)
    assert sorted(got, key=repr) == sorted(map(tuple, want.collect()), key=repr) and {a for *_, a in got} == {True, False}


def test_waiting_streams_with_late_rows(spark, streamed, collected):
    rng = random.Random(9)
    rows = [(i * 5, rng.choice("qr"), i, rng.choice(["submit", "submit", "hit", "end"])) for i in range(120)]
    stream, whole = streamed([*mixed_up(rows, 2), [(5000, "tick", 999, "end")]], "queue string, event_id long, kind string")
    got = collected(jobs.admit_stream(stream, 3, wait=True))
    assert sorted(got) == sorted(map(tuple, jobs.admit_pending(whole, 3).collect())) and {a for *_, a in got} == {True, False}
    times = rng.sample(range(2500), 160)
    issued = [(t, rng.randrange(2), rng.randrange(3)) for t in times[::2]]
    tries = [(t, rng.randrange(2), rng.choice([0, 1, 2, None]), t) for t in times[1::2]]
    i_stream, i_whole = streamed([*mixed_up(issued, 3), [(9000, 7, 1)]], "device_id long, code long")
    r_stream, r_whole = streamed([*mixed_up(tries, 4), [(9000, 8, 1, 9000)]], "device_id long, code long, event_id long")
    got = collected(jobs.redeem_stream(i_stream, r_stream, 200, "1 minute", wait=True))
    want = [(r.event_id, r.device_id, r.accepted) for r in state.match_codes(i_whole, r_whole.filter("event_id < 9000"), 200).collect()]
    assert sorted(got) == sorted(want) and 0 < sum(a for *_, a in got) < len(got)


def test_jobs_that_fail_are_asked_for_again(spark, streamed, collected):
    rng = random.Random(11)
    page = lambda: f"https://h/p{rng.randrange(3)}#f"
    subs = [(10 * i, i, page(), rng.choice(["/a.png", "BLOB:x", None]), rng.choice([True, False, False, None])) for i in range(90)]
    by_id = {s[1]: s for s in subs}
    ends = [(10 * i + rng.randrange(1, 40), i, by_id[i][2], by_id[i][3], rng.choice(["error", "done", "cancelled", None])) for i in rng.sample(range(90), 60)]
    s_stream, s_whole = streamed([*mixed_up(subs, 5), [(9000, 900, "tick", "t", False)]], "sub_id long, page_url string, image_url string, fresh boolean")
    e_stream, e_whole = streamed([*mixed_up(ends, 6), [(9000, 900, "tick", "t", "done")]], "sub_id long, page_url string, image_url string, status string")
    current, want = {}, []
    for _, _, kind, r in sorted([(s[0], s[1], 0, s) for s in subs] + [(e[0], e[1], 1, e) for e in ends], key=lambda x: x[:3]):
        key = "|".join(x for x in (r[2].split("#")[0], r[3]) if x is not None)
        if kind:
            if current.get(key, (None,))[0] == r[1]:
                current[key] = (r[1], r[4] == "done")
        elif r[3] and r[3].lower().startswith("blob:"):
            want.append((r[1], key, "error"))
        else:
            again = bool(r[4]) or not current.get(key, (None, False))[1]
            current[key] = (r[1] if again else current[key][0], True)
            want.append((r[1], key, "new" if again else "reuse"))
    got = sorted(map(tuple, jobs.dedupe_submissions(s_whole.filter("sub_id < 900"), e_whole).collect()))
    assert got == sorted(want) and {a for *_, a in got} == {"new", "reuse", "error"}
    assert sorted(collected(jobs.dedupe_stream(s_stream, "1 minute", ends=e_stream, wait=True))) == sorted(want)
    plain, p_whole = streamed([[(s[0], s[1], s[2], s[3], False) for s in part] for part in (subs[:40], subs[40:])], "sub_id long, page_url string, image_url string, fresh boolean")
    first = sorted(i for i, _, _ in collected(jobs.first_submissions(plain)))
    assert first == sorted(r.sub_id for r in jobs.dedupe_submissions(p_whole).collect() if r.action == "new")


def test_nulls_do_not_end_a_stream(spark, streamed, collected):
    rows = [[(1, "j", 1, "job.started", None), (2, "j", None, "job.progress", None), (3, None, 3, None, 5)], [(4, "j", 4, "job.progress", 30), (9, "j", 5, None, None), (None, "j", 6, "job.failed", None)]]
    stream, _ = streamed(rows, "job_id string, event_id long, type string, progress long")
    got = collected(jobs.job_state_stream(stream), "update")
    assert [g for g in got if g[0] == "j"][-1] == ("j", "job.running", 30) and (None, "job.running", None) in got
    stalled = collected(jobs.stall_stream(stream.select("job_id", "event_id", "ts", "type"), 1, 100, "0 seconds").select("job_id", "kind"))
    assert set(stalled) == {("j", "beat"), (None, "beat")}


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    """Two runs over one checkpoint, the second with the later half of the events: timers and states hold over; states of before the first run."""
    rows = [(i * 17 % 400, "k" if i % 2 else "m", i) for i in range(60)]
    rows = sorted(rows)
    first = spark.createDataFrame([("k", [1_000_000 * 1_000_000 - 1])], "key string, stamps array<long>")
    put = lambda part: spark.createDataFrame(part, "s long, key string, event_id long").selectExpr("timestamp_seconds(s + 1000000) AS ts", "key", "event_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for part in (rows[:30], [*rows[30:], (5000, "tick", 999)]):
        put(part)
        stream = spark.readStream.schema("ts timestamp, key string, event_id long").parquet(str(tmp_path / "in"))
        out = jobs.rate_limit_stream(stream, 2, 60, wait=True, initial=first)
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(240)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("key", "event_id", "allowed").collect()))
    before = spark.createDataFrame([(-1, "k", -1)], "s long, key string, event_id long")
    whole = spark.createDataFrame(rows, before.schema).unionByName(before).selectExpr("timestamp_micros((s + 1000000) * 1000000 + IF(s < 0, 999999, 0)) AS ts", "key", "event_id")
    assert got == sorted(map(tuple, jobs.rate_limit(whole, 2, 60).filter("event_id >= 0").collect()))
