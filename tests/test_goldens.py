"""Small cases with known results."""

from pyspark.sql import functions as F

from scriptorium.operators import filters, localization, merge, proposals, spatial, state
from scriptorium.sources import plans, readers
from scriptorium.streaming import jobs

BOX = "page_id long, region_id long, x long, y long, w long, h long"


def regions(spark, boxes, **more):
    rows = [(1, i, *b) for i, b in enumerate(boxes, 1)]
    df = spark.createDataFrame(rows, BOX)
    defaults = {"text": "t", "translation": "", "block_type": "narration", "class_name": "text_free", "confidence": 0.9, "document": False, "speaker": ""}
    for c, v in (defaults | more).items():
        df = df.withColumn(c, F.lit(v))
    return df.withColumns({c: F.lit(None).cast("long") for c in ("bx", "by", "bw", "bh")})


def test_paragraph_lines_merge_and_a_far_one_stays(spark):
    out = merge.merge_regions(regions(spark, [(10, 10, 200, 20), (12, 34, 200, 20), (10, 120, 200, 20)]), "paragraph").collect()
    assert sorted(r.n for r in out) == [1, 2]


def test_collinear_respects_bubbles(spark):
    both = regions(spark, [(20, 40, 160, 50), (165, 58, 90, 48)], block_type="sfx")
    assert spatial.merge_pairs(both, "collinear").count() == 1
    speech = regions(spark, [(20, 40, 120, 40), (165, 48, 70, 32)])
    held = {c: F.when(F.col("region_id") == 1, v).cast("long") for c, v in (("bx", 10), ("by", 20), ("bw", 150), ("bh", 80))}
    assert spatial.merge_pairs(speech.withColumns(held), "collinear").count() == 0


def test_bubble_takes_its_texts(spark):
    texts = spark.createDataFrame([(1, 1, 10, 10, 70, 18, 0.9), (1, 2, 10, 34, 70, 18, 0.8), (1, 3, 300, 300, 9, 9, 0.5)], "page_id long, det_id long, x long, y long, w long, h long, confidence double")
    bubbles = spark.createDataFrame([(1, 7, 0, 0, 100, 80), (1, 8, 500, 500, 9, 9)], "page_id long, bubble_id long, x long, y long, w long, h long")
    held, loose = spatial.assign_to_bubbles(texts, bubbles)
    (r,) = held.collect()
    assert (r.bubble_id, r.y, r.h, r.n, r.confidence, r.block_type) == (7, 10, 42, 2, 0.9, "dialogue")
    assert [x.det_id for x in loose.collect()] == [3]


def test_reading_order_from_top(spark):
    out = merge.reading_order(regions(spark, [(400, 701, 90, 40), (300, 548, 90, 40), (100, 628, 90, 40)])).orderBy("ord").collect()
    assert [r.y for r in out] == [548, 628, 701]


def test_oversize_goes(spark):
    det = spark.createDataFrame([(1, 1, 0, 0, 1000, 800, "text_free"), (1, 2, 10, 10, 120, 40, "text_free")], "page_id long, det_id long, x long, y long, w long, h long, class_name string")
    sheet = spark.createDataFrame([(1, 1000, 800)], "page_id long, width long, height long")
    assert [r.det_id for r in filters.drop_oversize(det, sheet).collect()] == [2]


def test_types(spark):
    cases = [("HELP", True, "dialogue"), ("BOOM", False, "sfx"), ("Sale", False, "sign"), ("YOUR LUNCH SWEETHEART.", False, "narration"), ("BA- DUMP", False, "sfx"), ("HA HA HA!", False, "sfx")]
    df = spark.createDataFrame(cases, "text string, in_bubble boolean, expected string")
    assert all(r.block_type == r.expected for r in localization.classify_blocks(df).collect())
    sounds = spark.createDataFrame([("ZAP",), ("ZING",), ("CRACKLE POP",)], "word string")
    more = [("ZAP ZING ZAP!", False, "sfx"), ("ZAP ZONG ZAP!", False, "narration"), ("crackle pop", False, "sfx"), ("zing?", True, "dialogue"), (None, False, "narration")]
    found = localization.classify_blocks(spark.createDataFrame(more, "text string, in_bubble boolean, expected string"), sounds).collect()
    assert len(found) == 5 and all(r.block_type == r.expected for r in found)


def test_leaks_and_routes(spark):
    df = spark.createDataFrame([("Hello there friend",), ("Он сказал «Hello there friend» и ушёл",), ("OK",), ("あいうえお",)], "text string")
    found = {r.text: r.leak for r in localization.leak_tokens(df, "ru").collect()}
    assert list(found.values()) == [True, False, False, True]
    routes = {r.text: r.route for r in localization.route_blocks(spark.createDataFrame([("Hello",), ("Привет",), ("あいうえお",), ("123",)], "text string"), "ru").collect()}
    assert list(routes.values()) == ["en", "skip", "uncovered", "skip"]


def test_same_word_elsewhere_is_new(spark):
    known = spark.createDataFrame([(1, "BAM", 100, 50, 100, 50)], "page_id long, text string, x long, y long, w long, h long")
    new = spark.createDataFrame([(1, 1, "BAM", 100, 50, 100, 50), (1, 2, "BAM", 600, 50, 100, 50), (1, 3, "BAM", 600, 52, 100, 50)], "page_id long, ord long, text string, x long, y long, w long, h long")
    assert [r.ord for r in proposals.dedupe_proposals(new, known).collect()] == [2]


def test_archive_members(spark):
    names = ["b/p10.png", "b/p2.png", "../evil.png", "/abs.png", "C:\\x.png", "a/../b/p2.png", "b/p2-mask.png", "1/2/3/4/5/6.png", "x.txt"]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "archive_id long, ord long, member string")
    assert [r.path for r in plans.plan_archive_members(df).orderBy("ord").collect()] == ["b/p2.png", "b/p10.png"]


def test_names(spark):
    planned = spark.createDataFrame([(1, "a.png"), (2, "A.png"), (3, "b.png")], "ord long, name string")
    old = spark.createDataFrame([("b.png", True)], "name string, protected boolean")
    get = lambda policy: [r.written for r in plans.resolve_names(planned, old, policy).orderBy("ord").collect()]
    assert get("rename") == ["a.png", "A-2.png", "b-2.png"]
    assert get("skip") == ["a.png", None, None]


def test_replies_in_thoughts_and_fences(spark):
    rows = [('{"n": 1}',), ('<THINK>{"n": 9}</Think> {"n": 2}',), ('lost {"n": 7}</THINK>{"n": 3}',), ('so ```json\n{"n": 4}\n```',), ("none",), ('[1]',)]
    ok, bad = localization.parse_replies(spark.createDataFrame(rows, "body string"), "n long")
    assert sorted(r.reply.n for r in ok.collect()) == [1, 2, 3, 4] and bad.count() == 2


def test_versions_chain(spark):
    edits = spark.createDataFrame([(1, 1, 1, None), (1, 2, 2, 5), (1, 3, 3, 6), (1, 4, 4, 6)], "page_id long, edit_id long, ts long, base_version long")
    now = spark.createDataFrame([(1, 5)], "page_id long, version long")
    assert [(r.accepted, r.version) for r in state.apply_versions(now, edits).orderBy("edit_id").collect()] == [(True, 6), (False, 6), (True, 7), (False, 7)]


def test_limiter_does_not_count_refused(spark):
    rows = [("k", i, s) for i, s in enumerate((0, 10, 20, 59, 60, 61, 70))] + [("", 99, 0)]
    df = spark.createDataFrame(rows, "key string, event_id long, s long").select("key", "event_id", F.timestamp_seconds("s").alias("ts"))
    got = {r.event_id: r.allowed for r in jobs.rate_limit(df, 2, 60).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: False, 6: True, 99: False}


def test_documents_files_and_glossary(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.json").write_text('{"version": 1, "regions": [{"id": 4, "bbox": [1, 2, 3, 4], "type": "sfx", "new": 1}, 7, {"text": "x"}]}')
    (tmp_path / "docs/b.json").write_text("[broken")
    found, bad = readers.read_regions(spark, str(tmp_path / "docs"))
    assert sorted((r.region_id, r.x, r.h, r.block_type, r.text) for r in found.collect()) == [(2, 0, 0, "dialogue", "x"), (4, 1, 4, "sfx", "")]
    assert bad.count() == 1
    (tmp_path / "img/html").mkdir(parents=True)
    for n in ("p1.PNG", "p2.webp", "p1-mask.png", "html/p3.png", "t.txt"):
        (tmp_path / "img" / n).write_bytes(b"x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in readers.list_page_files(spark, str(tmp_path / "img")).collect()) == ["p1.PNG", "p2.webp"]
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.txt").write_text("# note\nAnn = Anna\nBob: Robert\nAnn = Anja\n")
    (tmp_path / "g/b.json").write_text('{"Cid": "Sid"}')
    assert sorted(map(tuple, readers.read_glossary(spark, str(tmp_path / "g")).collect())) == [("Ann", "Anja"), ("Bob", "Robert"), ("Cid", "Sid")]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.jsonl").write_text('{"timestamp": "2024-01-01T00:00:00", "event": "start", "details": "d"}\nnot json\n')
    assert readers.read_events(spark, str(tmp_path / "log")).count() == 1


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows = [("a" if i % 3 else "b", i, i * 7 % 50, ("submit", "hit", "end", "submit")[i % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, event_id long, s long, kind string").select("key", "event_id", F.timestamp_seconds(F.col("s") + 1000).alias("ts"), "kind")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, name, mode="append"):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    as_set = lambda d: sorted(map(tuple, d.collect()))
    assert as_set(run(jobs.rate_limit_stream(stream, 4, 20), "limited")) == as_set(jobs.rate_limit(df, 4, 20))
    q = stream.withColumnRenamed("key", "queue")
    assert as_set(run(jobs.admit_stream(q, 3), "admitted")) == as_set(jobs.admit_pending(df.withColumnRenamed("key", "queue"), 3))
    kinds = F.expr("CASE kind WHEN 'end' THEN 'job.failed' WHEN 'hit' THEN 'job.started' ELSE 'job.progress' END")
    events = lambda d: d.select(F.concat("key", (F.col("event_id") % 10).cast("string")).alias("job_id"), "event_id", "ts", kinds.alias("type"), F.lit(5).cast("long").alias("progress"))
    last = run(jobs.job_state_stream(events(stream)), "states", "update")
    ended = lambda d: {r.job_id: r.status for r in d.collect() if r.status == "job.failed"}
    assert ended(last) == ended(state.job_status(events(df)))
    seen = []
    jobs.publish_progress(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: b.groupBy("kind").count()).awaitTermination(120)
    seen = spark.read.parquet(str(tmp_path / "out/rows")).count()
    assert seen == 60


def test_redact_strips_query_and_fragment_and_counts_by_rule(spark):
    texts = ["see https://host/p?sig=abc#x now", "http://host/p#part, HTTPS://host?a=b", "https://me:p@w@host/p?q=1 and bearer abc", "https://host/p is plain? yes #1", "the pinned pin", "API-Key: zz, x_api_key=\"a b\" ok",
             "GET https://h/p?sig=abc123#frag bearer zzz"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    got = [(r.text, r.n_redacted, tuple(r.redacted_by_rule)) for r in filters.redact(df, "text", ("pin", "pinned")).orderBy("i").collect()]
    assert got == [  # known secrets, user info, query or fragment, bearer, assignment
        ("see https://host/p now", 1, (0, 0, 1, 0, 0)), ("http://host/p HTTPS://host", 2, (0, 0, 2, 0, 0)), ("https://host/p and bearer ***", 3, (0, 1, 1, 1, 0)),
        ("https://host/p is plain? yes #1", 0, (0, 0, 0, 0, 0)), ("the *** ***", 2, (2, 0, 0, 0, 0)), ("API-Key: ***, x_api_key=*** ok", 2, (0, 0, 0, 0, 2)), ("GET https://h/p bearer ***", 2, (0, 0, 1, 1, 0)),
    ]


def test_second_source_stays_out_of_bubbles(spark):
    held = {"bx": 0, "by": 0, "bw": 200, "bh": 200}
    first = regions(spark, [(80, 80, 40, 20)]).withColumns({c: F.lit(v).cast("long") for c, v in held.items()})
    second = regions(spark, [(10, 10, 40, 20), (300, 10, 40, 20)])
    assert {(r.region_id, r.x) for r in spatial.add_second_source(first, second).collect()} == {(1, 80), (2, 300)}
