"""Listings by globs, fingerprints against a plain version, glossaries with repeats, and totals of a stream that fails between its writes."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import localization
from scriptorium.sources import readers
from scriptorium.streaming import jobs


def test_globs(spark, tmp_path):
    names = ["a.png", "b1.jpg", "b22.jpg", "x/a.png", "x/y/c 1.png", "x/y/z.webp", "x/html/no.png", "b1-mask.png", "+.png", "t.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x")

    def listed(**more):
        found = readers.list_page_files(spark, str(tmp_path), globs=True, **more).collect()
        return sorted(r.path.split(str(tmp_path) + "/", 1)[1] for r in found)

    assert listed() == sorted(["a.png", "b1.jpg", "b22.jpg", "x/a.png", "x/y/c 1.png", "x/y/z.webp", "+.png"]) or "x/y/c%201.png" in listed()
    assert listed(include="*.png") == ["+.png", "a.png"] and listed(include="**/*.png", exclude="x/**") == ["+.png", "a.png"]
    assert listed(include="b?.jpg") == ["b1.jpg"] and listed(include="b[0-9][!1].jpg") == ["b22.jpg"]
    assert len(listed(include="x/**/*.png")) == 2 and listed(include="x/*.png") == ["x/a.png"]
    q = readers.stream_page_files(spark, str(tmp_path), globs=True, include="**/*.jpg").writeStream.format("memory").queryName("files").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("files").count() == 2


def test_fingerprints_are_of_values(spark):
    settings = [{"b": 1, "a": {"y": [1, {"q": None, "p": True}], "x": "ü\"\\"}, "conf": 0.25}, {"z": [], "a": {}}, {"one": -3}]
    texts = [json.dumps(s) for s in settings] + [json.dumps(dict(reversed(s.items())), ensure_ascii=False, indent=1) for s in settings]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, "  own  ", "", None, "[1]"])], "k long, t string")
    got = {r.k: r.f for r in df.select("k", localization.settings_fingerprint("t").alias("f")).collect()}
    want = [hashlib.sha256(json.dumps(s, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() for s in settings]
    assert [got[k] for k in range(6)] == want * 2 and [got[k] for k in range(6, 10)] == ["own", "", None, "[1]"]


def test_glossary_with_repeats(spark):
    regions = spark.createDataFrame([(1, 1, "Ann", "female"), (1, 2, "Bob", "")], "page_id long, region_id long, speaker string, speaker_gender string")
    existing = spark.createDataFrame([(2, "Ann", "B", "", ""), (1, " Ann ", "A", "", "n"), (3, " ", "X", "", "")], "ord long, source string, target string, gender string, note string")
    got = sorted(map(tuple, localization.build_glossary(regions, existing).collect()))
    assert got == [("Ann", "A", "female", "n"), ("Bob", "", "", "")]


@pytest.mark.parametrize("fails_at", ["totals", "ledger"])
def test_a_batch_that_fails_between_its_writes_counts_once(spark, tmp_path, monkeypatch, fails_at):
    from pyspark.sql import DataFrameWriter

    rows = lambda lo: spark.createDataFrame([("a" if i % 2 else "b", i) for i in range(lo, lo + 10)], "k string, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows(0), rows(10)
    out = str(tmp_path / "out")
    state = {"left": 1}
    for kind in ("parquet", "json"):
        plain = getattr(DataFrameWriter, kind)

        def broken(self, path, *a, _plain=plain, **k):
            if f"/{fails_at}/batch=1" in path and state["left"]:
                state["left"] -= 1
                raise OSError("lost")
            return _plain(self, path, *a, **k)

        monkeypatch.setattr(DataFrameWriter, kind, broken)

    def run():
        stream = spark.readStream.schema("k string, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = jobs.publish_totals(stream, out, str(tmp_path / "cp"), ["k"], {"n": "1", "total": "v"})
        try:
            q.awaitTermination(180)
        except Exception:  # noqa: BLE001 - the first run is to fail
            return True
        return q.exception() is not None

    assert run() and not run()
    want = [("a", 10, sum(range(1, 20, 2))), ("b", 10, sum(range(0, 20, 2)))]
    assert sorted(map(tuple, jobs.published_totals(spark, out).select("k", "n", "total").collect())) == want
    rows(20)
    assert not run()
    assert {r.k: r.n for r in jobs.published_totals(spark, out).collect()} == {"a": 15, "b": 15}
    assert spark.read.parquet(f"{out}/rows").select(F.count("*")).first()[0] == 30


def test_temporary_folders_are_dropped(spark):
    import os

    from scriptorium.functions import shared

    shared.drop_temporary(spark)
    path = shared.text_files(spark.createDataFrame([("a",)], "value string"), "lines")
    local = path.removeprefix("file://")
    assert os.path.isdir(local) and shared.drop_temporary(spark) == 1 and not os.path.isdir(local)


def test_event_logs_as_a_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.jsonl").write_text('{"timestamp": "2024-01-01T00:00:00", "event": "start", "details": "d"}\nnot json\n{"details": "no event"}\n{"event": "end", "new": 1}\n')
    q = readers.read_events(spark, str(tmp_path / "log"), streaming=True).select("event", "details").writeStream.format("memory").queryName("events_read").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("events_read").collect())) == [("end", None), ("start", "d")]
