"""Folds by arrays over many pages at once: whole groups in each batch, small and large pages alike, rows without a box."""

import random

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.functions import grid
from scriptorium.functions.grouped import per_batch
from scriptorium.operators import localization, proposals, spatial
from scriptorium.plans import registry

SF = "/root/testdata/sf0.001"
BOX = "page_id long, region_id long, x long, y long, w long, h long"


@pytest.mark.parametrize("rows", [1, 3, 7, 1000])
def test_batches_hold_whole_groups(spark, rows):
    sizes = {k: 1 + k * k % 11 for k in range(40)} | {None: 5}
    df = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)], "k long, i long")

    def fold(batch: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.diff(group, prepend=-1))
        return pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(first)), pa.array(np.bincount(group))], names=["k", "n"])

    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = [tuple(r) for r in per_batch(df, ["k"], ["i"], fold, "k long, n long").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(got) == len(sizes) and dict(got) == sizes


def boxes(seed, pages=30):
    rng = random.Random(seed)
    return [(p, i, rng.randrange(60), rng.randrange(60), rng.randrange(0, 50), rng.randrange(0, 20)) for p in range(pages) for i in range(rng.randrange(1, 25))]


def test_small_and_large_pages_alike(spark, monkeypatch):
    df = spark.createDataFrame(boxes(3), BOX)
    want = sorted(map(tuple, spatial.drop_contained(df).collect()))
    rows = np.array(boxes(3))
    pairs = []
    for small in (128, 5):
        monkeypatch.setattr(grid, "SMALL", small)
        found = {(i, k) for a, b in grid.near_pairs(rows[:, 0], rows[:, 2:].T, rows[:, 0], rows[:, 2:].T) for i, k in zip(a.tolist(), b.tolist(), strict=True)}
        touch = lambda r, o: all(min(r[c] + r[c + 2], o[c] + o[c + 2]) >= max(r[c], o[c]) for c in (2, 3))
        pairs.append({(i, k) for i, k in found if touch(rows[i], rows[k])})
    assert pairs[0] == pairs[1] and 0 < len(want) < len(rows)


def test_lines_without_a_box_stay(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, 100, 14), (1, 2, 2, 3, 60, 12), (1, 3, None, None, None, None), (2, None, 2, 3, 60, 12)], BOX)
    assert {(r.page_id, r.region_id) for r in spatial.drop_contained(df).collect()} == {(1, 1), (1, 3), (2, None)}  # a TypeError before


def test_words_go_to_the_smallest_region(spark):
    rng = random.Random(4)
    page = lambda n: [(p, i, rng.randrange(60), rng.randrange(60), rng.randrange(0, 40), rng.randrange(0, 20)) for p in (1, 2, 3) for i in range(n)]
    words, regions = page(40), [*page(12), (1, 90, None, 0, 60, 60)]
    words += [words[0], (1, 77, None, 1, 1, 1), (None, 78, 1, 1, 1, 1)]  # one word twice, one without a place, one of no page
    holds = lambda r, w: None not in (*r, *w) and r[0] == w[0] and all(r[c] <= w[c] + w[c + 2] / 2 <= r[c] + r[c + 2] for c in (2, 3))
    want = [(*w[:2], min(((r[4] * r[5], r[1]) for r in regions if holds(r, w)), default=(0, None))[1]) for w in words]
    w = spark.createDataFrame(words, BOX.replace("region_id", "word_id"))
    got = spatial.assign_words(w, spark.createDataFrame(regions, BOX))
    assert got.columns == [*w.columns, "region_id"]
    key = lambda t: [(v is None, v) for v in t]
    assert sorted((tuple(r) for r in got.select("page_id", "word_id", "region_id").collect()), key=key) == sorted(want, key=key)


def test_words_and_regions_of_one_table_are_dealt_once(spark, capsys):
    registry.QUERIES["w02_order_words"](spark, SF).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2  # by page, and by region; 6 before


@pytest.mark.parametrize("n", [grid.FEW, grid.FEW + 1, 200])
def test_index_gives_all_that_touch(n):
    rng = random.Random(n)
    some = [(rng.randrange(300), rng.randrange(300), rng.randrange(1, 90), rng.randrange(1, 30)) for _ in range(n)]
    index = grid.Grid()
    for k, b in enumerate(some):
        index.add(k, b)
    for b in some:
        assert {k for k, o in enumerate(some) if all(min(b[c] + b[c + 2], o[c] + o[c + 2]) >= max(b[c], o[c]) for c in (0, 1))} <= index.near(b) <= set(range(n))


def test_lines_are_found_after_one_deal_of_the_table(spark, capsys):
    registry.QUERIES["j24_recover_lines"](spark, SF).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning(page_id") <= 3  # the table for lines and for their texts, and the lines; 13 before


def test_words_that_regions_have(spark):
    words = [(1, 1, "ПАРОХОД", 0, 0, 100, 10, 0.9), (1, 2, "other", 0, 20, 100, 10, 0.9), (1, 3, "next", 110, 20, 40, 10, 0.9)]
    regions = [(1, 1, "пароход", 55, 0, 60, 10), (1, 2, None, 55, 20, 60, 10), (1, 3, "next", None, 20, 40, 10)]  # 45 % of each, its center beside
    w = spark.createDataFrame(words, "page_id long, word_id long, text string, x long, y long, w long, h long, confidence double")
    r = spark.createDataFrame(regions, "page_id long, region_id long, text string, x long, y long, w long, h long")
    assert [(x.text, x.n) for x in proposals.recover_lines(w, r).collect()] == [("other next", 2)]


def test_versions_of_one_table_are_dealt_once(spark, capsys):
    registry.QUERIES["j13_diff_documents"](spark, SF).explain()
    assert "region_id" not in "".join(line.split("hashpartitioning(")[1].split("), ")[0] for line in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning(" in line)  # both versions by page and region before


def test_regions_without_a_number_have_no_counterpart(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "page_id long, region_id long, x long, style string")
    paper = spark.createDataFrame([(p, "k", "ltr") for p in (1, 2, 3)], "page_id long, strokes string, direction string")
    old = frame((1, None, 1, "a"), (2, 1, 1, "a"), (2, 1, 1, "b"), (2, 2, None, "c"), (3, 1, 1, None))
    new = frame((1, None, 1, "a"), (2, 1, 1, "b"), (2, 2, None, "c"), (3, 1, 1, None))
    got = {r.page_id: (r.plan, r.ids) for r in localization.diff_documents(old, new, paper, paper).collect()}
    assert got == {1: ("clean", ""), 2: ("typeset", "1"), 3: ("none", "")}
