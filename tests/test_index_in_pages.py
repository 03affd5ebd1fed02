"""Greedy rules of a page with their index, against the same rules over all pairs, and on one page of very many boxes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import merge, proposals, spatial
from scriptorium.operators.spatial import _over


def page(n, side, seed, most=60):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w, h = rng.choice([(rng.randrange(1, most), rng.randrange(1, 20)), (rng.randrange(0, 5), rng.randrange(0, 5)), (rng.randrange(40, 8 * most), rng.randrange(20, 90))])
        out.append((k, rng.randrange(-20, side), rng.randrange(-20, side), w, h))
    return out


def frame(spark, boxes):
    return spark.createDataFrame([(1, *b) for b in boxes], "page_id long, region_id long, x long, y long, w long, h long")


def contained_by_force(rows):
    gone = set()
    for r in rows:
        for o in rows:
            if o[0] in gone or o[3] * o[4] <= r[3] * r[4]:
                continue
            if abs((o[2] + o[4] / 2) - (r[2] + r[4] / 2)) <= 0.45 * max(o[4], r[4], 8) and _over(r[1:], o[1:]) >= 0.7:
                gone.add(r[0])
                break
    return [r[0] for r in rows if r[0] not in gone]


def rows_by_force(boxes):
    rows = []
    for r in sorted(boxes, key=lambda r: (r[2] + r[4] / 2, r[0])):
        for row in rows:
            if abs((r[2] + r[4] / 2) - (row[0][2] + row[0][4] / 2)) <= 0.35 * max(r[4], row[0][4], 8):
                row.append(r)
                break
        else:
            rows.append([r])
    return [r[0] for row in rows for r in sorted(row, key=lambda r: r[1])]


def gathered_by_force(boxes, order, alike, last_first):
    groups = []
    for i in order:
        for g in reversed(groups) if last_first else groups:
            if any(alike(boxes[i], boxes[k]) for k in g):
                g.append(i)
                break
        else:
            groups.append([i])
    return groups


@pytest.mark.parametrize("seed", range(3))
def test_same_as_all_pairs(spark, seed):
    boxes = page(250, [200, 800, 3000][seed], seed)
    df = frame(spark, boxes)
    assert sorted(r.region_id for r in spatial.drop_contained(df).collect()) == sorted(contained_by_force(boxes))
    assert [r.region_id for r in merge.reading_order(df).orderBy("ord").collect()] == rows_by_force(boxes)
    kept = []
    for b in boxes:
        if all(max(_over(b[1:], k[1:]), _over(k[1:], b[1:])) <= 0.3 for k in kept):
            kept.append(b)
    got = spatial.add_second_source(df.limit(0), df).orderBy("region_id").select("x", "y", "w", "h")
    assert list(map(tuple, got.collect())) == [b[1:] for b in kept]
    words = ["the", "then", "a", "another word", "word", "THE"]
    texts = [(1, k, words[k * 7 % 6], *b[1:]) for k, b in enumerate(boxes)]
    p = spark.createDataFrame(texts, "page_id long, ord long, text string, x long, y long, w long, h long")
    known, want = [], []
    for _, k, t, *b in texts:
        block = (*b, proposals.comparable(t))
        if not any(proposals._says_nothing_new(block, o) for o in known):
            known.append(block)
            want.append(k)
    none = p.limit(0).drop("ord")
    assert sorted(r.ord for r in proposals.dedupe_proposals(p, none).collect()) == want


@pytest.mark.parametrize("seed", range(40))
def test_groups_of_words(seed):
    boxes = [b[1:] for b in page(60, [60, 300, 900][seed % 3], seed, most=20)]
    for alike, order in ((merge.level, sorted(range(60), key=lambda i: boxes[i][1])), (merge.stacked, sorted(range(60), key=lambda i: boxes[i][:2]))):
        for last_first in (False, True):
            assert merge.gathered(boxes, order, alike, last_first) == gathered_by_force(boxes, order, alike, last_first)
    for n in (1, 2, 3, 8):
        part = boxes[:n]
        assert merge.any_stacked(part) == any(merge.stacked(part[i], part[k]) for i in range(n) for k in range(i))


def test_a_page_of_very_many_boxes(spark):
    rng = random.Random(1)
    n = 100_000
    boxes = [(k, rng.randrange(20_000), rng.randrange(20_000), rng.randrange(10, 90), rng.randrange(8, 30)) for k in range(n)]
    df = frame(spark, boxes).cache()
    df.count()
    words = df.selectExpr("page_id", "region_id AS word_id", "concat('word', region_id % 50) AS text", "x", "y", "w", "h", "0.9D AS confidence")
    p = df.selectExpr("page_id", "region_id AS ord", "concat('text', region_id % 50) AS text", "x", "y", "w", "h")
    none = df.limit(0).selectExpr("page_id", "region_id", "'' AS text", "x", "y", "w", "h")
    for run in (
        lambda: spatial.drop_contained(df), lambda: merge.reading_order(df), lambda: proposals.dedupe_proposals(p, none.drop("region_id")),
        lambda: proposals.recover_lines(words, none), lambda: merge.order_words(words.withColumn("region_id", F.lit(1).cast("long"))),
    ):
        began = time.time()
        assert run().count() > 0
        assert time.time() - began < 180  # seconds here; hours over all pairs


# ---------------------------------------------------------------- words in order and recovered lines, by a plain version


def words_by_force(boxes, direction):
    """Reading order of a region's words without quads, from the rule: columns if 60 % (two at least) are taller than wide by 1.15 and two words are
    above each other; else lines."""
    n = len(boxes)

    def shared(a, b, k):
        return min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k]) >= 0.5 * min(a[k + 2], b[k + 2]) > 0

    def joined(order, k, newest):
        groups = []
        for i in order:
            fitting = [g for g in groups if any(shared(boxes[i], boxes[j], k) for j in g)]
            if fitting:
                fitting[-1 if newest else 0].append(i)
            else:
                groups.append([i])
        return groups

    mean = lambda values: sum(values) / len(values)
    back = -1 if direction == "rtl" else 1
    tall = [b for b in boxes if b[3] > 1.15 * b[2]]
    above = any(shared(boxes[i], boxes[j], 0) for i in range(n) for j in range(i))
    if n > 1 and above and len(tall) >= max(2, round(0.6 * n)):
        groups = joined(sorted(range(n), key=lambda i: (boxes[i][0], boxes[i][1])), 0, False)
        groups.sort(key=lambda g: back * mean([boxes[i][0] + boxes[i][2] / 2 for i in g]))
        return [i for g in groups for i in sorted(g, key=lambda i: boxes[i][1] + boxes[i][3] / 2)]
    groups = joined(sorted(range(n), key=lambda i: (boxes[i][1] + boxes[i][3] / 2, boxes[i][0])), 1, True)
    groups.sort(key=lambda g: mean([boxes[i][1] for i in g]))
    return [i for g in groups for i in sorted(g, key=lambda i: back * boxes[i][0])]


@pytest.mark.parametrize("direction", ["ltr", "rtl"])
def test_words_in_order_by_force(spark, direction):
    rng = random.Random(5)
    rows, want = [], {}
    for region in range(120):
        tall = region % 2
        boxes = []
        for _ in range(rng.randrange(1, 9)):
            long_, short = rng.randrange(8, 40), rng.randrange(4, 12)
            boxes.append((rng.randrange(80), rng.randrange(80), *((short, long_) if tall and rng.random() < 0.8 else (long_, short))))
        rows += [(1, region, k, f"w{k}" if k % 5 else " ", *b) for k, b in enumerate(boxes)]
        want[region] = " ".join(f"w{k}" for k in words_by_force(boxes, direction) if k % 5)
    df = spark.createDataFrame(rows, "page_id long, region_id long, word_id long, text string, x long, y long, w long, h long")
    assert {r.region_id: r.text for r in merge.order_words(df, direction).collect()} == want


def lines_by_force(words, regions, sounds):
    """Loose words of a page as (text, n): lines of two or more, single sounds, and hyphened letters before the first sound that they partly overlap."""
    def inside(w, r):
        x, y = w[2] + w[4] / 2, w[3] + w[5] / 2
        return r[1] <= x <= r[1] + r[3] and r[2] <= y <= r[2] + r[4]

    letters = lambda t: sum(c.isalpha() for c in t)
    loose = [w for w in words if not any(inside(w, r) for r in regions)]
    free = []
    for w in loose:
        owned = any(_over(w[2:6], r[1:]) > 0.8 or (w[1].lower() == r[0].lower() and _over(w[2:6], r[1:]) > 0.4) for r in regions)
        n = letters(w[1])
        if w[6] >= 0.55 and not owned and "@" not in w[1] and "_" not in w[1] and n >= 2 and 2 * n >= len(w[1].strip()):
            if not any(w[1].casefold() == o[1].casefold() and _over(w[2:6], o[2:6]) > 0.8 for o in free):
                free.append(w)
    boxes = [w[2:6] for w in free]
    out, alone = [], []
    for g in gathered_by_force(boxes, sorted(range(len(free)), key=lambda i: (boxes[i][1] + boxes[i][3] / 2, boxes[i][0])), merge.level, True):
        if len(g) > 1:
            order = words_by_force([boxes[i] for i in g], "ltr")
            out.append([" ".join(free[g[k]][1] for k in order), len(g)])
        elif free[g[0]][1].upper() in sounds:
            alone.append([free[g[0]][1], 1, boxes[g[0]]])
    for w in loose:
        if w[6] >= 0.5 and "-" in w[1] and letters(w[1]) == 1:
            for s in alone:
                b = s[2]
                if 0.2 < _over(w[2:6], b) < 0.8 and w[4] <= 1.5 * b[2] and w[5] <= 1.5 * b[3]:
                    s[:] = [f"{w[1]} {s[0]}", s[1] + 1, proposals.united([b, w[2:6]])]
                    break
    return sorted((t, n) for t, n, *_ in [*out, *alone])


def test_recovered_lines_by_force(spark):
    rng = random.Random(9)
    words, regions, want = [], [], []
    for page_id in range(60):
        own = [(rng.choice(["some", "text"]), rng.randrange(300), rng.randrange(300), rng.randrange(5, 60), rng.randrange(5, 30)) for _ in range(4)]
        # long words in lower case have the type of speech; the dictionary's are sounds
        here = [(k, rng.choice(["zorplax", "quimbly", "a-", "b-", "wandering", "x@y"]), rng.randrange(300), rng.randrange(300), rng.randrange(10, 60), rng.randrange(10, 30), rng.choice([0.4, 0.52, 0.9, 1.0])) for k in range(rng.randrange(3, 14))]
        regions += [(page_id, k, *r) for k, r in enumerate(own)]
        words += [(page_id, *w) for w in here]
        want += [(page_id, *line) for line in lines_by_force(here, own, {"ZORPLAX", "QUIMBLY"})]
    w = spark.createDataFrame(words, "page_id long, word_id long, text string, x long, y long, w long, h long, confidence double")
    r = spark.createDataFrame(regions, "page_id long, region_id long, text string, x long, y long, w long, h long")
    sounds = spark.createDataFrame([("ZORPLAX",), ("QUIMBLY",)], "word string")
    got = sorted((x.page_id, x.text, x.n) for x in proposals.recover_lines(w, r, sounds).collect())
    assert got == sorted(want) and any(n == 1 for *_, n in got) and any("-" in t for _, t, _ in got)
