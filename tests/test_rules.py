"""Rules against plain versions on random small tables, and cases at their borders."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.grouped import per_group_running
from scriptorium.operators import filters, localization, merge, proposals, quality, spatial, state
from scriptorium.sources import plans, readers

BOX = "page_id long, region_id long, x long, y long, w long, h long"


def over(a, b):
    """Share of box a in box b."""
    w, h = (min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k]) for k in (0, 1))
    return max(0, w) * max(0, h) / (a[2] * a[3]) if a[2] * a[3] else 0


# ---------------------------------------------------------------- boxes


def test_low_lines_need_to_be_level(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, 100, 12), (1, 2, 2, 6, 60, 12), (1, 3, 2, 5, 60, 12)], BOX)
    assert sorted(r.region_id for r in spatial.drop_contained(df).collect()) == [1, 2, 3]  # 0.45 * 12 = 5.4, but only 7 / 12 of the third lie in the first
    df = spark.createDataFrame([(1, 1, 0, 0, 100, 14), (1, 2, 2, 4, 60, 12), (1, 3, 2, 3, 60, 12)], BOX)
    assert sorted(r.region_id for r in spatial.drop_contained(df).collect()) == [1]


@pytest.mark.parametrize(("size", "side", "n"), [((1000, 800), None, 1), ((1700, 800), 800, 3), ((1700, 1600), None, 1), ((800, 6000), 2309, 3), ((6000, 6000), 2309, 9)])
def test_tiles_cover_their_page(spark, size, side, n):
    w, h = size
    tiles = spatial.plan_tiles(spark.createDataFrame([(1, w, h)], "page_id long, width long, height long"), 1800).collect()
    assert len(tiles) == n and min(t.x for t in tiles) == min(t.y for t in tiles) == 0
    assert max(t.x + t.w for t in tiles) == w and max(t.y + t.h for t in tiles) == h
    if side:
        assert all((t.w, t.h) == (min(side, w), min(side, h)) for t in tiles)
        for a, b in ((0, 2), (1, 3)):
            starts = sorted({t[2 + a] for t in tiles})
            assert all(y - x <= 0.8 * side for x, y in zip(starts, starts[1:], strict=False)), b


def words_in(spark, rows, direction="ltr"):
    quads = all(len(r) == 6 for r in rows)
    schema = "page_id long, region_id long, word_id long, text string, x long, y long, w long, h long" + (", quad array<array<double>>" if quads else "")
    df = spark.createDataFrame([(1, 1, i, *r) for i, r in enumerate(rows)], schema)
    return merge.order_words(df, direction).first().text


def test_words_in_lines_and_columns(spark):
    rows = [("right", 80, 60, 30, 12), ("main", 10, 20, 40, 20), ("up", 52, 16, 12, 10), ("left", 10, 60, 30, 12)]
    assert words_in(spark, rows) == "main up left right" and words_in(spark, rows, "rtl") == "up main right left"
    assert words_in(spark, [("c", 14, 46, 14, 40), ("a", 16, 10, 14, 40), ("b", 12, 28, 14, 40)]) == "a b c"
    assert words_in(spark, [("two", 10, 10, 10, 40), ("one", 25, 10, 10, 40), ("three", 11, 52, 10, 40)], "rtl") == "one two three"
    # the third word meets the first of its line and not the last
    assert words_in(spark, [("a", 0, 0, 20, 20), ("b", 30, 8, 20, 20), ("c", 60, -6, 20, 20), ("d", 0, 40, 20, 20)]) == "a b c d"


def test_slanted_lines_are_straightened(spark):
    rows = []
    for text, x, y in (("d", 88, 64), ("b", 20, 26), ("c", 60, 43), ("a", 40, 10)):  # lines of a slant of 20 degrees
        quad = [[float(x), float(y)], [x + 94.0, y + 34.2], [x + 87.2, y + 53.0], [x - 6.8, y + 18.8]]
        xs, ys = [p[0] for p in quad], [p[1] for p in quad]
        rows.append((text, int(min(xs)), int(min(ys)), int(max(xs) - min(xs)), int(max(ys) - min(ys)), quad))
    flat = words_in(spark, [r[:5] for r in rows])
    assert flat != "a b c d" and words_in(spark, rows) == "a b c d"


# ---------------------------------------------------------------- proposals


def test_fragment_of_known_text_is_no_news_but_a_longer_text_is(spark):
    schema = "page_id long, ord long, text string, x long, y long, w long, h long"
    known = lambda t: spark.createDataFrame([(1, t, 0, 0, 100, 100)], "page_id long, text string, x long, y long, w long, h long")
    new = lambda t: spark.createDataFrame([(1, 1, t, 85, 0, 100, 100)], schema)
    whole, part = "abcdefghijklmnop", "abcdefxhij"  # inexact, 15 % of the box in common
    assert proposals.dedupe_proposals(new(part), known(whole)).count() == 0
    assert proposals.dedupe_proposals(new(whole), known(part)).count() == 1


def test_dedupe_proposals_by_force(spark):
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 14)))
    place = lambda: (rng.randrange(60), rng.randrange(60), rng.randrange(10, 50), rng.randrange(10, 50))
    known, new = [(p, text(), *place()) for p in range(20) for _ in range(2)], [(p, k, text(), *place()) for p in range(20) for k in range(6)]
    want = []
    for p in range(20):
        have = [(r[1], r[2:]) for r in known if r[0] == p]
        for r in sorted(x for x in new if x[0] == p):
            t, b = r[2], r[3:]
            for u, o in have:
                w, h = (min(b[k] + b[k + 2], o[k] + o[k + 2]) - max(b[k], o[k]) for k in (0, 1))
                both, least = max(0, w) * max(0, h), min(b[2] * b[3], o[2] * o[3])
                same = sum(m.size for m in difflib.SequenceMatcher(None, t, u, autojunk=False).get_matching_blocks())
                if both > 0.4 * least or (both and len(t) >= 3 and len(u) >= 3 and (t in u or u in t)) or (both > 0.08 * least and 4 <= len(t) < 0.85 * len(u) and same >= 0.8 * len(t)):
                    break
            else:
                have.append((t, b))
                want.append(r[:2])
    got = proposals.dedupe_proposals(spark.createDataFrame(new, "page_id long, ord long, text string, x long, y long, w long, h long"), spark.createDataFrame(known, "page_id long, text string, x long, y long, w long, h long"))
    assert sorted((r.page_id, r.ord) for r in got.collect()) == sorted(want) and 20 < len(want) < 120


def test_verified_reads_by_force(spark):
    rng = random.Random(5)
    texts = ["one two", "One  TWO", "three", "", "  ", None, "four five six"]
    rows = [(p, k, rng.choice(texts), rng.random()) for p in range(40) for k in range(rng.randrange(1, 6))]
    crops = [(p, k, rng.choice([t, "Three", "fore five sex", None])) for p, k, t, _ in rows]
    crop, want = {(p, k): t for p, k, t in crops}, []
    fold = lambda t: " ".join((t or "").split()).casefold()
    for p in range(40):
        page = [r for r in rows if r[0] == p]
        filled = sorted(r[1] for r in page if r[2] and r[2].strip())
        text = {r[1]: r[2] for r in page}
        off = any(difflib.SequenceMatcher(None, fold(text[k]), fold(crop[p, k]), autojunk=False).ratio() < 0.6 for k in {*filled[:1], *filled[-1:]})
        for _, k, t, c in page:
            twice = t and t.strip() and [r[2] for r in page].count(t) > 1
            want.append((p, k, bool(off or t is None or twice or (not t.strip() and c >= 0.5))))
    got = proposals.verify_reads(spark.createDataFrame(rows, "page_id long, region_id long, text string, confidence double"), spark.createDataFrame(crops, "page_id long, region_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def recovered(spark, words, regions=(), sounds=None):
    w = spark.createDataFrame([(1, i, *r) for i, r in enumerate(words)], "page_id long, word_id long, text string, x long, y long, w long, h long, confidence double")
    r = spark.createDataFrame([(1, i, *b) for i, b in enumerate(regions)], "page_id long, region_id long, text string, x long, y long, w long, h long")
    found = proposals.recover_lines(w, r, spark.createDataFrame([(s,) for s in sounds], "word string") if sounds else None).collect()
    return sorted((r.text, r.n, r.x, r.y, r.w, r.h) for r in found)


def test_lines_of_loose_words(spark):
    line = [("WALL", 68, 40, 40, 12, 0.99), ("on", 10, 40, 20, 12, 0.99), ("the", 35, 41, 28, 12, 0.99)]
    assert recovered(spark, line) == [("on the WALL", 3, 10, 40, 98, 13)]
    assert recovered(spark, [*line, ("the", 36, 41, 28, 12, 0.9)]) == [("on the WALL", 3, 10, 40, 98, 13)]  # read twice
    assert recovered(spark, line, [("x", 0, 0, 200, 200)]) == []


def test_single_words_are_sounds_by_their_own_text(spark):
    assert recovered(spark, [("BAM", 10, 10, 30, 20, 0.9), ("plain", 10, 60, 30, 20, 0.9), ("me@x", 90, 90, 30, 20, 0.9), ("LOW", 90, 10, 30, 20, 0.5)]) == [("BAM", 1, 10, 10, 30, 20)]
    assert recovered(spark, [("krrsh", 10, 10, 30, 20, 0.9)], sounds=["KRRSH"]) == [("krrsh", 1, 10, 10, 30, 20)]
    # a plain word over a known sound is none
    assert recovered(spark, [("plain", 10, 10, 30, 20, 0.9)], [("BOOM", 0, 0, 22, 40)]) == []


def test_hyphenated_letter_goes_to_the_sound_it_touches(spark):
    found = recovered(spark, [("DUMP", 60, 40, 50, 50, 0.9), ("A-", 50, 34, 22, 20, 0.6), ("B-", 300, 34, 22, 20, 0.9)])
    assert found == [("A- DUMP", 2, 50, 34, 60, 56)]


def test_budget_counts_tiles_without_candidates(spark):
    rows = [(1, 2, k, "t" * (k + 1)) for k in range(30)]
    tiles = lambda n: spark.createDataFrame([(1, t) for t in range(n)], "page_id long, tile long")
    df = spark.createDataFrame(rows, "page_id long, tile long, ord long, text string")
    assert sorted(r.ord for r in proposals.budget_candidates(df, tiles(4)).collect()) == list(range(12))  # 24 // 2 after two empty ones
    assert proposals.budget_candidates(df, tiles(3)).count() == 24


def test_signs_without_letters_are_confirmed_as_they_are(spark):
    box = "x long, y long, w long, h long"
    p = spark.createDataFrame([(1, "", "?!", True, 0, 0, 9, 9), (2, "", "?!", True, 0, 0, 9, 9), (3, "ab", "ab", True, 0, 0, 9, 9)], f"proposal_id long, key string, plain string, complete boolean, {box}")
    located = spark.createDataFrame([(1, "", 0, 0, 9, 9), (2, "", 0, 0, 9, 9), (3, "xaby", 0, 0, 9, 9)], f"proposal_id long, key string, {box}")
    read = spark.createDataFrame([(1, "", "?!"), (2, "", "!"), (3, "xaby", "xaby")], "proposal_id long, key string, plain string")
    assert [r.proposal_id for r in proposals.confirm_proposals(p, located, read).collect()] == [1]  # a part of two letters is none


# ---------------------------------------------------------------- texts


def test_leaks_by_token(spark):
    texts = ["Hello there friend", "Он сказал «Hello there» и ушёл", "Я пошёл к Kirby, OK", "OK", "This is English", "Да. Hello", "Да Hello", "Он купил x4word и hello", "сайт www.example.com/page, да", "안녕하세요", "", None]
    got = localization.leak_tokens(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string"), "ru").orderBy("i").collect()
    assert [r.leak for r in got] == [True, False, False, False, True, True, False, True, False, True, False, False]
    assert (got[2].cyr, got[2].lat) == (7, 0) and (got[5].lat, got[6].lat) == (5, 0)
    df = spark.createDataFrame([("Большой wildfire горит",)], "text string")
    assert localization.leak_tokens(df, "ru").first().leak and not localization.leak_tokens(df, "ru", ("wildfire",)).first().leak


def test_unchanged_words_look_past_quotes_and_terms(spark):
    rows = [("WILDFIRE is here", "WILDFIRE здесь"), ("say \"wildfire\"", "wildfire"), ("wildfire", "«wildfire»"), ("Wildfire", "Wildfire"), ("slam the door", "дверь slam")]
    df = spark.createDataFrame(rows, "text string, translation string")
    assert [r.unchanged for r in localization.unchanged_words(df, "ru").collect()] == [True, False, False, False, True]
    assert not any(r.unchanged for r in localization.unchanged_words(df, "ru", ("WILDFIRE", "slam")).collect())


def test_document_plans(spark):
    fields = "page_id long, region_id long, x long, bx long, skip boolean, text string, translation string, text_position string, style string, auto_layout string"
    base = (5, None, False, "a", "t", None, "s", None)

    def plan(new, pages=("k", "ltr"), old=((1, base), (2, base))):
        frame = lambda rows: spark.createDataFrame([(1, i, *f) for i, f in rows], fields)
        paper = lambda p: spark.createDataFrame([(1, *p)], "page_id long, strokes string, direction string")
        r = localization.diff_documents(frame(old), frame(new), paper(("k", "ltr")), paper(pages)).first()
        return r.plan, r.ids

    change = lambda k, v: tuple(v if i == k else x for i, x in enumerate(base))
    assert plan([(1, base), (2, base)]) == ("none", "")
    assert plan([(1, base), (2, base)], ("other", "ltr")) == ("clean", "")
    assert plan([(1, base), (2, base)], ("k", "rtl")) == ("typeset", "1,2")
    for k, v in ((1, 3), (7, "free"), (3, "b")):  # bubble, layout, text
        assert plan([(1, change(k, v)), (2, base)]) == ("clean", "")
    for k, v in ((4, "u"), (5, "1,2"), (6, "bold")):  # translation, position, style
        assert plan([(1, base), (2, change(k, v))]) == ("typeset", "2")
    assert plan([(1, change(3, "b")), (2, change(4, "u"))]) == ("clean", "2")
    assert plan([(1, base)]) == ("clean", "")


def test_short_replies_follow_their_neighbours(spark):
    rows = [(1, 1, "Да", 12, 48, 48, 1), (1, 2, "Long reply beside it", 18, 48, 48, 1), (1, 3, "One word too long", 9, 48, 48, 1), (2, 1, "А?", 12, 48, 50, 1), (2, 2, "no, no!", 12, 20, 90, 1), (3, 1, " ", 12, 48, 48, 1), (3, 2, "a bc def", 12, 48, 48, 1)]
    df = spark.createDataFrame(rows, "page_id long, region_id long, translation string, font long, high long, interior_h long, bx long")
    got = {(r.page_id, r.region_id): r.cap for r in state.short_reply_cap(df, 10).collect()}
    assert got == {(1, 1): 21, (2, 1): 14, (2, 2): 14}
    df = df.filter("page_id = 2").withColumn("bx", F.lit(None).cast("long"))
    assert {r.region_id: r.cap for r in state.short_reply_cap(df, 10).collect()} == {1: 22, 2: 20}


# ---------------------------------------------------------------- plans, states, quality


def test_names_by_force(spark):
    rng = random.Random(6)
    names = [f"{rng.choice('abA')}{rng.choice(['', '-1', '-2', '-2-2', '-3'])}{rng.choice(['.png', '.PNG', ''])}" for _ in range(120)] + [f"page-{k:04}.png" for k in range(300)]
    old = {"a.png": True, "b-2.png": False, "A-3": True, "page-0007.png": True}

    def by_force(policy):
        taken, out = {k.lower(): v for k, v in old.items()}, []
        for i, n in enumerate(names):
            new = n
            if n.lower() in taken:
                if policy == "skip" or (policy == "overwrite" and taken[n.lower()]):
                    out.append((i, n, None))
                    continue
                head, dot, tail = n.rpartition(".")
                k = 2
                while policy == "rename" and (new := f"{head}-{k}.{tail}" if dot else f"{n}-{k}").lower() in taken:
                    k += 1
            taken.setdefault(new.lower(), False)
            out.append((i, n, new))
        return out

    planned = spark.createDataFrame(list(enumerate(names)), "ord long, name string")
    existing = spark.createDataFrame(list(old.items()), "name string, protected boolean")
    for policy in ("rename", "skip", "overwrite"):
        got = plans.resolve_names(planned, existing, policy).collect()
        assert sorted((r.ord, r.name, r.written) for r in got) == by_force(policy), policy


def test_member_names(spark):
    df = spark.createDataFrame([(7, "ch/1", "{st}em", "C:n")], "index long, chapter string, stem string, name string")
    name = lambda t: df.select(plans.member_name(t, "-x", ".jpg").alias("n")).first().n
    assert [name(t) for t in ("{index:03}", "{index}", "../{chapter}//{stem}", "a\\{name}", "..", "{other}", "{index", "{stem:>9}", "{index:2}")] == [
        "007-x.jpg", "7-x.jpg", "ch/1/stem-x.jpg", "a/n-x.jpg", "007_stem-x.jpg", "007_stem-x.jpg", "007_stem-x.jpg", "007_stem-x.jpg", "7-x.jpg"]


def test_long_runs_of_digits_sort_as_numbers(spark):
    names = ["p" + "9" * 25, "p1" + "0" * 25, "p007", "p7", "p10", "p8"]
    got = state.natural_sort(spark.createDataFrame([(1, n) for n in names], "k long, n string"), "n", ["k"]).orderBy("ord").collect()
    assert [r.n for r in got] == ["p007", "p7", "p8", "p10", "p" + "9" * 25, "p1" + "0" * 25]


def test_eta_goes_by_the_last_completions(spark):
    rows = [(i, "a", "done", 100, float(i), i) for i in range(1, 31)] + [(50, "a", "running", 50, None, None), (51, "a", "queued", 0, None, None), (52, "b", "queued", 0, None, None)]
    df = spark.createDataFrame(rows, "job_id long, lane string, status string, progress long, seconds double, finished long")
    got = {r.job_id: r.eta for r in state.eta(df).collect() if r.job_id >= 50}
    assert got == {50: sum(range(11, 31)) / 20 / 2, 51: sum(range(11, 31)) / 20, 52: None}


def test_running_sums_of_null_and_large_lanes(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", None]), i, rng.randrange(5), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "lane string, id long, day long, v long").repartition(5)
    got = {r.id: r.s for r in state.running_sum(df, ["lane"], F.col("day"), ["day", "id"], F.col("v"), "s").collect()}
    for lane in ("a", None):
        total = 0
        for _, i, _, v in sorted((r for r in rows if r[0] == lane), key=lambda r: (r[2], r[1])):
            total += v
            assert got[i] == total


def test_folds_stream(spark):
    df = spark.range(50_000).select((F.col("id") % 2).alias("k"), "id")

    def fold(rows):
        n = 0
        for k, _ in rows:
            n += 1
            if n % 1000 == 0:
                yield k, n

    assert sorted(map(tuple, per_group_running(df, ["k"], ["id"], fold, "k long, n long").collect())) == [(k, n) for k in (0, 1) for n in range(1000, 25_001, 1000)]


def test_a_failing_row_fails_alone(spark):
    df = spark.range(100).coalesce(1)

    def fn(b):
        if (b["id"] == 37).any():
            raise ValueError("no 37")
        return b.assign(twice=2 * b["id"])

    got = {r.id: (r.twice, r.error) for r in localization.apply_page_model(df, fn, "id long, twice long").collect()}
    assert got[37] == (None, "ValueError: no 37") and all(got[k] == (2 * k, None) for k in got if k != 37) and len(got) == 100


def test_verdict_on_pairs(spark):
    def verdict(rows):
        return tuple(quality.ab_verdict(spark.createDataFrame(rows, "variant string, page long, recall double, hit6 double, seconds double"), ("a", "b"), "pair").first())

    pair = [("pair", p, 0.9, 0.9, 10.0) for p in (1, 2, 3)]
    assert verdict(pair + [("a", p, 0.896, 0.9, 10.1) for p in (1, 2, 3)]) == ("a", "")
    assert verdict(pair + [("a", p, 0.9, 0.9, 10.3) for p in (1, 2, 3)]) == ("pair", "")  # too slow
    weak = [("a", 1, 0.8, 0.9, 9.0), ("a", 2, 0.8, 0.9, 9.0), ("a", 3, 0.9, 0.9, 9.0), ("b", 1, 0.9, 0.9, 9.0), ("b", 2, 0.9, 0.8, 9.0), ("b", 3, None, None, 9.0)]
    assert verdict(pair + weak) == ("pair", "2") and verdict(pair + weak[:3]) == ("pair", "1,2")


def test_style_backgrounds(spark):
    html = "<div style=\"background-image: url('a.png')\"></div><style>.x{background:#fff url(b.jpg) no-repeat} .y{background:url(data:xx)}</style><p style=\"background:url(&quot;c.webp&quot;)\">"
    got = readers.background_assets(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("n").collect()
    assert [r.url for r in got] == ["a.png", "b.jpg", "c.webp"]


def test_report_kinds(spark, tmp_path):
    rows = spark.createDataFrame([("r", "1", "i1", "done", ""), ("r", "2", "i2", "error", "e"), ("r", "3", "i3", "pending", "x")], "run_id string, id string, image string, status string, error string")
    report = plans.run_report(rows)
    plans.write_report(report, str(tmp_path / "report"), ["run_id"], "json")
    assert sorted((r.kind, r.id, r.note) for r in spark.read.json(str(tmp_path / "report")).collect()) == [("errors", "2", "e"), ("pages", "1", ""), ("skipped", "3", "")]


def test_coercion_of_colours(spark):
    df = spark.createDataFrame([(1, [300, -4, None], None, 120), (2, [7], [1, 2, 3, 4], None)], "i long, fill_rgb array<int>, stroke_rgb array<int>, progress long")
    clean, audit = filters.coerce_regions(df)
    assert [tuple(r) for r in clean.orderBy("i").collect()] == [(1, [255, 0, 0], None, 100), (2, [7, 0, 0], [1, 2, 3], 0)]
    assert tuple(audit.first()) == (2, 2, 1)
