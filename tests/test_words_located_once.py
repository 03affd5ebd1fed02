"""Words are located by one fold over pages that are dealt once."""

import math
import random

import pytest

from scriptorium.operators import spatial
from scriptorium.plans import registry

SF = "/root/testdata/sf0.001"
BOX = "x long, y long, w long, h long"


def test_the_table_of_all_is_dealt_once(spark, capsys):
    registry.QUERIES["j22_locate_words"](spark, SF).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1  # several before


def plain(targets, words, regions):
    out = []
    for p, i, key, *t in targets:
        if None in (key, *t) or not 2 <= len(key) <= 40:
            continue
        own = [w for w in words if w[0] == p and None not in w]
        boxes = {tuple(w[3:]) for w in own if w[2] == key}
        for v in own:
            for w in own:
                (x, y, a, b), (u, z, c, d) = v[3:], w[3:]
                tall = 0.8 * max(b, d)
                if v[1] != w[1] and len(v[2]) >= 2 and w[2] and v[2] + w[2] == key and max(0, u - x - a, x - u - c) <= tall and max(0, z - y - b, y - z - d) <= tall \
                        and math.sqrt((x + a / 2 - u - c / 2) ** 2 + (y + b / 2 - z - d / 2) ** 2) <= 1.5 * max(a, b, c, d):
                    boxes.add((min(x, u), min(y, z), max(x + a, u + c) - min(x, u), max(y + b, z + d) - min(y, z)))
        found, pad = [], max(t[2:])
        for x, y, w, h in boxes:
            far = math.sqrt((t[0] + t[2] / 2 - x - w / 2) ** 2 + (t[1] + t[3] / 2 - y - h / 2) ** 2)
            over = lambda r: max(0, min(x + w, r[2] + r[4]) - max(x, r[2])) * max(0, min(y + h, r[3] + r[5]) - max(y, r[3]))  # noqa: B023, E731
            if min(w, h) >= 3 and 0.1 <= w * h / max(t[2] * t[3], 1) <= 6 and far <= 1.5 * pad and not any(r[0] == p and r[1] != i and over(r) > 0.4 * min(w * h, r[4] * r[5]) for r in regions):
                found.append((far, x, y, w, h))
        found.sort()
        if found and (len(found) == 1 or found[1][0] - found[0][0] >= max(8, 0.2 * pad)):
            out.append((p, i, round(found[0][0], 6), *found[0][1:]))
    return sorted(out)


@pytest.mark.parametrize("n", [8, 150])  # of many words of a key the index is asked
def test_words_by_brute_force(spark, n):
    rng, pages = random.Random(n), 400 // n
    keys = ["ab", "cd", "abcd", "abc", "d", "bcd", "", None, "cdab", "ab" * 25]
    side = 40 if n == 8 else 900
    box = lambda a, b: (rng.randrange(side), rng.randrange(side), rng.randrange(3, a), rng.randrange(3, b))
    words = [(p, i, rng.choice(keys), *box(30, 14)) for p in range(pages) for i in range(n)] + [(0, 998, "ab", None, 1, 9, 9)]
    targets = [(p, i, rng.choice(keys), *box(60, 20)) for p in range(pages) for i in range(n)]
    regions = [(p, i, *box(25, 9)) for p in range(pages) for i in range(n // 4)]
    of = lambda rows, names: spark.createDataFrame(rows, f"page_id long, {names} {BOX}")
    got = spatial.locate_words(of(targets, "target_id long, key string,"), of(words, "word_id long, key string,"), of(regions, "region_id long,"))
    got = sorted((r.page_id, r.target_id, round(r.distance, 6), r.x, r.y, r.w, r.h) for r in got.collect())
    assert got == plain(targets, words, regions) and len(got) > 5
