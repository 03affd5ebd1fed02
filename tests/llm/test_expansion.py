"""Suffixes are ordered as deep as windows are long, and contents of an anchor stay together however batches are cut."""

import random

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.llm import suffix_dedup


@pytest.mark.parametrize("letters", [b"ab", bytes(range(33, 120))])
def test_suffixes_are_ordered_to_a_depth(letters, monkeypatch):
    rng = random.Random(3)
    part = bytes(rng.choice(letters) for _ in range(300))
    contents = [part[rng.randrange(100) :] + bytes([rng.choice(letters)]) for _ in range(40)]
    data = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8).astype(np.int64) + 1
    sizes = np.array([len(c) + 1 for c in contents])
    ends = np.cumsum(sizes)
    data[ends - 1] = 0
    place = np.repeat(ends - 1, sizes) - np.arange(len(data))
    sorts, sort = [], suffix_dedup._ordered
    monkeypatch.setattr(suffix_dedup, "_ordered", lambda *a: sorts.append(1) or sort(*a))
    whole = suffix_dedup.suffix_array(data, place)
    n = len(sorts)
    some = suffix_dedup.suffix_array(data, place, 50)
    assert len(sorts) - n < n
    text = data.tobytes()
    at = lambda order, k: [text[8 * i : 8 * (i + min(place[i] + 1, k))] for i in order.tolist()]
    assert at(some, 50) == at(whole, 50) and sorted(some.tolist()) == list(range(len(data)))


def plain(rows, length):
    own: dict = {}
    for a, c, lo, hi in rows:
        low, high = own.get((a, c), (lo, hi))
        own[a, c] = min(lo, low), max(hi, high)
    first: dict = {}
    for (a, c), (lo, _) in own.items():
        for i in range(len(c) - length + 1):
            first[a, c[i : i + length]] = min(lo, first.get((a, c[i : i + length]), lo))
    return {(a, c, i, first[a, c[i : i + length]]) for (a, c), (_, hi) in own.items() for i in range(len(c) - length + 1) if first[a, c[i : i + length]] < hi}


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_runs_of_contents_by_brute_force(batch, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HELD_BYTES", 300)
    rng, length = random.Random(batch), 8
    rows = []
    for a in range(12):
        letters = bytes([65 + 4 * a, 66 + 4 * a])  # equal windows have one anchor
        base = bytes(rng.choice(letters) for _ in range(40))
        for _ in range(rng.randrange(1, 12)):
            k, lo = rng.randrange(20), rng.randrange(50)
            rows.append((a * 1000, base[k : k + rng.randrange(length, 20)] + rng.choice([b"", bytes([67 + 4 * a]), bytes([68 + 4 * a])]), lo, lo + rng.randrange(5)))
    t = pa.table({"anchor": pa.array([r[0] for r in rows], pa.int64()), "content": pa.array([r[1] for r in rows], pa.binary()), "first": pa.array([r[2] for r in rows]), "last": pa.array([r[3] for r in rows])})
    contents = {}
    for a, c, *_ in rows:
        name = suffix_dedup._names(np.frombuffer(c, np.uint8), np.array([0]), np.array([len(c)]))[0]
        contents[a, int(name)] = c
    got = set()
    for out in suffix_dedup._expand(length)(iter(t.to_batches(max_chunksize=batch))):
        for r in out.to_pylist():
            c = contents[r["anchor"], r["name"]]
            got |= {(r["anchor"], c, i, run["least"]) for run in r["runs"] for i in range(run["start"], run["end"] - length + 1)}
    assert got == plain(rows, length) and got
