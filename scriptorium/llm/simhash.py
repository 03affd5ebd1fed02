"""Operator 3: near-duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints within radius 4 of each other have a common variant within radius 2 of both. So every distinct fingerprint
emits all its variants within radius 2 (2081 of 64 bits), variants are brought together, and fingerprints that
collide are linked.

A variant need not travel in full. Fingerprints are sent to the high bits of their variants (137 prefixes of `PREFIX` bits;
more bits for more fingerprints, so that a bucket has `MEETING` of them on average), with the variants themselves made where they
meet; and fingerprints for one prefix are packed, for each batch, into one row. A bucket whose variants are more than `HELD` is
gone through by longer and longer prefixes, so that its time grows with its variants and its memory does not.

All fingerprints that hold a variant are pairwise within radius 4, so a group is linked by a star to its least member
(checked by their distance), never by all its pairs. Every task then reduces its links to a forest, and the forests are
merged by alternating large and small stars over tables: links whose ends are fingerprints, never documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BITS = 64
RADIUS = 4
PREFIX = 16
SHINGLE = 4
SEED = 42
#: Fingerprints that a bucket has on average, at most.
MEETING = 1 << 20
#: Variants that a task holds at once, and the bits by which a prefix grows where they would be more.
HELD = 2_000_000
STEP = 4


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash: words of the text with A-Z lower-cased, shingles with repeats; a bit is 1 if set in over half the hashes."""
    words = text.encode().lower().split()  # of bytes: A-Z alone are lowered, and the six ASCII blanks alone separate
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, 65536):
        hashes = b"".join([digest(b" ".join(words[i : i + shingle]), seed) for i in range(k, min(n, k + 65536))])
        ones += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([fingerprint(t or "") for t in s], dtype="int64")


def fingerprints(text: Column) -> Column:
    """Fingerprint of a text column; null is empty."""
    return F.pandas_udf(_fingerprints, "long")(text)


def flips(low: int, high: int, radius: int) -> list[np.ndarray]:
    """For 0 to radius flipped bits: the masks over bits low to high - 1."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(low, high), r)], dtype=np.uint64) for r in range(radius + 1)]


def prefix_bits(n: int) -> int:
    """Bits of the prefixes by which n fingerprints are dealt."""
    p = PREFIX
    while p < BITS // 2 and n * (1 + p + p * (p - 1) // 2) >> p > MEETING:
        p += 1
    return p


def _to_prefixes(prefix: int):
    """Fingerprints → (bucket, fps): for each prefix of a variant, the fingerprints of this batch that have such a variant."""
    masks = np.concatenate(flips(0, prefix, RADIUS // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k in range(0, len(fps), 20_000):
                part = fps[k : k + 20_000]
                bucket = ((part >> np.uint64(BITS - prefix))[:, None] ^ masks[None, :]).ravel()
                order = np.argsort(bucket, kind="stable")
                bucket, sent = bucket[order], np.repeat(part, len(masks))[order]
                first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                ends = np.r_[first[1:], len(bucket)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[first].astype(np.int64)), pa.array([sent[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary())],
                    names=["_bucket", "_fps"],
                )

    return run


def roots(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def colliding(fps: np.ndarray, bucket: np.ndarray, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints with a common variant in their buckets (a pair for each variant and further fingerprint)."""
    links: list[np.ndarray] = [np.zeros((0, 2), dtype=np.uint64)]

    def meet(v: np.ndarray, f: np.ndarray) -> None:
        order = np.argsort(v)
        v, f = v[order], f[order]
        new = np.r_[True, v[1:] != v[:-1]] if len(v) else np.zeros(0, dtype=bool)
        if new.all():
            return
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(f, first)[np.cumsum(new) - 1]
        pair = (f != least) & (np.bitwise_count(f ^ least) <= RADIUS)
        if pair.any():
            links.append(np.unique(np.stack([f[pair], least[pair]], axis=1), axis=0))
            if sum(map(len, links)) > HELD:  # a forest says as much
                nodes, root = roots(*np.concatenate(links).T)
                links[:] = [np.stack([nodes, root], axis=1)[nodes != root]]

    def part(f: np.ndarray, head: np.ndarray, prefix: int) -> None:
        """Brings together the variants of f that begin with the first `prefix` bits of head (its other bits are zero)."""
        rest = BITS - prefix
        near = np.bitwise_count((f ^ head) >> np.uint64(rest)) if rest < BITS else np.zeros(len(f), dtype=np.uint8)
        masks = flips(0, rest, RADIUS // 2)
        reach = np.cumsum([len(m) for m in masks])[::-1]  # variants of one that has 0, 1, 2 flipped bits in its prefix
        if not rest or int(reach[near].sum()) <= HELD:
            low = f & np.uint64((1 << rest) - 1)
            vs, fs = [], []
            for r in range(RADIUS // 2 + 1):
                mine = near == r
                for m in masks[: RADIUS // 2 - r + 1]:
                    vs.append((head[mine][:, None] | (low[mine][:, None] ^ m[None, :])).ravel())
                    fs.append(np.repeat(f[mine], len(m)))
            meet(np.concatenate(vs), np.concatenate(fs))
            return
        step = min(STEP, rest)
        shift = np.uint64(rest - step)
        own = (f >> shift & np.uint64((1 << step) - 1)).astype(np.int64)
        order = np.lexsort((near, own))  # by value, the nearest first
        at = np.searchsorted(own[order] * (RADIUS + 1) + near[order], np.arange((RADIUS + 1) << step))
        for value in range(1 << step):
            rows = [order[at[(value ^ int(m)) * (RADIUS + 1)] : at[(value ^ int(m)) * (RADIUS + 1) + RADIUS // 2 - r + 1]]
                    for r, some in enumerate(flips(0, step, RADIUS // 2)) for m in some]
            rows = np.concatenate(rows)
            if len(rows):
                part(f[rows], head[rows] | np.uint64(value) << shift, prefix + step)

    part(fps, bucket << np.uint64(BITS - prefix), prefix)
    both = np.concatenate(links)
    return both[:, 0], both[:, 1]


def _links(prefix: int):
    """Buckets in order → a forest over the fingerprints that collide in them."""

    def forest(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        fps = np.frombuffer(b"".join(f for _, f in held), dtype=np.uint64)
        bucket = np.repeat(np.array([b for b, _ in held], dtype=np.uint64), [len(f) // 8 for _, f in held])
        nodes, root = roots(*colliding(fps, bucket, prefix))
        real = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[real].view(np.int64)), pa.array(root[real].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for bucket, fps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != last and size > 8 * HELD // 256:  # on average, a fingerprint has 15 variants in a bucket
                    yield forest(held)
                    held, size = [], 0
                held.append((bucket, fps))
                size, last = size + len(fps), bucket
        if held:
            yield forest(held)

    return run


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, root) of links (a, b): root is the least node of the component, by unsigned order of no meaning to callers.

    Large star: every node links its greater neighbours to its least; small star: its lesser ones and itself. The least of each node is
    summed up before the shuffle and, for the large star, written: so both sides of the join are plain exchanges, and Spark can split a hub's
    links over tasks."""
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), label)
    before = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{label}-least")
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        large = large.distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m"), F.explode(F.array(F.col("a"), F.col("b"))).alias("x"))
        links = written(small.filter("m <> x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct(), label)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now


def near_classes(fps: DataFrame) -> DataFrame:
    """fps(_fp, _first: least key of its documents), one row per distinct fingerprint → (_fp, component_id, _root: one for each component)."""
    prefix = prefix_bits(fps.count())
    sent = fps.select("_fp").mapInArrow(_to_prefixes(prefix), "_bucket long, _fps binary")
    met = sent.repartition("_bucket").sortWithinPartitions("_bucket").mapInArrow(_links(prefix), "a long, b long")
    found = components(met)
    rooted = fps.join(found, fps["_fp"] == found["node"], "left").select("_fp", "_first", F.coalesce("root", "_fp").alias("_root"))
    # Written, so that both sides of the join are plain exchanges and Spark can split a component with a third of all fingerprints.
    least = written(rooted.groupBy("_root").agg(F.min("_first").alias("component_id")), "roots")
    return rooted.join(least, "_root").select("_fp", "component_id", "_root")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, fingerprint (16 hexadecimal digits), component_id (least key in reach).

    A null or empty text, or one of blanks alone, has fingerprint zero and is linked like any other. Rows that repeat a key
    are documents of their own; a null key is no candidate for component_id unless its component has no other. An empty table gives an
    empty result; other columns are ignored."""
    docs = written(df.select(F.col(key).alias("_key"), fingerprints(F.col(text)).alias("_fp")), "simhash")
    fps = written(docs.groupBy("_fp").agg(F.min("_key").alias("_first")), "fingerprints")
    classes = near_classes(fps)
    return docs.join(classes, "_fp").select(
        F.col("_key").alias(key), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay: of each component one with the least key, with the columns of df (of any names).

    Null texts and those of blanks alone are one component, fingerprint zero, with any that are within reach of it. A null key is the
    least only where its component has no other. Of rows that repeat the least key in a component, one of those with the least name of
    a text stays. A key that is the least of several components keeps a row for each. An empty table stays empty."""
    name = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    docs = written(df.select(F.col(key).alias("_key"), name.alias("_name"), fingerprints(F.col(text)).alias("_fp")), "simhash")
    classes = near_classes(written(docs.groupBy("_fp").agg(F.min("_key").alias("_first")), "fingerprints"))
    least = docs.join(classes, "_fp").filter(F.col("_key").eqNullSafe(F.col("component_id")))
    stays = least.groupBy("_root").agg(F.min("_key").alias("_key"), F.min("_name").alias("_text"))
    # In a struct a null key equals itself, and the window below finds the rows where the join has dealt them.
    stays = stays.select(F.struct("_key").alias("_id"), "_text")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.struct(F.col(key).alias("_key")).alias("_id"), name.alias("_text"))
    rows = rows.join(stays, ["_id", "_text"], "left_semi")
    one = Window.partitionBy("_id", "_text").orderBy(F.lit(0))  # equal rows; nearly every group is one row
    return rows.withColumn("_r", F.row_number().over(one)).filter("_r = 1").select("_row.*")
