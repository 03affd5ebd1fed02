"""Operator 1: removal of repeated strings by threshold-bounded interval expansion on a Burrows-Wheeler transform (BWT).

A byte goes if a string of `LENGTH` bytes that covers it also starts in a document with a smaller id.

Dealing out. A corpus has no one suffix array on a cluster, so windows of LENGTH bytes are dealt by content. The anchor of a
window is the least hash of the strings of `ANCHOR` bytes in it: equal windows have equal anchors wherever they are.
Adjacent windows with one anchor form a snippet. Only snippets whose anchor occurs in two documents or more are of use:

1. Documents are dealt to groups by id. Each group sends every distinct anchor once to the anchor's bucket; buckets tell the
   groups which of theirs also occur in another document.
2. Each group writes the snippets of those anchors: distinct contents with their first and last document, and occurrences.
3. Snippets are dealt by anchor. Each task concatenates distinct contents and expands intervals of their BWT up to LENGTH.
4. Occurrences are joined to what was found for their snippet; byte ranges are united by document and cut out.

A passage that a third of all documents hold is one content for each group, not one for each document, in steps 1 to 3, and a
join of occurrences that Spark can split in step 4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

LENGTH = 50
ANCHOR = 20
#: Windows of a snippet at most, so that a text of one repeated character gives short snippets too.
RUN = 60
#: Bytes of texts, bytes of snippets, and anchors, that a task works on at once.
PART_BYTES = 4_000_000
HELD_BYTES = 200_000
HELD_ANCHORS = 1_000_000
#: Groups of documents and buckets of anchors for each shuffle partition, at least, and bytes of texts for each of them, at most: both
#: are held whole by a task.
GROUPS, BUCKETS = 4, 1
GROUP_BYTES, BUCKET_BYTES = 64_000_000, 128_000_000
#: Buckets have 17 bits of the 64 of a key.
MOST_BUCKETS = 1 << 17
#: An anchor with more contents than this (distinct in a group, summed over groups) is hot, however many groups there are: its windows
#: become snippets of their own, dealt by their whole content, so that no task gets all the contents around a frequent string. A task
#: expands HELD_BYTES and HOT contents of RUN + LENGTH bytes at most, which is well below SYMBOLS.
HOT = 4096
#: Symbols from which a suffix array has no room for ranks beside the index.
SYMBOLS = 1 << 21
_REST = np.uint64((1 << 47) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- anchors


def _hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Mixed hashes of all strings of n bytes: products for powers of two, put together by the binary digits of n."""
    part, size, done, have = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                if done is None:
                    done = part
                else:
                    k = min(len(done), len(part) - have)
                    done = done[:k] * np.uint64(pow(int(_ODD), size, 1 << 64)) + part[have : have + k]
                have += size
            if have == n:
                break
            part = part[:-size] * np.uint64(pow(int(_ODD), size, 1 << 64)) + part[size:]
            size *= 2
        done = done ^ (done >> np.uint64(32))
        done = done * np.uint64(0xD6E8FEB86659FD93)
        return done ^ (done >> np.uint64(29))


def snippets(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR, run: int = RUN) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor) of all snippets; a text of fewer than `length` bytes has none."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.astype(np.uint64)
    least, width, span = _hashes(data, anchor), 1, length - anchor + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: width - span], least[span - width :])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    text = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
    many = np.maximum(sizes - length + 1, 0)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    least = least[starts[text] + inside]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(text)])
    if len(n) and n.max() > run:  # cut long ones
        parts = -(-n // run)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, n = np.repeat(first, parts) + k * run, np.minimum(run, np.repeat(n, parts) - k * run)
    return text[first], inside[first], n, least[first]


def _names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of the strings data[start:end]: polynomials from prefix sums, for all of them at a time. Contents are told apart by
    key and name, where the key has the anchor's hash too: of n contents with one anchor, two agree by chance at odds of n * n / 2**65."""
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(data), _ODD)])
        inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(data), pow(int(_ODD), -1, 1 << 64), dtype=np.uint64)])
        sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)])]
        name = (sums[end] - sums[start]) * inverse[start] ^ (end - start).astype(np.uint64) << np.uint64(40)
        name = (name ^ name >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return (name ^ name >> np.uint64(29)).view(np.int64)


def _keyed(anchors: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of an anchor, and its key: bucket and 47 further bits."""
    bucket = anchors % np.uint64(buckets)
    return bucket, bucket << np.uint64(47) | (anchors // np.uint64(buckets)) & _REST


def _parts(texts: list[bytes], limit: int = PART_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def _send_anchors(buckets: int, length: int = LENGTH):
    """A group of documents → for each bucket, the group's distinct anchor keys; the top bit tells those in two documents. _many has
    (index, contents) of the keys with two distinct contents or more."""

    def run(group: pa.Table) -> pa.Table:
        texts = [(t or "").encode() for t in group.column("_text").to_pylist()]
        doc = group.column("_doc").to_numpy()
        keys, docs, names = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for at, some in _parts(texts, 1_000_000):
            text, inside, n, anchors = snippets(some)
            sizes = np.array([len(t) for t in some], dtype=np.int64)
            start = (np.cumsum(sizes) - sizes)[text] + inside
            keys.append(_keyed(anchors, buckets)[1])
            docs.append(doc[at + text])
            names.append(_names(np.frombuffer(b"".join(some), dtype=np.uint8), start, start + n + length - 1))
        key, who, name = np.concatenate(keys), np.concatenate(docs), np.concatenate(names)
        order = np.argsort(key)
        key, who, name = key[order], who[order], name[order]
        if not len(key):
            return pa.table({"_bucket": pa.array([], pa.int64()), "_group": pa.array([], pa.int64()), "_keys": pa.array([], pa.binary()), "_many": pa.array([], pa.binary())})
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
        again = np.flatnonzero(np.r_[False, run[1:] == run[:-1]] | np.r_[run[1:] == run[:-1], False])  # rows of keys with two or more
        again = again[np.lexsort((name[again], run[again]))]
        other = (run[again][1:] == run[again][:-1]) & (name[again][1:] != name[again][:-1])
        contents = 1 + np.bincount(run[again][1:][other], minlength=len(first))
        several = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
        key = key[first]
        bucket = (key >> np.uint64(47)).astype(np.int64)
        short = (key & _REST | several.astype(np.uint64) << np.uint64(47)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[cut[1:], len(bucket)]
        many = np.flatnonzero(contents > 1)
        pairs = np.stack([many - cut[np.searchsorted(cut, many, "right") - 1], contents[many]], axis=1).astype("<u4").tobytes()
        low, high = (8 * np.searchsorted(many, x) for x in (cut, ends))
        return pa.table({
            "_bucket": pa.array(bucket[cut]), "_group": pa.array(np.full(len(cut), group.column("_group")[0].as_py(), dtype=np.int64)),
            "_keys": pa.array([short[6 * i : 6 * j] for i, j in zip(cut, ends, strict=True)], pa.binary()),
            "_many": pa.array([pairs[i:j] for i, j in zip(low, high, strict=True)], pa.binary()),
        })

    return run


def _shared_anchors(hot: int):
    """Buckets in order → for each group, those of its anchor keys that occur in two documents or more; hot ones in a row apart."""

    def found(held: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        n = [len(k) // 6 for _, _, k, _ in held]
        raw = np.zeros((sum(n), 8), dtype=np.uint8)
        raw[:, :6] = np.frombuffer(b"".join(k for _, _, k, _ in held), dtype=np.uint8).reshape(-1, 6)
        key = raw.view("<u8").ravel()
        several, key = key >> np.uint64(47) > 0, key & _REST | np.repeat(np.array([b for b, _, _, _ in held], dtype=np.uint64), n) << np.uint64(47)
        group = np.repeat(np.array([g for _, g, _, _ in held], dtype=np.int64), n)
        pairs = np.frombuffer(b"".join(m for _, _, _, m in held), dtype="<u4").reshape(-1, 2).astype(np.int64)
        contents = np.ones(len(key), dtype=np.int64)
        contents[pairs[:, 0] + np.repeat(np.cumsum(n) - n, [len(m) // 8 for _, _, _, m in held])] = pairs[:, 1]
        order = np.argsort(key)
        key, several, group, contents = key[order], several[order], group[order], contents[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        ok = np.repeat((size > 1) | np.logical_or.reduceat(several, first), size)
        frequent = np.repeat(np.add.reduceat(contents, first) > hot, size)[ok]
        key, group = key[ok], group[ok]
        order = np.lexsort((frequent, group))
        key, group, frequent = key[order], group[order], frequent[order]
        cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (frequent[1:] != frequent[:-1])]) if len(group) else np.zeros(0, dtype=np.int64)
        ends = np.r_[cut[1:], len(group)]
        keys = pa.array([key[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(group[cut]), keys, pa.array(frequent[cut])], names=["_group", "_keys", "_hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != last and size > 6 * HELD_ANCHORS:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[2]), row[0]
        if held:
            yield found(held)

    return run


_OUT = T.StructType([
    T.StructField("anchor", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("name", T.LongType()),
    T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
    T.StructField("doc", T.LongType()), T.StructField("text", T.LongType()), T.StructField("at", T.IntegerType()),
])


def _write_snippets(buckets: int, length: int):
    """A group's texts and its shared anchors → rows of contents (content, first, last) and of occurrences (doc, text, at)."""

    def run(group: pa.Table, shared: pa.Table) -> pa.Table:
        sets = list(zip(shared.column("_keys").to_pylist(), shared.column("_hot").to_pylist(), strict=True))
        keys = np.unique(np.frombuffer(b"".join(k for k, _ in sets), dtype=np.uint64))
        hot = np.unique(np.frombuffer(b"".join(k for k, h in sets if h), dtype=np.uint64))
        texts = [(t or "").encode() for t in group.column("_text").to_pylist()]
        doc, name = group.column("_doc").to_numpy(), group.column("_name").to_numpy()
        kinds = []
        for at, some in _parts(texts) if len(keys) else ():
            text, first, n, anchors = snippets(some)
            key = _keyed(anchors, buckets)[1]
            hit = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
            text, first, n, key = text[hit], first[hit], n[hit], key[hit].view(np.int64)
            frequent = np.zeros(len(key), dtype=bool)
            if len(hot):
                frequent = hot[np.minimum(np.searchsorted(hot, key.view(np.uint64)), len(hot) - 1)] == key.view(np.uint64)
                parts = np.where(frequent, n, 1)
                k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                text, first, frequent, key = np.repeat(text, parts), np.repeat(first, parts) + k, np.repeat(frequent, parts), np.repeat(key, parts)
                n = np.where(frequent, 1, np.repeat(n, parts))
            data = b"".join(some)
            sizes = np.array([len(t) for t in some], dtype=np.int64)
            start = (np.cumsum(sizes) - sizes)[text] + first
            end = start + n + length - 1
            names = _names(np.frombuffer(data, dtype=np.uint8), start, end)
            key = np.where(frequent, names + key * _ODD.view(np.int64), key)  # of a hot window: by anchor and whole content
            docs, m = doc[at + text], len(key)
            kinds.append(pa.table([pa.array(key), pa.nulls(m, pa.binary()), pa.array(names), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                                   pa.array(docs), pa.array(name[at + text]), pa.array(first.astype(np.int32))], names=_OUT.names))
            order = np.lexsort((names, key))
            cut = np.flatnonzero(np.r_[True, (names[order][1:] != names[order][:-1]) | (key[order][1:] != key[order][:-1])]) if m else order
            one, docs = order[cut], docs[order]
            low, high = (np.minimum.reduceat(docs, cut), np.maximum.reduceat(docs, cut)) if m else (docs, docs)
            some_contents = [data[i:j] for i, j in zip(start[one].tolist(), end[one].tolist(), strict=True)]
            m = len(one)
            kinds.append(pa.table([pa.array(key[one]), pa.array(some_contents, pa.binary()), pa.nulls(m, pa.int64()), pa.array(low), pa.array(high),
                                   pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())], names=_OUT.names))
        if not kinds:
            kinds = [pa.schema([("anchor", pa.int64()), ("content", pa.binary()), ("name", pa.int64()), ("first", pa.int64()), ("last", pa.int64()),
                                ("doc", pa.int64()), ("text", pa.int64()), ("at", pa.int32())]).empty_table()]
        return pa.concat_tables(kinds)

    return run


# ---------------------------------------------------------------- BWT


def _ordered(high: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of non-negative numbers below 2**(63 - bits), ties by index, and whether each in that order is new. One sort of numbers
    with the index in their low bits."""
    packed = np.sort(high << bits | np.arange(len(high)))
    high = packed >> bits
    return packed & ((1 << bits) - 1), np.r_[True, high[1:] != high[:-1]]


def suffix_array(symbols: np.ndarray, place: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Order of all suffixes of contents that each end in a separator of its own, for fewer than 2**21 symbols (more are an error). symbols:
    byte + 1 (UTF-8 has no byte above 244), 0 for a separator; place: distance to the own separator. Equal suffixes are in the order of their
    contents, and so are, with a depth, those with so many symbols in common. By prefix doubling, from as many symbols as fit beside the index."""
    n = len(symbols)
    if n >= SYMBOLS:
        raise ValueError(f"{n} symbols in one suffix array, {SYMBOLS - 1} at most")
    there = np.bincount(symbols, minlength=1) > 0
    there[0] = False
    dense = np.cumsum(there) * there  # mostly some 60 symbols are there
    bits, width = n.bit_length(), max(1, int(dense.max()).bit_length())
    size, most = (63 - bits) // width, min(int(place.max()) + 1, depth or n)
    dense, key = dense[symbols], np.zeros(n, dtype=np.int64)
    for k in range(size):
        key <<= width
        key[: n - k] |= np.where(place[: n - k] >= k, dense[k:], 0)
    while True:
        order, new = _ordered(key, bits)
        if size >= most or new.all():
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new) - 1
        key = rank << bits
        ahead = np.flatnonzero(place >= size)
        key[ahead] |= rank[ahead + size] + 1
        size *= 2


def equal_windows(contents: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(position, class) of all windows of `length` bytes in the concatenation of contents, each with a separator behind it."""
    return _windows(np.frombuffer(b"\0".join(contents) + b"\0", dtype=np.uint8), np.array([len(c) + 1 for c in contents]), length)


def _windows(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """As equal_windows, of contents one after the other, with sizes that count a separator behind each.

    Intervals of the BWT, breadth first: those of the strings of one symbol, then all of these extended backward by one symbol, and
    so on. A border between neighbouring rows that first appears with strings of l + 1 symbols has common prefix l: the common
    prefixes come by increasing value, and only rows without a border yet are looked at again. After `length` rounds the
    intervals left are the classes of suffixes with `length` or more bytes in common; how these are ordered among themselves does not matter."""
    symbols = data.astype(np.int64) + 1
    ends = np.cumsum(sizes)
    symbols[ends - 1] = 0
    place = np.repeat(ends - 1, sizes) - np.arange(len(symbols))
    order = suffix_array(symbols, place, length)
    bwt = symbols[order - 1]  # the first content's predecessor is the last separator
    # Backward steps: row i goes to LF(i), where the suffix with one symbol more before it is.
    row = np.empty(len(order), dtype=np.int32)
    row[order] = np.arange(len(order), dtype=np.int32)
    forth = row[order - 1]  # LF
    back = np.empty(len(order), dtype=np.int32)
    back[forth] = np.arange(len(order), dtype=np.int32)
    head = bwt[back]
    border = np.r_[True, (head[1:] != head[:-1]) | (head[1:] == 0)]
    # A border before row i, found last, parts rows j - 1 and j of the next round if it lies between back[j - 1] and back[j]. Mostly
    # these are neighbours, and then j = LF(i). Only the other rows (`wide`) compare the intervals of both.
    gap = np.r_[0, back[1:] - back[:-1]]
    near = gap == 1
    wide = np.flatnonzero(~border & ~near)
    this, above = back[wide], back[wide - 1]
    new = np.flatnonzero(border)
    for _ in range(length - 1):
        found = forth[new]
        found = found[~border[found] & near[found]]
        interval = np.cumsum(border, dtype=np.int32)
        parted = interval[this] != interval[above]
        new = np.concatenate([found, wide[parted]])
        if not len(new):
            break
        border[new] = True
        same = ~parted
        wide, this, above = wide[same], this[same], above[same]
    whole = place[order] >= length
    return order[whole], np.cumsum(border)[whole]


_RUNS = T.StructType([
    T.StructField("anchor", T.LongType()), T.StructField("name", T.LongType()),
    T.StructField("runs", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("least", "long"))),
])


def _expand(length: int):
    """Contents by anchor → for each, its runs of windows with the first document of each; contents of one document that
    comes first everywhere are left out."""

    def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        anchors, texts = rows["anchor"].to_numpy(), rows["content"].combine_chunks().dictionary_encode()
        # An anchor's equal contents, of several groups, are one.
        new = np.r_[True, anchors[1:] != anchors[:-1]]
        both = (np.cumsum(new) - 1) * len(texts.dictionary) + texts.indices.to_numpy()
        order = np.argsort(both, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(both[order]) != 0])
        first, last = np.minimum.reduceat(rows["first"].to_numpy()[order], cut), np.maximum.reduceat(rows["last"].to_numpy()[order], cut)
        one = order[cut]
        data = pc.binary_join_element_wise(texts.dictionary.take(texts.indices.take(pa.array(one))), pa.scalar(b"", pa.binary()), pa.scalar(b"\0", pa.binary()))
        sizes = np.diff(np.frombuffer(data.buffers()[1], dtype=np.int32, count=len(data) + 1, offset=4 * data.offset)).astype(np.int64)
        data = np.frombuffer(data.buffers()[2], dtype=np.uint8, count=int(sizes.sum()))
        at, which = _windows(data, sizes, length)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        cut = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.zeros(0, dtype=np.int64)
        least = np.minimum.reduceat(first[owner[at]], cut)
        by_place = np.full(len(owner), np.iinfo(np.int64).max)
        by_place[at] = np.repeat(least, np.diff(np.r_[cut, len(at)]))
        there = np.zeros(len(owner), dtype=bool)
        there[at] = True
        windows = np.flatnonzero(there)
        value, who = by_place[windows], owner[windows]
        cut = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (who[1:] != who[:-1])])
        ends = windows[np.r_[cut[1:] - 1, len(windows) - 1]] + length
        starts, value, who = windows[cut], value[cut], who[cut]
        useful = value < last[who]
        starts, ends, value, who = starts[useful], ends[useful], value[useful], who[useful]
        base = np.cumsum(sizes) - sizes
        starts, ends = (starts - base[who]).astype(np.int32), (ends - base[who]).astype(np.int32)
        cut = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, dtype=np.int64)
        offsets = pa.array(np.r_[cut, len(who)].astype(np.int32)) if len(cut) else pa.array([0], pa.int32())
        names = _names(data, base, base + sizes - 1)
        runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x) for x in (starts, ends, value)], names=["start", "end", "least"]))
        return pa.RecordBatch.from_arrays([pa.array(anchors[one][who[cut]]), pa.array(names[who[cut]]), runs], names=_RUNS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            anchors = b.column("anchor").to_numpy()
            new = np.flatnonzero(np.r_[anchors[0] != last, anchors[1:] != anchors[:-1]])
            before = np.r_[0, np.cumsum(pc.binary_length(b.column("content")).to_numpy() + 1)]
            done, last = 0, anchors[-1]
            for i in new.tolist():
                if size + before[i] - before[done] > 2 * HELD_BYTES:  # some half of the contents are equal to others; an anchor's stay together
                    yield found([*held, b[done:i]])
                    held, size, done = [], 0, i
            held.append(b[done:])
            size += int(before[-1] - before[done])
        if held:
            yield found(held)

    return run


# ---------------------------------------------------------------- documents


def _united(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the united ranges (start << 32 | end) of every row's list of ranges, in order."""
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    values = lists.flatten().to_numpy()
    start, end = values >> 32, values & 0xFFFFFFFF
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    apart = int(end.max()) + 1  # rows one after the other on one line
    reach = np.maximum.accumulate(end + row * apart)
    new = np.r_[True, start[1:] + row[1:] * apart > reach[:-1]] | np.r_[True, row[1:] != row[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(row) - 1]
    return row[first], start[first], reach[last] - row[last] * apart


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, starts, ends = _united(b.column(2))
        at = np.searchsorted(row, np.arange(b.num_rows + 1)).tolist()
        s, e = starts.tolist(), ends.tolist()
        n_bytes, digests = [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            data = (text or "").encode()
            digest, done = hashlib.sha256(), 0
            for k in range(at[i], at[i + 1]):
                digest.update(data[done : s[k]])
                done = e[k]
            digest.update(data[done:])
            n_bytes.append(len(data)), digests.append(digest.hexdigest())
        removed = np.r_[0, np.cumsum(ends - starts)]
        n_removed, n_spans = np.diff(removed[at]), np.diff(at)
        spans = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], names=["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.array(at, dtype=np.int32)), spans)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed.astype(np.int64)), pa.array(n_spans.astype(np.int64)), pa.array(digests), spans],
            names=["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def repeated_strings(df: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end byte of each removed run).

    A null text is empty; texts of fewer than `length` bytes lose nothing. A null key is smaller than any other. Rows that
    repeat a key are documents of their own of which neither comes first, so none of them loses what only they share. An
    empty table gives an empty result; other columns are ignored."""
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = df.agg(F.sum(F.octet_length(body)).alias("n")).first()[0] or 0
    groups = max(GROUPS * partitions, size // GROUP_BYTES)
    buckets = min(max(BUCKETS * partitions, size // BUCKET_BYTES), MOST_BUCKETS)
    doc = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    docs = df.select(F.col(key).alias("_key"), doc.alias("_doc"), body.alias("_text"), F.xxhash64(body).alias("_name"))
    dealt = docs.select("_doc", "_text", "_name", F.pmod(F.xxhash64("_doc"), F.lit(groups)).alias("_group"))
    many = size // GROUP_BYTES  # tasks, where the session has fewer partitions than the texts have groups
    dealt = dealt.repartition(many, "_group") if many > partitions else dealt.repartition("_group")
    sent = dealt.groupBy("_group").applyInArrow(_send_anchors(buckets, length), "_bucket long, _group long, _keys binary, _many binary")
    shared = sent.repartition("_bucket").sortWithinPartitions("_bucket").mapInArrow(_shared_anchors(hot), "_group long, _keys binary, _hot boolean")
    rows = dealt.groupBy("_group").cogroup(shared.groupBy("_group")).applyInArrow(_write_snippets(buckets, length), _OUT)
    rows = written(rows, "snippets")
    contents = rows.filter(F.col("content").isNotNull()).select("anchor", "content", "first", "last")
    runs = contents.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_expand(length), _RUNS)
    runs = written(runs, "runs")
    places = rows.filter(F.col("content").isNull()).select("anchor", "name", "doc", "text", "at")
    hits = places.join(runs, ["anchor", "name"])
    # What runs give is told apart after they are rows: as functions of list items the same would not be compiled.
    hits = hits.select("doc", "text", "at", F.inline("runs")).filter("least < doc")
    span = F.shiftleft((F.col("at") + F.col("start")).cast("long"), 32).bitwiseOR((F.col("at") + F.col("end")).cast("long"))
    ranges = hits.groupBy("doc", "text").agg(F.collect_list(span).alias("_ranges"))
    ranges = written(ranges, "ranges")
    joined = docs.join(ranges, (docs["_doc"] == ranges["doc"]) & (docs["_name"] == ranges["text"]), "left").select("_key", "_text", F.coalesce("_ranges", F.array().cast("array<long>")).alias("_ranges"))
    out = T.StructType([T.StructField("_key", df.schema[key].dataType)]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    out = out.add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long")))
    return joined.mapInArrow(_cut_out, out).withColumnRenamed("_key", key)
