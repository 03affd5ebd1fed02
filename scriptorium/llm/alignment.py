"""Operator 11: alignment of two tokenizers' tokens by products of incidence matrices.

Both tokenizers cut the same bytes. A token-byte incidence matrix has a row for each token and a column for each byte; A·Bᵀ counts the bytes that
a token of A and one of B share, so its entries are the overlap links. Bytes where tokens of both end cut the tokens into groups; the product of
the token-group incidence matrices has an entry for each pair that shares a group. Matrices are compressed by rows (row starts, columns,
values) and made here; products go row by row as Gustavson's: every entry of a row of the left one brings a scaled row of the right one, and equal
columns are added up. Where groups are large, equal ids of a group are one row with their number as value, so the product is over
distinct ids. Rows are multiplied in blocks of about `BLOCK` terms, so memory does not depend on a text's length but for its tokens.

1. One pass over the texts: tokens, groups and links, whose id pairs are packed and written with each document; every task also counts the documents
   of each pair and passes on sums.
2. The sums of all tasks give each pair's documents, and the highest count of each id of A.
3. The pairs of most documents (at most `HEAD`) are looked up in the worker, all others joined by a shuffle on the pair.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, written
from .tokens import _SIGNS, ChunkTokenizer, grouped

#: Terms of a product that are held at once.
BLOCK = 1 << 20
#: Pairs that workers look up: 13 bytes each.
HEAD = 1_000_000
#: Pairs that a task counts before it passes their sums on.
COUNTED = 1 << 21
#: Segments up to that length are worked out together, and the first `KEPT` of them kept by a worker (some 400 bytes each).
SHORT_CHARS = 64
KEPT = 300_000
_SPACE = "▁"


class Csr(NamedTuple):
    """A matrix compressed by rows."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray


def incidence(columns: np.ndarray, values: np.ndarray | None = None) -> Csr:
    """One entry in each row: in that column."""
    return Csr(np.arange(len(columns) + 1), columns, np.ones(len(columns), dtype=np.int64) if values is None else values)


def ranges(lengths: np.ndarray) -> Csr:
    """Each row has as many entries as its length, in the columns after those of the row before."""
    starts = np.concatenate(([0], np.cumsum(lengths)))
    return Csr(starts, np.arange(starts[-1]), np.ones(starts[-1], dtype=np.int64))


def transposed(m: Csr, n_columns: int) -> Csr:
    """By counting the entries of each column; within a column rows stay in their order."""
    rows = np.repeat(np.arange(len(m.starts) - 1), np.diff(m.starts))
    order = slice(None) if (np.diff(m.columns) >= 0).all() else np.argsort(m.columns, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(m.columns, minlength=n_columns))))
    return Csr(starts, rows[order], m.values[order])


def product(a: Csr, b: Csr, n_columns: int) -> Csr:
    """a·b, whose columns are in order within a row."""
    width = np.diff(b.starts)[a.columns]
    total, n = int(width.sum()), len(a.starts) - 1
    rows = np.repeat(np.repeat(np.arange(n), np.diff(a.starts)), width)
    at = np.arange(total) + np.repeat(b.starts[a.columns] - np.cumsum(width) + width, width)
    place, value = rows * n_columns + b.columns[at], np.repeat(a.values, width) * b.values[at]
    if total and not (np.diff(place) >= 0).all():
        order = np.argsort(place, kind="stable")
        place, value = place[order], value[order]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    place = place[first]
    value = np.add.reduceat(value, first) if total else value
    return Csr(np.searchsorted(place, np.arange(n + 1) * n_columns), place % n_columns, value)


def _blocks(cost: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose costs add up to about `most`, a row of more alone."""
    upto, lo = np.cumsum(cost), 0
    while lo < len(cost):
        hi = max(lo + 1, int(np.searchsorted(upto, most + (upto[lo - 1] if lo else 0), side="right")))
        yield lo, hi
        lo = hi


def overlap_links(a_bytes: np.ndarray, b_bytes: np.ndarray, most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lengths of both sides' tokens → (tokens of A, of B, bytes they share), a block of tokens of A after another."""
    a_ends, b_ends = np.cumsum(a_bytes), np.cumsum(b_bytes)
    for lo, hi in _blocks(a_bytes, most):
        left, right = int(a_ends[lo] - a_bytes[lo]), int(a_ends[hi - 1])
        i, j = int(np.searchsorted(b_ends, left, side="right")), int(np.searchsorted(b_ends, right))
        inside = np.minimum(b_ends[i : j + 1], right) - np.maximum(b_ends[i : j + 1] - b_bytes[i : j + 1], left)
        links = product(ranges(a_bytes[lo:hi]), transposed(ranges(inside), right - left), len(inside))
        yield lo + np.repeat(np.arange(hi - lo), np.diff(links.starts)), i + links.columns, links.values


def groups_of(a_bytes: np.ndarray, b_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of either side."""
    a_ends, b_ends = np.cumsum(a_bytes), np.cumsum(b_bytes)
    out = []
    for own, other in ((a_ends, b_ends), (b_ends, a_ends)):
        closes = other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own
        out.append(np.cumsum(closes) - closes)
    return out[0], out[1]


def _distinct(ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) in order, and how often each occurs."""
    place, n = np.unique(group.astype(np.int64) << 16 | ids, return_counts=True)
    return place & 0xFFFF, place >> 16, n


def pair_links(a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, most: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids (that of A in the upper 16 bits) that share a group, in order, and the links of each."""
    n = int(a_group[-1]) + 1
    a_n = b_n = None
    if int((np.bincount(a_group) * np.bincount(b_group)).sum()) > 8 * (len(a_ids) + len(b_ids)):
        (a_ids, a_group, a_n), (b_ids, b_group, b_n) = _distinct(a_ids, a_group), _distinct(b_ids, b_group)
    right = transposed(incidence(b_group, b_n), n)
    pairs, times = [], []
    for lo, hi in _blocks(np.diff(right.starts)[a_group], most):
        links = product(incidence(a_group[lo:hi], None if a_n is None else a_n[lo:hi]), right, len(b_ids))
        own = np.repeat(a_ids[lo:hi].astype(np.int64), np.diff(links.starts)) << 16 | b_ids[links.columns]
        pairs.append(own), times.append(links.values)
    return summed(np.concatenate(pairs), np.concatenate(times))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else order
    return keys[first], np.add.reduceat(values, first) if len(first) else values


# ---------------------------------------------------------------- tokens


#: Fixed value: the pre-tokenizer's pattern of the byte-level vocabulary.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN_SEGMENT = re.compile(f"[\n{re.escape(''.join(_SIGNS))}]*").fullmatch


class _Made:
    """Computed anew each time: what is worth keeping are whole segments."""

    def __init__(self, make):
        self.make = make

    def __getitem__(self, k):
        return self.make(k)


class ByteSide(ChunkTokenizer):
    """Side A: ids by a byte-level file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path, "byte")
        self.library.encode_special_tokens = True
        self.special, self.cut = {}, None
        self.ids, self.spaced_ids, self.piece_ids = _Made(self._chunk_ids), _Made(lambda c: self._chunk_ids(" " + c)), _Made(self._piece_ids)
        byte = {x: b for b, x in self.letters.items()}
        names = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.bytes = [bytes(byte.get(x, 63) for x in names.get(i, "")) for i in range(max(names) + 1)]
        self.code = None
        if self.encode_piece:  # ids are ranks; characters of plain text have the same classes for both libraries
            import tiktoken

            ranks = {self.bytes[i]: i for i in names if i not in self.library.get_added_tokens_decoder()}
            self.code = tiktoken.Encoding("segments", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def tokens(self, segments: list[str]) -> list[bytes]:
        plain, code = _PLAIN_SEGMENT, self.code
        if code is None:
            return list(map(self.encode, segments))
        return [array("H", code(s)).tobytes() if plain(s) else self.encode(s) for s in segments]


class PieceSide:
    """Side B: ids by a sentencepiece model, which puts a space before the text. Where it merges pairs, and no piece has a space or a line's end behind another
    character, no merge crosses from a character to a space or line's end after it: `cuts`."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.space = pieces.index(_SPACE) if _SPACE in pieces else -1
        self.cuts = self.space >= 0 and self._plain_pairs() and not any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces)

    def _plain_pairs(self) -> bool:
        """Whether the model merges pairs, does not change the text, and puts a space before it."""
        try:
            from sentencepiece import sentencepiece_model_pb2 as model
        except ImportError:  # without protobuf
            return False
        m = model.ModelProto()
        m.ParseFromString(self.library.serialized_model_proto())
        n, t = m.normalizer_spec, m.trainer_spec
        special = any(p.type == p.USER_DEFINED for p in m.pieces)
        return t.model_type == t.BPE and not special and not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces

    def tokens(self, segments: list[str]) -> list[bytes]:
        """Ids of segments, each of which begins with a space or a line's end. The library's own space is the segment's, or goes."""
        found = self.library.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        out = []
        for s, ids in zip(segments, found, strict=True):
            if s == " ":
                ids = [self.space]
            elif s[0] != " ":
                if ids[0] != self.space:
                    raise ValueError("a line's end was merged with a space")
                ids = ids[1:]
            out.append(array("H", ids).tobytes())
        return out


#: From a space or a line's end behind another character to the next such place.
_SEGMENT = re.compile(r"[ \n](?:[^ \n]+|(?<=\s)[ \n])*")


class Aligned(NamedTuple):
    """A segment: six numbers (tokens of A and B, groups, links, overlaps, pairs of ids) as bytes, its groups as text, its pairs of ids as bytes and,
    if not one each, their links."""

    numbers: bytes
    groups: str
    pairs: bytes
    times: np.ndarray | None


#: A segment that the tokens of a side do not give back.
_BAD = Aligned(b"", "", b"", None)


class Aligner:
    """Tokens of both sides. Neither side's tokens cross the borders of segments, so the matrices of a text are made of blocks, one for each
    segment. Short segments that a worker meets first are one matrix of their blocks; it keeps the first `KEPT` of them."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = ByteSide(a), PieceSide(b)
        self.sizes = [np.array([len(x) for x in side.bytes], dtype=np.int64) for side in (self.a, self.b)]
        most = max(map(len, self.sizes))
        self.names = [f"{i}{sign}" for i in range(most) for sign in ",|;"]
        self.kept: dict[str, Aligned] = {}

    def segments(self, text: str | None) -> list[str] | None:
        """None: no tokens."""
        if not text or _SPACE in text:  # that character's token is a space, so the bytes differ
            return None
        return _SEGMENT.findall(" " + text) if self.b.cuts else [" " + text]

    def _same(self, ids: list[bytes], segments: list[str], side: int) -> list[bool]:
        names = (self.a, self.b)[side].bytes

        def joined(x: bytes) -> bytes:
            return b"".join(map(names.__getitem__, np.frombuffer(x, "<u2").tolist()))

        flat = b"".join(ids)
        sizes = np.add.reduceat(self.sizes[side][np.frombuffer(flat, "<u2")], np.cumsum([0, *map(len, ids[:-1])]) // 2) if all(ids) else None
        want = [s.encode() for s in segments]
        if sizes is not None and sizes.tolist() == list(map(len, want)) and joined(flat) == b"".join(want):
            return [True] * len(ids)
        return [joined(x) == w for x, w in zip(ids, want, strict=True)]

    def tokens(self, segments: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both sides, as unsigned 16-bit integers; None where they do not give the segment back."""
        if not segments:
            return []
        a, b = self.a.tokens(segments), self.b.tokens(segments)
        good = [x and y for x, y in zip(self._same(a, segments, 0), self._same(b, segments, 1), strict=True)]
        return [(x, y) if ok else None for x, y, ok in zip(a, b, good, strict=True)]

    def _alone(self, segment: str) -> Aligned:
        found = self.tokens([segment])[0]
        if found is None:
            return _BAD
        ids = [np.frombuffer(x, "<u2") for x in found]
        x, y = self.sizes[0][ids[0]], self.sizes[1][ids[1]]
        gx, gy = groups_of(x, y)
        pairs, times = pair_links(*ids, gx, gy)
        overlaps = sum(len(c) for _, c, _ in overlap_links(x, y))
        numbers = np.array([len(x), len(y), gx[-1] + 1, times.sum(), overlaps, len(pairs)], dtype=np.int64)
        return Aligned(numbers.tobytes(), "".join(self.written(*ids, gx, gy))[:-1], pairs.astype("<u4").tobytes(), times)

    def _together(self, segments: list[str]) -> dict[str, Aligned]:
        """Short segments: their matrices are blocks of one."""
        found = dict(zip(segments, self.tokens(segments), strict=True))
        out = {s: _BAD for s, f in found.items() if f is None}
        good = [s for s in segments if found[s] is not None]
        if not good:
            return out
        ids, n = [], []
        for side in range(2):
            own = [found[s][side] for s in good]
            ids.append(np.frombuffer(b"".join(own), "<u2"))
            n.append(np.array(list(map(len, own))) // 2)
        x, y = self.sizes[0][ids[0]], self.sizes[1][ids[1]]
        gx, gy = groups_of(x, y)
        last = [np.cumsum(c) for c in n]
        whose = np.repeat(np.arange(len(good)), n[0])
        overlaps = np.zeros(len(good), dtype=np.int64)
        for rows, _, _ in overlap_links(x, y):
            overlaps += np.bincount(whose[rows], minlength=len(good))
        right = transposed(incidence(gy), int(gx[-1]) + 1)
        links, pairs = np.zeros(len(good), dtype=np.int64), []
        for lo, hi in _blocks(np.diff(right.starts)[gx], BLOCK):
            made = product(incidence(gx[lo:hi]), right, len(gy))
            width = np.diff(made.starts)
            links += np.bincount(whose[lo:hi], width, minlength=len(good)).astype(np.int64)
            pairs.append((np.repeat(ids[0][lo:hi].astype(np.uint32), width) << 16) | ids[1][made.columns])
        packed = np.concatenate(pairs).astype("<u4").tobytes()
        ends = gx[last[0] - 1] + 1
        numbers = np.stack([*n, np.diff(ends, prepend=0), links, overlaps, links], axis=1).astype(np.int64).tobytes()
        names, at, first = self.written(*ids, gx, gy), 0, 0
        for k, (s, hi, end) in enumerate(zip(good, (last[0] + last[1]).tolist(), (4 * np.cumsum(links)).tolist(), strict=True)):
            out[s] = Aligned(numbers[48 * k : 48 * k + 48], "".join(names[at:hi])[:-1], packed[first:end], None)
            at, first = hi, end
        return out

    def _new(self, segments: set[str]) -> tuple[dict[str, Aligned], set[str]]:
        """What is not kept of segments, and which of them have counts of links."""
        kept = self.kept
        new = [s for s in segments if s not in kept]
        long_ = {s for s in new if len(s) > SHORT_CHARS}
        out = self._together([s for s in new if s not in long_] if long_ else new)
        for s in long_:
            out[s] = self._alone(s)
        for s in new:
            if len(kept) >= KEPT:
                break
            if s not in long_:
                kept[s] = out[s]
        return out, long_

    def texts(self, texts: list[str | None]) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray] | None]:
        """Each text's tokens of A and B, groups, links and overlaps, its groups as text, and its pairs of ids in order with the links of each."""
        cut = [self.segments(t) for t in texts]
        new, long_ = self._new(set().union(*filter(None, cut)))
        kept = self.kept
        for segments in cut:
            if segments is None:
                yield None
                continue
            counts = Counter(segments)
            own = {s: kept.get(s) or new[s] for s in counts}
            parts = own.values()
            packed = b"".join([p.numbers for p in parts])
            if len(packed) < 48 * len(own):
                yield None
                continue
            numbers = np.frombuffer(packed, dtype=np.int64).reshape(-1, 6)
            n = np.array(list(counts.values()))
            pairs = np.frombuffer(b"".join([p.pairs for p in parts]), "<u4")
            times = np.repeat(n, numbers[:, 5])
            if long_ and not long_.isdisjoint(counts):
                times = times * np.concatenate([np.ones(len(p.pairs) // 4, np.int64) if p.times is None else p.times for p in parts])
            yield (n @ numbers[:, :5]).tolist(), ";".join([own[s].groups for s in segments]), *summed(pairs, times)

    def written(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> list[str]:
        """Ids with the sign after each, group by group."""
        codes = []
        for ids, group, sign in ((a, a_group, 1), (b, b_group, 2)):
            last = np.diff(group, append=group[-1] + 1) > 0
            codes.append(ids.astype(np.int64) * 3 + last * sign)
        order = np.argsort(np.concatenate((a_group * 2, b_group * 2 + 1)), kind="stable")
        return list(map(self.names.__getitem__, np.concatenate(codes)[order].tolist()))


def aligner(a: str, b: str) -> Aligner:
    """One for each Python worker."""
    return held(("aligner", a, b), lambda: Aligner(a, b))


# ---------------------------------------------------------------- documents


_DOC = ("_n_a", "_n_b", "_n_groups", "_n_links", "_n_overlaps")


def _aligned(a: str, b: str):
    """Rows of documents, with the pairs of ids and their links as arrays of bytes, and rows of pairs with the documents that have them."""
    names = ["_rid", "_key", *_DOC, "_groups", "_pairs", "_times", "_pair", "_docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, key_type = aligner(a, b), None
        counted = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        open_: list[np.ndarray] = []
        size = 0

        def count() -> None:
            keys = np.concatenate([counted[0], *open_])
            n = np.concatenate([counted[1], np.ones(len(keys) - len(counted[1]), np.int64)])
            counted[:] = summed(keys, n)
            open_.clear()

        def sums_of() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(counted[0]), 100_000):
                pair, n = (x[k : k + 100_000] for x in counted)
                empty = [pa.nulls(len(pair), t) for t in (pa.int64(), key_type, *[pa.int64()] * len(_DOC), pa.string(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*empty, pa.array(pair), pa.array(n)], names=names)
            counted[:] = np.zeros(0, np.int64), np.zeros(0, np.int64)

        types = [*[pa.int64()] * len(_DOC), pa.string(), pa.binary(), pa.binary()]
        for batch in batches:
            key_type, k = batch.column(1).type, 0
            for texts in grouped([t or "" for t in batch.column(2).to_pylist()]):
                rows = []
                for found in both.texts(texts):
                    if found is None:
                        rows.append((0, 0, 0, 0, 0, "", b"", b""))
                        continue
                    sums, groups, pairs, times = found
                    rows.append((*sums, groups, pairs.tobytes(), times.astype("<u8").tobytes()))
                    open_.append(pairs)
                    size += len(pairs)
                    if size > COUNTED:
                        count()
                        size = 0
                m = len(rows)
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, m), batch.column(1).slice(k, m), *made, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names)
                k += m
                if len(counted[0]) > COUNTED:
                    yield from sums_of()
        if open_:
            count()
        if len(counted[0]):
            yield from sums_of()

    return run


def alignments(df: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Not written: rows of documents (_rid, _key, counts, _groups as text, packed pairs) and, where _rid is null, of pairs (_pair, _docs), a pair once for
    each task that has it, or more often."""
    rows = df.select(F.monotonically_increasing_id().alias("_rid"), F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    long_ = [T.StructField(c, T.LongType()) for c in _DOC]
    more = [T.StructField("_groups", T.StringType()), T.StructField("_pairs", T.BinaryType()), T.StructField("_times", T.BinaryType())]
    schema = T.StructType([T.StructField("_rid", T.LongType()), T.StructField("_key", df.schema[key].dataType), *long_, *more, T.StructField("_pair", T.LongType()), T.StructField("_docs", T.LongType())])
    return rows.mapInArrow(_aligned(a, b), schema)


def token_groups(df: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and groups of every document: `a1,a2|b1;a3|b2,b3`, decimal ids of A and B in order; empty without tokens."""
    return alignments(df, a, b, key, text).filter(F.col("_rid").isNotNull()).select(F.col("_key").alias(key), F.col("_groups").alias("groups"))


def link_counts(rows: DataFrame) -> DataFrame:
    """Rows of alignments → (_pair, _docs, _best): documents of each pair of ids, and whether no pair of its id of A has more. Written.

    The window holds one id of A: not more rows than B has ids."""
    counts = rows.filter(F.col("_pair").isNotNull()).groupBy("_pair").agg(F.sum("_docs").alias("_docs"))
    most = F.max("_docs").over(Window.partitionBy(F.shiftright("_pair", 16)))
    return written(counts.select("_pair", "_docs", (F.col("_docs") == most).alias("_best")), "links")


def head_of(links: DataFrame, most: int = HEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of most documents: those from the least power of two that leaves at most `most`; sorted, with their documents and whether best."""
    level = F.floor(F.log2("_docs"))
    sizes = {r[0]: r[1] for r in links.groupBy(level.alias("b")).count().collect()}  # 63 rows at most
    least, total = 64, 0
    for b in sorted(sizes, reverse=True):
        total += sizes[b]
        if total > most:
            break
        least = b
    rows = links.filter(level >= least).select("_pair", "_docs", "_best").toArrow()  # at most `most` rows
    pair, docs, best = (rows.column(k).to_numpy() for k in range(3))
    order = np.argsort(pair)
    return pair[order].astype(np.uint32), docs[order], best[order]


def _counted(head):
    """Documents with what the head's pairs give, and the other pairs of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, docs, best = head.value
        if not len(pair):
            pair, docs, best = np.array([-1 & 0xFFFFFFFF], np.uint32), np.zeros(1, np.int64), np.zeros(1, bool)  # no pair: ids of A are below 0xFFFF
        for b in batches:
            fixed, rid = b.columns[:-2], b.column(0)
            names = [*b.schema.names[:-2], "_n_best", "_count_sum", "_pair", "_times"]
            for k in range(0, b.num_rows, 512):
                packed = [[x or b"" for x in c.slice(k, 512).to_pylist()] for c in b.columns[-2:]]
                n = np.array([len(x) // 4 for x in packed[0]])
                own, times = np.frombuffer(b"".join(packed[0]), "<u4"), np.frombuffer(b"".join(packed[1]), "<u8").astype(np.int64)
                whose = np.repeat(np.arange(len(n)), n)
                at = np.minimum(np.searchsorted(pair, own), len(pair) - 1)
                hit = pair[at] == own
                sums = [np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)]
                for out, v in zip(sums, (best[at] * times, docs[at] * times), strict=True):
                    np.add.at(out, whose[hit], v[hit])
                m = len(n)
                yield pa.RecordBatch.from_arrays([*[c.slice(k, m) for c in fixed], *map(pa.array, sums), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names)
                rare = np.flatnonzero(~hit)
                for lo in range(0, len(rare), 100_000):
                    r = rare[lo : lo + 100_000]
                    none = [pa.nulls(len(r), c.type) for c in (*fixed[1:], pa.nulls(0, pa.int64()), pa.nulls(0, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([rid.take(pa.array(k + whose[r])), *none, pa.array(own[r].astype(np.int64)), pa.array(times[r])], names=names)

    return run


def align(df: DataFrame, a: str, b: str, head: int = HEAD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps (pairs of tokens that share a byte).

    a: a byte-level tokenizers file, b: a sentencepiece model. A text that is null or empty, or that either side's tokens do not give back byte for
    byte (as with U+2581), has no tokens: zeros and an empty digest. Rows that repeat a key or a text are documents of their own. Texts of any
    length are aligned whole, one at a time. An empty table gives an empty result; other columns are ignored."""
    rows = alignments(df, a, b, key, text)
    digest = F.when(F.col("_groups") != "", F.sha2("_groups", 256)).otherwise(F.col("_groups"))
    rows = written(rows.withColumn("_sha", digest).drop("_groups"), "alignments")
    links = link_counts(rows)
    table = df.sparkSession.sparkContext.broadcast(head_of(links, head))
    fixed = ["_rid", "_key", *_DOC, "_sha"]
    docs = rows.filter(F.col("_rid").isNotNull()).select(*fixed, "_pairs", "_times")
    schema = T.StructType([*docs.select(*fixed).schema.fields, *[T.StructField(c, T.LongType()) for c in ("_n_best", "_count_sum", "_pair", "_times")]])
    docs = written(docs.mapInArrow(_counted(table), schema), "counted")
    rare = docs.filter(F.col("_pair").isNotNull()).select("_rid", "_pair", "_times").join(links, "_pair")
    rare = rare.groupBy("_rid").agg(F.sum(F.when(F.col("_best"), F.col("_times")).otherwise(0)).alias("_more_best"), F.sum(F.col("_times") * F.col("_docs")).alias("_more_sum"))
    docs = docs.filter(F.col("_pair").isNull()).join(rare, "_rid", "left")
    plus = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
    return docs.select(
        F.col("_key").alias(key), *[F.col(c).alias(c[1:]) for c in _DOC[:4]], plus("_n_best", "_more_best").alias("n_best"),
        plus("_count_sum", "_more_sum").alias("count_sum"), F.col("_sha").alias("groups_sha256"), F.col("_n_overlaps").alias("n_overlaps"),
    )
