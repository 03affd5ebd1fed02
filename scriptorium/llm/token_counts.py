"""Operator 5: token counts from distinct pre-tokens, without ids.

1. Occurrences of every pre-token over the corpus, summed in each batch before the shuffle.
2. The lexicon: pieces of each distinct pre-token, counted once, written to the shared folder.
3. Documents are read again as pre-token frequencies and joined to the lexicon. The most frequent pre-tokens (at most
   `HEAD`, none longer than `HEAD_CHARS`) are a bounded broadcast that workers look up; all others are joined by a shuffle
   on the pre-token. Both parts are summed by document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .tokens import CACHED, Memo, chunk_tokenizer, grouped

#: Bounds of the broadcast: entries, and characters of each (thus 300,000 x 64 bytes at most).
HEAD = 300_000
HEAD_CHARS = 16
LIMIT = 1024


def _occurrences(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["_pre", "_n"])

        tok, counts = chunk_tokenizer(path, "byte"), Counter()
        pieces = {False: Memo(tok.pieces), True: Memo(lambda c: tok.pieces(" " + c))}
        for b in batches:
            for group in grouped(b.column(0).to_pylist()):
                seen = {False: Counter(), True: Counter()}
                for text in group:
                    for space, words in tok.chunks(text):
                        seen[space].update(words)
                for space, chunks in seen.items():
                    for c, n in chunks.items():
                        for p in pieces[space][c]:
                            counts[p] += n
                if len(counts) > CACHED:
                    yield flush(counts)
                    counts = Counter()
        if counts:
            yield flush(counts)

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = chunk_tokenizer(path, "byte").library
        for b in batches:
            found = library.encode_batch_fast(b.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(e.ids) for e in found], pa.int64())], names=["_pre", "_n", "_pieces"])

    return run


def lexicon(texts: DataFrame, path: str) -> DataFrame:
    """texts(_text) → (_pre, _n, _pieces): each distinct pre-token, its occurrences and its pieces."""
    counts = texts.mapInArrow(_occurrences(path), "_pre string, _n long").groupBy("_pre").agg(F.sum("_n").alias("_n"))
    return written(counts.mapInArrow(_pieces(path), "_pre string, _n long, _pieces long"), "lexicon")


def head_of(words: DataFrame, most: int = HEAD) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens: those above the least power of two of occurrences that leaves at most `most`."""
    short = words.filter(F.char_length("_pre") <= HEAD_CHARS)
    sizes = {r[0]: r[1] for r in short.groupBy(F.floor(F.log2("_n")).alias("b")).count().collect()}  # 63 rows at most
    least, total = 64, 0
    for b in sorted(sizes, reverse=True):
        total += sizes[b]
        if total > most:
            break
        least = b
    rows = short.filter(F.floor(F.log2("_n")) >= least).select("_pre", "_pieces").toArrow()  # at most `most` rows
    return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))


def _frequencies(path: str, head):
    """Rows of documents (_n_bytes, and _n: pieces of its frequent pre-tokens), and of their other pre-tokens (_pre, _n: frequency)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, table = chunk_tokenizer(path, "byte"), head.value

        def counted(chunk: str) -> tuple[int, tuple[str, ...]]:
            parts = tok.pieces(chunk)
            return sum(table.get(p, 0) for p in parts), tuple(p for p in parts if p not in table)

        known = {False: Memo(counted), True: Memo(lambda c: counted(" " + c))}
        for b in batches:
            rid, key = b.column(0), b.column(1)
            for k in range(0, b.num_rows, 512):
                n_bytes, n, where, words, often = [], [], [], [], []
                for i, text in enumerate(b.column(2).slice(k, 512).to_pylist()):
                    sure, rare = 0, Counter()
                    for space, chunks in tok.chunks(text):
                        for m, others in map(known[space].__getitem__, chunks):
                            sure += m
                            if others:
                                rare.update(others)
                    n.append(sure), n_bytes.append(len(text.encode()))
                    where += [k + i] * len(rare)
                    words += rare.keys()
                    often += rare.values()
                m = len(n)
                yield pa.RecordBatch.from_arrays(
                    [rid.slice(k, m), key.slice(k, m), pa.array(n_bytes, pa.int64()), pa.nulls(m, pa.string()), pa.array(n, pa.int64())],
                    names=["_rid", "_key", "_n_bytes", "_pre", "_n"],
                )
                if where:
                    at = pa.array(where, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [rid.take(at), pa.nulls(len(where), key.type), pa.nulls(len(where), pa.int64()), pa.array(words, pa.string()), pa.array(often, pa.int64())],
                        names=["_rid", "_key", "_n_bytes", "_pre", "_n"],
                    )

    return run


def token_counts(df: DataFrame, tokenizer: str, limit: int = LIMIT, head: int = HEAD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_bytes, n_tokens, over_limit.

    A null or empty text has no tokens. Repeated keys and repeated rows are counted one by one. An empty table gives an
    empty result; other columns are ignored."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")
    words = lexicon(df.select(body), tokenizer)
    table = df.sparkSession.sparkContext.broadcast(head_of(words, head))
    schema = T.StructType([T.StructField("_rid", T.LongType()), T.StructField("_key", df.schema[key].dataType), T.StructField("_n_bytes", T.LongType()),
                           T.StructField("_pre", T.StringType()), T.StructField("_n", T.LongType())])
    rows = df.select(F.monotonically_increasing_id().alias("_rid"), F.col(key).alias("_key"), body)
    rows = written(rows.mapInArrow(_frequencies(tokenizer, table), schema), "frequencies")
    rare = rows.filter(F.col("_pre").isNotNull()).select("_rid", "_pre", "_n")
    rare = rare.join(words.select("_pre", "_pieces"), "_pre").groupBy("_rid").agg(F.sum(F.col("_n") * F.col("_pieces")).alias("_more"))
    docs = rows.filter(F.col("_pre").isNull()).join(rare, "_rid", "left")
    n = F.col("_n") + F.coalesce(F.col("_more"), F.lit(0))
    return docs.select(F.col("_key").alias(key), F.col("_n_bytes").alias("n_bytes"), n.alias("n_tokens"), (n > limit).alias("over_limit"))
