"""Operator 9: language identification by prediction by partial matching (PPM) over bytes.

Training: for each language a tree of byte contexts of up to `ORDER` bytes, with the counts of the bytes that follow, from all texts
to learn from (see `fit`). The counts are summed by Spark, brought to those of `SCALE` bytes and frozen. A context gives a byte its
count's share, or an escape (as many as it has distinct followers) to the context one byte shorter, whose probabilities are scaled to
the bytes not seen here; at the bottom all 256 bytes are alike.

Each language's tree is made in a task from its counts, which their scale bounds, and comes to the driver as arrays for the broadcast.

Scoring: the exact code length of the whole text under every language; the shortest wins. With frozen counts a byte's code
length hangs on it and the three bytes before it alone, so a worker works it out once for each such string of four bytes and keeps
it. Trees are sparse: sorted arrays of what was seen, for each language and order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held, written

ORDER = 3
#: A language's counts are those of all its texts, over their bytes and times so many, if it has more: so a tree is as large, and its escapes weigh as
#: much, whatever the corpus. What then comes less than once is left to escapes. Languages are not bounded: a model has some 3 MB for each, 32 MB at most.
SCALE = 1 << 20
#: For fits on a sample, which callers may ask for: the bytes of a language's texts after which no further one is taken.
SAMPLE_BYTES = 1 << 20
#: A context of 3 bytes is kept if it occurs so often in a language's (scaled) counts.
LEAST = 3
#: Strings that a counting task sorts at once, and different ones that it keeps before it gives their counts.
SORTED, KEPT = 1 << 20, 1 << 19
#: Code lengths (a number for each language and string of four bytes) that a worker keeps.
HELD = 1 << 22
#: Texts of a batch that are scored at once, in pieces of an eighth of what is held.
TEXTS = 256
#: Bytes of evidence that a score goes by: so it tells how far apart the languages are, whatever the length of the text.
EVIDENCE = 20
#: Bits a byte of the shortest code above which a text is in no known language: those of the plain bytes.
MOST_BITS = 8.0
#: A text is in a language if its bits a byte are those of the language's own texts: at most the QUANTILE of these, but no less than SPREAD[0] and no more than
#: SPREAD[1] times their median, as few texts tell little of their tail; and if the language has at least the share LEAST_SCORE of the evidence.
QUANTILE, SPREAD, LEAST_SCORE = 0.995, (1.4, 1.6), 0.5
#: Bits beyond the limit, over a whole text, that are let pass: a short text gives no evidence.
SLACK_BITS = 40.0
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}").search
_PAD = b" " * ORDER


def held_out(key: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2 (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def _pieces(text: bytes, most: int) -> Iterator[bytes]:
    """The text in pieces of `most` bytes, each behind the three bytes that go before it."""
    data = _PAD + text
    for k in range(0, len(text), most):
        yield data[k : k + most + ORDER]


def _grams(pieces: list[bytes]) -> np.ndarray:
    """Every byte of the pieces with the three before it, as a number; the byte itself is the lowest."""
    raw = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.uint32)
    ends = np.cumsum([len(p) for p in pieces])
    own = np.ones(len(raw), dtype=bool)
    for k in range(ORDER):  # what a piece has before it is not predicted
        own[np.r_[0, ends[:-1]] + k] = False
    return (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:])[own[3:]]


def _followers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(language, half, four bytes, occurrences) of the texts; a string may come several times."""
    held("strings", lambda: None)  # what an earlier stage left in this worker goes
    waiting: dict[tuple, list[np.ndarray]] = {}
    found: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    size = 0

    def settle() -> None:
        for whose, parts in waiting.items():
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            if whose in found:
                gram, at = np.unique(np.concatenate([found[whose][0], gram]), return_inverse=True)
                n = np.bincount(at, np.concatenate([found[whose][1], n])).astype(np.int64)
            found[whose] = gram, n
        waiting.clear()

    def given() -> Iterator[pd.DataFrame]:
        for (lang, half), (gram, n) in found.items():
            yield pd.DataFrame({"lang": lang, "half": half, "gram": gram.astype(np.int64), "n": n.astype(np.int64)})
        found.clear()

    for b in batches:
        for lang, half, text in zip(b["_lang"], b["_half"], b["_text"], strict=True):
            for piece in _pieces(text.encode(), 1 << 20):
                waiting.setdefault((lang, half), []).append(_grams([piece]))
                size += len(piece)
                if size >= SORTED:
                    settle()
                    size = 0
                    if sum(len(gram) for gram, _ in found.values()) >= KEPT:
                        yield from given()
    settle()
    yield from given()


def sampled(df: DataFrame, sample: int | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang",
            sample_bytes: int = SAMPLE_BYTES, languages: int | None = None) -> DataFrame:
    """(_lang, _h, _text): all texts to learn from, with their hashes. If a `sample` is asked for: at most so many distinct texts of each language,
    or of the `languages` most frequent ones, those with the least hash of id and text; where their bytes reach `sample_bytes`, the text that does
    so is the last. The first texts by hash are looked for among about twice as many, so no task has a language's rows."""
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang"))
    rows = rows.filter(F.col("_lang").isNotNull() & ~held_out(F.col("_key")))
    if sample is None:
        return rows.filter(F.col("_text").isNotNull()).select("_lang", F.xxhash64("_text").alias("_h"), "_text")
    share = F.lit(2.0 * sample + 50) / F.count("*")
    shares = rows.groupBy("_lang").agg(F.count("*").alias("_n"), share.alias("_share"))
    if languages:
        shares = shares.orderBy(F.desc("_n"), "_lang").limit(languages)
    place = F.md5(F.concat_ws("/", F.col("_key").cast("string"), F.xxhash64("_text").cast("string")))
    near = F.conv(F.substring(place, 1, 12), 16, 10).cast("double") < F.col("_share") * F.lit(float(1 << 48))
    rows = rows.filter(F.col("_text").isNotNull()).withColumn("_h", place)
    few = rows.join(F.broadcast(shares), "_lang").filter(near)  # a row for each language
    few = few.groupBy("_lang", "_h").agg(F.max(F.octet_length("_text")).alias("_size"))
    order = Window.partitionBy("_lang").orderBy("_h")
    before = F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = few.withColumns({"_r": F.row_number().over(order), "_before": before}).filter((F.col("_r") <= sample) & (F.col("_before") < sample_bytes))
    return rows.join(F.broadcast(few.select("_lang", "_h")), ["_lang", "_h"], "left_semi").dropDuplicates(["_lang", "_h"])  # `sample` rows a language


def _half() -> Column:
    """Half of the texts, by their hash."""
    return F.pmod(F.xxhash64("_h"), F.lit(2)).cast("int")


def strings(texts: DataFrame) -> DataFrame:
    """(lang, half, gram, n): how often each byte comes behind the three before it, in either half of the texts."""
    rows = texts.select("_lang", _half().alias("_half"), "_text").mapInPandas(_followers, "lang string, half int, gram long, n long")
    return rows.groupBy("lang", "half", "gram").agg(F.sum("n").alias("n"))


def counted(grams: DataFrame) -> DataFrame:
    """The frozen counts of strings(lang, gram, n): lang, ord, gram, n. A language has 2**20 strings of an order at most (see SCALE)."""
    total = grams.groupBy("lang").agg(F.sum("n").alias("_total"))
    orders = F.explode(F.transform(F.sequence(F.lit(0), F.lit(ORDER)), lambda o: F.struct(o.alias("ord"), F.col("gram").bitwiseAND(F.element_at(F.array(*[F.lit((1 << 8 * (k + 1)) - 1) for k in range(ORDER + 1)]), o + 1)).alias("gram"))))
    counts = grams.select("lang", "n", orders.alias("o")).groupBy("lang", "o.ord", "o.gram").agg(F.sum("n").alias("n")).join(F.broadcast(total), "lang")  # a row a language
    counts = counts.select("lang", "ord", "gram", (F.col("n") * F.least(F.lit(1.0), F.lit(float(SCALE)) / F.col("_total"))).alias("n")).filter("n >= 1")
    whole = F.sum("n").over(Window.partitionBy("lang", "ord", F.shiftright("gram", 8)))
    return counts.withColumn("_whole", whole).filter((F.col("ord") < ORDER) | (F.col("_whole") >= LEAST)).drop("_whole")


def fit(df: DataFrame, sample: int | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang",
        sample_bytes: int = SAMPLE_BYTES, languages: int | None = None) -> pd.DataFrame:
    """The counts on the driver, to look at."""
    return counted(strings(sampled(df, sample, key, text, lang, sample_bytes, languages))).toPandas()


class Model:
    """Frozen counts of each language as sorted arrays, and their code lengths (bits)."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        # by language and order: strings, their bits, contexts, bits of their escapes
        self.trees = [self._tree(counts[counts["lang"] == lang]) for lang in self.langs]

    @classmethod
    def _tree(cls, mine: pd.DataFrame) -> list[tuple[np.ndarray, ...]]:
        tree: list[tuple[np.ndarray, ...]] = []
        for order in range(ORDER + 1):
            level = mine[mine["ord"] == order].sort_values("gram")
            gram, n = level["gram"].to_numpy(dtype=np.uint32), level["n"].to_numpy(dtype=np.float64)
            context, own, kinds = np.unique(gram >> np.uint32(8), return_inverse=True, return_counts=True)
            total = np.bincount(own, n, len(context))
            rest = 1 - np.bincount(own, np.exp2(-cls._bits(tree, gram)), len(context))  # what the shorter context leaves to others
            escape = np.where(rest > 1e-9, kinds, 0)
            bits = -np.log2(n / (total + escape)[own])
            escaped = np.log2(np.maximum(rest, 1e-9) * (total + escape) / np.maximum(escape, 1e-9))
            tree.append((gram, bits.astype(np.float32), context, escaped.astype(np.float32)))
        return tree

    @classmethod
    def packed(cls, mine: pd.DataFrame) -> pd.DataFrame:
        """A language's counts → its tree, an array in bytes for each order and kind."""
        rows = [(mine["lang"].iloc[0], order, *[a.tobytes() for a in level]) for order, level in enumerate(cls._tree(mine))]
        return pd.DataFrame(rows, columns=["lang", "ord", "gram", "bits", "context", "escaped"])

    @classmethod
    def trained(cls, counts: DataFrame) -> Model | None:
        """Trees are made by tasks, one for each language, and come to the driver as arrays; None of no counts."""
        rows = counts.groupBy("lang").applyInPandas(lambda mine: cls.packed(mine), "lang string, ord int, gram binary, bits binary, context binary, escaped binary").collect()
        if not rows:
            return None
        model = cls.__new__(cls)
        kinds = (("gram", np.uint32), ("bits", np.float32), ("context", np.uint32), ("escaped", np.float32))
        found = {(r["lang"], r["ord"]): tuple(np.frombuffer(r[c], dtype=t) for c, t in kinds) for r in rows}
        model.langs = sorted({r["lang"] for r in rows})
        model.trees = [[found[lang, order] for order in range(ORDER + 1)] for lang in model.langs]
        return model

    @staticmethod
    def _bits(tree: list[tuple[np.ndarray, ...]], grams: np.ndarray) -> np.ndarray:
        """Code lengths under the longest known contexts of a tree, of any height."""
        bits, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for order in range(len(tree) - 1, -1, -1):
            gram, own, context, escaped = tree[order]
            if not len(gram):
                continue
            g = grams[open_] & np.uint32((1 << 8 * (order + 1)) - 1)
            at = np.minimum(np.searchsorted(gram, g), len(gram) - 1)
            hit = gram[at] == g
            bits[open_[hit]] += own[at[hit]]
            open_, c = open_[~hit], g[~hit] >> np.uint32(8)
            at = np.minimum(np.searchsorted(context, c), len(context) - 1)
            known = context[at] == c
            bits[open_[known]] += escaped[at[known]]
        bits[open_] += 8
        return bits

    def gram_bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of each string of four bytes' last one under each language."""
        return np.stack([self._bits(t, grams) for t in self.trees], axis=1).astype(np.float32)


class Scorer:
    """A model with the code lengths that a worker has met, in one place for each hash: later ones take the places of earlier ones."""

    def __init__(self, model: Model):
        places = max(1 << 10, HELD // len(model.langs))
        self.model, self.most, self.power = model, max(1 << 10, places >> 3), min(20, places.bit_length() - 1)
        self.gram = np.full(1 << self.power, -1, dtype=np.int64)
        self.bits = np.zeros((1 << self.power, len(model.langs)), dtype=np.float32)

    def _place(self, grams: np.ndarray) -> np.ndarray:
        return grams * np.uint32(0x9E3779B1) >> np.uint32(32 - self.power)

    def gram_bits(self, grams: np.ndarray) -> np.ndarray:
        place = self._place(grams)
        new = np.unique(grams[self.gram[place] != grams])
        if not len(new):
            return self.bits[place]
        bits, at = self.model.gram_bits(new), self._place(new)
        self.gram[at] = new
        self.bits[at] = bits[np.searchsorted(new, self.gram[at])]  # where two met in a place, those of the one that has it
        out, lost = self.bits[place], np.flatnonzero(self.gram[place] != grams)
        known = np.searchsorted(new, grams[lost])
        here = new[np.minimum(known, len(new) - 1)] == grams[lost]
        out[lost[here]] = bits[known[here]]
        if not here.all():  # was known until a new one took its place
            out[lost[~here]] = self.model.gram_bits(grams[lost[~here]])
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (not empty) under each language."""
        out = np.zeros((len(texts), len(self.model.langs)))
        whose: list[int] = []
        pieces: list[bytes] = []
        size = 0

        def flush() -> None:
            sizes = np.array([len(p) - ORDER for p in pieces])
            sums = np.add.reduceat(self.gram_bits(_grams(pieces)), np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
            np.add.at(out, whose, sums)

        for i, t in enumerate(texts):
            for p in _pieces(t, self.most):
                if pieces and size + len(p) > self.most:
                    flush()
                    whose, pieces, size = [], [], 0
                whose.append(i), pieces.append(p)
                size += len(p)
        if pieces:
            flush()
        return out


def predictor(model: Model | None, df: DataFrame):
    """A column function: text → struct(lang, score, bits: bits a byte of the shortest code). It is called nondeterministic so that Spark leaves filters on
    its result above it; one that was moved below would score every text again, in a second Python worker beside the first."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    number = uuid.uuid4().hex

    @F.pandas_udf("lang string, score double, bits double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = held(("scorer", number), lambda: Scorer(shared.value) if shared.value else None)
        for s in texts:
            known = [bool(scorer and t and _LETTER(t)) for t in s]
            langs, scores, least = np.full(len(s), UNKNOWN, dtype=object), np.zeros(len(s)), np.full(len(s), np.nan)
            at = np.flatnonzero(known)
            for k in range(0, len(at), TEXTS):
                own = at[k : k + TEXTS]
                data = [s.iloc[i].encode() for i in own]
                size = np.array([len(t) for t in data])
                bits = scorer.code_lengths(data)
                best = bits.argmin(1)
                apart = (bits - bits.min(1)[:, None]) * (np.minimum(size, EVIDENCE) / size)[:, None]
                langs[own] = np.array(scorer.model.langs, dtype=object)[best]
                scores[own] = 1 / np.exp2(-np.minimum(apart, 1000)).sum(1)
                least[own] = bits.min(1) / size
            yield pd.DataFrame({"lang": langs, "score": scores, "bits": least})

    return predict.asNondeterministic()


def identify(df: DataFrame, sample: int | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: key, held_out, lang_pred, score, bits (bits a byte of the shortest code, null for `und`).

    score: the share of the predicted language, among all languages, of the probability of `EVIDENCE` average bytes of the text (of the
    whole text if it is shorter). A text that is null or has no letter is `und` with score 0, and so are all texts where nothing can be
    learned (an empty table, or no language given). Rows that repeat a key are judged one by one; equal code lengths give the first
    language by name. Other columns are ignored."""
    predict = predictor(Model.trained(counted(strings(sampled(df, sample, key, text, lang)))), df)
    rows = df.select(F.col(key), predict(F.col(text)).alias("_p"))
    bits = F.nanvl("_p.bits", F.lit(None).cast("double")).alias("bits")
    return rows.select(key, held_out(F.col(key)).alias("held_out"), F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"), bits)


def accepted(df: DataFrame, sample: int | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", most_bits: float = MOST_BITS) -> DataFrame:
    """The rows of df whose text is in a known language, with the columns of df (of any names): its best language codes it in `most_bits`
    bits a byte or less. Null texts, texts without a letter, and texts of scripts or strings of characters that no language
    has, go. Rows that repeat a key are judged one by one. Where nothing can be learned no text is known: the result is empty."""
    predict = predictor(Model.trained(counted(strings(sampled(df, sample, key, text, lang)))), df)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), predict(F.col(text)).alias("_p"))
    return rows.filter((F.col("_p.lang") != UNKNOWN) & (F.col("_p.bits") <= most_bits)).select("_row.*")


def limits(texts: DataFrame, grams: DataFrame, quantile: float = QUANTILE, spread: tuple[float, float] = SPREAD) -> list[tuple[str, float]]:
    """Texts to learn from and their strings → (language, bits a byte up to which a text is in it), from texts that the model scoring them has not seen:
    each half is scored by a model of the other. Quantiles are those of all texts, in steps of 2**-16 bits, which bounds what a task counts. A language
    that has no such text has the bits of plain bytes. One row for each language comes to the driver."""
    scored = None
    for k in (0, 1):
        model = Model.trained(counted(grams.filter(F.col("half") == k)))
        if model:
            others = texts.filter(_half() != k)
            rows = others.select("_lang", predictor(model, texts)("_text").alias("_p")).select("_lang", "_p.bits").filter("bits IS NOT NULL AND NOT isnan(bits)")
            scored = rows if scored is None else scored.unionByName(rows)
    languages = [r[0] for r in grams.select("lang").distinct().collect()]
    if scored is None:
        return [(language, MOST_BITS) for language in languages]
    steps = scored.select("_lang", (F.round(F.col("bits") * 65536) / 65536).alias("bits"))
    found = {r[0]: r[1] for r in steps.groupBy("_lang").agg(F.percentile("bits", F.array(F.lit(0.5), F.lit(quantile)))).collect()}
    out = []
    for language in languages:
        middle, tail = found.get(language) or (None, None)
        out.append((language, MOST_BITS if middle is None else min(MOST_BITS, max(spread[0] * middle, min(spread[1] * middle, tail)))))
    return out


def in_language(df: DataFrame, sample: int | None = None, slack_bits: float = SLACK_BITS, least_score: float = LEAST_SCORE,
                key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of df whose text is in one language, with the columns of df (of any names): its code takes no more bits a byte than the language's own
    texts do (see `limits`), or no more than `slack_bits` beyond that over the whole text, and the language has `least_score` of the evidence.

    Counts and limits come from all texts to learn from. So strings of random characters, scripts that no language has, and texts of several languages go, and null texts and those without a
    letter. Rows that repeat a key are judged one by one; very long texts as whole ones, in pieces. Where nothing can be learned no text is
    known: the result is empty."""
    texts = sampled(df, sample, key, text, lang)
    grams = written(strings(texts), "strings")
    found = limits(texts, grams)
    # one row for each language, as an Arrow table: rows of Python would be read by workers of their own
    of = df.sparkSession.createDataFrame(pa.table({"_lang": pa.array([x for x, _ in found], pa.string()), "_limit": pa.array([x for _, x in found], pa.float64())}))
    predict = predictor(Model.trained(counted(grams)), df)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.octet_length(F.col(text).cast("string")).alias("_n"), predict(F.col(text)).alias("_p"))
    rows = rows.filter((F.col("_p.lang") != UNKNOWN) & (F.col("_p.score") >= least_score)).withColumn("_lang", F.col("_p.lang")).join(F.broadcast(of), "_lang")
    return rows.filter((F.col("_p.bits") - F.col("_limit")) * F.col("_n") <= slack_bits).select("_row.*")
