"""Operator 2: quality rules from hashed n-gram log-likelihood ratios.

Words and pairs of adjacent words of a text are hashed into `BUCKETS` buckets. Counts over the trusted documents (label
quality = 1) and over all documents give two smoothed multinomials; a document's score is the mean over its n-grams of
the log of their ratio. A document stays if it passes the base rules and its score is at least the threshold: no random
draw, so every document gets the same verdict in every run.

All of it is built-in functions. Counting sums by bucket before it shuffles, so it moves `BUCKETS` rows per task; the
weights are one array of `BUCKETS` numbers whatever the corpus. Scoring and the base rules work within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, written

BUCKETS = 10_000
#: At most so many trusted documents (those with the least MD5 of their key) fit the trusted multinomial. Their keys are
#: broadcast: 8 bytes each. The raw multinomial is over all documents.
TRUSTED = 20_000
#: Counts that smooth each bucket, in parts of the trusted side's mean count of a bucket: so verdicts do not hang on the corpus's size, but
#: for chance. With less than some 20 trusted n-grams a bucket chance tells: clean documents then score down to -0.1.
SMOOTHING = 1.0
#: Mean log ratio per n-gram from which on a document stays.
THRESHOLD = -0.035
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _named(value: Column, body) -> Column:
    """body(value) with the value computed once. A column that is used within a lambda function would be computed for every
    element if the optimizer copied its expression there, as it does when it moves a filter."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words, in order; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(words, lambda w: F.xxhash64(w)))


def n_of(body: Column, characters: str) -> Column:
    """How many of a text's characters are among some ASCII ones. A plain search for each is far faster than translate()."""
    return sum((F.octet_length(body) - F.octet_length(F.replace(body, F.lit(c), F.lit(""))) for c in characters), F.lit(0))


def bucket_of(word: Column, following: Column | None = None, buckets: int = BUCKETS) -> Column:
    """Bucket of a word, or of a word with its successor, from their hashes."""
    return F.pmod(word if following is None else F.xxhash64(word, following), F.lit(buckets)).cast("int")


def ngram_buckets(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of each word, and of each word with its successor."""
    one = F.transform(hashes, lambda w: bucket_of(w, buckets=buckets))
    two = F.transform(hashes, lambda w, i: bucket_of(w, F.get(hashes, i + 1), buckets))
    return F.concat(one, F.slice(two, 1, F.greatest(F.size(hashes) - 1, F.lit(0))))


def window_hashes(hashes: Column) -> Column:
    """64-bit hashes of all 3-word windows."""
    found = F.transform(hashes, lambda w, i: F.xxhash64(w, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    return F.slice(found, 1, F.greatest(F.size(hashes) - 2, F.lit(0)))


def repeated_words(hashes: Column) -> Column:
    """Number of words that lie in a window whose hash is found twice or more."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(found: Column) -> Column:
        twice = F.filter(found, lambda x, i: (x["h"] == F.get(found, i - 1)["h"]) | (x["h"] == F.get(found, i + 1)["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(repeated, _named(placed, covered)).otherwise(0).cast("long")


def fit_weights(df: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: int = TRUSTED, smoothing: float = SMOOTHING,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: _weights, an array of log(trusted share / raw share) by bucket. Both are smoothed by `smoothing` mean counts of a bucket, so
    that buckets with few counts weigh little. Without any trusted document it is all zero."""
    ids = labels.filter(F.col("quality") == 1).select(F.col(key).alias("_id")).distinct()
    ids = ids.orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(trusted).withColumn("_t", F.lit(1))
    rows = df.select(F.col(key).alias("_id"), word_hashes(F.col(text)).alias("_w")).join(F.broadcast(ids), "_id", "left")
    rows = rows.select("_t", F.explode(_named(F.col("_w"), lambda w: ngram_buckets(w, buckets))).alias("_b"))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_raw"), F.count("_t").alias("_good"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("_b")).join(counts, "_b", "left")
    counts = every.select("_b", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("_raw", "_good")])
    packed = counts.agg(F.array_sort(F.collect_list(F.struct("_b", "_raw", "_good"))).alias("_c"))  # `buckets` entries
    packed = packed.select("_c", *[F.aggregate(F.col("_c")[c], F.lit(0).cast("long"), lambda a, x: a + x).alias(f"_n{c}") for c in ("_raw", "_good")])
    prior = F.col("_n_good") * smoothing / buckets
    expected = lambda x: x["_raw"] * F.col("_n_good") / F.col("_n_raw")
    ratio = lambda x: F.log((x["_good"] + prior) / (expected(x) + prior))
    return packed.select(F.transform("_c", lambda x: F.when(F.col("_n_good") > 0, ratio(x)).otherwise(0.0)).alias("_weights"))


def quality_rules(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, trusted: int = TRUSTED,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    A null or empty text has no words, fails the base rules and scores 0. Repeated rows are judged one by one. Label rows
    of null or unknown keys, and repeated ones, change nothing. An empty table gives an empty result; other columns are
    ignored. score: mean log ratio of the text's n-grams."""
    weights = written(fit_weights(df, labels, buckets, trusted, SMOOTHING, key, text), "weights").scalar()
    body = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")

    def judged(w: Column) -> Column:
        """Of word hashes: n, repeated words, n-grams and the sum of their weights."""
        total = lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get("_weights", x))
        score = _named(ngram_buckets(w, buckets), lambda b: F.struct(F.size(b).alias("n"), total(b).alias("total")))
        return F.struct(F.size(w).cast("long").alias("words"), _named(window_hashes(w), repeated_words).alias("repeated"), score.alias("score"))

    rows = df.select(F.col(key), F.col(text).alias("_text")).withColumn("_weights", weights)
    rows = rows.withColumn("_m", _named(word_hashes(F.col("_text")), judged))
    rows = rows.select(
        key,
        F.col("_m.words").alias("n_words"),
        (F.char_length(body) - n_of(body, _SPACES)).cast("long").alias("word_chars"),
        n_of(body, _SYMBOLS).cast("long").alias("n_symbols"),
        _named(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.col("_m.repeated").alias("n_repeat_words"),
        F.when(F.col("_m.score.n") > 0, F.col("_m.score.total") / F.col("_m.score.n")).otherwise(0.0).alias("score"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score",
    )
