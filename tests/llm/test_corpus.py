"""The corpus operators on a small corpus of awkward documents, against plain versions by brute force, SQL, round trips and accuracy."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from scriptorium.llm import ans, common, exact_dedup, lang_id, mixing, packing, quality, queries, sharding, simhash, suffix_dedup, token_counts, tokens

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
#: Names that clash with columns the operators make for themselves.
CLASHING = ("_key", "_text", "_row", "shard", "slot", "target", "size", "_h", "kept", "component_id", "_fp", "start", "_source")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])


def corpus():
    rng = random.Random(5)
    words = ["the", "und", "maison", "perro", "shiny", "öl", "word,", "Über", "naïve", "x1", "it's", "end."]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long_ = body(9000)
    passage = body(40)
    texts = [None, "", " ", "a", "a", "short text", long_, long_, body(60), body(60) + "\n" + passage, passage + " " + body(30), passage,
             "日本語のテキスト " * 20, "<|endoftext|> in text", "tab\tand  two spaces\n\nlines\r\n", "###", "ß" * 70, "ß" * 70 + "!", "0" * 300, "12 34 ²"]
    near = body(400).split()
    for k in range(4):
        texts.append(" ".join([*near[:200], f"edit{k}", *near[201:]]))
    texts += [body(rng.randrange(1, 120)) for _ in range(40)]
    ids = [*range(10, 10 + len(texts))]
    rng.shuffle(ids)
    sources = ["s1", "s2", None, "s3", "s1", "s1"]
    return [(i, t, ["en", "de", None][k % 3], sources[k % 6], None if t is None else len(t), *["c"] * len(CLASHING)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null keys, repeated keys with other texts, and repeated rows."""
    c = ["c"] * len(CLASHING)
    rows = [(None, "none", "en", "s1", 4, *c), (None, "none", "en", None, 4, *c), (7, "one text of a key", "de", "s1", 1, *c), (7, "another text of it", "de", "s1", 1, *c), (7, "another text of it", "de", "s1", 1, *c), (8, None, None, None, None, *c)]
    return spark.createDataFrame(rows, SCHEMA)


def text_of(t):
    return t or ""


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


BYTE, WORDS = ("byte_bpe_50k.json", "word_bpe_49k.json")


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


# ---------------------------------------------------------------- 1


def removed_by_force(rows):
    seen, out = {}, []
    for i, t in rows:
        b = text_of(t).encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            seen[w] = min(seen.get(w, i), i)
    for i, t in rows:
        b = text_of(t).encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if b else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_dedup(docs, hot):
    got = rows_of(suffix_dedup.repeated_strings(docs, hot=hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == removed_by_force([r[:2] for r in ROWS])


def test_suffix_dedup_odd(odd, empty):
    assert suffix_dedup.repeated_strings(odd).count() == 6 and suffix_dedup.repeated_strings(empty).count() == 0


def test_suffix_dedup_is_hot_by_contents_not_groups(spark):
    rng = random.Random(3)
    body = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, body(60) + "a frequent string of more than twenty bytes " + body(60)) for i in range(60)]
    rows += [(60 + i, rows[i][1][30:120] + body(30)) for i in range(30)]
    sent = []
    for g in (0, 1):
        mine = [r for r in rows if r[0] % 2 == g]
        group = pa.table({"_group": pa.array([g] * len(mine), pa.int64()), "_doc": pa.array([i for i, _ in mine], pa.int64()), "_text": [t for _, t in mine]})
        sent.append(suffix_dedup._send_anchors(1)(group))
    hot = [h for b in suffix_dedup._shared_anchors(30)(iter(pa.concat_tables(sent).to_batches())) for h in b.column("_hot").to_pylist()]
    assert any(hot)  # two groups alone
    assert not any(h for b in suffix_dedup._shared_anchors(200)(iter(pa.concat_tables(sent).to_batches())) for h in b.column("_hot").to_pylist())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(suffix_dedup.repeated_strings(df, hot=30), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == removed_by_force(rows)


@pytest.mark.parametrize("common", [30_000, 10_000])
def test_suffix_dedup_around_one_frequent_string(spark, common):
    """All the contents around the string are more symbols than a suffix array has room for; a half of them repeat bytes beside it."""
    rng = random.Random(11)
    body = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    middle = "zyxwvutsrqzyxwvutsrqzyxw"
    rows = [(i, body(30) + middle + body(30)) for i in range(common // 2)]
    rows += [(common + i, body(20) + t[8:70] + body(3)) for i, t in rows]  # the string with 22 and 16 bytes beside it: over 50 in common
    rows += [(10**6 + i, body(84)) for i in range(30_000 - common)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = rows_of(suffix_dedup.repeated_strings(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = removed_by_force(rows)
    assert got == want and sum(r[2] > 0 for r in want) == common // 2


def test_suffix_dedup_with_small_groups(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 3000)
    got = rows_of(suffix_dedup.repeated_strings(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == removed_by_force([r[:2] for r in ROWS])


def test_suffix_array_is_not_for_more_symbols_than_fit():
    place = np.zeros(1 << 21, dtype=np.int64)
    with pytest.raises(ValueError, match="2097152 symbols"):
        suffix_dedup.suffix_array(place, place)


def test_equal_windows_are_those_of_a_plain_sort():
    rng = random.Random(2)
    contents = list({bytes(rng.choice(b"ab") for _ in range(rng.randrange(8, 40))) for _ in range(60)} | {b"\0" * 20, b"aaaaaaaaaaaaaaaa"})
    at, which = suffix_dedup.equal_windows(contents, 8)
    whole = b"\0".join(contents) + b"\0"
    names = {}
    for p, k in zip(at.tolist(), which.tolist(), strict=True):
        assert names.setdefault(k, whole[p : p + 8]) == whole[p : p + 8]
    assert len(set(names.values())) == len(names)
    assert len(at) == sum(len(c) - 7 for c in contents)


# ---------------------------------------------------------------- 2


def base_by_force(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", text_of(t))
    lines = [x for x in text_of(t).split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 500 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text_of(t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, odd, empty):
    labels = spark.createDataFrame([(r[0], int(k % 2 == 0), 0) for k, r in enumerate(ROWS)] + [(None, 1, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels, buckets=500).collect()}
    for i, t, *_ in ROWS:
        r = got[i]
        base = base_by_force(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base, t
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
    # the score, by another way
    h = lambda w, seed=42: np.int64(np.uint64(xxhash.xxh64_intdigest(w.encode(), seed)))

    def grams(t):
        w = [int(h(x)) for x in re.findall(r"[^\x20\x09-\x0D]+", text_of(t))]
        two = [spark_hash(a, b) for a, b in zip(w, w[1:], strict=False)]
        return [x % 500 for x in w] + [x % 500 for x in two]

    def spark_hash(a, b):  # as Spark chains: the first hash seeds the second
        s = xxhash.xxh64_intdigest(int(a).to_bytes(8, "little", signed=True), 42)
        return int(np.int64(np.uint64(xxhash.xxh64_intdigest(int(b).to_bytes(8, "little", signed=True), s))))

    good, raw = np.zeros(500), np.zeros(500)
    for k, (_, t, *_) in enumerate(ROWS):
        for g in grams(t):
            raw[g] += 1
            good[g] += k % 2 == 0
    prior = quality.SMOOTHING * good.sum() / 500
    weights = np.log((good + prior) / (raw * good.sum() / raw.sum() + prior))
    for i, t, *_ in ROWS:
        g = grams(t)
        want = weights[g].mean() if g else 0.0
        assert got[i].score == pytest.approx(want, abs=1e-9)
        assert got[i].kept == (not got[i].base_failed and got[i].score >= quality.THRESHOLD)
    assert quality.quality_rules(odd, labels).count() == 6 and quality.quality_rules(empty, labels).count() == 0
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**6))  # verdicts do not hang on the corpus's size
    both = labels.unionByName(labels.withColumn("doc_id", F.col("doc_id") + 10**6)).unionByName(spark.createDataFrame([(ROWS[0][0], None, None)], labels.schema))
    again = {r.doc_id: r.score for r in quality.quality_rules(twice, both, buckets=500).collect()}
    assert all(again[i] == pytest.approx(again[i + 10**6]) == pytest.approx(got[i].score, abs=1e-9) for i in got)
    unlabelled = quality.quality_rules(docs, labels.limit(0)).collect()
    assert all(r.score == 0 for r in unlabelled)


# ---------------------------------------------------------------- 3


def components_by_force(rows):
    prints = []
    for _, t in rows:
        w = text_of(t).encode().lower().split()
        shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes)))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return sorted([(rows[k][0], f"{prints[k]:016x}", least[root[k]]) for k in range(len(rows))], key=repr)


def test_simhash(docs, odd, empty):
    got = rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    assert got == components_by_force([r[:2] for r in ROWS])
    assert simhash.near_duplicates(odd).count() == 6 and simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each(docs).columns == docs.columns
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == {c for _, _, c in got}


def test_one_of_each_keeps_a_row_of_every_component(spark, odd):
    near = [w for w in "a text of many words that two rows have in common but for one of them " * 20][:-1]
    c = ["c"] * len(CLASHING)
    more = [(None, "other words and no key", "en", "s1", 1, *c), (5, "".join(near), "en", "s1", 1, *c), (6, "".join(near), "en", "s2", 1, *c), (6, "words of its own under key six", "en", "s2", 1, *c), (None, "".join(near), "en", "s3", 1, *c)]
    df = odd.unionByName(spark.createDataFrame(more, SCHEMA))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    parts = {}
    numbered = components_by_force([(k, t) for k, (_, t) in enumerate(rows)])
    for k, _, c in numbered:
        parts.setdefault(c, []).append(rows[k])
    assert len(parts) == 7
    got = [(r.doc_id, r.text) for r in simhash.one_of_each(df).collect()]
    assert len(got) == len(parts)
    for some in parts.values():
        least = min((i for i, _ in some if i is not None), default=None)
        assert sum(g in some and g[0] == least for g in got) == 1


def test_ball_hashing_finds_all_classes_and_no_other_pair(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for b in base for n in (0, 2, 4, 5, 7)]
    fps = np.unique(np.array(fps, dtype=np.uint64))
    want = {(int(a), int(b)) for a in fps for b in fps if a < b and int(a ^ b).bit_count() <= 4}

    def classes(pairs):
        label = {int(f): int(f) for f in fps}
        for a, b in pairs:
            x, y = label[a], label[b]
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
        return label

    for prefix in (16, 21):
        masks = np.concatenate(simhash.flips(0, prefix, 2))
        bucket = ((fps >> np.uint64(64 - prefix))[:, None] ^ masks[None, :]).ravel()
        for held in (10**9, 200_000, 1500):
            monkeypatch.setattr(simhash, "HELD", held)
            left, right = simhash.colliding(np.repeat(fps, len(masks)), bucket, prefix)
            pairs = {(int(x), int(y)) if x < y else (int(y), int(x)) for x, y in zip(left, right, strict=True)}
            assert classes(pairs) == classes(want) and (pairs <= want or held == 1500)  # which gives forests in place of pairs


def test_one_large_bucket_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(0, 1 << 48, 20_000, dtype=np.uint64))
    fps = np.unique(np.r_[fps, fps[:50] ^ np.uint64(0b10011)])
    tracemalloc.start()
    left, right = simhash.colliding(fps, np.zeros(len(fps), dtype=np.uint64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(left) >= 50 and (np.bitwise_count(left ^ right) <= 4).all() and peak < 300_000_000


def test_prefixes_grow_with_the_fingerprints():
    sizes = [10, 10**6, 10**9, 5 * 10**10]
    bits = [simhash.prefix_bits(n) for n in sizes]
    assert bits[0] == 16 and bits == sorted(bits)
    assert all(n * (1 + p + p * (p - 1) // 2) / 2**p <= 1 << 20 for n, p in zip(sizes, bits, strict=True))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 200), (150, 200), (7, 7)], "a long, b long")
    got = dict(map(tuple, simhash.components(links).collect()))
    assert all(got[k] == 0 for k in range(1, 61)) and got[150] == got[200] == 100


# ---------------------------------------------------------------- 4


def test_sharding(docs, odd, empty):
    got = {r.doc_id: r for r in sharding.assign_shards(docs, [1.0] * 40).collect()}
    for i, t, *_ in ROWS:
        assert (got[i].size, got[i].text_crc32) == (len(text_of(t).encode()) + 16, zlib.crc32(text_of(t).encode()))
        assert got[i].grown_shard in (got[i].shard, 40) and 0 <= got[i].shard < 40
    by = {}
    for r in got.values():
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    grown = {r.doc_id: r.shard for r in sharding.assign_shards(docs, [1.0] * 41).collect()}
    assert all(grown[i] == got[i].grown_shard for i in got)
    rows = sharding.assign_shards(odd, [1.0] * 3).collect()
    assert len(rows) == 6 and len({(r.shard, r.slot) for r in rows}) == 6
    assert sharding.assign_shards(empty, [1.0]).count() == 0


def test_sharding_follows_weights(spark):
    keys = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = dict(map(tuple, sharding.assign_shards(keys, [1.0, 3.0]).groupBy("shard").count().collect()))
    assert 0.7 < n[1] / 4000 < 0.8


# ---------------------------------------------------------------- 5, 6, 8


def test_tokens_are_the_librarys():
    rng = random.Random(1)
    letters = "aAbé ß\t\n  .,'sS!?12<|>#ÀΣσ́  \x1c\x1f\x85中文字あ한ǅİſﬁ🙂‍'’-_²½\xad"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + [f"{a}<|endoftext|>{a}" for a in ("", "x", " y ", "<|startoftext|>")]
    for name, kind in ((BYTE, "byte"), (WORDS, "word")):
        lib, own = library(name), tokens.ChunkTokenizer(P.path(name), kind)
        for t, got in zip(texts, own.encoded(texts), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("head", [300_000, 3])
def test_token_counts(docs, odd, empty, head):
    lib = library(BYTE)
    want = sorted([(i, len(text_of(t).encode()), n := len(lib.encode(text_of(t), add_special_tokens=False).ids), n > 1024) for i, t, *_ in ROWS], key=repr)
    assert rows_of(token_counts.token_counts(docs, P.path(BYTE), head=head), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(odd, P.path(BYTE)).count() == 6 and token_counts.token_counts(empty, P.path(BYTE)).count() == 0


def pieces_by_force(rows):
    lib, at, out = library(WORDS), 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids, s = [*lib.encode(text_of(t), add_special_tokens=False).ids, 1], 0
        while s < len(ids):
            n = min(len(ids) - s, 2048 - (at + s) % 2048)
            out.append((i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()), len(ids), (at + s) // 2048, (at + s) % 2048))
            s += n
        at += len(ids)
    return sorted(out, key=repr)


def test_packing(docs, odd, empty):
    got = rows_of(packing.pack(docs, P.path(WORDS)), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    assert got == pieces_by_force([r[:2] for r in ROWS])
    assert packing.pack(odd, P.path(WORDS)).count() == 6 and packing.pack(empty, P.path(WORDS)).count() == 0


def test_coded_round_trip(docs, odd, empty):
    lib, at, want = library(BYTE), 0, []
    for i, t, *_ in sorted(ROWS):
        ids = [*lib.encode(text_of(t), add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for block in (ans.BLOCK, 700):  # small blocks: documents over many of them
        read = ans.read_documents(*ans.encode_documents(docs, P.path(BYTE), block=block))
        assert rows_of(read, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert ans.coded_round_trip(odd, P.path(BYTE)).count() == 6 and ans.coded_round_trip(empty, P.path(BYTE)).count() == 0


def test_coder_and_checksums():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 5000), 50_000).astype(np.uint16)
    coder = ans.Coder(ans.scaled(np.bincount(ids, minlength=1 << 16)))
    for n in (1, 5, 1024, 1025, 5000):
        assert (coder.decode(*coder.encode(ids[:n]), n) == ids[:n]).all()
    a, b = rng.bytes(1000), rng.bytes(12345)
    assert ans.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert ans.scaled(np.array([1] * 100 + [10**12])).sum() == 1 << ans.SCALE


# ---------------------------------------------------------------- 7


def test_exact_dedup(docs, odd, empty):
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(text_of(t), []).append(i)
    want = sorted([(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g], key=repr)
    for size in (exact_dedup.BLOCK_BYTES, 64):  # small blocks: many rounds of naming
        assert rows_of(exact_dedup.exact_dedup(docs, block_bytes=size), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    out = exact_dedup.exact_dedup(odd).collect()
    assert len(out) == 6 and sum(r.kept for r in out) == 4 and exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.deduplicated(odd).count() == 4


# ---------------------------------------------------------------- 9


def test_language_id(spark, odd, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    out = lang_id.identify(table, sample=40).join(table.select("doc_id", "lang", "text"), "doc_id").collect()
    test = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    assert sum(r.lang_pred == r.lang for r in test) / len(test) > 0.97
    extra = [(1_000_000 + k, t, None, "s", 1, *["c"] * len(CLASHING)) for k, t in enumerate([None, "", "123 !?", "日本語のテキスト"])]
    both = spark.createDataFrame([(*r[:5], *["c"] * len(CLASHING)) for r in map(tuple, table.select("doc_id", "text", "lang", "source", "n_chars").collect())] + extra, SCHEMA)
    got = {r.doc_id - 1_000_000: (r.lang_pred, r.score) for r in lang_id.identify(both, sample=40).collect() if r.doc_id >= 1_000_000}
    assert [got[k] for k in range(3)] == [("und", 0.0)] * 3 and got[3][0] != "und"
    assert lang_id.identify(odd).count() == 6 and lang_id.identify(empty).count() == 0
    kept = lang_id.accepted(both, sample=40)
    bits = {r.doc_id: r.bits for r in lang_id.identify(both, sample=40).collect()}
    assert kept.columns == both.columns and bits[1_000_003] > 8  # no language of the sample has such letters
    assert {r.doc_id for r in kept.collect()} == {i for i, b in bits.items() if b is not None and b <= 8}
    assert sum(i < 1_000_000 for i in bits) - kept.count() == table.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).count()
    assert lang_id.accepted(odd).columns == odd.columns and lang_id.accepted(odd).filter("text is null").count() == 0 and lang_id.accepted(empty).count() == 0


def bits_by_force(counts, lang, text):
    """Code length by the definition: probabilities of all 256 bytes under each context, from the counts."""
    tables = {}
    for r in counts[counts["lang"] == lang].itertuples():
        context = (r.gram >> 8).to_bytes(r.ord, "big") if r.ord else b""
        tables.setdefault(context, np.zeros(256))[r.gram & 255] += r.n

    def share(context):
        below = share(context[1:]) if context else np.full(256, 1 / 256)
        if context not in tables:
            return below
        n = tables[context]
        left = np.where(n > 0, 0, below)
        escape = (n > 0).sum() if left.sum() > 0 else 0
        return n / (n.sum() + escape) + (escape / (n.sum() + escape) * left / left.sum() if escape else 0)

    data = b"   " + text
    return -sum(np.log2(share(data[k : k + 3])[data[k + 3]]) for k in range(len(text)))


def test_code_lengths_are_exact(spark, monkeypatch):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    counts = lang_id.fit(table, sample=10)
    model = lang_id.Model(counts)
    texts = [r.text.encode()[:200] for r in table.filter("text is not null").limit(6).collect()] + ["日本".encode(), b"a", b"zqx!" * 9]
    want = np.array([[bits_by_force(counts, lang, t) for lang in model.langs] for t in texts])
    assert np.allclose(lang_id.Scorer(model).code_lengths(texts), want, rtol=1e-5)
    monkeypatch.setattr(lang_id, "HELD", 64)  # small pieces
    small = lang_id.Scorer(model)
    small.power, small.most = 4, 37  # and many strings in a place
    for _ in range(3):
        assert np.allclose(small.code_lengths(texts), want, rtol=1e-5)


def test_sample_of_languages_is_bounded(spark):
    rows = [(k, f"text number {k} of a language", f"l{k % 7}", "s", 1) for k in range(700)] + [(9999, "x" * 5000, "l0", "s", 1)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counts = lang_id.fit(df, sample=5, languages=3)
    assert len(counts["lang"].unique()) == 3
    letters = lambda **bounds: lang_id.fit(df, sample=5, **bounds)[lambda c: c["ord"] == 0].groupby("lang")["n"].sum().drop("l0")
    assert all(letters() <= 5 * 40) and all(letters(sample_bytes=1) <= 40)  # one text


def test_frozen_model_is_a_distribution(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    counts = lang_id.fit(table, sample=20)
    contexts = np.r_[counts[counts["ord"] == 3]["gram"].to_numpy()[::50] >> 8, np.arange(0, 1 << 24, 999_983)].astype(np.uint32)
    grams = (contexts[:, None] << np.uint32(8) | np.arange(256, dtype=np.uint32)).ravel()
    p = np.exp2(-lang_id.Model(counts).gram_bits(grams).astype(float)).reshape(len(contexts), 256, -1)
    assert np.allclose(p.sum(1), 1, atol=1e-4)


# ---------------------------------------------------------------- 10


def test_water_filling(spark):
    sizes = spark.createDataFrame([("=a", 100), ("=b", 100), ("=c", 10), ("", 1)], "_s string, source_size long")
    got = {r[0]: r[2] for r in mixing.water_fill(sizes).collect()}
    # a: 5, b: 2, c: 1, null: 5; caps 300, 300, 30, 3
    assert got[""] == 3 and got["=a"] == pytest.approx(208 * 5 / 8) and got["=b"] == pytest.approx(208 * 2 / 8) and got["=c"] == pytest.approx(26)


def test_mixing(docs, odd, empty):
    out = mixing.mix(docs).join(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("src")), "doc_id").collect()
    by = {}
    for r in out:
        assert r.taken <= 3 * r["size"]
        by.setdefault(r.src, []).append(r)
    for rs in by.values():
        assert sum(r["size"] for r in rs) == rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 0.5
    assert rows_of(mixing.mix(docs), "doc_id", "taken") == rows_of(mixing.mix(docs.repartition(5)), "doc_id", "taken")
    assert mixing.mix(odd).count() == 6 and mixing.mix(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    words = {r.doc_id: r.n for r in mixed.filter("text is not null").groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    assert mixed.columns == docs.columns and {i: n for i, n in words.items() if n} == {r.doc_id: r.taken for r in out if r.taken}


# ---------------------------------------------------------------- queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    result = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    rounded = lambda v: round(v, 8) if isinstance(v, float) else v
    mine = sorted(repr([rounded(r[c]) for c in names]) for r in df.collect())
    assert mine == sorted(repr([rounded(v) for v in r]) for r in result.fetchall())


def test_queries_read_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, run in queries.QUERIES.items():
        df = run(spark, SF)
        assert df.select("doc_id").distinct().count() == n, name


def mixed_by_force(rows):
    """rows(doc_id, text, source) → the (doc_id, text) of all repetitions."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", text_of(t))
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    size = {s: sum(len(words(t)) for _, t, o in rows if o == s) for s in sources}
    target, left, free = {}, sum(size.values()), set(sources)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        target |= {s: 3 * size[s] for s in over} if over else {s: level * weight[s] for s in free}
        left -= sum(3 * size[s] for s in over)
        free = free - over if over else set()
    out = []
    for s in sources:
        whole = int(target[s] // size[s]) if size[s] else 0
        rest = int(target[s] - whole * size[s] + 0.5)
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(f"mix/{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0], len(words(r[1])))):
            n = len(words(t))
            out += [(i, t)] * whole
            part = max(0, min(n, rest))
            rest -= n
            if part:
                out.append((i, t if part == n else "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t)[:part])))
    return out


def test_mixed_documents(docs, odd, empty):
    got = sorted(map(tuple, mixing.mixed_documents(docs).select("doc_id", "text").collect()), key=repr)
    assert got == sorted(mixed_by_force([(r[0], r[1], r[3]) for r in ROWS]), key=repr)
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert sorted(map(tuple, mixing.mixed_documents(odd).select("doc_id", "text").collect()), key=repr) == sorted(mixed_by_force(rows), key=repr)
    assert mixing.mixed_documents(empty).count() == 0 and mixing.mixed_documents(odd).columns == odd.columns


def pipeline_by_force(rows, known):
    """rows(doc_id, text, source), known: the texts that the language stage lets pass → the pieces of the pipeline."""
    rows = [r for r in rows if r[1] in known]
    last = {}
    for r in rows:
        key = (r[0] is not None, r[0] or 0)
        if r[1] not in last or key > (last[r[1]][0] is not None, last[r[1]][0] or 0):
            last[r[1]] = r
    rows = list(last.values())
    groups = {}
    for (k, _, c), r in zip(sorted(components_by_force([(k, r[1]) for k, r in enumerate(rows)]), key=lambda x: x[0]), rows, strict=True):
        groups.setdefault(c, []).append(r)
    rows = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
    signed = lambda t: int(np.int64(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42))))
    lib, at, out = library(WORDS), 0, []
    for i, t in sorted(mixed_by_force(rows), key=lambda r: (r[0] is not None, r[0], signed(r[1]))):
        ids, s = [*lib.encode(t, add_special_tokens=False).ids, 1], 0
        while s < len(ids):
            n = min(len(ids) - s, 2048 - (at + s) % 2048)
            out.append((i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()), len(ids), (at + s) // 2048, (at + s) % 2048))
            s += n
        at += len(ids)
    return sorted(out, key=repr)


def ppm(texts):
    """Counts of the bytes behind each context of up to three bytes, and the bits of a text by them, from the definition."""
    tables = {}
    for t in texts:
        data = b"   " + t
        for k in range(3, len(data)):
            for n in range(4):
                follow = tables.setdefault(data[k - n : k], {})
                follow[data[k]] = follow.get(data[k], 0) + 1
    tables = {c: f for c, f in tables.items() if len(c) < 3 or sum(f.values()) >= 3}
    memo = {}

    def share(context):
        if context not in memo:
            below = share(context[1:]) if context else np.full(256, 1 / 256)
            if context not in tables:
                return below
            n = np.zeros(256)
            for b, m in tables[context].items():
                n[b] = m
            left = np.where(n > 0, 0, below)
            escape = (n > 0).sum() if left.sum() > 1e-9 else 0
            memo[context] = n / (n.sum() + escape) + (escape / (n.sum() + escape) * left / left.sum() if escape else 0)
        return memo[context]

    known = {}

    def bits(t):
        data, out = b"   " + t, 0.0
        for k in range(3, len(data)):
            four = data[k - 3 : k + 1]
            if four not in known:
                known[four] = -np.log2(share(four[:3])[four[3]])
            out += known[four]
        return out

    return bits


def in_language_by_force(df):
    """The texts that are in one language, by plain models of the operator's sample."""
    sample = [(r["_lang"], r["_h"], r["_text"].encode(), r["k"]) for r in lang_id.sampled(df).withColumn("k", F.pmod(F.xxhash64("_h"), F.lit(2))).collect()]
    langs = sorted({x[0] for x in sample})
    models = {k: {g: ppm([t for h, _, t, f in sample if h == g and k in (2, f)]) for g in langs} for k in (0, 1, 2)}
    letter = lambda t: re.search(r"[^\W\d_]", t)
    limit = {}
    for g in langs:
        own = [min(m(t) for m in models[1 - f].values()) / len(t) for h, _, t, f in sample if h == g and letter(t.decode())]
        middle, tail = np.percentile(own, 50), np.percentile(own, 99.5)
        limit[g] = min(8, max(1.4 * middle, min(1.6 * middle, tail)))
    kept = set()
    for (t,) in df.select("text").distinct().collect():
        if not t or not letter(t):
            continue
        data = t.encode()
        bits = {g: m(data) for g, m in models[2].items()}
        best = min(langs, key=lambda g: (bits[g], g))
        share = 1 / sum(2 ** -min(1000, (b - bits[best]) * min(20, len(data)) / len(data)) for b in bits.values())
        if share >= 0.5 and bits[best] - limit[best] * len(data) <= 40:
            kept.add(t)
    return kept


def test_texts_in_no_language_go(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(3)
    texts = {r.lang: r.text for r in table.filter("char_length(text) BETWEEN 1500 AND 4000 AND NOT text RLIKE '[0-9#*%$!]'").orderBy("doc_id").collect()}
    half = lambda t: t[:700]
    bad = ["".join(rng.choice("qxzjkvwQXZJKVW0123456789") for _ in range(400)), "日本語のテキストを書きます。" * 20, "Быстрая лиса прыгает через собаку " * 10, "жук" * 30,
           half(texts["en"]) + " " + half(texts["fr"]), half(texts["de"]) + " " + half(texts["es"]) + " " + half(texts["en"]), "a1B2" * 90, "123 !?", "", None]
    rows = spark.createDataFrame([(1_000_000 + k, t, None) for k, t in enumerate(bad)], table.schema)
    kept = {r.doc_id for r in lang_id.in_language(table.unionByName(rows)).select("doc_id").collect()}
    assert not any(i >= 1_000_000 for i in kept)
    labelled = [r.doc_id for r in table.filter("lang IS NOT NULL AND text RLIKE '[A-Za-z]'").collect()]
    assert sum(i in kept for i in labelled) >= 0.99 * len(labelled)
    clean = [r.doc_id for r in table.filter("char_length(text) > 20 AND NOT text RLIKE '[0-9#*%$!|]'").collect()]
    assert len(clean) > 300 and sum(i in kept for i in clean) >= 0.998 * len(clean)  # a text of two languages is among them
    assert lang_id.in_language(table.limit(0)).count() == 0 and lang_id.in_language(table.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_mixes_of_repeated_keys_agree(spark):
    texts = [(7, " ".join(f"w{k}{j}" for j in range(10)), "s") for k in range(8)] + [(8, "x " * 30, None)]
    got = set()
    for seed, parts in ((1, 1), (2, 3), (3, 5)):
        rows = texts[:]
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        got.add(tuple(sorted(r.text for r in mixing.mixed_documents(df).collect())))
    assert len(got) == 1


PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def test_pipeline(spark):
    """Against plain versions of its stages on the same rows."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in table.collect()]
    known = in_language_by_force(table)
    assert 0 < len({t for _, t, _ in rows} - known) < 0.01 * len(rows) + 2
    got = corpus_pipeline.run(spark, SF)
    assert rows_of(got, *PIECE) == pipeline_by_force(rows, known)


def test_pipeline_on_odd_tables(spark, docs, odd, empty, tmp_path):
    """Null and repeated keys, null and empty texts, repeated rows, clashing names, and no rows at all; each stage written and read again."""
    for name, df in (("odd", odd.filter("doc_id IS NOT NULL OR source IS NOT NULL").unionByName(docs)), ("empty", empty)):
        (tmp_path / name).mkdir()
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        now = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        rows = [(r.doc_id, r.text, r.source) for r in now.collect()]
        known = {r.text for r in lang_id.in_language(now).select("text").collect()}
        assert name == "empty" or len(known) > 20
        for stage, run in corpus_pipeline.STAGES:
            out = run(spark, now, str(tmp_path / name))
            assert stage == "pack" or out.columns == df.columns
            out.write.parquet(str(tmp_path / name / stage))
            now = spark.read.parquet(str(tmp_path / name / stage))
        assert rows_of(now, *PIECE) == pipeline_by_force(rows, known)


def test_written_tables_are_dropped_on_demand(spark, docs, monkeypatch):
    import os

    common.drop_written(spark)
    exact_dedup.exact_dedup(docs).count()
    paths = [p.removeprefix("file://") for p in common._WRITTEN]
    assert paths and all(os.path.isdir(p) for p in paths)
    assert common.drop_written(spark) == len(paths) and not any(os.path.isdir(p) for p in paths)


def test_no_shared_folder_on_a_cluster_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_path(Session(), "x")
