"""Fill-in-middle, captures and alignments, against plain versions by brute force, SQL, the libraries and round trips."""

import gzip
import hashlib
import random
import re
from base64 import b32encode
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm import alignment, common, fill_middle, queries, warc

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
CLASHING = ("_key", "_text", "_row", "_cut", "_n", "form", "n", "output", "_rid", "payload", "kind", "_pair", "_digest")


def schema(key, *columns):
    return T.StructType([T.StructField(key, T.LongType()), *[T.StructField(c, T.StringType()) for c in (*columns, *CLASHING)]])


def table(spark, key, columns, rows):
    c = ["c"] * len(CLASHING)
    return spark.createDataFrame([(*r, *c) for r in rows], schema(key, *columns))


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns or df.columns).collect()), key=repr)


def against_sql(spark, name, **tables):
    """Whether a query equals its SQL on the smallest tables and, if given, on these."""
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df, *names) == sorted(found.fetchall(), key=repr)


def awkward():
    rng = random.Random(4)
    words = ["the", "und", "maison", "shiny", "öl", "word,", "naïve", "x1", "it's", "日本", "é", "🙂"]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", " ", "a", "ab", "has <P> in it", "<S", "<", "M><M", "P>", body(9000), body(60), body(60), "日本語のテキスト " * 20, "<|endoftext|> in text",
             "</s> <s> <0x41>", "tab\tand  two spaces\n\nlines\r\n", "###", "ß" * 70, "0" * 300, "12 34 ²", "trailing ", "  leading", "has ▁ in it", "é ﬁ \x00\x01"]
    texts += [body(rng.randrange(1, 90)) for _ in range(40)]
    return list(enumerate(texts, 5))


ROWS = awkward()
ODD = [(None, "no key"), (None, "no key"), (7, "one text of a key"), (7, "another text"), (7, "another text"), (8, None), (9, "")]


# ---------------------------------------------------------------- 13


def cut_by_force(rows):
    out = []
    for i, t in rows:
        t = t or ""
        d = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
        n = len(t)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = t[:a], t[a:b], t[b:]
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            out.append((i, n, "plain", None, None, t))
        elif h4 % 100 < 20:
            out.append((i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"))
        else:
            out.append((i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))
    return sorted(out, key=repr)


def test_fill_in_middle(spark):
    many = ROWS + ODD + [(i, f"text {i} <" + "x" * (i % 7)) for i in range(100, 300)]
    df = table(spark, "doc_id", ["text"], many).repartition(3)
    got = fill_middle.fill_in_middle(df)
    assert rows_of(got) == cut_by_force(many)
    assert {r.form for r in got.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    back = got.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")))
    assert rows_of(back) == sorted(((i, t or "") for i, t in many), key=repr)
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_fill_in_middle_equals_sql(spark):
    against_sql(spark, "op13_fill_middle")


@pytest.mark.parametrize("n", [0, 1, 2, 7, 9, 63, 64, 65, 1000, 70_000])
def test_descents_reach_every_rank(n):
    rng = np.random.default_rng(n)
    widths = rng.integers(1, 9, n)
    units, before = fill_middle.SkipList(widths), np.r_[0, np.cumsum(widths)]
    ranks = range(n + 1) if n <= 1000 else [0, 1, n, n - 1, *map(int, rng.integers(0, n, 500))]
    assert all(units.offset(r) == before[r] for r in ranks)
    assert n < 1000 or len(units.lanes) > 3 and all(len(a[0]) > len(b[0]) for a, b in zip(units.lanes, units.lanes[1:]))


def test_other_units_and_a_very_long_text(spark):
    text = "one two  three\nfour"
    assert fill_middle.unit_widths(text, r"\S+\s*").tolist() == [4, 5, 6, 4] and fill_middle.unit_widths("--a--", "a").tolist() == [3, 2]
    df = table(spark, "doc_id", ["text"], [(1, "wörd  " * 3_500_000), (2, text), (3, "   ")])
    got = {r.doc_id: r for r in fill_middle.fill_in_middle(df, plain_percent=0, unit=r"\S+\s*").collect()}
    assert got[1].n == 3_500_000 and got[1].prefix_chars % 6 == got[1].middle_chars % 6 == 0 and got[3].n == 1
    again = {r.doc_id: r for r in fill_middle.fill_in_middle(df).collect()}
    assert again[1].n == 21_000_000 and again[1].output == next(o for i, *_, o in cut_by_force([(1, "wörd  " * 3_500_000)]))


# ---------------------------------------------------------------- 12


def digest(body):
    return b32encode(hashlib.sha1(body).digest()).decode()


def archived_by_force(rows):
    """rows(page_id, body) → page_id, payload_bytes, payload_digest, record_type, refers_to."""
    out = []
    for body in {b for _, b in rows}:
        ids = sorted((i for i, b in rows if b == body), key=lambda i: (i is not None, i or 0))
        out += [(i, len(body), digest(body), "revisit", ids[-1]) for i in ids[:-1]] + [(ids[-1], len(body), digest(body), "response", None)]
    return sorted(out, key=repr)


#: Payloads that hold separators, end in parts of one, or look like records.
BODIES = [None, "", "\r\n", "\r\n\r\n", "a\r\n", "a\r\n\r\n", "a\r", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nx", "a\r\n\r\r\n\r\nb\r\n\r\n\r\n", "ü" * 900, "\x00\x01", "\n\n"]
PAGES = [(i, f"https://{h}.example.org/p/{i % 5}?q=1#f", BODIES[i % 12] if i % 3 else f"<p>{i % 7}</p>") for i, h in enumerate(["www", "a.b", "M"] * 40)]
ODD_PAGES = [(None, None, "x"), (None, "http://h:8080", "x"), (500, "no url", "x"), (500, "no url", "x"), (501, "http://h/with space\r\nX: y", None), (502, "", "y")]


def test_archives(spark):
    rows = PAGES + ODD_PAGES
    df = table(spark, "page_id", ["url", "html"], rows).repartition(5)
    got = warc.archived(df)
    assert rows_of(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == archived_by_force([(i, (b or "").encode()) for i, _, b in rows])
    ordered = [(r.url_key, r.page_id is not None, r.page_id or 0) for r in got.orderBy("position").collect()]
    assert ordered == sorted(ordered) and sorted(r.position for r in got.collect()) == [*range(len(rows))]
    keys = dict(zip(["org,example)/p/0?q=1", "org,example,b,a)/p/1?q=1", "h:8080)/", "no%20url", "h)/with%20space%0d%0ax:%20y"], [0, 1, None, 500, 501], strict=True))
    assert all(any(u == k and i == (v or 0) for u, _, i in ordered) for k, v in keys.items())
    assert warc.archived(df.limit(0)).count() == 0
    assert {r.record_type for r in warc.archived(df.filter("page_id < 12"), least_bytes=10_000).collect()} == {"response"}


def test_archives_are_plain_warc_files(spark, tmp_path):
    """Files read without the library: records follow each other by their Content-Length."""
    df = table(spark, "page_id", ["url", "html"], PAGES).repartition(3)
    path = warc.write_archives(df, f"file://{tmp_path}/w")
    found = []
    for file in Path(tmp_path, "w").glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            block, data = rest[:n], rest[n:]
            assert data.startswith(b"\r\n\r\n")
            data = data[4:]
            body = block.split(b"\r\n\r\n", 1)[1]
            found.append((fields, body))
            assert fields["WARC-Type"] == "revisit" or fields["WARC-Payload-Digest"] == "sha1:" + digest(body)
    responses = {f["WARC-Record-ID"]: f for f, _ in found if f["WARC-Type"] == "response"}
    assert len(found) == len(PAGES) == len({f["WARC-Record-ID"] for f, _ in found})
    for f, body in found:
        if f["WARC-Type"] == "revisit":
            first = responses[f["WARC-Refers-To"]]
            assert not body and (first["WARC-Payload-Digest"], first["WARC-Target-URI"]) == (f["WARC-Payload-Digest"], f["WARC-Refers-To-Target-URI"])
    again = {r.record_id: r for r in warc.read_archives(spark, path).collect()}
    assert {f["WARC-Record-ID"]: b for f, b in found} == {i: bytes(r.payload) for i, r in again.items()}


def test_other_archives(spark, tmp_path):
    """Records of one gzip member each, with other kinds; binary payloads; dates; a cut archive."""
    record = lambda kind, body, more="": f"WARC/1.0\r\nWARC-Type: {kind}\r\n{more}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    parts = [record("warcinfo", b"software: x\r\n"), record("resource", b"\x00\xff\r\n\r\n\xfe", "WARC-Date: 2001-02-03T04:05:06Z\r\n"), record("metadata", b"")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    got = warc.read_archives(spark, f"file://{tmp_path}/a.warc.gz").orderBy("number").collect()
    assert [(r.kind, bytes(r.payload), r.number) for r in got] == [("warcinfo", b"software: x\r\n", 0), ("resource", b"\x00\xff\r\n\r\n\xfe", 1), ("metadata", b"", 2)]
    assert got[1].us == 981_173_106_000_000
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(parts)[:-30]))
    with pytest.raises(Exception, match="b.warc.gz"):
        warc.read_archives(spark, f"file://{tmp_path}/b.warc.gz").count()
    raw = spark.createDataFrame([(1, "http://h/", bytearray(b"\xff\r\n\x00"), 5), (2, "http://h/", bytearray(b"\xff\r\n\x00"), -1), (3, None, None, 3)], "page_id int, url string, html binary, s long")
    raw = raw.withColumn("at", F.timestamp_micros(F.col("s") * 1_500_000 - 1))
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(raw, date="at").orderBy("position").collect()]
    assert got == [(3, 0, "response", None), (2, 4, "response", None), (1, 4, "revisit", 2)]  # by URL, then time


def test_archives_equal_sql(spark):
    against_sql(spark, "op12_warc")


def test_merging_of_runs_and_ranges(spark):
    rng = random.Random(6)
    for k in (0, 1, 2, 3, 7, 8, 33):
        runs = [sorted(rng.randrange(50) for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(k)]
        keys, starts = [x for r in runs for x in r], [sum(map(len, runs[:i])) for i in range(k + 1)]
        order = list(warc.merged_order(keys, starts))
        assert [keys[i] for i in order] == sorted(keys) and order == sorted(range(len(keys)), key=lambda i: (keys[i], i))
    df = table(spark, "page_id", ["url", "html"], [(i, "https://one.example.org/", str(i)) for i in range(3000)]).repartition(4)
    found = warc.read_archives(spark, warc.write_archives(df), payloads=False)
    index = warc.capture_index(found, entries=200)  # one URL in 15 ranges
    assert [r._key for r in index.orderBy("position").collect()] == [*range(3000)]


def test_a_very_long_payload(spark):
    body = "0123456789\r\n\r\n" * 1_500_000
    df = table(spark, "page_id", ["url", "html"], [(1, "http://h/", body), (2, "http://h/", body), (3, "http://h/", "x")])
    got = rows_of(warc.archived(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    assert got == archived_by_force([(1, body.encode()), (2, body.encode()), (3, b"x")])


# ---------------------------------------------------------------- 11


A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(P.path(A)), sentencepiece.SentencePieceProcessor(model_file=P.path(B))
    a.encode_special_tokens = True
    return a, b


def aligned_by_force(rows):
    a, b = sides()
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in seen} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in seen)}
    docs, count = [], {}
    for i, t in rows:
        want = (" " + (t or "")).encode()
        x = [(k, bytes(letters[c] for c in a.id_to_token(k))) for k in a.encode(" " + t, add_special_tokens=False).ids] if t else []
        y = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("\u2581", " ").encode()) for k in b.encode(t)] if t else []
        if not t or b"".join(p for _, p in x) != want or b"".join(p for _, p in y) != want:
            docs.append((i, [], [], [], 0))
            continue
        spans = []
        for side in (x, y):
            at, own = 0, []
            for k, p in side:
                own.append((k, at, at + len(p)))
                at += len(p)
            spans.append(own)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, lo = [], 0
        for c in cuts:
            groups.append([[k for k, s, e in own if lo <= s and e <= c] for own in spans])
            lo = c
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        overlaps = sum(max(s, u) < min(e, v) for _, s, e in spans[0] for _, u, v in spans[1]) if len(t) < 3000 else None
        for pair in set(links):
            count[pair] = count.get(pair, 0) + 1
        docs.append((i, x, y, groups, overlaps))
    top = {}
    for (p, _), n in count.items():
        top[p] = max(top.get(p, 0), n)
    out = []
    for i, x, y, groups, overlaps in docs:
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append(((i, len(x), len(y), len(groups), len(links), sum(count[k] == top[k[0]] for k in links), sum(count[k] for k in links), sha), overlaps))
    return out


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("head", [1_000_000, 3, 0])
def test_alignment(spark, head):
    rows = [(i, t) for i, t in ROWS + ODD if len(t or "") < 9000] + [(900, "aaaa bbbb" * 50), (901, "\u65e5\u672c" * 60), (902, "ab\n" * 40), (903, "<0xE3>" + "\ud55c" * 30)]
    df = table(spark, "doc_id", ["text"], rows).repartition(3)
    got = alignment.align(df, P.path(A), P.path(B), head=head)
    want = aligned_by_force(rows)
    assert rows_of(got, *ALIGNED) == sorted((w for w, _ in want), key=repr)
    overlaps = {w[0]: n for w, n in want if n is not None and w[0] not in (7, 8, 9, None)}
    assert {r.doc_id: r.n_overlaps for r in got.collect() if r.doc_id in overlaps} == overlaps
    if not head:
        texts = alignment.token_groups(df, P.path(A), P.path(B))
        assert rows_of(texts.select("doc_id", F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise(""))) == sorted(((w[0], w[-1]) for w, _ in want), key=repr)
        assert alignment.align(df.limit(0), P.path(A), P.path(B)).count() == 0


def test_alignment_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(queries.op11_alignment(spark, SF), *ALIGNED) == sorted((w for w, _ in aligned_by_force(rows)), key=repr)


def test_products_of_matrices():
    rng = np.random.default_rng(3)

    def dense(m, n):
        out = np.zeros((len(m.starts) - 1, n), dtype=np.int64)
        for i in range(len(out)):
            np.add.at(out[i], m.columns[m.starts[i] : m.starts[i + 1]], m.values[m.starts[i] : m.starts[i + 1]])
        return out

    for _ in range(40):
        n, k, m = rng.integers(1, 9, 3)
        made = []
        for rows, columns in ((n, k), (k, m)):
            counts = rng.integers(0, columns + 1, rows)
            own = [np.sort(rng.choice(columns, c, replace=False)) for c in counts]
            made.append(alignment.Csr(np.r_[0, np.cumsum(counts)], np.concatenate(own).astype(int), rng.integers(1, 5, counts.sum())))
        a, b = made
        assert (dense(alignment.product(a, b, int(m)), m) == dense(a, k) @ dense(b, m)).all()
        assert (dense(alignment.transposed(a, int(k)), n) == dense(a, k).T).all()


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_links_in_blocks_and_of_large_groups(most):
    rng = np.random.default_rng(5)
    for hard in (0, 1):
        a_bytes, b_bytes = rng.integers(1, 5, 200), rng.integers(1, 5, 200)
        if hard:  # no common end but the last
            a_bytes, b_bytes = np.full(200, 2), np.r_[1, np.full(199, 2), 1]
        total = min(a_bytes.sum(), b_bytes.sum())
        a_bytes, b_bytes = (np.diff(np.unique(np.r_[np.minimum(np.cumsum(x), total)]), prepend=0) for x in (a_bytes, b_bytes))
        a, b = rng.integers(0, 9, len(a_bytes)), rng.integers(0, 9, len(b_bytes))
        ends = [np.cumsum(x) for x in (a_bytes, b_bytes)]
        cuts = np.intersect1d(*ends)
        groups = alignment.groups_of(a_bytes, b_bytes)
        assert all((g == np.searchsorted(cuts, e)).all() for g, e in zip(groups, ends, strict=True))
        want = {}
        for i, g in zip(a, groups[0], strict=True):
            for j, h in zip(b, groups[1], strict=True):
                if g == h:
                    want[int(i) << 16 | int(j)] = want.get(int(i) << 16 | int(j), 0) + 1
        pairs, times = alignment.pair_links(a, b, *groups, most=most)
        assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == want
        got = {(int(i), int(j)): int(n) for p, q, r in alignment.overlap_links(a_bytes, b_bytes, most) for i, j, n in zip(p, q, r, strict=True)}
        shared = {(i, j): min(ends[0][i], ends[1][j]) - max(ends[0][i] - a_bytes[i], ends[1][j] - b_bytes[j]) for i in range(len(a)) for j in range(len(b))}
        assert got == {k: n for k, n in shared.items() if n > 0}


def both_tokens(text):
    """Ids of both sides of a text by its segments."""
    both = alignment.aligner(P.path(A), P.path(B))
    cut = both.segments(text)
    found = both.tokens(cut) if cut else [None]
    return None if None in found else [[i for part in side for i in np.frombuffer(part, "<u2").tolist()] for side in zip(*found, strict=True)]


def test_tokens_equal_the_libraries():
    a, b = sides()
    rng = random.Random(8)
    signs = ["a", "b", "the", " ", "  ", " ", "\n", "\t", "\u00e9", "\u65e5", "<s>", "</s>", "<|endoftext|>", "<0x41>", "\x00", "\x1c", "\x85", "\u3000", "1", "23", "\U0001f642", "'s", "_", "\u2581"]
    for _ in range(6000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 25)))
        found = both_tokens(text)
        if "\u2581" in text:
            assert found is None
        else:
            assert found == [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]


def test_alignment_of_a_very_long_text(spark):
    text = "shiny maison, the 12 " * 1_000_000
    df = table(spark, "doc_id", ["text"], [(1, text), (2, "shiny"), (3, "\u65e5" * 300_000)])
    got = {r.doc_id: r for r in alignment.align(df, P.path(A), P.path(B)).collect()}
    a, _ = both_tokens("shiny maison, the 12 " * 10)
    assert got[1].n_a == (len(a) - 1) * 100_000 + 1 and got[1].n_overlaps >= got[1].n_groups > 1_000_000 and got[3].n_a > 0
