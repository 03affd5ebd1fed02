"""Operator 12: WARC archives of captures, and their index by external merging.

Writing: of captures with equal payloads one is the response and the others revisit it. Records are made of columns and written by Spark as
text files with CR LF CR LF, which ends a record, as the line separator, each file compressed as a whole; so they go to any file system
that Spark writes to, and a lost task is repeated.

Reading: a compressed file is read by one task as a stream, in pieces between two separators, which are put together again by the records'
Content-Length; any .warc.gz can be read so. A task holds a batch of pieces and one record.

Index: each reading task sorts its captures by URL key and time and writes them as a run. Splitters of the order cut all runs into ranges
of about `ENTRIES` captures, also within one URL; a task gets its range's slice of every run, as sorted, and merges the slices by a tree
of losers. Places in the whole index are prefix sums over the ranges.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_path, track, utf8, written
from .packing import task_starts

SEPARATOR = "\r\n\r\n"
_SEP = SEPARATOR.encode()
#: Captures of one range of the index.
ENTRIES = 100_000
#: Time of captures where none is given: the first second of the year 2000, in microseconds.
CAPTURED = 946_684_800_000_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payloads after which a reader passes on what it has.
FLUSH = 8 << 20


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: 160 bits as four numbers of 8 digits, whose letters differ from those of conv."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """The key that captures of a URL are sorted by: host labels from the last to the first, a port that is not usual, path and query, in lower
    case, without scheme, user, leading www and fragment. What is no URL with a host is its own key; null is the empty string."""
    form = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www[0-9]*[.])?([^/:?#]+)(?::([0-9]+))?([^#]*)"
    low = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    host, port, rest = (F.regexp_extract(low, form, k) for k in (1, 2, 3))
    labels = F.array_join(F.reverse(F.split(host, "[.]")), ",")
    named = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    return F.when(host == "", low).otherwise(F.concat(labels, named, F.lit(")"), F.when(rest == "", "/").otherwise(rest)))


def _iso(us: Column) -> Column:
    """Microseconds since 1970 as a date in UTC, whatever the session's zone."""
    day = F.floor(us / F.lit(86_400_000_000)).cast("int")
    left = us - day.cast("long") * 86_400_000_000
    two = lambda n, size: F.lpad((F.floor(left / F.lit(n)) % size).cast("string"), 2, "0")
    clock = F.concat_ws(":", two(3_600_000_000, 24), two(60_000_000, 60), two(1_000_000, 60))
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"), F.lit("T"), clock, F.lit("."), F.lpad((left % 1_000_000).cast("string"), 6, "0"), F.lit("Z"))


def captures(df: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html", date: str | None = None) -> DataFrame:
    """df's rows as captures, written, and which of them revisit another: _rid, _key, _url, _us, _payload, _n, _sha1, and _first, the capture
    (_key, _rid, _url, _us) that has the same payload and the largest key; null where there is none besides itself."""
    if dict(df.dtypes)[payload] == "binary":
        body = F.coalesce(F.col(payload), F.lit(b""))
    else:
        body = utf8(payload)
    us = F.coalesce(F.unix_micros(F.col(date).cast("timestamp")), F.lit(CAPTURED)) if date else F.lit(CAPTURED).cast("long")
    rows = df.select(F.monotonically_increasing_id().alias("_rid"), F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"), us.alias("_us"), body.alias("_payload"))
    rows = rows.withColumns({"_n": F.octet_length("_payload").cast("long"), "_sha1": base32_sha1(F.col("_payload")), "_sha2": F.unhex(F.sha2("_payload", 256))})
    rows = written(rows, "captures")
    same = rows.filter(F.col("_n") >= least_bytes).groupBy("_sha2", "_n")
    same = same.agg(F.max(F.struct("_key", "_rid", "_url", "_us")).alias("_first"), F.count("*").alias("_c")).filter("_c > 1")
    same = written(same.drop("_c"), "originals")  # so that both sides of the join are plain exchanges, which Spark can split at a hot payload
    return rows.join(same, ["_sha2", "_n"], "left").withColumn("_first", F.when(F.col("_first._rid") != F.col("_rid"), F.col("_first"))).drop("_sha2")


def _record_id(rid: Column, key: Column, sha1: Column) -> Column:
    m = F.md5(F.concat_ws("/", rid.cast("string"), F.coalesce(key.cast("string"), F.lit("")), sha1))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(m, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def _safe(url: Column) -> Column:
    """A URL that cannot end its header line: blanks and line ends percent-encoded, other control characters left out."""
    for sign, code in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        url = F.replace(url, F.lit(sign), F.lit(code))
    return F.regexp_replace(url, r"[\x00-\x1F\x7F]", "")


def records(rows: DataFrame) -> DataFrame:
    """Rows of captures → value: one WARC record each, without the separator at its end, as a string of raw bytes."""
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)  # noqa: E731 - null without a value
    first = F.col("_first")
    again = first.isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_n").cast("string"), F.lit(SEPARATOR))
    length = F.octet_length(http) + F.when(again, 0).otherwise(F.col("_n"))
    head = F.concat_ws(
        "",
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"),
        line("WARC-Record-ID", _record_id(F.col("_rid"), F.col("_key"), F.col("_sha1"))),
        line("WARC-Date", _iso(F.col("_us"))),
        line("WARC-Target-URI", _safe(F.col("_url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha1"))),
        F.when(again, line("WARC-Profile", F.lit(REVISIT))),
        F.when(again, line("WARC-Refers-To", _record_id(first["_rid"], first["_key"], F.col("_sha1")))),
        F.when(again, line("WARC-Refers-To-Target-URI", _safe(first["_url"]))),
        F.when(again, line("WARC-Refers-To-Date", _iso(first["_us"]))),
        line("X-Record-Key", F.url_encode(F.col("_key").cast("string"))),
        F.when(again, line("X-Refers-To-Key", F.url_encode(first["_key"].cast("string")))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(SEPARATOR), http,
    )
    whole = F.concat(F.encode(head, "UTF-8"), F.when(again, F.lit(b"")).otherwise(F.col("_payload")))
    return rows.select(whole.cast("string").alias("value"))


def write_archives(df: DataFrame, path: str | None = None, **columns) -> str:
    """Archives of df's captures (see `captures` for the columns) in a folder, whose path is returned: one .gz file for each task.

    A null payload is an empty one. Of captures that repeat key and payload one is the response. A null URL has no WARC-Target-URI, one with
    blanks or line ends has them percent-encoded. A null key has no X-Record-Key. A null date is 2000. No row gives no record."""
    path = path or track(shared_path(df.sparkSession, "archives"))
    records(captures(df, **columns)).write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path)
    return path


_SCHEMA = "file string, number long, kind string, record_id string, us long, uri string, headers map<string,string>, payload_bytes long, payload_digest string"


def _parsed(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(file, piece) in order → (file, headers, block) of each record."""
    file, head, parts, size, need = None, {}, [], 0, None

    def begin(raw: bytes) -> tuple[dict[str, str], int]:
        version, *lines = raw.decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"{file}: no WARC record at {version[:60]!r}")
        found = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        if not found.get("content-length", "").isdigit():
            raise ValueError(f"{file}: a record is cut or has no length")
        return found, int(found["content-length"])

    for name, piece in pieces:
        if name != file:
            if need is not None:
                raise ValueError(f"{file}: the last record is cut")
            file = name
        if need is None:
            raw = piece.lstrip(b"\r\n")
            if raw:
                (head, need), parts, size = begin(raw), [], -len(_SEP)
            continue
        parts.append(piece)
        size += len(_SEP) + len(piece)
        if size >= need:
            data = _SEP.join(parts)
            yield file, head, data[:need]
            raw, need = data[need:].lstrip(b"\r\n"), None  # a block that ends in a line's end leaves the next header here
            if raw:
                (head, need), parts, size = begin(raw), [], -len(_SEP)
    if need is not None:
        raise ValueError(f"{file}: the last record is cut")


def _payload(head: dict[str, str], block: bytes) -> tuple[bytes, int, str]:
    """Payload, and the length and digest of the whole payload, which a revisit only tells of."""
    told = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if head.get("content-type", "").startswith("application/http"):
        http, _, body = block.partition(_SEP)
        if head.get("warc-type") == "revisit":
            fields = [x.partition(":") for x in http.decode("latin-1").split("\r\n")]
            return body, next((int(v) for k, _, v in fields if k.strip().lower() == "content-length"), len(body)), told
    else:
        body = block
    return body, len(body), b32encode(hashlib.sha1(body).digest()).decode()


def _us(date: str | None) -> int | None:
    if not date:
        return None
    at = datetime.fromisoformat(date)
    return round((at.replace(microsecond=0)).timestamp()) * 1_000_000 + at.microsecond


def _records(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "number", "kind", "record_id", "us", "uri", "headers", "payload_bytes", "payload_digest", *(["payload"] if payloads else [])]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), *([pa.binary()] if payloads else [])]
        out: list[tuple] = []
        held, number, last = 0, 0, None

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        pieces = ((f, p) for b in batches for f, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for file, head, block in _parsed(pieces):
            body, n, digest = _payload(head, block)
            number, last = (number + 1 if file == last else 0), file
            out.append((file, number, head.get("warc-type"), head.get("warc-record-id"), _us(head.get("warc-date")), head.get("warc-target-uri"), list(head.items()), n, digest,
                        *([body] if payloads else [])))
            held += len(block) if payloads else 200
            if held >= FLUSH or len(out) >= 10_000:
                yield packed()
                out, held = [], 0
        if out:
            yield packed()

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all compressed archives in a folder: file, number (in its file, from 0), kind, record_id, us, uri, headers (names in lower
    case), payload_bytes and payload_digest (of responses from the payload itself, of revisits as told), payload if wanted. An archive
    that is cut or holds something else is an error, which names it."""
    lines = spark.read.option("lineSep", SEPARATOR).schema("value string").text(path)
    lines = lines.select(F.col("_metadata.file_path"), F.col("value").cast("binary"))
    return lines.mapInArrow(_records(payloads), _SCHEMA + (", payload binary" if payloads else ""))


# ---------------------------------------------------------------- the index


def merged_order(keys: list, starts: list[int]) -> Iterator[int]:
    """Places of keys in order; keys holds sorted runs, starts their first places and the end. A tree of losers has the winner's rivals on the
    way from its leaf to the root, so a step takes one comparison for each level; of equal keys the earlier run's goes first."""
    k, at, ends = len(starts) - 1, list(starts[:-1]), starts[1:]

    def first(a: int, b: int) -> bool:
        if at[a] == ends[a] or at[b] == ends[b]:
            return at[b] == ends[b]
        x, y = keys[at[a]], keys[at[b]]
        return x < y or (x == y and a < b)

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if first(a, b) else (b, a)
    top = winners[1] if k > 1 else 0
    while k and at[top] < ends[top]:
        yield at[top]
        at[top] += 1
        node = (top + k) // 2
        while node:
            if first(losers[node], top):
                losers[node], top = top, losers[node]
            node //= 2


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of runs, one after the other, each in order → one order. _at has the run above 33 bits."""
    held = list(batches)
    if not any(b.num_rows for b in held):
        return
    table = pa.Table.from_batches(held)
    keys = [(u, t, k is not None, k) for u, t, k in zip(*(table.column(c).to_pylist() for c in ("url_key", "us", "_key")), strict=True)]
    runs = [x >> 33 for x in table.column("_at").to_pylist()]
    starts = [i for i in range(len(runs)) if i == 0 or runs[i] != runs[i - 1]] + [len(runs)]
    order = list(merged_order(keys, starts))
    table = table.take(pa.array(order, pa.int64())).drop_columns("_at")
    n = table.num_rows
    table = table.append_column("_task", pa.array([TaskContext.get().partitionId()] * n, pa.int64())).append_column("_place", pa.array(range(n), pa.int64()))
    yield from table.combine_chunks().to_batches(max_chunksize=10_000)


def capture_index(found: DataFrame, key_type: str = "long", entries: int = ENTRIES) -> DataFrame:
    """Records as read → the index of their captures: url_key, us, _key, payload_bytes, payload_digest, kind, refers_to, file, number and position,
    gapless from 0 in the order of URL key, time and key (a null key first). Written."""
    key = lambda name: F.url_decode(F.element_at("headers", name)).cast(key_type)
    rows = found.filter(F.col("kind").isin("response", "revisit")).select(
        url_key(F.col("uri")).alias("url_key"), "us", key("x-record-key").alias("_key"), "payload_bytes", "payload_digest", "kind",
        key("x-refers-to-key").alias("refers_to"), "file", "number",
    )
    runs = written(rows.sortWithinPartitions("url_key", "us", "_key").withColumn("_at", F.monotonically_increasing_id()), "runs")
    n = max(1, -(-runs.count() // entries))
    dealt = runs.repartitionByRange(n, "url_key", "us", "_key", "_at").sortWithinPartitions("_at")
    schema = T.StructType([*runs.drop("_at").schema.fields, T.StructField("_task", T.LongType()), T.StructField("_place", T.LongType())])
    merged = written(dealt.mapInArrow(_merge, schema), "index")
    # one row of two numbers for each range: bounded by the number of captures over `entries`
    bases = task_starts(merged.withColumn("_one", F.lit(1)), "_task", "_one")
    return merged.join(F.broadcast(bases), "_task").withColumn("position", F.col("_base") + F.col("_place")).drop("_task", "_place", "_base")


def archived(df: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html", date: str | None = None) -> DataFrame:
    """df written to archives and read back, one row per input row: key, payload_bytes, payload_digest, record_type, refers_to, url_key,
    position (its place in the index of all captures).

    Null payloads count as empty. Of equal payloads of `least_bytes` or more the capture with the largest key is the response; null keys are
    smallest; of rows that repeat payload and key one is the response and the others refer to that key. A hot URL or payload is
    several ranges or tasks. Very long payloads are read one at a time. An empty table gives no row; other columns are ignored."""
    found = read_archives(df.sparkSession, write_archives(df, least_bytes=least_bytes, key=key, url=url, payload=payload, date=date), payloads=False)
    index = capture_index(found, df.schema[key].dataType.simpleString())
    return index.select(F.col("_key").alias(key), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to", "url_key", "position")
