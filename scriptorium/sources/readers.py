"""Readers of page documents, image files, event logs and glossaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .documents import page_regions, read_pages

IMAGES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")


def read_regions(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(regions, quarantined documents) of JSON documents, one a file or, for many small ones, one a line; see documents.page_regions."""
    pages = read_pages(spark, path, lines)
    return page_regions(pages), pages.filter("raw IS NULL").select("path", "body")


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression over a path relative to its root: `*` and `?` stay within a name, `**` goes over folders, sets in brackets."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            inside = glob[i + 1 : end]
            none, inside = inside[0] in "!^", inside.lstrip("!^") if inside[0] in "!^" else inside
            out, i = out + "[" + ("^/" if none else "") + re.sub(r"([\\\[\]&~^])", r"\\\1", inside) + "]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def _page_files(files: DataFrame, root: str, suffixes: tuple[str, ...], include: str | None, exclude: str | None, globs: bool) -> DataFrame:
    name = F.element_at(F.split("path", re.escape(root.rstrip("/").split(":", 1)[-1].lstrip("/")) + "/", 2), -1)
    df = files.withColumn("_name", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))) if globs else F.col("path"))
    ok = F.lower("path").rlike(r"\.(" + "|".join(suffixes) + ")$") & ~F.lower("path").rlike(r"[-_]mask(-2)?\.[a-z]+$") & ~F.lower("path").rlike(r"/html/")
    if include:
        ok &= F.col("_name").rlike(glob_pattern(include) if globs else include)
    if exclude:
        ok &= ~F.col("_name").rlike(glob_pattern(exclude) if globs else exclude)
    return df.filter(ok).drop("_name")


def list_page_files(spark: SparkSession, root: str, recursive: bool = True, suffixes: tuple[str, ...] = IMAGES, include: str | None = None, exclude: str | None = None,
                    globs: bool = False) -> DataFrame:
    """Image files without their contents; companion masks and folders of web pages are left out. include, exclude: regular expressions of paths, or globs of
    paths under root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "length", "modificationTime")
    return _page_files(files, root, suffixes, include, exclude, globs)


def stream_page_files(spark: SparkSession, root: str, recursive: bool = True, suffixes: tuple[str, ...] = IMAGES, include: str | None = None, exclude: str | None = None,
                      globs: bool = False) -> DataFrame:
    """As list_page_files, files as they come."""
    schema = spark.read.format("binaryFile").load(root).schema
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "length", "modificationTime")
    return _page_files(files, root, suffixes, include, exclude, globs)


EVENT = T.StructType().add("timestamp", "timestamp").add("event", "string").add("details", "string")


def read_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines of a JSON event log; invalid lines are dropped."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(EVENT).option("mode", "DROPMALFORMED").json(path).filter("event is not null")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) of text files: one JSON object, or lines `name = value` or `name: value` with # for comments. The last wins."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    is_json = F.trim("body").startswith("{") & F.try_parse_json("body").isNotNull()
    objects = whole.filter(is_json).select("path", F.posexplode(F.map_entries(F.from_json("body", "map<string,string>"))).alias("n", "e")).select("path", "n", F.col("e.key").alias("source"), F.col("e.value").alias("target"))
    lines = whole.filter(~is_json).select("path", F.posexplode(F.split("body", "\r?\n")).alias("n", "line")).filter(~F.col("line").rlike(r"^\s*#"))
    pattern = r"^\s*([^=:]+?)\s*[=:]\s*(.+?)\s*$"
    lines = lines.select("path", "n", F.regexp_extract("line", pattern, 1).alias("source"), F.regexp_extract("line", pattern, 2).alias("target")).filter("source <> ''")
    last = Window.partitionBy("source").orderBy(F.desc("path"), F.desc("n"))
    return objects.unionByName(lines).withColumn("_r", F.row_number().over(last)).filter("_r = 1").select("source", "target")


def _attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag, quoted or not; empty where there is none."""
    pattern = rf"(?i)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))"
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def page_assets(pages: DataFrame, tag: str = "img", attribute: str = "src", long_side: int = 160, short_side: int = 80) -> DataFrame:
    """pages(page_id, html) → (page_id, n, url, reason): what tags point to; reason is '' for those to keep. Decorations are told by class, id and
    text; sizes count where they are given."""
    tags = F.regexp_extract_all("html", F.lit(rf"(?i)<{tag}\b[^>]*>"), F.lit(0))
    t = F.col("t")
    df = pages.select("page_id", F.posexplode(tags).alias("n", "t")).withColumn("url", _attribute(t, attribute))
    size = lambda a: F.regexp_extract(_attribute(t, a), "^[0-9]{1,8}", 0).try_cast("long")
    wide, high = size("width"), size("height")
    names = F.concat_ws(" ", *[_attribute(t, a) for a in ("class", "id", "alt")])
    reason = (
        F.when(F.col("url") == "", "none").when(F.col("url").startswith("blob:"), "blob").when(F.lower(names).rlike("icon|sprite|emoji|avatar"), "decoration")
        .when((F.lower(_attribute(t, "aria-hidden")) == "true") | F.lower(_attribute(t, "role")).isin("presentation", "none"), "hidden")
        .when((F.greatest(wide, high) < long_side) | (F.least(wide, high) < short_side), "small").otherwise("")
    )
    return df.select("page_id", F.col("n").cast("long").alias("n"), "url", reason.alias("reason"))


def background_assets(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) → (page_id, n, url): what styles name as backgrounds, in order; data and blob addresses are none."""
    urls = F.regexp_extract_all("html", F.lit(r"(?i)background(?:-image)?\s*:[^;\"'}>]*?url\(\s*(?:&quot;|[\"'])?([^\"')\s&]+)"), F.lit(1))
    urls = F.filter(urls, lambda u: ~F.lower(u).rlike("^(data|blob):"))
    return pages.select("page_id", F.posexplode(urls).alias("n", "url")).select("page_id", F.col("n").cast("long").alias("n"), "url")


def content_dedupe(files: DataFrame) -> DataFrame:
    """files(path, pos, content) → by digest: the first path, how many there are, and whether sizes differ (an error)."""
    df = files.withColumns({"sha": F.sha2("content", 256), "size": F.octet_length("content")})
    return df.groupBy("sha").agg(F.min_by("path", F.struct("pos", "path")).alias("path"), F.count("*").alias("n"), (F.count_distinct("size") > 1).alias("conflict"))
