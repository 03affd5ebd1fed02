"""Plans of imports and exports over listings, and report sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grouped import per_group_running
from ..operators.state import READY, natural_key
from .readers import IMAGES


def _normal_parts(member: Column) -> Column:
    """Parts of a path without `.` and with `..` resolved; null where it leaves its root."""
    parts = F.filter(F.split(F.replace(member, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("a"), F.lit(True).alias("ok"))

    def step(s, p):
        up = p == ".."
        rest = F.slice(s["a"], 1, F.greatest(F.size(s["a"]) - 1, F.lit(0)))
        return F.struct(F.when(up, rest).otherwise(F.concat(s["a"], F.array(p))).alias("a"), (s["ok"] & (~up | (F.size(s["a"]) > 0))).alias("ok"))

    done = F.aggregate(parts, start, step)
    return F.when(done["ok"], done["a"])


def plan_archive_members(members: DataFrame, depth: int = 5) -> DataFrame:
    """members(archive_id, ord, member) → (archive_id, path, ord): images to unpack, each path once, in natural order from 0."""
    bad = F.col("member").rlike(r"^[/\\]|^[A-Za-z]:|\x00")
    df = members.filter(~bad).withColumn("parts", _normal_parts(F.col("member"))).filter(F.col("parts").isNotNull() & F.size("parts").between(1, depth))
    df = df.withColumn("path", F.array_join("parts", "/"))
    df = df.filter(F.lower("path").rlike(r"\.(" + "|".join(IMAGES) + ")$") & ~F.lower("path").rlike(r"[-_]mask(-2)?\.[a-z]+$"))
    df = df.groupBy("archive_id", "path").agg(F.min("ord").alias("first"))
    place = F.row_number().over(Window.partitionBy("archive_id").orderBy(natural_key("path"), "path")) - 1
    return df.select("archive_id", "path", place.cast("long").alias("ord"))


def plan_chapters(files: DataFrame, mode: str) -> DataFrame:
    """files(source_id, source_name, path) → path with its chapter; mode: flat, folder or archive."""
    first = F.when(F.col("path").contains("/"), F.split_part("path", F.lit("/"), F.lit(1))).otherwise("")
    if mode == "flat":
        return files.withColumn("chapter", F.lit(""))
    if mode == "folder":
        return files.withColumn("chapter", first)
    own = Window.partitionBy("source_id")
    stem = F.regexp_replace("source_name", r"\.[^.]+$", "")
    alone = (F.min(first).over(own) == F.max(first).over(own)) & (first == "")
    return files.withColumn("chapter", F.when(alone, stem).otherwise(first))


def _safe_parts(name: Column) -> Column:
    """Parts of a path within an archive, without empty ones, `.`, `..` and the letters of drives."""
    parts = F.transform(F.split(name, r"[\\/]+"), lambda p: F.trim(F.replace(p, F.lit("\x00"), F.lit(""))))
    parts = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^\p{L}:", "")))
    return F.filter(parts, lambda p: ~p.isin("", ".", ".."))


def _plain(value: Column) -> Column:
    return F.translate(F.coalesce(value.cast("string"), F.lit("")), "{}", "")


def member_name(template: str, suffix: str = "", extension: str = ".png") -> Column:
    """Name within an archive from {chapter}, {name}, {stem} and {index} (also {index:03}) of the columns chapter, name, stem and index; a template
    that asks for anything else is as if it were {index:03}_{stem}."""
    fallback = "{index:03}_{stem}"

    def rendered(form: str) -> Column | None:
        pieces = []
        for literal, field, spec, conversion in Formatter().parse(form):
            pieces.append(F.lit(literal))
            if field is None:
                continue
            if field not in ("chapter", "name", "stem", "index") or conversion or (spec and not (field == "index" and re.fullmatch("0?[0-9]{1,2}d?", spec))):
                return None
            width = int(spec.rstrip("d")) if spec else 0
            number = F.col("index").cast("string")
            padded = F.lpad(number, width, "0" if spec.startswith("0") else " ") if spec else number
            pieces.append(F.when(F.length(number) < width, padded).otherwise(number) if field == "index" else _plain(F.col(field)))
        return F.concat(*pieces) if pieces else F.lit("")

    try:
        wanted = rendered(template)
    except ValueError:
        wanted = None
    spare = _safe_parts(rendered(fallback))
    parts = _safe_parts(wanted) if wanted is not None else spare
    parts = F.when(F.size(parts) > 0, parts).when(F.size(spare) > 0, spare).otherwise(F.array(F.lit("page")))
    return F.concat(F.array_join(parts, "/"), F.lit(suffix + extension))


def plan_export(pages: DataFrame, artifacts: DataFrame, required: list[str], only_ready: bool = True, request: DataFrame | None = None, template: str = "{index:04}") -> tuple[DataFrame, DataFrame]:
    """pages(project_id, page_id, pos, status; chapter, name and stem for templates), artifacts(page_id, kind), request(project_id, page_id, pos: the
    wanted order, of pages that may be unknown) → (packed pages with a gapless index from 1 and names, skipped pages with the reason)."""
    have = artifacts.filter(F.col("kind").isin(required)).groupBy("page_id").agg(F.count_distinct("kind").alias("n"))
    known = pages.withColumn("_known", F.lit(True))
    df = known if request is None else request.select("project_id", "page_id", "pos").join(known.drop("pos"), ["project_id", "page_id"], "left")
    df = df.withColumns({c: F.lit("") for c in ("chapter", "name", "stem") if c not in df.columns}).join(have, "page_id", "left")
    reason = F.when(F.col("_known").isNull() | F.col("status").isNull(), "unknown")
    if only_ready:
        reason = reason.when(~F.col("status").isin(list(READY)), "not ready")
    df = df.withColumn("reason", reason.when(F.coalesce("n", F.lit(0)) < len(required), "missing").otherwise(""))
    packed = df.filter("reason = ''").withColumn("index", F.row_number().over(Window.partitionBy("project_id").orderBy("pos", "page_id")).cast("long"))
    packed = packed.select("project_id", "page_id", "index", member_name(template).alias("name"), member_name(template, "-clean").alias("clean"))
    return packed, df.filter("reason <> ''").select("project_id", "page_id", "reason")


def resolve_names(planned: DataFrame, existing: DataFrame, policy: str = "rename") -> DataFrame:
    """planned(ord, name), existing(name, protected) → name to write, or null for what is skipped. rename adds -2, -3 and so on to what is taken,
    whatever its case; overwrite spares protected names.

    Only names that may clash go through the fold: those of a family (a name and what hangs numbers on it) in which one name comes
    twice. All others are written as they are."""
    both = planned.select(F.lower("name").alias("key"), "ord", "name", F.lit(False).alias("old"), F.lit(False).alias("protected"))
    both = both.unionByName(existing.select(F.lower("name").alias("key"), F.lit(-1).cast("long").alias("ord"), "name", F.lit(True).alias("old"), "protected"))
    keys = both.groupBy("key").agg(F.count("*").alias("n"))
    # The shortest name that is there itself and gives this one with numbers hung on.
    head, tail = F.regexp_extract("key", r"(?s)^(.+?)((?:-[0-9]+)*)(\.[^.]*)?$", 1), F.regexp_extract("key", r"(?s)^(.+?)((?:-[0-9]+)*)(\.[^.]*)?$", 3)
    numbers = F.split(F.regexp_extract("key", r"(?s)^(.+?)((?:-[0-9]+)*)(\.[^.]*)?$", 2), "-")
    shorter = F.transform(F.sequence(F.lit(1), F.size(numbers)), lambda k: F.concat(head, F.array_join(F.slice(numbers, F.lit(1), k), "-"), tail))
    roots = keys.select("key", "n", F.explode(shorter).alias("root")).join(keys.select(F.col("key").alias("root")), "root")
    roots = roots.groupBy("key", "n").agg(F.min_by("root", F.length("root")).alias("root"))
    clash = roots.groupBy("root").agg(F.max("n").alias("most")).filter("most > 1")
    families = roots.join(clash, "root").select("key", "root")

    def settle(rows: Iterator[tuple]) -> Iterator[tuple]:
        taken: dict[str, bool] = {}
        tried: dict[tuple[str, str], int] = {}  # numbers below are taken, and stay so
        for key, order, name, old, protected, _ in rows:
            if old:
                taken[key] = protected or taken.get(key, False)
                continue
            free = key not in taken
            if policy == "skip" and not free or policy == "overwrite" and taken.get(key):
                yield order, name, None
                continue
            new = name
            if policy == "rename" and not free:
                dot = name.rfind(".")
                stem, end = (name[:dot], name[dot:]) if dot > 0 else (name, "")
                k = tried.get((stem, end), 2)
                while (new := f"{stem}-{k}{end}").lower() in taken:
                    k += 1
                tried[stem, end] = k + 1
            taken.setdefault(new.lower(), False)
            yield order, name, new

    rows = both.join(families, "key")
    settled = per_group_running(rows.select("key", "ord", "name", "old", "protected", "root"), ["root"], ["ord", "name"], settle, "ord long, name string, written string")
    alone = both.filter("not old").join(families, "key", "left_anti").select("ord", "name", F.col("name").alias("written"))
    return alone.unionByName(settled)


def validate_manifests(manifests: DataFrame, top_version: int = 1) -> DataFrame:
    """manifests(package_id, body JSON, packed array of ids) → package_id, reason ('' if valid)."""
    m = F.from_json("body", "kind string, schema_version int, pages array<struct<id:string>>, wanted array<string>")
    df = manifests.withColumn("m", m)
    ids = F.filter(F.transform(F.col("m.pages"), lambda p: p["id"]), lambda i: i.isNotNull() & (i != ""))
    reason = (
        F.when(~F.col("m.kind").eqNullSafe("project"), "kind").when(~F.coalesce(F.col("m.schema_version").between(1, top_version), F.lit(False)), "version")
        .when(F.coalesce(F.size("m.pages"), F.lit(0)) < 1, "empty").when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate")
        .when(~F.col("packed").eqNullSafe(F.col("m.wanted")), "incomplete").otherwise("")
    )
    return df.select("package_id", reason.alias("reason"))


def artifact_inventory(pages: DataFrame, artifacts: DataFrame, kinds: list[str]) -> DataFrame:
    """Missing kinds of every page, in their order."""
    have = artifacts.groupBy("page_id").agg(F.collect_set("kind").alias("have"))
    df = pages.select("page_id").join(have, "page_id", "left")
    wanted = F.array(*[F.lit(k) for k in kinds])
    return df.select("page_id", F.array_join(F.array_except(wanted, F.coalesce("have", F.array().cast("array<string>"))), ",").alias("missing"))


def write_report(df: DataFrame, path: str, by: list[str] | None = None, kind: str = "parquet") -> None:
    """A report as files of the kind (parquet, json, csv), in folders by columns."""
    writer = df.write.mode("overwrite").format(kind)
    (writer.partitionBy(*by) if by else writer).save(path)


def run_report(run_pages: DataFrame) -> DataFrame:
    """run_pages(run_id, id, image, status, error, seconds) → (run_id, kind, id, image, note): pages that are done, errors with their text, and
    skipped pages."""
    kind = F.when(F.col("status") == "done", "pages").when(F.col("status") == "error", "errors").otherwise("skipped")
    return run_pages.select("run_id", kind.alias("kind"), "id", "image", F.when(F.col("status") == "error", F.col("error")).otherwise("").alias("note"))
