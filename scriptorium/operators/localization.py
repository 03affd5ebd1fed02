"""Dictionaries, glossaries, replies, routes, leaks, memory, types and edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CYRILLIC_TARGETS, once, own_words, script_counts, token_counts
from .filters import GENDERS, STORY_TYPES, filled

# ---------------------------------------------------------------- dictionaries


def lookup_sfx(regions: DataFrame, words: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """words(source in capitals, value) → (sound blocks with their value, blocks that remain to be translated). Only for Russian."""
    key = F.upper(F.regexp_replace("text", r"^[\s.!?,;:…-]+|[\s.!?,;:…-]+$", ""))
    usable = (F.col("block_type") == "sfx") & (F.lit(target) == "ru")
    df = regions.withColumn("_key", F.when(usable, key)).join(words, F.col("_key") == F.col("source"), "left").drop("_key", "source")
    return df.filter(F.col("value").isNotNull()), df.filter(F.col("value").isNull() & ~F.col("translation_locked")).drop("value")


def overlay_glossary(base: DataFrame, user: DataFrame) -> DataFrame:
    """(source, target) of both; the user's wins."""
    u = user.select(F.col("source").alias("source"), F.col("target").alias("own"))
    return base.join(u, "source", "full_outer").select("source", F.coalesce("own", "target").alias("target"))


def normalize_glossary(entries: DataFrame, order: str = "ord") -> DataFrame:
    """entries(ord, source, target, gender, note) → one row a source: the first; source and gender without blanks at their ends, missing texts empty, those
    without a source left out."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = entries.select(F.trim("source").alias("source"), F.struct(order, text("target").alias("target"), F.trim(text("gender")).alias("gender"), text("note").alias("note")).alias("e"))
    return rows.filter("source <> ''").groupBy("source").agg(F.min("e").alias("e")).select("source", "e.target", "e.gender", "e.note")


#: Bytes of result that the pages of one project and part have at most, and bytes of result for a task at least.
BLOCKS_BYTES, BLOCKS_TASK = 4 << 30, 64 << 20


def glossary_blocks(pages: DataFrame, glossary: DataFrame) -> DataFrame:
    """pages(page_id, project_id), glossary(project_id, ord, source, target) → (page_id, block): what a request for the page says of names, in order. A
    project's text is made once, not once a page. The result grows with pages times names, so pages are dealt by project before they get their text:
    a task has few texts, each many times in a row, which files hold once. A project with much to write is dealt to several tasks."""
    line = F.concat(F.lit("- "), "source", F.lit(" = "), "target")
    wanted = pages.select("page_id", "project_id")
    # What a project's pages and its text come to: one row for the driver.
    sizes = wanted.groupBy("project_id").agg(F.count("*").alias("n")).join(glossary.groupBy("project_id").agg(F.sum(F.octet_length(line) + 1).alias("long")), "project_id", "left")
    size = sizes.select((F.col("n") * F.coalesce("long", F.lit(16))).alias("b")).agg(F.count("*").alias("n"), F.max("b").alias("most"), F.sum("b").alias("all")).first()
    parts = -(-(size["most"] or 1) // BLOCKS_BYTES)
    tasks = max(1, min(2 * size["n"] * parts, (size["all"] or 0) // BLOCKS_TASK))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda r: r["line"])  # one project's names
    text = F.concat(F.lit("Glossary, use these translations exactly:\n"), F.array_join(rows, "\n"))
    blocks = glossary.groupBy("project_id").agg(text.alias("block")).select("project_id", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    dealt = wanted.withColumn("_part", F.pmod(F.xxhash64("page_id"), F.lit(parts)).cast("int"))
    keys = ["project_id", "_part"]
    found = dealt.repartition(tasks, *keys).join(blocks.repartition(tasks, *keys).hint("merge"), keys, "left")
    return found.select("page_id", F.coalesce("block", F.lit("No glossary.")).alias("block"))


def build_glossary(regions: DataFrame, existing: DataFrame) -> DataFrame:
    """Speakers with the first gender that is given for them, in the order of pages and regions; what the glossary
    (source, target, gender, note, and ord where there is one) already says stays; of sources that it repeats the first."""
    existing = normalize_glossary(existing if "ord" in existing.columns else existing.withColumn("ord", F.lit(0)))
    found = regions.filter(filled("speaker")).select(F.trim("speaker").alias("source"), "speaker_gender", F.struct("page_id", "region_id").alias("at"))
    found = found.groupBy("source").agg(F.min_by("speaker_gender", F.when(F.col("speaker_gender") != "", F.col("at"))).alias("found"))
    df = found.join(existing, "source", "full_outer")
    keep = lambda c: F.coalesce(c, F.lit(""))
    gender = F.when(filled("gender"), F.col("gender")).otherwise(keep("found"))
    return df.select("source", keep("target").alias("target"), gender.alias("gender"), keep("note").alias("note"))


def page_script(blocks: DataFrame) -> DataFrame:
    """One text a page: its blocks as `id. [type] text`, in reading order."""
    line = F.concat(F.col("region_id").cast("string"), F.lit(". ["), "block_type", F.lit("] "), "text")
    return blocks.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("script"))


# ---------------------------------------------------------------- routes and leaks


def route_blocks(blocks: DataFrame, target: str, source: str | None = None) -> DataFrame:
    """blocks with cyr, lat, other and the route of their script: skip, ru, en or uncovered; an explicit source overrides ru and en."""
    c = F.col
    uncovered = (c("other") > c("cyr")) & (c("other") > c("lat"))
    cyrillic = F.when(F.lit(target in CYRILLIC_TARGETS), "skip").otherwise("ru")
    latin = F.when(F.lit(target == "en"), "skip").otherwise("en")
    route = F.when(uncovered, "uncovered").when((c("cyr") == 0) & (c("lat") == 0), "skip").when(c("cyr") >= c("lat"), cyrillic).otherwise(latin)
    if source:
        route = F.when(F.lit(source == target), "skip").otherwise(source)
    counts = F.struct(*[v.alias(k) for k, v in script_counts("text").items()])
    return once(blocks.drop("cyr", "lat", "other"), counts).withColumn("route", route)


def leaks(target: str) -> Column:
    """Whether text of counts cyr, lat, other shows another script than the target's."""
    c = F.col
    foreign, home = c("other"), c("cyr") + c("lat")
    if target in CYRILLIC_TARGETS:
        foreign, home = c("lat") + c("other"), c("cyr")
    elif target == "en":
        foreign, home = c("cyr") + c("other"), c("lat")
    return (foreign > 0) & ((home == 0) | ((foreign >= 4) & (4 * foreign >= home + foreign)))


def leak_tokens(docs: DataFrame, target: str, allowed: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """docs with cyr, lat, other (see token_counts; quotes, addresses and allowed terms do not count) and leak."""
    df = once(docs.drop("cyr", "lat", "other"), F.struct(own_words(text, allowed).alias("_own")))
    return once(df, token_counts(F.col("_own"))).drop("_own").withColumn("leak", leaks(target))


def leak_audit(docs: DataFrame, target: str, by: list[str], allowed: tuple[str, ...] = ()) -> DataFrame:
    df = leak_tokens(docs, target, allowed)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("leak").alias("n_leak"), F.round(F.avg(F.col("leak").cast("int")), 6).alias("rate"))


def unchanged_words(blocks: DataFrame, target: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """blocks(text, translation) with unchanged: a word of four Latin letters or more, all small or all capital, is in both, quotes, addresses and
    allowed terms aside."""
    words = lambda c, pattern: F.transform(F.regexp_extract_all(own_words(c, allowed), F.lit(pattern), F.lit(0)), F.lower)
    own, left = words("text", r"\b(?:[A-Z]{4,}|[a-z]{4,})\b"), words("translation", r"\b[A-Za-z]{4,}\b")
    return blocks.withColumn("unchanged", F.lit(target in CYRILLIC_TARGETS) & F.coalesce(F.arrays_overlap(own, left), F.lit(False)))


def rewrite_set(blocks: DataFrame, target: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Blocks whose translation leaks or keeps foreign words."""
    df = leak_tokens(unchanged_words(blocks, target, allowed), target, allowed, "translation")
    return df.filter(F.col("leak") | F.col("unchanged")).drop("cyr", "lat", "other", "leak")


def accept_proofread(blocks: DataFrame, revised: DataFrame, target: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """blocks with the last revised translation (page_id, region_id, ord, revised) where it is filled and does not leak."""
    ok = leak_tokens(revised.filter(filled("revised")), target, allowed, "revised").filter(~F.col("leak"))
    last = ok.groupBy("page_id", "region_id").agg(F.max_by("revised", "ord").alias("revised"))
    return blocks.join(last, ["page_id", "region_id"], "left").withColumn("translation", F.coalesce("revised", "translation")).drop("revised")


# ---------------------------------------------------------------- replies and memory


def apply_replies(regions: DataFrame, replies: DataFrame) -> DataFrame:
    """The last reply of a region (page_id, region_id, ord, translation, speaker, speaker_gender) takes the place of its fields, but on locked rows."""
    last = replies.groupBy("page_id", "region_id").agg(F.max_by(F.struct("translation", "speaker", "speaker_gender"), "ord").alias("_reply"))
    gender = F.lower("_reply.speaker_gender")
    new = {"translation": F.trim("_reply.translation"), "speaker": F.trim("_reply.speaker"), "speaker_gender": F.when(gender.isin(list(GENDERS)), gender).otherwise("unknown")}
    free = F.col("_reply").isNotNull() & ~F.col("translation_locked")
    return regions.join(last, ["page_id", "region_id"], "left").withColumns({c: F.when(free, v).otherwise(F.col(c)) for c, v in new.items()}).drop("_reply")


def missing_replies(regions: DataFrame, replies: DataFrame) -> DataFrame:
    """(page_id, region_id) without a filled reply."""
    return regions.select("page_id", "region_id").join(replies.filter(filled("translation")), ["page_id", "region_id"], "left_anti")


def missing_by_page(regions: DataFrame, replies: DataFrame) -> DataFrame:
    df = missing_replies(regions, replies).groupBy("page_id").agg(F.array_sort(F.collect_list("region_id")).alias("ids"))
    return df.select("page_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("untranslated"))


def with_memory(blocks: DataFrame, memory: DataFrame, text: str = "text", pair: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """memory(text, translation, and the columns of `pair`: languages) → (blocks with `translated`, or null where memory has none, the distinct texts, by
    pair, that remain to be translated). Texts of fewer than two characters, blanks at the ends left out, are their own translation; of several
    in memory the least holds. What remains after translation is its own (see models.translate)."""
    keys = [text, *pair]
    m = memory.groupBy(F.col("text").alias("_key0"), *[F.col(c).alias(f"_key{i + 1}") for i, c in enumerate(pair)]).agg(F.min("translation").alias("translated"))
    on = F.lit(True)
    for i, c in enumerate(keys):
        on &= F.col(c) == F.col(f"_key{i}")
    df = blocks.join(m, on, "left").drop(*[f"_key{i}" for i in range(len(keys))])
    short = F.char_length(F.regexp_replace(text, r"^\s+|\s+$", "")) < 2
    df = df.withColumn("translated", F.when(short, F.col(text)).otherwise(F.col("translated")))
    return df, df.filter(F.col("translated").isNull()).select(*keys).distinct()


def settings_fingerprint(settings: str | Column) -> Column:
    """Digest of settings as JSON text: sha256 of the object in one form, with keys in order at every level, no blanks, and numbers by their value; a text
    that is no object is its own, without blanks at its ends."""
    text = F.col(settings) if isinstance(settings, str) else settings
    one_form = F.to_json(F.try_parse_json(text))  # a VARIANT object has its keys in order
    return F.when(F.trim(text).startswith("{") & one_form.isNotNull(), F.sha2(one_form, 256)).otherwise(F.trim(text))


def cache_token(parts: list[Column]) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("v2"), *[F.lower(F.trim(p)) for p in parts]), 256)


def cache_lookup(submissions: DataFrame, cache: DataFrame) -> DataFrame:
    """Submissions with their token and whether the cache (token) has it; `fresh` ones never hit."""
    token = cache_token([F.col(c) for c in ("image_sha", "source_lang", "target_lang", "fingerprint")])
    df = submissions.withColumn("token", token).join(cache.select("token", F.lit(True).alias("known")).distinct(), "token", "left")
    return df.withColumn("hit", F.coalesce("known", F.lit(False)) & ~F.col("fresh")).drop("known")


def skip_existing(pages: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages to do, pages that have an output)."""
    return pages.join(outputs, "page_id", "left_anti"), pages.join(outputs, "page_id", "left_semi")


#: Fields of a region whose changes ask for new cleaning, or for new setting alone.
CLEAN_FIELDS = ("x", "y", "w", "h", "bx", "by", "bw", "bh", "skip", "block_type", "text", "auto_layout")
TYPESET_FIELDS = ("translation", "text_position", "speaker", "speaker_gender", "style")


def diff_documents(prev: DataFrame, new: DataFrame, prev_pages: DataFrame, new_pages: DataFrame) -> DataFrame:
    """Regions (page_id, region_id and what there is of the fields above) and pages(page_id, strokes, direction) of two versions → page_id, plan
    (none, typeset or clean) and the ids to set again: those with other typeset fields, all where the direction changed, none where the
    sets of ids differ."""
    sides = {"p": prev, "n": new}
    one = lambda s: F.struct(*[F.col(c) for c in (*CLEAN_FIELDS, *TYPESET_FIELDS) if c in prev.columns]).alias(s)
    p, n = (sides[s].select("page_id", "region_id", one(s)) for s in sides)
    return diff_versions(p.unionByName(n, allowMissingColumns=True), prev_pages, new_pages)


def diff_versions(versions: DataFrame, prev_pages: DataFrame, new_pages: DataFrame) -> DataFrame:
    """As diff_documents, of a table with a row for each region of each version: page_id, region_id and the fields as a struct, in p or in n. It is dealt
    by page once."""
    fields = [f.name for f in versions.schema["p"].dataType]
    unknown = F.col("page_id").isNull() | F.col("region_id").isNull()  # such rows are nobody's counterpart
    both = versions.repartition("page_id").groupBy("page_id", "region_id", F.when(unknown, F.col("n").isNull()).alias("_side")).agg(F.collect_list("p").alias("ps"), F.collect_list("n").alias("ns"))
    both = both.withColumn("p", F.explode_outer("ps")).withColumn("n", F.explode_outer("ns"))
    differs = lambda cs: F.array_contains(F.array(*[~F.col(f"p.{c}").eqNullSafe(F.col(f"n.{c}")) for c in cs if c in fields]), True)
    lone = F.col("p").isNull() | F.col("n").isNull()
    df = both.select("page_id", "region_id", lone.alias("lone"), differs(CLEAN_FIELDS).alias("c"), differs(TYPESET_FIELDS).alias("t"))
    ids = lambda c: F.array_join(F.array_sort(F.collect_list(c)).cast("array<string>"), ",")
    df = df.groupBy("page_id").agg(F.bool_or("lone").alias("other"), F.bool_or("c").alias("c"), F.bool_or("t").alias("t"),
                                   ids(F.when(F.col("t"), F.col("region_id"))).alias("some"), ids("region_id").alias("all"))
    pages = prev_pages.alias("p").join(new_pages.alias("n"), "page_id", "full_outer").select(
        "page_id", (~F.col("p.strokes").eqNullSafe(F.col("n.strokes"))).alias("drawn"), (~F.col("p.direction").eqNullSafe(F.col("n.direction"))).alias("turned"))
    df = df.join(pages, "page_id", "full_outer").fillna(False, ["other", "c", "t", "drawn", "turned"]).fillna("", ["some", "all"])
    plan = F.when(F.col("drawn") | F.col("other") | F.col("c"), "clean").when(F.col("turned") | F.col("t"), "typeset").otherwise("none")
    return df.select("page_id", plan.alias("plan"), F.when(F.col("other"), "").when(F.col("turned"), F.col("all")).otherwise(F.col("some")).alias("ids"))


def stale_layouts(regions: DataFrame, inputs: list[str]) -> DataFrame:
    """regions(version, stored, size, lines, inputs) with stale: the snapshot is of another version, another input or empty."""
    key = F.to_json(F.struct(*inputs))
    ok = (F.col("version") == 1) & (F.col("stored") == key) & (F.col("size") > 0) & (F.col("lines") > 0)
    return regions.withColumn("stale", ~F.coalesce(ok, F.lit(False)))


# ---------------------------------------------------------------- types and roles

#: Words for actions, which are not labels.
ACTIONS = ("startle", "shake", "whisper", "squeeze", "pull", "kiss", "glance", "jiggle", "shiver", "tremble", "nod", "gulp", "nudge", "poke", "pat", "blush", "giggle", "sniff", "sob")
#: What is an address or a handle on a sign.
_SIGN = r"@[\w.-]+|(?i:https?://|www\.|\b[\w.-]+\.(com|net|org|ru|io|me|tv|gg)(/|\b))"
_MARKS = " .!?,;:-…"


def _known_words(blocks: DataFrame, sounds: DataFrame) -> DataFrame:
    """(_t, _known): the words of each text, and the text itself, that are in the dictionary: an equality join, of any size."""
    bare = lambda w: F.upper(F.btrim(w, F.lit(_MARKS)))
    texts = blocks.select(F.trim("text").alias("_t")).filter("_t <> ''").distinct()
    words = texts.select("_t", F.explode(F.array_distinct(F.transform(F.concat(F.array("_t"), F.split("_t", r"\s+")), bare))).alias("word"))
    return words.join(sounds.select("word").distinct(), "word").groupBy("_t").agg(F.collect_set("word").alias("_known"))  # words of one text


def classify_blocks(blocks: DataFrame, sounds: DataFrame | None = None) -> DataFrame:
    """blocks(text, in_bubble) with the type that their text and place suggest; sounds(word): the dictionary, in capitals."""
    none = F.array().cast("array<string>")
    df = blocks.withColumn("_t", F.trim("text"))
    df = df.join(_known_words(blocks, sounds), "_t", "left").withColumn("_known", F.coalesce("_known", none)) if sounds is not None else df.withColumn("_known", none)
    t = F.col("_t")
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    bare = F.lower(F.btrim(t, F.lit(_MARKS)))
    in_dict = lambda w: F.array_contains("_known", F.upper(F.btrim(w, F.lit(_MARKS))))
    tokens = F.array_distinct(F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(_MARKS)))))
    letters, n = t.rlike(r"\p{L}"), F.size(words)
    capitals = F.upper(t) == t
    shout = letters & capitals & (F.length(t) <= 24)
    sequence = (n > 0) & F.forall(words, in_dict)
    kind = (
        F.when(F.col("in_bubble"), "dialogue")
        .when(t.rlike(_SIGN), "sign")
        .when((shout & ((n <= 2) | (F.size(tokens) == 1) | sequence)) | bare.isin(list(ACTIONS)) | in_dict(t), "sfx")
        .when((n >= 3) & capitals, "narration")
        .when(t.rlike(r"(!|\?|…|\.\.\.)$"), F.when(n == 1, "sfx").otherwise("narration"))
        .when(letters & ((F.length(t) <= 12) | ((n <= 3) & (F.length(t) <= 24))), "sign").otherwise("narration")
    )
    return df.withColumn("block_type", kind).drop("_t", "_known")


#: What laughter is written as.
LAUGHTER = ("хаха", "хихи", "хех", "хохо", "haha", "hehe", "hihi", "lol", "лол", "кек")


def assign_roles(regions: DataFrame, catalog: DataFrame, laughter: tuple[str, ...] = LAUGHTER) -> DataFrame:
    """regions with the font role of their type and place. A role that a region has stays, and so does that of manual and edited ones, empty or not;
    roles that the catalog (role) lacks fall back or leave the region's as it is."""
    folded = F.lower(F.regexp_replace("text", r"\s", ""))
    digits, stripped = F.regexp_count("text", F.lit("[0-9]")), F.trim("text")
    capital = F.col("text").rlike(r"\p{L}") & (F.upper("text") == F.col("text"))
    bubble, kind = F.col("bx").isNotNull(), F.col("block_type")
    laugh = F.lit(False)
    for w in laughter:
        laugh |= F.contains(folded, F.lit(w))
    tech = (stripped != "") & (F.length(stripped) <= 8) & ((digits >= 2) | ((digits >= 1) & stripped.rlike("[A-Za-z]")))
    role = (
        F.when(F.col("document"), None).when(kind == "sfx", F.when(laugh, "sfx_comedy").when(tech, "sfx_tech").otherwise("sfx"))
        .when(bubble & kind.isin("dialogue", "narration", ""), "dialogue").when(kind == "title", "title")
        .when(kind == "sign", F.when(capital, "stencil").otherwise("handwritten")).when(kind == "noise", "pixel")
        .when(bubble, "dialogue").when(capital, "shout").otherwise("handwritten")
    )
    df = regions.withColumn("_role", F.when(~(F.col("manual") | F.col("edited")), role))
    has = catalog.select(F.col("role").alias("_role"), F.lit(True).alias("_has")).distinct()
    there = lambda r: catalog.agg(F.coalesce(F.bool_or(F.col("role") == r), F.lit(False))).scalar()
    df = df.join(has, "_role", "left").withColumns({"_shout": there("shout"), "_speech": there("dialogue")})
    fallback = F.when(F.col("_role") == "title", F.when(F.col("_shout"), "shout").when(F.col("_speech"), "dialogue"))
    before = F.col("role") if "role" in regions.columns else F.lit(None).cast("string")
    new = F.coalesce(F.when(F.col("_has"), F.col("_role")).otherwise(fallback), before)
    keeps = F.col("manual") | F.col("edited") | F.coalesce(F.trim(before) != "", F.lit(False))
    return df.withColumn("role", F.when(keeps, before).otherwise(new)).drop("_role", "_has", "_shout", "_speech")


def parse_replies(raw: DataFrame, schema: str, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(rows with `reply` parsed, rows that hold no JSON object). Thoughts go; then the whole text, a fenced block, or all from the
    first brace to the last."""
    text = F.regexp_replace(F.col(body), r"(?is)<think>.*?</think>", "")
    text = F.btrim(F.regexp_replace(text, r"(?is)^.*</think>", ""), F.lit(" \t\r\n"))
    tries = [text, F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1)]
    usable = [F.when(F.trim(t).startswith("{") & F.try_parse_json(t).isNotNull(), t) for t in tries]
    df = raw.withColumn("_json", F.coalesce(*usable))
    return df.filter(F.col("_json").isNotNull()).withColumn("reply", F.from_json("_json", schema)).drop("_json"), df.filter(F.col("_json").isNull()).drop("_json")


def finish_status(pages: DataFrame, fallbacks: tuple[str, ...] = ("offline",)) -> DataFrame:
    """pages(warnings, result_version, visual_version) with the status of a finished page."""
    named = F.exists("warnings", lambda w: F.lower(w).rlike("|".join(fallbacks)))
    return pages.withColumn("status", F.when(named, "offline").when(F.col("visual_version") > F.col("result_version"), "edited").otherwise("done"))


# ---------------------------------------------------------------- models


def apply_page_model(df: DataFrame, fn: Callable, schema: str, fallback: Callable | None = None, attempts: int = 3) -> DataFrame:
    """fn(pandas batch) → pandas batch of the schema. A batch that fails `attempts` times is halved, down to the rows that fail alone; these
    go to the fallback, and if that fails too they come back with nulls and the column `error`."""
    from pyspark.sql.types import _parse_datatype_string

    names = _parse_datatype_string(schema).names

    def run(batches):
        import pandas as pd

        def tried(b, functions):
            error = None
            for f in functions:
                try:
                    return f(b), None
                except Exception as e:  # noqa: BLE001 - a user's model may fail in any way; the row says so
                    error = f"{type(e).__name__}: {e}"
            return None, error

        def done(b, again: bool, failed: list):
            """Frames of what fn does; the rows that fail alone go to `failed`."""
            out, error = tried(b, [fn] * (attempts if again else 1))
            if out is not None:
                yield out.assign(error=None)
            elif len(b) > 1:
                half = len(b) // 2
                yield from done(b.iloc[:half], False, failed)
                yield from done(b.iloc[half:], False, failed)
            else:
                failed.append((b, error))

        def spared(failed: list):
            """Rows that failed, together: by the fallback if there is one, halved as above, else nulls and their errors."""
            b = pd.concat([x for x, _ in failed])
            out, error = tried(b, [fallback]) if fallback else (None, None)
            if out is not None:
                yield out.assign(error=None)
            elif fallback and len(failed) > 1:
                half = len(failed) // 2
                yield from spared(failed[:half])
                yield from spared(failed[half:])
            else:
                out = pd.DataFrame({c: b[c] if c in b else None for c in names}, index=b.index)
                yield out.assign(error=[error or e for _, e in failed])

        for b in batches:
            failed = []
            # few frames go back, however many rows fail alone
            frames = list(done(b, True, failed))
            if failed:
                frames += spared(failed)
            yield pd.concat(frames) if len(frames) > 1 else frames[0]

    return df.mapInPandas(run, f"{schema}, error string")


def apply_text_model(blocks: DataFrame, fn: Callable, text: str = "text") -> DataFrame:
    """blocks with `translated`: fn(series of distinct texts) runs once for each distinct text."""

    def run(b):
        return b.assign(translated=fn(b[text]))

    distinct = apply_page_model(blocks.select(text).distinct(), run, f"{text} string, translated string").drop("error")
    return blocks.join(distinct, text, "left")


def apply_with_retry(blocks: DataFrame, fn: Callable, again: Callable, text: str = "text") -> DataFrame:
    """As apply_text_model, and once more with `again` for texts that came back empty."""
    first = apply_text_model(blocks, fn, text)
    rest = apply_text_model(first.filter(~filled("translated")).select(text).distinct(), again, text).withColumnRenamed("translated", "_more")
    return first.join(rest, text, "left").withColumn("translated", F.when(filled("translated"), F.col("translated")).otherwise(F.col("_more"))).drop("_more")


def story_order(blocks: DataFrame) -> DataFrame:
    """Story blocks of each page with their position."""
    df = blocks.filter(F.col("block_type").isin(list(STORY_TYPES)))
    return df.withColumn("ord", (F.row_number().over(Window.partitionBy("page_id").orderBy("y", "x", "region_id")) - 1).cast("long"))
