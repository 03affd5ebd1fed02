"""Batch models in tasks: loaded when the first row comes, once for each task and route, closed with the task; failures are told by row.

A model is made by `load(route)` in the worker and called with a data frame; if it has a `close`, that is called when its route or the task ends, also
where the task fails. A load that fails `attempts` times is not tried again by that task: all its rows come back with nulls and `error`, which
begins with `load:`. A batch that fails is halved down to the rows that fail alone; these go to the fallback, then come back with `error`."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from .filters import filled
from .localization import route_blocks

#: Tasks that a route's texts are dealt to, so that one language does not make one task.
SPREAD = 64


def apply_loaded_model(df: DataFrame, load: Callable, schema: str, route: str | None = None, fallback: Callable | None = None, attempts: int = 3) -> DataFrame:
    """The rows that load(route)(batch) gives, of the schema, with `error`. With a route column rows should come sorted by it within partitions."""
    names = _parse_datatype_string(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, model, failed = None, None, None  # of one route

        def close() -> None:
            nonlocal model
            if model is not None and hasattr(model, "close"):
                model.close()
            model = None

        def tried(b: pd.DataFrame, functions: list[Callable]) -> tuple[pd.DataFrame | None, str | None]:
            error = None
            for f in functions:
                try:
                    return f(b), None
                except Exception as e:  # noqa: BLE001 - a user's model may fail in any way; the row says so
                    error = f"{type(e).__name__}: {e}"
            return None, error

        def missing(b: pd.DataFrame, error: str | None) -> pd.DataFrame:
            return pd.DataFrame({c: b[c] if c in b else None for c in names}, index=b.index).assign(error=error)

        def given(out: pd.DataFrame) -> pd.DataFrame:
            return out.assign(error=None)[[*names, "error"]]

        def done(b: pd.DataFrame, times: int) -> Iterator[pd.DataFrame]:
            out, error = tried(b, [model] * times)
            if out is None and len(b) > 1:
                half = len(b) // 2
                yield from done(b.iloc[:half], 1)
                yield from done(b.iloc[half:], 1)
                return
            if out is None and fallback:
                out, error = tried(b, [fallback])
            yield missing(b, error) if out is None else given(out)

        try:
            for batch in batches:
                parts = batch.groupby(route, sort=False, dropna=False) if route else [(None, batch)]
                for name, part in parts:
                    name = None if pd.isna(name) else name
                    if (name,) != held:
                        close()
                        held, failed = (name,), None
                        for _ in range(attempts):
                            try:
                                model, failed = load(name), None
                                break
                            except Exception as e:  # noqa: BLE001 - as above
                                failed = f"load: {type(e).__name__}: {e}"
                    if failed is None:
                        yield from done(part, attempts)
                    elif fallback:
                        out, _ = tried(part, [fallback])
                        yield missing(part, failed) if out is None else given(out)
                    else:
                        yield missing(part, failed)
        finally:
            close()

    return df.mapInPandas(run, f"{schema}, error string")


def stripped_length(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"^\s+|\s+$", ""))


def translate(blocks: DataFrame, load: Callable, target: str, source: str | None = None, memory: DataFrame | None = None, attempts: int = 3, spread: int = SPREAD) -> DataFrame:
    """blocks(text, translation, translation_locked, speaker_gender, ...) with their translations and `warning`. load(route) gives a model of the pair
    (route, target): a series of texts → a series.

    By the route of each text's script (see route_blocks) or the explicit source: locked rows stay as they are; what needs no translation is its
    own; scripts without a pair stay, with the warning `uncovered`, and so do those of a model that does not load (`no pair ...`). Texts of fewer
    than two characters, blanks at the ends left out, and those that a model leaves empty or fails on, are their own translation. Each distinct
    text of a pair is translated once; memory(text, source, target, translation) knows some, of several the least. Filled rows without a
    speaker's gender get `unknown`."""
    locked = F.coalesce("translation_locked", F.lit(False))
    rows = route_blocks(blocks, target, source).drop("cyr", "lat", "other")
    rows = rows.withColumn("_do", ~locked & ~F.col("route").isin("skip", "uncovered") & (stripped_length(F.col("text")) >= 2))
    wanted = rows.filter("_do").select("text", "route").distinct()
    known = None
    if memory is not None:
        known = memory.filter((F.col("target") == target) & filled("translation")).groupBy("text", F.col("source").alias("route")).agg(F.min("translation").alias("_new"))
        wanted = wanted.join(known, ["text", "route"], "left_anti")
    dealt = wanted.repartition("route", F.pmod(F.xxhash64("text"), F.lit(spread))).sortWithinPartitions("route")

    def loaded(name):
        model = load(name)

        class One:
            def __call__(self, b: pd.DataFrame) -> pd.DataFrame:
                return b.assign(_new=model(b["text"]))

            def close(self) -> None:
                if hasattr(model, "close"):
                    model.close()

        return One()

    found = apply_loaded_model(dealt, loaded, "text string, route string, _new string", "route", attempts=attempts)
    if known is not None:
        found = found.unionByName(known.withColumn("error", F.lit(None).cast("string")))
    rows = rows.join(found, ["text", "route"], "left")
    unloaded = F.coalesce(F.col("error").startswith("load:"), F.lit(False))
    warning = F.when(locked, None).when(F.col("route") == "uncovered", "uncovered").when(F.col("_do") & unloaded, F.concat(F.lit("no pair "), "route", F.lit(f"-{target}")))
    stays = locked | warning.isNotNull()
    new = F.when(F.col("_do") & filled("_new"), F.col("_new")).otherwise(F.col("text"))
    gender = F.when(~stays & ~filled("speaker_gender"), "unknown").otherwise(F.col("speaker_gender"))
    done = rows.withColumns({"warning": warning, "translation": F.when(stays, F.col("translation")).otherwise(new), "speaker_gender": gender})
    return done.select(*blocks.columns, "route", "warning")
