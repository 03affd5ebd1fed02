"""Order-dependent logic over groups, as one streaming pass for each partition.

For choices whose result hangs on earlier choices of the same group (a page, a job, a key). Rows are dealt by the keys and sorted, and go
through the fold as plain tuples, without a data frame for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

BATCH = 10_000


def per_group_running(df: DataFrame, keys: Sequence[str], order: Sequence, fold: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str | StructType) -> DataFrame:
    """fold gets the rows of a group one at a time, in order, as tuples of df's columns, and gives rows of the schema as it goes: what a task holds
    is what the fold keeps, however many rows a group has. A null key is a group of its own."""
    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow, at = to_arrow_schema(schema), [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        for _, own in groupby(rows, key=lambda row: [row[k] for k in at]):
            for row in fold(own):
                out.append(row)
                if len(out) >= BATCH:
                    yield packed(out)
                    out = []
        if out:
            yield packed(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def per_group(df: DataFrame, keys: Sequence[str], order: Sequence, fold: Callable[[list[tuple]], Iterable[tuple]], schema: str | StructType) -> DataFrame:
    """As per_group_running, for folds that look at a whole group, which a task then holds as a list: for pages, whose rows are tens."""
    return per_group_running(df, keys, order, lambda rows: fold(list(rows)), schema)


def per_batch(df: DataFrame, keys: Sequence[str], order: Sequence, fold: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """As per_group, for folds by arrays: fold gets many whole groups at once, as a batch of df's columns and the number of the group of each row, and
    gives a batch of the schema. A batch has some 10,000 rows, or one group."""
    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow, at = to_arrow_schema(schema), [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_groups(batches, at):
            out = fold(whole, np.cumsum(starts(*[whole.column(k) for k in at])) - 1)
            if out.num_rows:
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out.columns, arrow, strict=True)], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _whole_groups(batches: Iterator[pa.RecordBatch], at: list[int]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where a group ends."""
    held: list[pa.RecordBatch] = []  # no group ends in them but at their end
    for b in batches:
        if not b.num_rows:
            continue
        # The first row is compared with the last one held.
        joint = [pa.concat_arrays([held[-1].column(k)[-1:], b.column(k)]) if held else b.column(k) for k in at]
        first = np.flatnonzero(starts(*joint)[1:] if held else starts(*joint))
        if not len(first):
            held.append(b)
            continue
        last = int(first[-1])
        if last or held:
            yield pa.concat_batches([*held, b[:last]])
        held = [b[last:]]
    if held:
        yield pa.concat_batches(held)


def starts(*columns: pa.Array) -> np.ndarray:
    """Whether a row's values differ from those of the row before; a null is like a null alone."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        null = np.asarray(c.is_null())
        same = np.asarray(pc.fill_null(pc.equal(c[1:], c[:-1]), False))
        new[1:] |= ~(same | (null[1:] & null[:-1]))
    return new
