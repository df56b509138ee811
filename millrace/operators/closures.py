"""Python closures over Arrow batches, for what has no Column form.

They are opaque to the optimizer and need the output schema; rows travel in
batches.  Values are handed over as Python objects: a row of one column as its
value, others as tuples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..workers import prepare

#: Keys that a task combines before it passes them on.
FLUSH_KEYS = 100_000


def _schema(schema: str | T.StructType) -> T.StructType:
    parsed = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return parsed if isinstance(parsed, T.StructType) else T.StructType([T.StructField("value", parsed)])


def _items(batch: pa.RecordBatch) -> Iterator[Any]:
    cols = [c.to_pylist() for c in batch.columns]
    return iter(cols[0]) if len(cols) == 1 else zip(*cols, strict=True)


def _batch(items: list[Any], schema: pa.Schema) -> pa.RecordBatch:
    cols = [items] if len(schema) == 1 else [list(c) for c in zip(*items, strict=True)] or [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def flat_map_rows(df: DataFrame, f: Callable[[Any], Iterable[Any]], schema: str | T.StructType, batch_rows: int = 10_000, only: tuple[Callable[[Any], bool], ...] = ()) -> DataFrame:
    """Zero or more rows for each row, in order; the inner iterable is never held whole.

    only: conditions that a row must meet to come to f, asked in the same pass.
    """
    prepare(df.sparkSession)
    out = _schema(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Any] = []
        for batch in batches:
            for item in _items(batch):
                if not all(p(item) for p in only):
                    continue
                for made in f(item):
                    held.append(made)
                    if len(held) == batch_rows:
                        yield _batch(held, arrow)
                        held = []
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, out)


def map_rows(df: DataFrame, f: Callable[[Any], Any], schema: str | T.StructType, only: tuple[Callable[[Any], bool], ...] = ()) -> DataFrame:
    """A row for each row that meets all conditions in only."""
    prepare(df.sparkSession)
    out = _schema(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = _items(batch)
            for p in only:
                items = filter(p, items)
            yield _batch([f(x) for x in items], arrow)

    return df.mapInArrow(run, out)


def filter_rows(df: DataFrame, *only: Callable[[Any], bool]) -> DataFrame:
    """The rows that meet all conditions."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([all(f(x) for f in only) for x in _items(batch)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def combine_partitions(df: DataFrame, create: Callable, merge_value: Callable, merge_combiners: Callable, combiner: str | T.DataType, flush: int = FLUSH_KEYS) -> DataFrame:
    """key, value of a flow of two columns: combined in each task, shuffled, combined again.

    A task holds ``flush`` keys at most before it passes partial results on; the
    last step holds one combiner and one batch of a key's partial results.
    """
    prepare(df.sparkSession)
    key = df.columns[0]
    kind = T._parse_datatype_string(combiner) if isinstance(combiner, str) else combiner
    out = T.StructType([df.schema[key], T.StructField(df.columns[1], kind)])
    arrow = to_arrow_schema(out)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Any, Any] = {}
        for batch in batches:
            for k, v in _items(batch):
                held[k] = merge_value(held[k], v) if k in held else create(v)
                if len(held) >= flush:
                    yield _batch(list(held.items()), arrow)
                    held = {}
        yield _batch(list(held.items()), arrow)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = total = None
        seen = False
        for batch in batches:
            for k, x in _items(batch):
                total, seen = (merge_combiners(total, x), True) if seen else (x, True)
        yield _batch([(k, total)], arrow)

    return df.mapInArrow(partial, out).groupBy(key).applyInArrow(final, out)


def reduce_rows(df: DataFrame, f: Callable[[Any, Any], Any]) -> list[Any]:
    """The fold of each partition that has rows, in the order of the partitions."""
    prepare(df.sparkSession)
    arrow = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = None, False
        for batch in batches:
            for x in _items(batch):
                total, seen = (f(total, x), True) if seen else (x, True)
        if seen:
            yield _batch([total], arrow)

    rows = df.mapInArrow(run, df.schema).collect()  # one row for each partition
    return [r[0] if len(r) == 1 else tuple(r) for r in rows]
