"""Folds by Column lambdas: any associative and commutative function, in the JVM.

Combining may start anew at any value, so folding is merging what ``create`` makes of
each value.  Where the merge is one of the built-in aggregates' (a sum, a minimum, a
maximum, a logical or bitwise and/or/xor), or does one of them to each field of a
struct, that aggregate is used: partial, one exchange, final.

Any other merge is done to the values of a batch of rows first.  Arrow gathers a batch's
values by key without looking at them, and the JVM folds each such list, so what is
shuffled is one combiner for each key of a batch.  Then come a fold for each key and one of
``SALTS`` groups of partitions, and one for each key.  A list holds a batch, a salt's
partial results, or SALTS values, however hot a key is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import prepare

Fold2 = Callable[[Column, Column], Column]
SALTS = 256


def loose(kind: T.DataType) -> T.DataType:
    """The type with every part nullable, which any value of it can be cast to."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, loose(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(loose(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(loose(kind.keyType), loose(kind.valueType))
    return kind


def result_type(df: DataFrame, expr: Column) -> T.DataType:
    return loose(df.select(expr.alias("x")).schema["x"].dataType)


def combiner_type(df: DataFrame, value: str, create: Callable[[Column], Column], merge: Fold2) -> T.DataType:
    """The type that creating and merging settle on (a sum of ints stays what merging makes of it)."""
    kind = result_type(df, create(F.col(value)))
    return result_type(df, merge(create(F.col(value)).cast(kind), F.col(value)))


def _strict(made: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Null as soon as one value is, as an operator of two columns has it."""
    return lambda c: F.when(F.count(c) == F.count(F.lit(1)), made(c))


def _logical(made: Callable[[Column], Column], settles: bool) -> Callable[[Column], Column]:
    """One value that settles it counts more than a null."""
    return lambda c: F.when(made(c) == F.lit(settles), F.lit(settles)).when(F.count(c) == F.count(F.lit(1)), made(c))


def _shapes(kind: T.DataType) -> list[tuple[Fold2, Callable[[Column], Column]]]:
    """Merges of this type that a built-in aggregate does."""
    out: list[tuple[Fold2, Callable[[Column], Column]]] = []
    if isinstance(kind, T.BooleanType):
        out += [(lambda a, b: a & b, _logical(F.bool_and, False)), (lambda a, b: a | b, _logical(F.bool_or, True))]
    if isinstance(kind, T.NumericType):
        out.append((lambda a, b: a + b, _strict(F.sum)))
    if isinstance(kind, T.IntegralType):
        out += [(lambda a, b: a.bitwiseAND(b), _strict(F.bit_and)), (lambda a, b: a.bitwiseOR(b), _strict(F.bit_or)), (lambda a, b: a.bitwiseXOR(b), _strict(F.bit_xor))]
    if isinstance(kind, T.AtomicType):
        out += [(F.greatest, F.max), (F.least, F.min)]
    return out


def built_in(df: DataFrame, kind: T.DataType, merge: Fold2) -> Callable[[Column], Column] | None:
    """The aggregate that does what merge does, if the plan shows one."""
    if not hasattr(df, "_jdf"):
        return None
    a, b = F.col("__a"), F.col("__b")
    fields = [f.name for f in kind] if isinstance(kind, T.StructType) else [None]
    tried, made = [], []
    for f in fields:
        x, y, of = (a, b, kind) if f is None else (a[f], b[f], kind[f].dataType)
        for shape, aggregate in _shapes(of):
            tried += [shape(x, y), shape(y, x)]
            made += [(f, aggregate)] * 2
    probe = df.sparkSession.createDataFrame([], T.StructType([T.StructField("__a", kind), T.StructField("__b", kind)]))
    plan = probe.select(merge(a, b).alias("x"), *[c.alias(f"x{i}") for i, c in enumerate(tried)])._jdf.queryExecution().analyzed().projectList()
    whole = plan.apply(0).child()
    if fields == [None]:
        parts = [whole]
    elif whole.getClass().getSimpleName() == "CreateNamedStruct" and whole.valExprs().size() == len(fields):
        parts = [whole.valExprs().apply(i) for i in range(len(fields))]
    else:
        return None
    known = {(made[i][0], plan.apply(i + 1).child().sql()): made[i][1] for i in range(len(tried))}
    found = [known.get((f, p.sql())) for f, p in zip(fields, parts, strict=True)]
    if None in found:
        return None
    if fields == [None]:
        return lambda c: found[0](c).cast(kind)
    return lambda c: F.struct(*[g(c[f]).alias(f) for f, g in zip(fields, found, strict=True)]).cast(kind)


def _gathered(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and value: the values of each key of a batch of rows, in order, as an array. Nothing is shuffled."""
    prepare(df.sparkSession)
    kind = loose(df.schema[value].dataType)
    at = df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, index = batch.column(at), pa.array(range(batch.num_rows), pa.int64())
            own = [batch.column(i) for i, n in enumerate(batch.schema.names) if i != at]
            first, order, ends = [0], index, [0, batch.num_rows]
            if own:
                try:
                    groups = pa.table([*own, index], names=[*keys, "__i"]).group_by(keys, use_threads=False).aggregate([("__i", "list")])["__i_list"].combine_chunks()
                    order, ends = groups.flatten(), groups.offsets.to_pylist()
                    first = order.take(pa.array(ends[:-1])).to_pylist()
                except pa.ArrowNotImplementedError:  # keys that Arrow can't group
                    first, ends = index.to_pylist(), list(range(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.take(order))
            yield pa.record_batch([*(c.take(pa.array(first)) for c in own), lists], names=[*keys, value])

    return df.select(*keys, value).mapInArrow(run, T.StructType([*(df.schema[k] for k in keys), T.StructField(value, T.ArrayType(kind))])) if keys else df.select(value).mapInArrow(run, T.StructType([T.StructField(value, T.ArrayType(kind))]))


def _folded(items: Column, merge: Fold2, kind: T.DataType) -> Column:
    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), F.get(items, F.lit(0)).cast(kind), lambda a, x: merge(a, x.cast(kind)).cast(kind))


def fold_by_key(df: DataFrame, keys: list[str], value: str, create: Callable[[Column], Column], merge_value: Fold2, merge_combiners: Fold2) -> DataFrame:
    """keys and value: the combiner of each key. Null values are folded like any other."""
    kind = combiner_type(df, value, create, merge_value)
    made = df.select(*keys, create(F.col(value)).cast(kind).alias(value))
    if aggregate := built_in(df, kind, merge_combiners):
        return made.groupBy(*keys).agg(aggregate(F.col(value)).alias(value))
    part = _gathered(made, keys, value).select(*keys, _folded(F.col(value), merge_combiners, kind).alias(value), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("__salt"))

    def merged(rows: DataFrame, *by: str) -> DataFrame:
        items = F.transform(F.collect_list(F.struct(F.col(value).alias("v"))), lambda x: x["v"])
        return rows.groupBy(*by).agg(items.alias(value)).select(*by, _folded(F.col(value), merge_combiners, kind).alias(value))

    return merged(merged(part, *keys, "__salt"), *keys)


def fold_rows(df: DataFrame, value: str, merge: Fold2) -> DataFrame:
    """One row, or none over no rows: the fold of a column in the order of its partitions."""
    kind = combiner_type(df, value, lambda c: c, merge)
    rows = df.select(F.col(value).cast(kind).alias(value))
    if aggregate := built_in(df, kind, merge):
        return rows.agg(aggregate(F.col(value)).alias(value), F.count(F.lit(1)).alias("__n")).where("__n > 0").select(value)
    for _ in range(2):  # batches, then batches of those; what is left of a partition comes together
        rows = _gathered(rows, [], value).select(_folded(F.col(value), merge, kind).alias(value))
    whole = rows.select(F.monotonically_increasing_id().alias("at"), F.col(value).alias("v")).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("l")).where(F.size("l") > 0)
    return whole.select(_folded(F.transform("l", lambda x: x["v"]), merge, kind).alias(value))
