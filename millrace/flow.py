"""Flows: a dataset as a DataFrame, with the lineage of the operators that made it.

An operator takes a function of the row's columns.  It is called once, with an
object whose attributes are columns, and its result becomes part of the plan, so
filters are pushed down, columns pruned and aggregates combined before a shuffle.
Python closures have methods of their own (``*_py``) and need an output schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import operators
from .errors import EmptyDataset, SchemaMismatch
from .functions import Collect, Combiner
from .plans.lineage import Dependency, HashPartitioner, Node, stages_of, walk
from .plans.profile import action

_ids = count()


class Row:
    """Columns of a flow by attribute or by name: ``c.value``, ``c["value"]``."""

    def __init__(self, df: DataFrame):
        self._df = df

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_") and name not in self._df.columns:
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> Column:
        if name not in self._df.columns:
            raise AttributeError(f"no column {name!r}; there are {', '.join(self._df.columns)}")
        return F.col(f"`{name}`")


def projected(made: Column | dict[str, Column] | tuple[Column, ...]) -> list[Column]:
    """A column is ``value``; two are ``key`` and ``value``; a dict names its columns."""
    if isinstance(made, dict):
        return [c.alias(n) for n, c in made.items()]
    if isinstance(made, tuple):
        names = ["key", "value"] if len(made) == 2 else [f"_{i + 1}" for i in range(len(made))]
        return [c.alias(n) for n, c in zip(names, made, strict=True)]
    return [made.alias("value")]


class Flow:
    """An immutable, lazy dataset; branching from one flow is free."""

    def __init__(self, df: DataFrame, node: Node):
        self.df, self.node = df, node
        #: of a flow that Python conditions made: what they were asked of, and they
        self._asked: tuple[DataFrame, tuple[Callable[[Any], bool], ...]] = (df, ())

    @classmethod
    def source(cls, df: DataFrame) -> Flow:
        return cls(df, Node(next(_ids), "source", (), ()))

    def _next(self, df: DataFrame, kind: str = "narrow", partitioner: HashPartitioner | None = None, others: tuple[Flow, ...] = ()) -> Flow:
        parents = (self.node, *(o.node for o in others))
        deps = tuple(Dependency(p.id, kind == "shuffle") for p in parents)
        return Flow(df, Node(next(_ids), kind, parents, deps, partitioner))

    # transformations
    def map(self, f: Callable[[Row], Column | dict | tuple]) -> Flow:
        """One row for each row; order and partitions stay."""
        return self._next(self.df.select(*projected(f(Row(self.df)))))

    def filter(self, f: Callable[[Row], Column]) -> Flow:
        """The rows for which the condition is true (not null)."""
        return self._next(self.df.where(f(Row(self.df))))

    def flat_map(self, f: Callable[[Row], Column | tuple]) -> Flow:
        """A row for each element of the array, in order; none for an empty or null one.

        A tuple ends with the array; the columns before it are repeated.
        """
        made = f(Row(self.df))
        *keep, items = made if isinstance(made, tuple) else (made,)
        if not keep:
            return self._next(self.df.select(F.explode(items).alias("value")))
        return self._next(self.df.select(*[c.alias("key" if len(keep) == 1 else f"_{i + 1}") for i, c in enumerate(keep)], F.explode(items).alias("value")))

    def union(self, other: Flow) -> Flow:
        """All rows of both, doubles kept; columns, types and session must be the same."""
        if self.df.sparkSession is not other.df.sparkSession:
            raise SchemaMismatch("the flows belong to different sessions")
        mine, theirs = ([(f.name, f.dataType) for f in x.df.schema] for x in (self, other))
        if mine != theirs:
            raise SchemaMismatch(f"{self.df.schema.simpleString()} and {other.df.schema.simpleString()}")
        return self._next(self.df.union(other.df), others=(other,))

    def distinct(self) -> Flow:
        """Each different row once; order undefined; nulls equal each other."""
        shuffled = self._next(self.df.distinct(), "shuffle")
        return shuffled._next(shuffled.df)

    def _shuffle_partitions(self) -> int:
        return int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    # Python closures
    # conditions and the function after them run in one pass
    def map_py(self, f: Callable[[Any], Any], schema: str | T.StructType) -> Flow:
        df, only = self._asked
        return self._next(operators.map_rows(df, f, schema, only=only))

    def filter_py(self, f: Callable[[Any], bool]) -> Flow:
        df, only = self._asked
        flow = self._next(operators.filter_rows(df, *only, f))
        flow._asked = (df, (*only, f))
        return flow

    def flat_map_py(self, f: Callable[[Any], Iterable[Any]], schema: str | T.StructType) -> Flow:
        df, only = self._asked
        return self._next(operators.flat_map_rows(df, f, schema, only=only))

    # keys
    def key_by(self, f: Callable[[Row], tuple[Column, Column]]) -> KeyedFlow:
        """Rows of ``key`` and ``value``; a null key is a key."""
        flow = self.map(f)
        return KeyedFlow(flow.df, flow.node)

    def keyed(self, key: str = "key", value: str = "value") -> KeyedFlow:
        return self.key_by(lambda c: (c[key], c[value]))

    # actions
    def collect(self) -> list[Any]:
        """All rows on the driver: values of a one-column flow, else tuples."""
        with action("collect"):
            return [_plain(r) for r in self.df.collect()]

    collect_to_driver = collect

    def count(self) -> int:
        with action("count"):
            return self.df.count()

    def take(self, n: int) -> list[Any]:
        """The first n rows; 0 starts no job. Partitions are read as far as needed."""
        with action("take"):
            return [_plain(r) for r in self.df.take(n)] if n else []

    def reduce(self, f: Combiner | Callable[[Column, Column], Column], value: str = "value") -> Any:
        """The fold of a column; an error over no rows.

        A declared combiner is a built-in aggregate, and so is a function of two columns
        that does what one does; any other is folded in the order of the partitions and must
        be associative.
        """
        if isinstance(f, Combiner):
            made = f.make(f.on(Row(self.df)) if f.on else F.col(value))
            with action("reduce"):
                n, out = self.df.agg(F.count("*"), made).first()
            if not n:
                raise EmptyDataset("reduce over no rows")
            return out
        with action("reduce"):
            got = operators.fold_rows(self.df, value, f).collect()
        if not got:
            raise EmptyDataset("reduce over no rows")
        return got[0][0]

    def reduce_py(self, f: Callable[[Any, Any], Any]) -> Any:
        with action("reduce"):
            parts = operators.reduce_rows(self.df, f)
        if not parts:
            raise EmptyDataset("reduce over no rows")
        total = parts[0]
        for x in parts[1:]:
            total = f(total, x)
        return total

    # introspection
    @property
    def id(self) -> int:
        return self.node.id

    @property
    def dependencies(self) -> tuple[Dependency, ...]:
        return self.node.dependencies

    @property
    def partitioner(self) -> HashPartitioner | None:
        """Known only directly after a keyed operator."""
        return self.node.partitioner

    @property
    def num_partitions(self) -> int:
        return self.df.rdd.getNumPartitions()

    def lineage(self) -> list[Node]:
        """The operators that made this flow, nearest first."""
        return walk(self.node)

    def stages(self) -> list:
        """One stage for each shuffle below, parents first, and the result."""
        return stages_of(self.node)


class KeyedFlow(Flow):
    """Rows of ``key`` and ``value``. Functions must be associative and commutative."""

    def _shuffled(self, df: DataFrame) -> Flow:
        return self._next(df, "shuffle", HashPartitioner(self._shuffle_partitions()))

    def aggregate(self, **combiners: Combiner) -> Flow:
        """Declared combiners: one row for each key, a column for each combiner."""
        made = [c.make(c.on(Row(self.df)) if c.on else F.col("value")).alias(n) for n, c in combiners.items()]
        return self._shuffled(self.df.groupBy("key").agg(*made))

    def reduce_by_key(self, f: Combiner | Callable[[Column, Column], Column]) -> Flow:
        if isinstance(f, Combiner):
            return self.aggregate(value=f)
        return self.combine_by_key(lambda v: v, f, f)

    def combine_by_key(self, create: Callable, merge_value: Callable, merge_combiners: Callable) -> Flow:
        """Column functions that make, extend and merge combiners."""
        return self._shuffled(operators.fold_by_key(self.df, ["key"], "value", create, merge_value, merge_combiners))

    def aggregate_by_key(self, zero: Column, seq: Callable, comb: Callable) -> Flow:
        """zero starts every partial combiner, so it must be neutral to comb."""
        return self.combine_by_key(lambda v: seq(zero, v), seq, comb)

    def group_by_key(self) -> Flow:
        """All values of a key in an array, nulls kept, order undefined."""
        return self.aggregate(value=Collect)

    def combine_by_key_py(self, create: Callable, merge_value: Callable, merge_combiners: Callable, combiner: str | T.DataType) -> Flow:
        return self._shuffled(operators.combine_partitions(self.df, create, merge_value, merge_combiners, combiner))


def _plain(row: Any) -> Any:
    return row[0] if len(row) == 1 else tuple(row)
