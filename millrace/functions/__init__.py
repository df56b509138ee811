"""Declared combiners: each is a built-in aggregate, so Spark combines before the shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Combiner:
    """make: from the value column to the aggregate; on: which columns it takes, by a lambda."""

    make: Callable[[Column], Column]
    on: Callable | None = None

    def of(self, on: Callable) -> Combiner:
        """The same combiner of another expression, e.g. ``Sum.of(lambda c: c.price * 2)``."""
        return Combiner(self.make, on)


Sum = Combiner(F.sum)
Min = Combiner(F.min)
Max = Combiner(F.max)
Avg = Combiner(F.avg)
Count = Combiner(lambda c: F.count("*"))
CountDistinct = Combiner(F.count_distinct)
First = Combiner(F.first)
BoolAnd = Combiner(F.bool_and)
BoolOr = Combiner(F.bool_or)
#: Values of a key in one array; nulls are kept, the order is undefined.
Collect = Combiner(lambda c: F.transform(F.collect_list(F.struct(c.alias("v"))), lambda x: x["v"]))


def hash_bucket(n: int, *key: Column) -> Column:
    """The partition, 0 up to n, that a key's rows are shuffled to."""
    return F.pmod(F.hash(*key), F.lit(n))
