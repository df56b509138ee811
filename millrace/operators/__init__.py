"""Operators that Spark's own don't express: folds by Column lambdas, and Python closures."""

from .closures import combine_partitions, filter_rows, flat_map_rows, map_rows, reduce_rows
from .folds import fold_by_key, fold_rows

__all__ = ["combine_partitions", "filter_rows", "flat_map_rows", "fold_by_key", "fold_rows", "map_rows", "reduce_rows"]
