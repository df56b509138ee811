"""Errors of the engine; a failing closure is a TaskFailed, other failures of tasks are Spark's own exceptions."""

from __future__ import annotations


class MillraceError(Exception):
    """Base of all errors raised by this package."""


class InvalidMaster(MillraceError, ValueError):
    """The master isn't ``local``, ``local[N]``, ``local[*]`` or a cluster's."""


class InvalidParallelism(MillraceError, ValueError):
    """A number of partitions or threads below 1."""


class EmptyDataset(MillraceError, ValueError):
    """A reduction without an initial value over no rows."""


class SchemaMismatch(MillraceError, ValueError):
    """A union of flows of different columns, types or sessions."""


class NoSharedFolder(MillraceError, ValueError):
    """A cluster session without a folder that its machines share."""


class TaskFailed(MillraceError, RuntimeError):
    """A task failed for good; partition is None where Spark doesn't name it."""

    def __init__(self, partition: int | None, message: str):
        super().__init__(message if partition is None else f"partition {partition}: {message}")
        self.partition, self.message = partition, message


class SourceNotFound(MillraceError, FileNotFoundError):
    """A path that doesn't exist, found when the flow is made and not when it runs."""
