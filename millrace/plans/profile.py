"""Wall-time spans of actions, on request, and errors of tasks by partition."""

from __future__ import annotations

import os
import re
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PythonException

from ..errors import TaskFailed

#: Set in the environment, every span is also written to standard error.
SWITCH = "MILLRACE_PROFILE"


class Spans:
    """Name and seconds of what ran; spans that contain or overlap others mustn't be added up."""

    def __init__(self) -> None:
        self.done: list[tuple[str, float]] = []

    @contextmanager
    def span(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            took = time.perf_counter() - began
            self.done.append((name, took))
            del self.done[:-10_000]
            if os.environ.get(SWITCH):
                print(f"PROFILE pid={os.getpid()} stage={name} us={round(took * 1e6)}", file=sys.stderr)


#: Spans of this process's actions.
spans = Spans()


@contextmanager
def action(name: str) -> Iterator[None]:
    """A span; a closure's error comes out as TaskFailed, with its partition and message."""
    with spans.span(name):
        try:
            yield
        except PythonException as e:
            found = re.search(r"Task (\d+) in stage", getattr(e, "_stackTrace", None) or "")
            lines = [x for x in str(getattr(e, "_desc", None) or e).splitlines() if x.strip()]
            raise TaskFailed(int(found[1]) if found else None, lines[-1].strip() if lines else str(e)) from e
