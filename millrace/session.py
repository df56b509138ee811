"""The engine: a checked master, a Spark session, and the sources."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import sources
from .errors import InvalidMaster, InvalidParallelism
from .flow import Flow
from .plans.metrics import Metrics


def parse_master(master: str) -> int | None:
    """Threads of a local master; None for ``local[*]``."""
    text = master.strip()
    if text == "local":
        return 1
    found = re.fullmatch(r"local\[(\*|[0-9]+)\]", text)
    if not found:
        raise InvalidMaster(f"not a local master: {master!r}")
    if found[1] == "*":
        return None
    if int(found[1]) < 1:
        raise InvalidParallelism(f"{master!r} has no threads")
    return int(found[1])


#: Masters of clusters that Spark starts executors on.
CLUSTER = r"yarn|spark://\S+|k8s://\S+|local-cluster\[\d+,\s*\d+,\s*\d+\]"


def spark_master(master: str, attempts: int) -> str:
    """The master for Spark: a cluster's as it is, a local one with its threads and attempts."""
    if re.fullmatch(CLUSTER, master.strip()):
        return master.strip()
    return f"local[{parse_master(master) or '*'},{attempts}]"


class EngineBuilder:
    """Collects settings; a task is tried ``attempts`` times in all, in local mode too."""

    def __init__(self) -> None:
        self._master, self._name, self._attempts, self._conf = "local[*]", "millrace", 3, {}

    def master(self, master: str) -> EngineBuilder:
        self._master = master
        return self

    def app_name(self, name: str) -> EngineBuilder:
        self._name = name
        return self

    def attempts(self, n: int) -> EngineBuilder:
        self._attempts = n
        return self

    def config(self, key: str, value: Any) -> EngineBuilder:
        self._conf[key] = str(value)
        return self

    def build(self) -> Engine:
        """The engine; a session that runs already is used again."""
        return self.get_or_create()

    def get_or_create(self) -> Engine:
        """The engine; a session that runs already is used again, with a warning if it was made for another master."""
        url = spark_master(self._master, self._attempts)
        conf = {
            "spark.task.maxFailures": str(self._attempts),
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.ui.showConsoleProgress": "false",
        } | self._conf
        spark = SparkSession.builder.master(url).appName(self._name).config(map=conf).getOrCreate()
        if spark.sparkContext.master != url:
            warnings.warn(f"the session that runs has master {spark.sparkContext.master}, not {url}", stacklevel=2)
        return Engine(spark)


class Engine:
    """Sources and facts of one session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    @staticmethod
    def builder() -> EngineBuilder:
        return EngineBuilder()

    # facts: there is one driver, and actions are global
    @property
    def parallelism(self) -> int:
        return self.spark.sparkContext.defaultParallelism

    @property
    def rank(self) -> int:
        return 0

    @property
    def is_driver(self) -> bool:
        return True

    @property
    def world_size(self) -> int:
        """The driver and its executors; the driver alone in local mode."""
        executors = self.spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()
        return max(1, len(executors))

    @property
    def metrics(self) -> Metrics:
        return Metrics(self.spark)

    def gather(self, metric: str = "totalTasks") -> dict[str, int]:
        """One number of each executor: a field of Spark's executor summaries."""
        return self.metrics.of_executors(metric)

    def net_bytes(self) -> tuple[int, int]:
        """Shuffle bytes written and read by all stages so far."""
        m = self.metrics.counters()
        return m["network_sent_bytes_total"], m["network_received_bytes_total"]

    def file_partition_opens(self) -> int:
        """Tasks of stages that read input so far."""
        return self.metrics.input_tasks()

    # sources
    def table(self, df: DataFrame) -> Flow:
        return Flow.source(df)

    def parallelize(self, values: Iterable[Any], schema: str | T.DataType | None = None, partitions: int | None = None) -> Flow:
        return Flow.source(sources.from_values(self.spark, values, schema, self.parallelism if partitions is None else partitions))

    def range(self, n: int, partitions: int | None = None) -> Flow:
        return Flow.source(sources.from_range(self.spark, n, self.parallelism if partitions is None else partitions))

    def read_text_file(self, path: str, partitions: int | None = None) -> Flow:
        return Flow.source(sources.text_lines(self.spark, path, partitions))

    def read_parquet(self, path: str, partitions: int | None = None) -> Flow:
        return Flow.source(sources.parquet(self.spark, path, partitions))
