"""millrace: a small data-processing vocabulary compiled to Spark DataFrame plans."""

from .errors import EmptyDataset, InvalidMaster, InvalidParallelism, MillraceError, NoSharedFolder, SchemaMismatch, SourceNotFound, TaskFailed
from .flow import Flow, KeyedFlow
from .functions import Avg, BoolAnd, BoolOr, Collect, Combiner, Count, CountDistinct, First, Max, Min, Sum
from .plans.lineage import Dependency, HashPartitioner, Stage
from .plans.metrics import Metrics, MetricsServer
from .plans.profile import Spans, spans
from .session import Engine, parse_master

__all__ = [
    "Avg", "BoolAnd", "BoolOr", "Collect", "Combiner", "Count", "CountDistinct", "Dependency", "EmptyDataset",
    "Engine", "First", "Flow", "HashPartitioner", "InvalidMaster", "InvalidParallelism", "KeyedFlow", "Max",
    "Metrics", "MetricsServer", "MillraceError", "Min", "NoSharedFolder", "SchemaMismatch", "SourceNotFound", "Spans",
    "Stage", "Sum", "TaskFailed", "parse_master", "spans",
]
