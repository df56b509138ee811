"""Beyond parity: the same flows over a growing folder of text files.

The engine's operators are plans, so those that need no whole input (map, filter,
flat_map, union) and declared keyed aggregates work on a streaming source as they
are.  ``run_available`` processes what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..flow import Flow


def text_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> Flow:
    """value: a row for each line of files as they appear."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return Flow.source(reader.text(folder))


def run_available(flow: Flow, table: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Processes all input there is into a memory table, and returns that table."""
    query = flow.df.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return flow.df.sparkSession.table(table)
