"""What the operators share: reading, spooling, row identity, components.

Row identity.  Operators that carry decisions back to rows identify a row by
its id and the hash of its text, so repeated rows (same id, same text) get the
same answer and equal ids with different texts are told apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import shared_dir
from ..workers import prepare

__all__ = ["connected_components", "delete", "discard", "numbered", "prepare", "shared_dir", "spool", "table", "text_hash"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def spool(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it back, which cuts lineage.

    A lost executor loses nothing of it: later reads come from the shared store.  The
    files go when the driver ends, or before by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a spooled table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles() if "/spool-" in f}:
        delete(df.sparkSession, folder)


def text_hash(text: str | Column = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with name, the row's number within its group (a long column) in the order given, from 1.

    One range sort by group and order; a group of any size is spread over tasks.
    Rows are counted within (partition, group), and only groups that lie in several
    partitions, fewer than there are partitions, need what came before.
    """
    prepare(df.sparkSession)
    schema = StructType(list(df.schema)).add("__mr_n", "long").add("__mr_pid", "integer")
    at = df.columns.index(group)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            g = batch.column(at).to_numpy(zero_copy_only=False)
            if not len(g):
                continue
            new = np.ones(len(g), bool)
            new[1:] = g[1:] != g[:-1]
            new[0] = last is None or g[0] != last
            lead = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
            n = np.arange(len(g)) - np.where(lead >= 0, lead, -seen) + 1
            last, seen = g[-1], int(n[-1])
            yield pa.record_batch([*batch.columns, pa.array(n), pa.array(np.full(len(g), pid, np.int32))], names=[*batch.schema.names, "__mr_n", "__mr_pid"])

    rows = spool(df.orderBy(group, *order).mapInArrow(count, schema))
    parts = rows.groupBy(group, "__mr_pid").agg(F.count("*").alias("__mr_k"))
    wide = parts.groupBy(group).agg(F.count("*").alias("__mr_p")).where("__mr_p > 1").select(F.col(group).alias("__mr_g"))
    before = F.sum("__mr_k").over(Window.partitionBy("__mr_g").orderBy("__mr_pid").rowsBetween(Window.unboundedPreceding, -1))
    base = parts.join(wide, F.col(group) == F.col("__mr_g")).select("__mr_g", F.col("__mr_pid").alias("__mr_q"), before.alias("__mr_base"))
    out = rows.join(base, (F.col(group) == F.col("__mr_g")) & (F.col("__mr_pid") == F.col("__mr_q")), "left")
    return out.withColumn(name, F.col("__mr_n") + F.coalesce("__mr_base", F.lit(0))).select(*df.columns, name)


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest vertex of each vertex's component: columns ``v``, ``root``.

    edges: columns ``a``, ``b`` (long), undirected; vertices without edges do not
    appear.  Alternates the large-star and small-star steps until the edges are
    stars; every step is an aggregation and a join, so no component is held by
    one task.  A hub's rows are one side of a join that adaptive execution splits.
    """
    e = spool(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(e)
    while seen[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("lo")).select("a", F.least("a", "lo").alias("lo"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("lo").alias("b"))
        large = large.where("a <> b").distinct()
        # every edge now points from a larger to a smaller vertex
        low = large.groupBy("a").agg(F.min("b").alias("lo"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("lo").alias("b")), F.struct("a", F.col("lo").alias("b")))).alias("e"))
        old, e = e, spool(small.select("e.a", "e.b").where("a <> b").distinct())
        discard(old)
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("root")), F.struct(F.col("b").alias("v"), F.col("b").alias("root")))).alias("x")).select("x.v", "x.root").distinct()
