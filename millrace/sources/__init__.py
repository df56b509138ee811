"""Sources: values in memory, ranges, lines of text, Parquet."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidParallelism, NoSharedFolder, SourceNotFound


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset a local session gets a temporary folder; on a cluster that would
    be another folder on every machine, so it is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all machines share")
        there = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def check_partitions(n: int) -> int:
    if n < 1:
        raise InvalidParallelism(f"{n} partitions")
    return n


def split_points(length: int, n: int) -> list[int]:
    """Borders of n contiguous parts of nearly equal size; empty parts are kept."""
    return [i * length // check_partitions(n) for i in range(n + 1)]


def from_range(spark: SparkSession, length: int, n: int) -> DataFrame:
    """value: 0 up to length, in n contiguous partitions."""
    return spark.range(0, length, 1, check_partitions(n)).withColumnRenamed("id", "value")


def from_values(spark: SparkSession, values: Iterable[Any], schema: str | T.DataType | None, n: int) -> DataFrame:
    """A row for each value, in order; a scalar becomes one column ``value``.

    The rows are placed in n contiguous parts: partition i holds the rows from
    i * len // n on.
    """
    check_partitions(n)
    rows = list(values)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if schema is None:
        schema = T._infer_type(rows[0]) if rows else T.LongType()
    if not isinstance(schema, T.StructType):
        schema, rows = T.StructType([T.StructField("value", schema)]), [(v,) for v in rows]
    marks = split_points(len(rows), n)
    parts = [rows[a:b] for a, b in zip(marks, marks[1:], strict=False)]
    return spark.createDataFrame(spark.sparkContext.parallelize(parts, n).flatMap(lambda part: part), schema)


def text_lines(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    r"""value: a row for each line.

    Lines end at ``\n``; one ``\r`` before it belongs to the end. A lone ``\r``
    stays. The last line needs no end; an empty file has no lines. A missing path
    is an error here and not at the action. Spark's file splits never lose or
    double a line. n asks for about so many splits by bytes, in the order of the file
    and without a shuffle; small files may give fewer or, at their ends, more.
    """
    try:
        df = spark.read.option("lineSep", "\n").text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise SourceNotFound(path) from e
        raise
    if n is not None and check_partitions(n):
        df = _planned(df, n)
    return df.select(F.regexp_replace("value", r"\r\z", "").alias("value"))


def _planned(df: DataFrame, n: int) -> DataFrame:
    """A scan that is planned now, with n splits: Spark takes the wanted number from the session when it plans."""
    spark = df.sparkSession
    size = sum(s.getLen() for s in _statuses(spark, df.inputFiles()))
    wanted = {"spark.sql.files.minPartitionNum": str(n), "spark.sql.files.maxPartitionBytes": str(max(1, -(-size // n))), "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        rows = df._jdf.queryExecution().toRdd()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark)


def _statuses(spark: SparkSession, files: list[str]) -> list:
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(f)) for f in files]
    return [p.getFileSystem(conf).getFileStatus(p) for p in paths]


def parquet(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """The columns of Parquet files. A scan of fewer than n partitions is dealt out to n.

    A large table has more row groups than n and isn't shuffled; a small one of a
    single row group would else leave all but one thread idle.
    """
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise SourceNotFound(path) from e
        raise
    if n is not None and check_partitions(n) > df.rdd.getNumPartitions():
        df = df.repartition(n)
    return df
