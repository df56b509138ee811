"""The catalogue: each operator's query over the test tables, with the same in SQL.

Queries use the engine's own operators throughout.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import Collect, Count, Engine, Flow, HashPartitioner, Max, Min, Sum
from .functions import hash_bucket
from .sources import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

WORDS = r"select word from (select unnest(regexp_split_to_array(text, '\s+')) as word from documents) where word <> ''"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> Flow:
    return Engine(spark).read_parquet(f"{sf_dir}/{table}.parquet")


def _words(spark: SparkSession, sf_dir: str) -> Flow:
    """value: the words of all documents, split at white space."""
    engine = Engine(spark)
    texts = engine.read_parquet(f"{sf_dir}/documents.parquet", engine.parallelism)
    return texts.flat_map(lambda c: F.split(c.text, r"\s+")).filter(lambda c: c.value != "")


def _written_lines(spark: SparkSession, sf_dir: str) -> str:
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    _read(spark, sf_dir, "documents").df.select("text").write.option("lineSep", "\n").text(path)
    return path


def _one(spark: SparkSession, value: int, name: str) -> DataFrame:
    return spark.range(1).select(F.lit(value).cast("long").alias(name))


@query(f"select word, count(*) as cnt from ({WORDS}) group by word")
def wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _words(spark, sf_dir).key_by(lambda c: (c.value, F.lit(1))).reduce_by_key(Sum)
    return counts.map(lambda c: {"word": c.key, "cnt": c.value}).df


@query(f"select word, count(*) as cnt from ({WORDS}) group by word order by cnt desc, word limit 10")
def wordcount_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordcount(spark, sf_dir).orderBy(F.desc("cnt"), "word").limit(10)


@query(f"select k, sum(w)::bigint as total from (select 'hot' as k, 9 as w from ({WORDS}) union all select concat('key:', word), 1 from ({WORDS})) group by k")
def skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all weighted pairs have one key; they are combined before the shuffle."""
    pairs = _words(spark, sf_dir).flat_map(lambda c: F.array(F.struct(F.lit("hot").alias("k"), F.lit(9).alias("w")), F.struct(F.concat(F.lit("key:"), c.value).alias("k"), F.lit(1).alias("w"))))
    total = pairs.key_by(lambda c: (c.value["k"], c.value["w"])).reduce_by_key(Sum)
    return total.map(lambda c: {"k": c.key, "total": c.value}).df


@query("select l_orderkey, l_linenumber * 2 as doubled from lineitem")
def map_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").map(lambda c: {"l_orderkey": c.l_orderkey, "doubled": c.l_linenumber * 2}).df


@query("select l_orderkey, l_linenumber from lineitem where l_quantity > 25 and l_returnflag = 'R'")
def filter_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _read(spark, sf_dir, "lineitem").filter(lambda c: (c.l_quantity > 25) & (c.l_returnflag == "R"))
    return kept.map(lambda c: {"l_orderkey": c.l_orderkey, "l_linenumber": c.l_linenumber}).df


@query("select event_id, unnest(string_split(event_type, '')) as ch from events")
def flat_map_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = _read(spark, sf_dir, "events").flat_map(lambda c: (c.event_id, F.split(c.event_type, "")))
    return chars.map(lambda c: {"event_id": c.key, "ch": c.value}).df


@query("select (l_orderkey + 1) * (l_orderkey + 1) as sq from lineitem where (l_orderkey + 1) % 3 = 0 and ((l_orderkey + 1) * (l_orderkey + 1)) % 2 = 0")
def pipeline_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = _read(spark, sf_dir, "lineitem").map(lambda c: c.l_orderkey + 1).filter(lambda c: c.value % 3 == 0)
    return flow.map(lambda c: {"sq": c.value * c.value}).filter(lambda c: c.sq % 2 == 0).df


@query("select upper(p_brand) as brand from part where length(p_brand) > 3")
def string_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").filter(lambda c: F.length(c.p_brand) > 3).map(lambda c: {"brand": F.upper(c.p_brand)}).df


@query("select c_nationkey as nationkey from customer union all select s_nationkey from supplier")
def union_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _read(spark, sf_dir, "customer").map(lambda c: {"nationkey": c.c_nationkey})
    return customers.union(_read(spark, sf_dir, "supplier").map(lambda c: {"nationkey": c.s_nationkey})).df


@query("select distinct user_id, event_type from events")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").map(lambda c: {"user_id": c.user_id, "event_type": c.event_type}).distinct().df


@query(f"select distinct word from ({WORDS})")
def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).map(lambda c: {"word": c.value}).distinct().df


@query("select count(*) as n from lineitem")
def count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, _read(spark, sf_dir, "lineitem").count(), "n")


@query("select sum(l_orderkey)::bigint as s from lineitem")
def reduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, _read(spark, sf_dir, "lineitem").reduce(Sum.of(lambda c: c.l_orderkey)), "s")


@query("select max(l_orderkey * 7 + l_linenumber)::bigint as m from lineitem")
def reduce_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reduce with a function of two columns."""
    values = _read(spark, sf_dir, "lineitem").map(lambda c: c.l_orderkey * 7 + c.l_linenumber)
    return _one(spark, values.reduce(lambda a, b: F.greatest(a, b)), "m")


@query("select event_id, event_type from events order by event_id limit 10")
def take_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action over an ordered flow; ten rows are the feature."""
    flow = Engine(spark).table(_read(spark, sf_dir, "events").df.orderBy("event_id")).map(lambda c: {"event_id": c.event_id, "event_type": c.event_type})
    return spark.createDataFrame(flow.take(10), flow.df.schema)


@query("select event_type, max(event_id) as m from events group by event_type")
def reduce_by_key_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _read(spark, sf_dir, "events").key_by(lambda c: (c.event_type, c.event_id)).reduce_by_key(Max)
    return out.map(lambda c: {"event_type": c.key, "m": c.value}).df


@query("select l_returnflag, count(*) as n, sum(round(l_quantity)::bigint)::bigint as s from lineitem group by l_returnflag")
def combine_by_key_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count and sum of an average, as declared combiners."""
    flow = _read(spark, sf_dir, "lineitem").key_by(lambda c: (c.l_returnflag, F.round(c.l_quantity).cast("long")))
    return flow.aggregate(n=Count, s=Sum).map(lambda c: {"l_returnflag": c.key, "n": c.n, "s": c.s}).df


@query("select event_type, count(*) as n, min(event_id) as lo, max(event_id) as hi from events group by event_type")
def combine_by_key_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column functions that make, extend and merge combiners."""
    def make(v):
        return F.struct(F.lit(1).cast("long").alias("n"), v.alias("lo"), v.alias("hi"))

    def extend(a, v):
        return F.struct((a["n"] + 1).alias("n"), F.least(a["lo"], v).alias("lo"), F.greatest(a["hi"], v).alias("hi"))

    def merge(a, b):
        return F.struct((a["n"] + b["n"]).alias("n"), F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"))

    out = _read(spark, sf_dir, "events").key_by(lambda c: (c.event_type, c.event_id)).combine_by_key(make, extend, merge)
    return out.map(lambda c: {"event_type": c.key, "n": c.value["n"], "lo": c.value["lo"], "hi": c.value["hi"]}).df


@query("select event_type, string_agg(event_id::varchar, ',' order by event_id) as ids from events group by event_type")
def group_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _read(spark, sf_dir, "events").key_by(lambda c: (c.event_type, c.event_id)).group_by_key()
    return out.map(lambda c: {"event_type": c.key, "ids": F.array_join(F.sort_array(c.value), ",")}).df


@query("select user_id, max(event_id) as m from events group by user_id")
def fold_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _read(spark, sf_dir, "events").key_by(lambda c: (c.user_id, c.event_id)).reduce_by_key(lambda a, b: F.greatest(a, b))
    return out.map(lambda c: {"user_id": c.key, "m": c.value}).df


@query("select event_type, sum(event_id)::bigint as s from events group by event_type")
def aggregate_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    add = lambda a, v: a + v
    out = _read(spark, sf_dir, "events").key_by(lambda c: (c.event_type, c.event_id)).aggregate_by_key(F.lit(0).cast("long"), add, add)
    return out.map(lambda c: {"event_type": c.key, "s": c.value}).df


@query("select b, sum(n)::bigint as orders from (select o_custkey % 10 as b, count(*) as n from orders group by o_custkey) group by b")
def chained_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _read(spark, sf_dir, "orders").key_by(lambda c: (c.o_custkey, F.lit(1))).reduce_by_key(Sum)
    return per.key_by(lambda c: (c.key % 10, c.value)).reduce_by_key(Sum).map(lambda c: {"b": c.key, "orders": c.value}).df


@query("select unnest(string_split(text, chr(10))) as line from documents")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts are written as lines to the shared folder and read by the text source."""
    path = _written_lines(spark, sf_dir)
    return Engine(spark).read_text_file(path).map(lambda c: {"line": c.value}).df


@query("select unnest(string_split(text, chr(10))) as line from documents")
def text_lines_by_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over 24 splits by bytes."""
    return Engine(spark).read_text_file(_written_lines(spark, sf_dir), 24).map(lambda c: {"line": c.value}).df


@query("select sum(x * 3 - 7)::bigint as s from range(0, 10000) t(x)")
def parallelize_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = Engine(spark).parallelize(range(10_000)).map(lambda c: c.value * 3 - 7)
    return _one(spark, values.reduce(lambda a, b: a + b), "s")


@query("select i as n, 'v' || i as s from range(0, 1000) t(i)")
def parallelize_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in 7 contiguous parts."""
    rows = [(i, f"v{i}") for i in range(1000)]
    return Engine(spark).parallelize(rows, "n bigint, s string", 7).df


@query("select sum(x * 5 + 1)::bigint as s from range(0, 100000) t(x)")
def range_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, Engine(spark).range(100_000).map(lambda c: c.value * 5 + 1).reduce(Sum), "s")


@query("select n_nationkey, n_name from nation")
def collect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a small table to the driver and back."""
    flow = _read(spark, sf_dir, "nation").map(lambda c: {"n_nationkey": c.n_nationkey, "n_name": c.n_name})
    return spark.createDataFrame(flow.collect_to_driver(), flow.df.schema)


@query("select l_returnflag, max(l_orderkey * 10 + l_linenumber) as m from lineitem group by l_returnflag")
def reduce_by_key_any_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of columns that no built-in aggregate does, over three hot keys."""
    flow = _read(spark, sf_dir, "lineitem").key_by(lambda c: (c.l_returnflag, c.l_orderkey * 10 + c.l_linenumber))
    return flow.reduce_by_key(lambda a, b: F.when(a < b, b).otherwise(a)).map(lambda c: {"l_returnflag": c.key, "m": c.value}).df


@query("select event_type as k, count(*) as n, sum(event_id)::bigint as s from events group by event_type")
def arrow_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python closures: combined in each task, shuffled, combined again."""
    flow = _read(spark, sf_dir, "events").key_by(lambda c: (c.event_type, c.event_id))
    add = lambda a, b: {"n": a["n"] + b["n"], "s": a["s"] + b["s"]}
    out = flow.combine_by_key_py(lambda v: {"n": 1, "s": v}, lambda a, v: {"n": a["n"] + 1, "s": a["s"] + v}, add, "struct<n:bigint,s:bigint>")
    return out.map(lambda c: {"k": c.key, "n": c.value["n"], "s": c.value["s"]}).df


@query("select l_orderkey * 2 + 1 as x from lineitem where l_linenumber % 2 = 1")
def arrow_map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = _read(spark, sf_dir, "lineitem").map(lambda c: (c.l_orderkey, c.l_linenumber)).filter_py(lambda r: r[1] % 2 == 1)
    return flow.map_py(lambda r: r[0] * 2 + 1, "x long").df


@query("select p_partkey as k, unnest(string_split(p_type, ' ')) as v from part")
def arrow_flat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = _read(spark, sf_dir, "part").map(lambda c: (c.p_partkey, c.p_type))
    return flow.flat_map_py(lambda r: ((r[0], v) for v in r[1].split(" ")), "k long, v string").df


@query(f"select r::int as run, (select count(distinct word) from ({WORDS})) as n from range(1, 4) t(r)")
def reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three counts of one shuffled flow of word counts, each computed anew."""
    counts = _words(spark, sf_dir).key_by(lambda c: (c.value, F.lit(1))).reduce_by_key(Sum)
    return spark.createDataFrame([(r, counts.count()) for r in (1, 2, 3)], "run int, n long")


@query("select o_orderkey + 1 as x from orders union all select o_orderkey * 10 from orders")
def diamond(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _read(spark, sf_dir, "orders")
    return base.map(lambda c: {"x": c.o_orderkey + 1}).union(base.map(lambda c: {"x": c.o_orderkey * 10})).df


@query("select event_type, min(event_id) as lo, count(*) as n, sum(event_id)::bigint as s from events group by event_type")
def declared_combiners(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _read(spark, sf_dir, "events").key_by(lambda c: (c.event_type, c.event_id)).aggregate(lo=Min, n=Count, s=Sum)
    return out.map(lambda c: {"event_type": c.key, "lo": c.lo, "n": c.n, "s": c.s}).df


@query("select event_type, count(*) as n from events group by event_type")
def collect_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _read(spark, sf_dir, "events").key_by(lambda c: (c.event_type, c.value)).aggregate(vs=Collect)
    return out.map(lambda c: {"event_type": c.key, "n": F.size(c.vs).cast("long")}).df


@query()
def hash_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partition of each key; placement is Spark's own and has no SQL form."""
    n = HashPartitioner(16).n
    return _read(spark, sf_dir, "events").map(lambda c: {"event_type": c.event_type, "bucket": hash_bucket(n, c.event_type)}).distinct().df


@query("select * from (values (0, 'shuffle_map'), (1, 'shuffle_map'), (2, 'shuffle_map'), (3, 'result')) t(stage, kind)")
def lineage_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of a flow with two shuffles over a diamond."""
    base = _read(spark, sf_dir, "orders").key_by(lambda c: (c.o_custkey, F.lit(1)))
    both = base.reduce_by_key(Sum).union(base.reduce_by_key(Max).map(lambda c: (c.key, c.value.cast("long"))))
    rows = [(s.id, s.kind) for s in both.distinct().stages()]
    return spark.createDataFrame(rows, "stage int, kind string")
