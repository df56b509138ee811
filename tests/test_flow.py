"""Sources, narrow operators and actions."""

import pytest
from pyspark.sql import functions as F

from millrace import EmptyDataset, InvalidMaster, InvalidParallelism, Max, NoSharedFolder, SchemaMismatch, SourceNotFound, Sum, TaskFailed, parse_master
from millrace.session import spark_master
from millrace.sources import split_points


def test_master_grammar():
    assert parse_master("local") == 1
    assert parse_master(" local[3] ") == 3
    assert parse_master("local[*]") is None
    for bad in ("", "local[]", "local[x]", "yarn", "local[-1]", "local[2,3]"):
        with pytest.raises(InvalidMaster):
            parse_master(bad)
    with pytest.raises(InvalidParallelism):
        parse_master("local[0]")


def test_masters_of_clusters():
    for url in ("yarn", "spark://host:7077", "k8s://https://h:443", "local-cluster[2,1,1024]"):
        assert spark_master(f" {url} ", 3) == url
    assert spark_master("local", 4) == "local[1,4]" and spark_master("local[*]", 3) == "local[*,3]"
    with pytest.raises(InvalidMaster):
        spark_master("mesos://x", 3)


def test_a_session_that_runs_is_used_with_a_warning(engine):
    from millrace import Engine

    with pytest.warns(UserWarning, match="has master"):
        assert Engine.builder().master("local[2]").get_or_create().spark is engine.spark


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from millrace.sources import shared_dir

    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(NoSharedFolder):
        shared_dir(spark)


def test_split_points():
    assert split_points(7, 3) == [0, 2, 4, 7]
    assert split_points(1, 4) == [0, 0, 0, 0, 1]
    assert split_points(12, 4) == [0, 3, 6, 9, 12]


def test_map_then_reduce(engine):
    flow = engine.parallelize([17, -3, 40, 8]).map(lambda c: c.value * 3)
    assert flow.reduce(lambda a, b: a + b) == 186
    assert flow.reduce(Sum) == 186
    assert flow.reduce(Max) == 120
    assert flow.reduce_py(lambda a, b: a + b) == 186


def test_collect_keeps_order(engine):
    assert engine.parallelize(range(20)).collect() == list(range(20))
    assert engine.parallelize([9, 2, 7, 4], partitions=1).collect() == [9, 2, 7, 4]


def test_contiguous_partitions(engine):
    flow = engine.parallelize([1, 2], partitions=5)
    assert flow.num_partitions == 5
    assert [len(p) for p in engine.parallelize(list(range(10)), partitions=4).df.rdd.glom().collect()] == [2, 3, 2, 3]


def test_filter_and_nulls(engine):
    assert engine.range(10).filter(lambda c: c.value % 2 == 0).collect() == [0, 2, 4, 6, 8]
    assert engine.parallelize([1, None, 3], "int").filter(lambda c: c.value > 1).collect() == [3]


def test_flat_map(engine):
    flow = engine.parallelize(["ab", "c", ""]).flat_map(lambda c: F.filter(F.split(c.value, ""), lambda x: x != ""))
    assert flow.collect() == ["a", "b", "c"]
    assert engine.parallelize(["a b"]).flat_map_py(lambda s: iter(s.split()), "string").collect() == ["a", "b"]


def test_count_take(engine):
    flow = engine.range(100)
    assert (flow.count(), flow.take(3), flow.take(0)) == (100, [0, 1, 2], [])
    assert engine.parallelize([1, 2, 3], partitions=8).take(2) == [1, 2]
    assert engine.parallelize([1, 2]).take(100) == [1, 2]


def test_empty(engine):
    flow = engine.parallelize([], "int")
    assert (flow.count(), flow.collect()) == (0, [])
    for f in (Sum, lambda a, b: a + b):
        with pytest.raises(EmptyDataset):
            flow.reduce(f)
    with pytest.raises(EmptyDataset):
        flow.reduce_py(lambda a, b: a + b)


def test_invalid_partitions(engine):
    for make in (lambda: engine.parallelize([1], partitions=0), lambda: engine.range(3, 0)):
        with pytest.raises(InvalidParallelism):
            make()


def test_branching(engine):
    base = engine.parallelize([6, 11, 25])
    assert base.map(lambda c: c.value - 1).collect() == [5, 10, 24]
    assert base.map(lambda c: c.value * 4).collect() == [24, 44, 100]


def test_pipeline_against_python(engine):
    got = engine.range(100).map(lambda c: c.value + 1).filter(lambda c: c.value % 3 == 0).map(lambda c: c.value * c.value).filter(lambda c: c.value % 2 == 0)
    assert got.collect() == [y for x in range(100) if (x + 1) % 3 == 0 and (y := (x + 1) ** 2) % 2 == 0]
    total = engine.range(10_000).map(lambda c: c.value * 3 - 7)
    assert total.reduce(lambda a, b: a + b) == total.reduce(Sum) == sum(x * 3 - 7 for x in range(10_000))


def test_reduce_is_in_partition_order(engine):
    words = engine.parallelize(list("abcdefgh"), partitions=3)
    assert words.reduce(lambda a, b: F.concat(a, b)) == "abcdefgh"
    assert words.reduce_py(lambda a, b: a + b) == "abcdefgh"


def test_strings(engine):
    flow = engine.parallelize(["flour", "rye", "wheel"]).filter(lambda c: F.length(c.value) > 3).map(lambda c: F.upper(c.value))
    assert flow.collect() == ["FLOUR", "WHEEL"]


def test_closures(engine):
    k = 3
    assert engine.parallelize([1, 2, 3]).map_py(lambda x: x * k, "long").collect() == [3, 6, 9]
    assert engine.range(10).filter_py(lambda x: x > 7).collect() == [8, 9]
    assert engine.range(3).flat_map_py(lambda x: [(x, "a")] * x, "n long, s string").collect() == [(1, "a"), (2, "a"), (2, "a")]


def test_failing_closure_carries_its_message(engine):
    def fail(x):
        if x == 2:
            raise ValueError("boom on two")
        return x

    with pytest.raises(TaskFailed, match="boom on two") as e:
        engine.parallelize([1, 2, 3], partitions=3).map_py(fail, "long").collect()
    assert e.value.partition == 1


def test_union(engine):
    a, b = engine.parallelize([1, 2, 2]), engine.parallelize([2, 3])
    assert a.union(b).collect() == [1, 2, 2, 2, 3]
    with pytest.raises(SchemaMismatch):
        a.union(engine.parallelize(["x"]))
    with pytest.raises(SchemaMismatch):
        a.union(engine.parallelize([1]).map(lambda c: {"other": c.value}))


def test_distinct(engine):
    assert sorted(engine.parallelize([1, 1, 2, 2, 3]).distinct().collect()) == [1, 2, 3]
    assert sorted(engine.parallelize([1, None, None], "int").distinct().collect(), key=str) == [1, None]


@pytest.mark.parametrize("text, lines", [
    ("alpha\nbeta gamma\ndelta\n", ["alpha", "beta gamma", "delta"]),
    ("a\r\nb\rc\nlast", ["a", "b\rc", "last"]),
    ("\n\nx", ["", "", "x"]),
    ("", []),
    ("é\U0001f600ü\nß", ["é\U0001f600ü", "ß"]),
])
def test_text_lines(engine, tmp_path, text, lines):
    path = tmp_path / "t.txt"
    path.write_bytes(text.encode())
    assert engine.read_text_file(str(path)).collect() == lines
    assert engine.read_text_file(str(path), 16).collect() == lines


def test_text_lines_over_many_splits(engine, tmp_path, spark):
    path, lines = tmp_path / "t.txt", [f"zeile {i} äöü{'€' * (i % 9)}" for i in range(300)]
    path.write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        flow = engine.read_text_file(str(path))
        assert flow.num_partitions > 10
        assert sorted(flow.collect()) == sorted(lines)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_text_lines_by_splits_keep_their_order(engine, tmp_path, spark):
    path, lines = tmp_path / "t.txt", [f"zeile {i} äöü{'€' * (i % 9)}" for i in range(900)]
    path.write_text("\r\n".join(lines))
    flow = engine.read_text_file(str(path), 12)
    assert 12 <= flow.num_partitions <= 14 and flow.collect() == lines
    plan = flow.df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_missing_path_is_found_at_once(engine, tmp_path):
    with pytest.raises(SourceNotFound):
        engine.read_text_file(str(tmp_path / "none"))
    with pytest.raises(SourceNotFound):
        engine.read_parquet(str(tmp_path / "none"))


def test_small_parquet_is_dealt_out(engine, sf_dir):
    path = f"{sf_dir}/documents.parquet"
    whole, dealt = engine.read_parquet(path), engine.read_parquet(path, 7)
    assert dealt.num_partitions == 7 and dealt.count() == whole.count()
    plan = dealt.map(lambda c: c.doc_id).df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan  # only the columns asked for are dealt
    with pytest.raises(InvalidParallelism):
        engine.read_parquet(path, 0)
