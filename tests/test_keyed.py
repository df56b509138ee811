"""Keyed aggregations: declared combiners, Column folds, Python closures."""

from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace import Count, Max, Min, Sum

PAIRS = [("plum", 12), ("fig", -4), ("plum", 30), ("lime", 7), ("fig", 9), ("plum", 1)]


def keyed(engine, pairs, kind="key string, value bigint", partitions=3):
    return engine.parallelize(pairs, kind, partitions).keyed()


def test_reduce_by_key(engine):
    flow = keyed(engine, PAIRS)
    want = {"plum": 43, "fig": 5, "lime": 7}
    assert dict(flow.reduce_by_key(Sum).collect()) == want
    assert dict(flow.reduce_by_key(lambda a, b: a + b).collect()) == want
    add = lambda a, b: a + b
    assert dict(flow.combine_by_key_py(lambda v: v, add, add, "long").collect()) == want


def test_group_by_key_keeps_nulls(engine):
    got = dict(keyed(engine, [("a", 1), ("a", None), ("b", 3), (None, 4), (None, 5)]).group_by_key().collect())
    assert {k: sorted(v, key=str) for k, v in got.items()} == {"a": [1, None], "b": [3], None: [4, 5]}


def test_combine_and_aggregate(engine):
    flow = keyed(engine, [("oak", 8), ("oak", 5), ("elm", 3)])
    make = lambda v: F.struct(v.alias("s"), F.lit(1).alias("n"))
    extend = lambda a, v: F.struct((a["s"] + v).alias("s"), (a["n"] + 1).alias("n"))
    merge = lambda a, b: F.struct((a["s"] + b["s"]).alias("s"), (a["n"] + b["n"]).alias("n"))
    assert {k: tuple(v) for k, v in flow.combine_by_key(make, extend, merge).collect()} == {"oak": (13, 2), "elm": (3, 1)}
    assert dict(flow.aggregate_by_key(F.lit(0), lambda a, v: a + v, lambda a, b: a + b).collect()) == {"oak": 13, "elm": 3}
    assert sorted(flow.aggregate(n=Count, lo=Min, hi=Max).collect()) == [("elm", 1, 3, 3), ("oak", 2, 5, 8)]


def test_python_combiner_passes_partial_results_on(engine):
    from millrace.operators import combine_partitions

    df = engine.parallelize([(i % 17, i) for i in range(1000)], "key int, value bigint", 4).df
    add = lambda a, b: a + b
    got = {r.key: r.value for r in combine_partitions(df, lambda v: v, add, add, "long", flush=3).collect()}
    want = Counter()
    for i in range(1000):
        want[i % 17] += i
    assert got == dict(want)


def test_weighted_hot_key(engine):
    assert keyed(engine, [("much", 6)] * 5 + [("less", 2)]).reduce_by_key(Sum).map(lambda c: c.value).reduce(Sum) == 32


def test_two_shuffles(engine):
    flow = keyed(engine, [("oak", 8), ("oak", 5), ("elm", 3)]).reduce_by_key(Sum)
    again = flow.key_by(lambda c: (c.key, c.value * 10)).reduce_by_key(Sum)
    assert dict(again.collect()) == {"oak": 130, "elm": 30}


def plan_of(flow):
    return flow.df._jdf.queryExecution().executedPlan().toString()


def test_merges_that_aggregates_do_are_recognised(engine):
    flow = keyed(engine, [("x", 5), ("x", None), ("y", 3), ("y", 6), (None, 1)])
    for f, want in [
        (lambda a, b: a + b, {"x": None, "y": 9, None: 1}), (lambda a, b: F.greatest(b, a), {"x": 5, "y": 6, None: 1}),
        (lambda a, b: F.least(a, b), {"x": 5, "y": 3, None: 1}), (lambda a, b: a.bitwiseXOR(b), {"x": None, "y": 5, None: 1}),
    ]:
        out = flow.reduce_by_key(f)
        assert dict(out.collect()) == want and "collect_list" not in plan_of(out) and "MapInArrow" not in plan_of(out)
    truth = keyed(engine, [("x", None), ("x", False), ("y", None), ("y", True)], "key string, value boolean")
    assert dict(truth.reduce_by_key(lambda a, b: a & b).collect()) == {"x": False, "y": None}
    assert dict(truth.reduce_by_key(lambda a, b: a | b).collect()) == {"x": None, "y": True}
    ends = flow.combine_by_key(lambda v: F.struct(F.lit(1).alias("n"), v.alias("hi")), lambda a, v: F.struct((a["n"] + 1).alias("n"), F.greatest(a["hi"], v).alias("hi")), lambda a, b: F.struct((b["n"] + a["n"]).alias("n"), F.greatest(a["hi"], b["hi"]).alias("hi")))
    assert {k: tuple(v) for k, v in ends.collect()} == {"x": (2, 5), "y": (2, 6), None: (1, 1)} and "collect_list" not in plan_of(ends)


def test_other_merges_fold_batches_before_the_shuffle(engine, spark):
    """A hot key of 50,000 rows in small batches: what is shuffled is a value for each batch and key."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        rows = engine.range(50_000, 4).key_by(lambda c: (F.when(c.value % 50 == 0, c.value % 7).otherwise(F.lit(99)), c.value))
        out = rows.reduce_by_key(lambda a, b: (a * 31 + b * 31) % 1_000_003 * 0 + F.greatest(a, b))
        got = dict(out.collect())
        want = {}
        for x in range(50_000):
            k = x % 7 if x % 50 == 0 else 99
            want[k] = max(want.get(k, 0), x)
        assert got == want
        spans = engine.range(5000, 3).map(lambda c: F.struct(c.value.alias("lo"), c.value.alias("hi")))
        assert tuple(spans.reduce(lambda a, b: F.struct(a["lo"].alias("lo"), b["hi"].alias("hi")))) == (0, 4999)
        nested = keyed(engine, [(("p", 1), 4), (("p", 1), 5), (("q", 2), 6)], "key struct<a:string,b:int>, value bigint")
        assert sorted((tuple(k), v) for k, v in nested.reduce_by_key(lambda a, b: a * b).collect()) == [(("p", 1), 20), (("q", 2), 6)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_closures_combine_a_key_of_many_partial_results(engine):
    from millrace.operators import combine_partitions

    df = engine.range(30_000, 3).map(lambda c: (F.lit("k"), c.value)).df
    out = combine_partitions(df, lambda v: [v, v], lambda a, v: [min(a[0], v), max(a[1], v)], lambda a, b: [min(a[0], b[0]), max(a[1], b[1])], "array<bigint>", flush=1)
    assert [tuple(r) for r in out.collect()] == [("k", [0, 29_999])]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.integers(-100, 100)), max_size=40))
def test_random_bags(engine, pairs):
    flow = keyed(engine, pairs, "key int, value bigint")
    want = defaultdict(list)
    for k, v in pairs:
        want[k].append(v)
    assert dict(flow.reduce_by_key(Sum).collect()) == {k: sum(v) for k, v in want.items()}
    assert dict(flow.reduce_by_key(lambda a, b: F.greatest(a, b)).collect()) == {k: max(v) for k, v in want.items()}
    assert dict(flow.reduce_by_key(lambda a, b: F.when(a < b, a).otherwise(b)).collect()) == {k: min(v) for k, v in want.items()}
    assert {k: sorted(v) for k, v in flow.group_by_key().collect()} == {k: sorted(v) for k, v in want.items()}
