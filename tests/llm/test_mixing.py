import re

import numpy as np
import pytest

from millrace.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([50, 100, 150])
    # the third stops at 3 times its size, what is left goes to the others by weight
    assert mixing.targets([1000, 1000, 10]) == pytest.approx([660, 1320, 30])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    many = mixing.targets([10, 1, 1, 500, 7, 0])
    assert sum(many) == pytest.approx(519) and all(t <= 3 * s + 1e-9 for t, s in zip(many, [10, 1, 1, 500, 7, 0], strict=True))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 12345))
    assert sorted(got) == list(range(n))
    assert n < 100 or (got != np.arange(n)).mean() > 0.9


def test_draws_use_up_the_slots():
    got = mixing.draw([100, 0, 37, 1000], 7, 3)
    assert got.sum(0).tolist() == [100, 0, 37, 1000] and got.min() >= 0


def test_digest(spark, sf_dir, docs):
    rows = queries.op5_source_mixing(spark, sf_dir).collect()
    size = {r.doc_id: (len(WORD.findall(r.text or "")), r.source) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == {k: v[0] for k, v in size.items()}
    sources = sorted({s for _, s in size.values()})
    total = [sum(n for n, s in size.values() if s == x) for x in sources]
    goal = dict(zip(sources, mixing.targets(total), strict=True))
    for s, t in zip(sources, total, strict=True):
        mine = [r for r in rows if size[r.doc_id][1] == s]
        assert {(r.source_size, r.target) for r in mine} == {(t, goal[s])}
        assert abs(sum(r.taken for r in mine) - goal[s]) <= max(2, 0.02 * goal[s])
    assert all(r.taken <= 3 * r["size"] for r in rows)
    again = mixing.mix_digest(docs.repartition(7)).select("doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.taken) for r in rows)


def test_small_sources_come_near_their_targets(spark):
    rows = [(100 * i + j, " ".join(["word"] * n), s) for i, (s, k, n) in enumerate([("a", 10, 10), ("b", 1, 100), ("c", 4, 25), ("d", 1, 1), ("e", 300, 90)]) for j in range(k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_digest(df).groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect()
    assert {r.source: r["max(source_size)"] for r in got} == {"a": 100, "b": 100, "c": 100, "d": 1, "e": 27_000}
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= max(1, 0.01 * r["max(target)"])
    three = df.where("source in ('a', 'b', 'c')")
    assert sorted((r.source, r["sum(taken)"]) for r in mixing.mix_digest(three).groupBy("source").sum("taken").collect()) == [("a", 50), ("b", 100), ("c", 150)]


def test_slots_are_the_same_however_they_are_dealt_out(spark, monkeypatch):
    want = sorted(map(tuple, mixing._slots(spark, [700, 3, 0, 90], [400, 1, 0, 30], 5, 9).collect()))
    monkeypatch.setattr(mixing, "TASK_SLOTS", 16)
    assert sorted(map(tuple, mixing._slots(spark, [700, 3, 0, 90], [400, 1, 0, 30], 5, 9).collect())) == want and len(want) == 793


def test_blocks_hold_what_the_digest_says(docs):
    mix = {r.doc_id: r.taken for r in mixing.mix_digest(docs, block_words=32, shards=5).collect()}
    blocks = mixing.mixed_blocks(docs, block_words=32, shards=5).collect()
    assert all(len(WORD.findall(b.text)) == b.n_words <= 32 for b in blocks)
    assert sum(b.n_words for b in blocks) == sum(mix.values())
    for shard in {b.shard for b in blocks}:
        assert sorted(b.position for b in blocks if b.shard == shard) == list(range(sum(b.shard == shard for b in blocks)))
    texts = {r.doc_id: WORD.findall(r.text) for r in docs.collect()}
    some = max((b for b in blocks if len(b.doc_ids) == 1), key=lambda b: b.n_words)
    words, n = texts[some.doc_ids[0]], some.n_words
    assert n > 3 and any(words[i : i + n] == WORD.findall(some.text) for i in range(len(words)))


def test_odd_rows_and_empty_table(odd, empty):
    rows = mixing.mix_digest(odd, block_words=16).collect()
    assert len(rows) == odd.count() and all(r.taken <= 3 * r["size"] for r in rows)
    blocks = mixing.mixed_blocks(odd, block_words=16).collect()
    assert sum(b.n_words for b in blocks) == sum(r.taken for r in rows)
    assert mixing.mix_digest(empty).count() == 0 and mixing.mixed_blocks(empty).count() == 0
