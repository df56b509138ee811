import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import queries, tiling


def toks(t):
    return re.findall(r"[\u3040-\u30ff\u4e00-\u9fff]|(?:(?![\u3040-\u30ff\u4e00-\u9fff])[^\W_])+", (t or "").lower())


def greedy(a, b, k):
    """Greedy string tiling, the slow way: longest match first, earliest on ties."""
    ma, mb, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in ma and j + n not in mb:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return tiles
        tiles.append(best)
        ma.update(range(i, i + n))
        mb.update(range(j, j + n))


@pytest.mark.parametrize("seed", range(25))
def test_tiles_cover_what_the_slow_way_covers(seed):
    rnd = random.Random(seed)
    a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 60))]
    b = [rnd.choice("abcd") for _ in range(rnd.randint(5, 20))]
    if seed % 3 == 0 and len(b) > 10:
        a[5:5] = b[6:] + b[:6]
    (ha, _), (hb, _) = (tiling.tokens(pa.array([" ".join(x)])) for x in (a, b))
    assert [(n, i, j) for i, j, n in tiling.tile(ha, hb, 3)] == greedy(a, b, 3)


def test_tokens_of_other_scripts():
    texts = ["\u201cThe cat\u2019s caf\u00e9\u201d \u2014 no\u00a0break", "\u6771\u4eac\u30bf\u30ef\u30fc\u306b2020\u5e74a", "", "x\u0301y", "\U0001f600a\U00020000b"]
    got, at = [], tiling.tokens(pa.array(texts))
    for i, t in enumerate(texts):
        data = t.lower().encode()
        s = tiling.token_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        got.append([data[a:b].decode() for a, b in zip(s.start, s.end, strict=True)])
        assert len(got[-1]) == (at[1] == i).sum()
    assert got == [["the", "cat", "s", "caf\u00e9", "no", "break"], [*"\u6771\u4eac\u30bf\u30ef\u30fc\u306b", "2020", "\u5e74", "a"], [], ["x\u0301y"], ["a", "\U00020000", "b"]]


def test_repetitive_texts_take_memory_in_proportion(spark):
    """200,000 tokens of two words against an item of 1,000: no pairs of positions are made."""
    rnd = random.Random(3)
    texts = ["to be " * 100_000, " ".join(rnd.choice(("to", "be", "or", "not")) for _ in range(200_000))]
    items = ["to be " * 500, " ".join(rnd.choice(("to", "be", "or", "not")) for _ in range(1000)), "to be or not " * 5 + "entirely other words that nobody has ever written down before in any text " * 9]
    seeds = tiling.Seeds([1, 2, 3], items, 4)
    tracemalloc.start()
    got = [(r, i, c) for r, i, c, _, _ in tiling.matches(pa.array(texts), seeds, 0.5)]
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert [x[:2] for x in got] == [(0, 1), (1, 1), (1, 2)] and got[0][2] == 1 and got[2][2] > 0.9


def test_query_against_brute_force(spark, sf_dir, docs):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id): r.coverage for r in queries.op8_benchmark_decontamination(spark, sf_dir).collect()}
    want = {}
    for d in docs.collect():
        a = toks(d.text)
        grams = {tuple(a[i : i + 4]) for i in range(len(a) - 3)}
        for item in bench:
            b = toks(item.text)
            under = {j + t for j in range(len(b) - 3) if tuple(b[j : j + 4]) in grams for t in range(4)}
            if len(under) >= 0.5 * len(b):
                coverage = sum(t[0] for t in greedy(a, b, 4)) / len(b)
                if coverage >= 0.5:
                    want[d.doc_id, item.item_id] = coverage
    assert got == pytest.approx(want) and want


def test_reordered_passages_are_caught_and_clean_texts_kept(spark):
    item = "the cat sat on the mat with a red hat. seven blue birds flew over the old stone bridge at noon. nobody knew where the music came from that night."
    parts = item.split(". ")
    docs = spark.createDataFrame([
        (1, "intro words here. " + ". ".join(reversed(parts)) + " and an end"), (2, "a wholly different text about the sea and the wind and the long way home"),
        (3, "the cat sat on the mat and nothing else of it is here"), (4, None), (5, ""),
    ], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, "too short"), (12, None), (None, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in tiling.contaminated(docs, bench).orderBy("item_id").collect()] == [(1, None), (1, 10)]
    assert [r.doc_id for r in tiling.clean(docs, bench).collect()] == [2, 3, 4, 5]
    # many blocks give what one gives
    assert [(r.doc_id, r.item_id) for r in tiling.contaminated(docs, bench, block_bytes=20).orderBy("item_id").collect()] == [(1, None), (1, 10)]


def test_odd_rows_and_empty_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, "Same row, same id. It comes twice. Nothing else is here.")], "item_id long, text string")
    assert sorted(r.doc_id for r in tiling.contaminated(odd, bench).collect()) == [7, 7, 8]
    left = tiling.clean(odd, bench)
    assert left.schema == odd.schema and left.count() == odd.count() - 3
    assert tiling.contaminated(empty, bench).count() == 0 and tiling.clean(empty, bench).count() == 0
    assert tiling.contaminated(odd, bench.limit(0)).count() == 0 and tiling.clean(odd, bench.limit(0)).count() == odd.count()
