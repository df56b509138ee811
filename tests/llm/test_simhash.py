import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute_components(fps, bits=2):
    """Smallest index reachable for each fingerprint."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= bits):
            x, y = find(i), find(i + 1 + int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_query_against_brute_force(spark, sf_dir, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash_near_dedup(spark, sf_dir).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    assert got == {rows[i][0]: (f"{fps[i]:016x}", rows[comp[i]][0]) for i in range(len(rows))}


@pytest.mark.parametrize("max_bucket", [2, 32])
def test_links_give_the_components_of_all_close_pairs(spark, max_bucket):
    """Planted chains and a dense ball, with buckets both joined and filed."""
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 60, dtype=np.uint64)}
    for base in list(fps)[:10]:
        at = base
        for _ in range(5):
            at ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            fps.add(at)
    fps |= {12345 ^ (1 << i) for i in range(64)}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(x), i) for i, x in enumerate(fps)], "fp long, doc_id long")
    got = {r.fp: r.component_id for r in simhash.components(df, max_bucket=max_bucket).collect()}
    comp = brute_components(fps)
    assert got == {simhash.signed(x): comp[i] for i, x in enumerate(fps)}


def test_keep_first(odd, docs):
    found = simhash.near_duplicates(docs)
    assert simhash.keep_first(docs).count() == found.select("component_id").distinct().count()
    kept = simhash.keep_first(odd)
    assert kept.schema == odd.schema
    rows = kept.collect()
    # 1, 2, 3 and the null id share the zero fingerprint; 7 and 8 are copies
    assert sorted([r.doc_id for r in rows], key=str) == [1, 4, 5, 6, 7, 9, None]
    assert len(rows) == 7


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(empty).count() == 0


def test_null_ids_are_linked_but_name_no_component(odd):
    rows = simhash.near_duplicates(odd).where("fp = 0").collect()
    assert {r.component_id for r in rows} == {1} and len(rows) == 4
    assert simhash.near_duplicates(odd).where(F.col("doc_id") == 7).count() == 2
