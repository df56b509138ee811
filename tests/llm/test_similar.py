import re

import numpy as np

import corpus_pipeline
from millrace.llm import similar

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(text.lower())
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def kept_by_brute_force(texts, similarity=0.8):
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= similarity:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sorted(set(root))


def family(rng, size, copies, changed):
    """A text and copies of it with some words changed."""
    base = [f"w{x}" for x in rng.integers(0, 10**6, size)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for i in rng.choice(size, int(rng.integers(1, changed + 1)), replace=False):
            w[i] = f"x{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


def test_the_stage_drops_near_copies_of_five_word_similarity(spark, sf_dir):
    rng = np.random.default_rng(5)
    texts = [t for _ in range(40) for t in family(rng, int(rng.integers(60, 300)), 2, 8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, sf_dir).collect())
    want = kept_by_brute_force(texts)
    assert len(want) < len(texts) - 20
    assert got == want


def test_a_large_family_of_near_copies(spark, sf_dir):
    """Far more than a bucket holds, and many of them are too far from each other to be linked directly."""
    texts = family(np.random.default_rng(6), 150, 250, 8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, sf_dir).collect())
    want = kept_by_brute_force(texts)
    assert set(want) <= set(got) and len(got) <= len(want) + 0.02 * (len(texts) - len(want))


def kept(spark, sf_dir, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    return sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, sf_dir).collect())


def test_large_families_as_by_brute_force(spark, sf_dir, monkeypatch):
    """No text of a bucket far beyond max_bucket stays though any other, not only a central one, is near enough."""
    for seed, copies, changed, block in ((6, 250, 8, similar.BLOCK), (7, 120, 14, 20)):
        monkeypatch.setattr(similar, "BLOCK", block)
        texts = family(np.random.default_rng(seed), 150, copies, changed)
        want = kept_by_brute_force(texts)
        assert kept(spark, sf_dir, texts) == want and len(want) < len(texts)


def test_a_common_passage_and_drifting_versions(spark, sf_dir):
    """A passage of many texts links none of them; each version links to the next ones only."""
    rng = np.random.default_rng(8)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join([*(f"u{x}" for x in rng.integers(0, 10**6, 50)), passage]) for _ in range(60)]
    version = [f"v{i}" for i in range(120)]
    for i in range(50):
        version[int(rng.integers(120))] = f"new{i}"
        version[int(rng.integers(120))] = f"newer{i}"
        texts.append(" ".join(version))
    texts += ["a b", "A  b", "a b c d e", "a b c d e f", "", " "]
    want = kept_by_brute_force([t if t.strip() else "none" for t in texts])
    assert kept(spark, sf_dir, texts) == want


def join_rows(spark, since):
    """The most rows that a join of the SQL executions from this one on made, and the next execution's number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs, most, after = store.executionsList(), 0, since
    for i in range(runs.size()):
        number = runs.apply(i).executionId()
        if number < since:
            continue
        after = max(after, number + 1)
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            of = [node.metrics().apply(j) for j in range(node.metrics().size())] if "Join" in node.name() else []
            found = [values.get(m.accumulatorId()) for m in of if m.name() == "number of output rows"]
            most = max([most, *(int(v.get().replace(",", "")) for v in found if v.isDefined())])
    return most, after


def test_a_large_family_meets_few_pairs(spark, sf_dir):
    """Hundreds of texts that no link brings to their family's centre aren't met with all of the family."""
    texts = family(np.random.default_rng(9), 150, 400, 8)
    want = kept_by_brute_force(texts)
    since = join_rows(spark, 0)[1]
    assert kept(spark, sf_dir, texts) == want and len(want) > 150
    most = join_rows(spark, since)[0]
    assert 0 < most < 60 * len(texts), most


def test_families_that_leave_out_or_add_as_by_brute_force(spark, sf_dir):
    """Near copies of no common size: parts left out, parts added, and a second family in the same buckets."""
    rng = np.random.default_rng(10)
    base = [f"w{i}" for i in range(200)]
    other = base[:120] + [f"o{i}" for i in range(90)]
    texts = []
    for i in range(90):
        for w in (base, other):
            w, n = list(w), int(rng.integers(5, 40))
            at = int(rng.integers(0, len(w) - n))
            if i % 3 == 0:
                del w[at : at + n]
            elif i % 3 == 1:
                w[at:at] = [f"a{x}" for x in rng.integers(0, 40, n)]
            for j in rng.choice(len(w), int(rng.integers(0, 7)), replace=False):
                w[j] = f"x{rng.integers(3)}"
            texts.append(" ".join(w))
    want = kept_by_brute_force(texts)
    assert 20 < len(want) < len(texts) - 20
    assert kept(spark, sf_dir, texts) == want
