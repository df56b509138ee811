import binascii
import math
from collections import Counter

import numpy as np
import pytest

from millrace.llm import langid, queries
from millrace.llm import textops as T


def brute_vector(text):
    """Square roots of the counts of hashed letter trigrams, of length 1; words are bordered by one 0."""
    mask, mul = (1 << 64) - 1, lambda x: int(T.mix(np.array([x & ((1 << 64) - 1)], np.uint64))[0])
    c = [0]
    for x in text:
        v = ord(x.lower()[0]) if x.isalpha() else 0
        if v or c[-1]:
            c.append(v)
    c += [0] if c[-1] else []
    out = np.zeros(langid.DIM)
    for a, b, d in zip(c, c[1:], c[2:], strict=False):
        if b:
            out[mul(a * 0x9E3779B1 + mul(b + 11) * 3 + mul(d + 29) * 7 & mask) % langid.DIM] += 1
    out = np.sqrt(out)
    return out / max(np.linalg.norm(out), 1e-9)


def test_vectors_against_plain_python():
    texts = ["The cat, the hat!", "", "12 -- 34", "\u00c9t\u00e9 \u6771\u4eac a", "x", "  spaced   out  ", "\U0001f600 \U00010400ab"]
    x, has = langid.vectors(texts)
    assert has.tolist() == [any(c.isalpha() for c in t) for t in texts]
    for row, t in zip(x, texts, strict=True):
        assert np.allclose(row, brute_vector(t), atol=1e-6)


@pytest.mark.parametrize("seed", range(3))
def test_support_vector_machine_reaches_the_optimum(seed):
    """Run to its end, its objective is that of a slow subgradient method."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, 6))
    y = np.where(x @ rng.normal(size=6) + rng.normal(size=40) > 0, 1.0, -1.0)
    wide = np.hstack([x, np.ones((40, 1))])

    def objective(w):
        return 0.5 * w @ w + 10.0 * np.maximum(0, 1 - y * (wide @ w)).sum()

    w, b = langid.svm(x, y, passes=1000, still=0)
    best, at = math.inf, np.zeros(7)
    for step in range(1, 40_000):
        at = at - (at - 10.0 * wide.T @ (y * (y * (wide @ at) < 1))) / (step + 10)
        best = min(best, objective(at))
    assert objective(np.append(w, b)) <= 1.001 * best


def test_votes_and_ties_against_plain_python():
    rng = np.random.default_rng(4)
    m = langid.Model(["germanic", "romance"], {"germanic": ["de", "en", "nl", "sv"], "romance": ["fr"]}, rng.normal(size=(5, 2)), rng.normal(size=2))
    for i, a in enumerate(m.langs["germanic"]):
        for b in m.langs["germanic"][i + 1 :]:
            m.pairs[a, b] = (rng.normal(size=5), 0.0)
    x = rng.normal(size=(300, 5))
    lang, score = m.predict(x)
    tied = 0
    for v, got, s in zip(x, lang, score, strict=True):
        z = np.exp(v @ m.w + m.b)
        f = int(z.argmax())
        langs = m.langs[m.families[f]]
        votes, margin, prob = Counter(), Counter(), Counter()
        for (a, b), (w, c) in m.pairs.items() if len(langs) > 1 else []:
            d = v @ w + c
            votes[a if d >= 0 else b] += 1
            margin[a] += d
            margin[b] -= d
            prob[a] += 1 / (1 + math.exp(-2 * d))
            prob[b] += 1 - 1 / (1 + math.exp(-2 * d))
        top = max(votes.values(), default=0)
        tied += sum(n == top for n in votes.values()) > 1
        want = max(langs, key=lambda n: (votes[n], margin[n]))
        assert got == want
        assert abs(s - z[f] / z.sum() * (prob[want] / (len(langs) - 1) if len(langs) > 1 else 1)) < 1e-9
    assert tied > 10


def test_held_out_accuracy(spark, sf_dir, docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = queries.op9_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_have_no_effect(spark, docs):
    from pyspark.sql import functions as F

    base = docs.select("doc_id", "lang", "text")
    other = base.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in langid.identify(x).collect()} for x in (base, other))
    assert a == b


def test_languages_within_families(spark):
    texts = {"en": "the house and the garden with another thing that", "de": "das haus und der garten mit einem anderen ding das", "fr": "la maison et le jardin avec une autre chose que", "es": "la casa y el jardin con otra cosa que", "pl": "dom i ogrod z inna rzecza ktora jest", "xx": "zzq qqz vvx xvv zqx"}
    rows = [(i * 10 + j, f"{t} {' '.join(reversed(t.split()))} {j}", lang) for j, (lang, t) in enumerate(texts.items()) for i in range(40)]
    df = spark.createDataFrame([*rows, (9001, "12 34 !!", "en"), (9002, None, "en"), (9003, "le jardin et la maison avec une chose", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(got[d].lang_pred == lang for d, _, lang in rows)
    assert got[9001].lang_pred == got[9002].lang_pred == "und" and got[9001].score == 0
    assert got[9003].lang_pred == "fr"


def test_odd_rows_and_empty_tables(odd, empty):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.where("lang is null")).collect()} == {"und"}
