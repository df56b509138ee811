import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest

from millrace.llm import pii, queries

# The plain patterns of the contract, matched leftmost and non-overlapping.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and luhn % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    spans = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if passes(k, m[0])] for k, p in PLAIN.items()]
    return [len(s) for s in spans], ",".join(x for s in spans for x in s)


EDGES = [
    "a@b.com_c@d.com x@y..z a.b@c-d.e.f.g 1.2.3.4.5.6.7.8 300.1.1.1 001.02.0003.255 +1 (234) 567-8901 +12345678 +1234567",
    "4111 1111 1111 1111 4111-1111-1111-1111-1 4111  1111 1111 1111 12 4111111111111111", "+1.2.3.4.5.6.7.8.9-", "9" * 40,
    "héé é@x.y é1.1.1.1é \U0001f600 a@b.c", None, "", "5 4111111111111111 5", "+49 170 1234567, +49-(0)30-123456+1 222 333 4444",
]


def check(rows, texts):
    got = {r.doc_id: r for r in rows}
    assert set(got) == set(texts)
    for k, t in texts.items():
        n, base = brute(t)
        r = got[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == n, t
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t
        assert r.spans == base or r.spans.startswith(base)


def test_base_spans_on_edges_and_random_texts(spark):
    rnd = random.Random(1)
    texts = dict(enumerate([*EDGES, *("".join(rnd.choice("01 -.+()@a4.é") for _ in range(150)) for _ in range(200))]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(pii.digest(pii.find(df)).collect(), texts)


def test_query_against_brute_force(spark, sf_dir, docs):
    check(queries.op6_pii(spark, sf_dir).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_long_runs_take_linear_time(spark):
    texts = {1: "1" * 40_000, 2: "a" * 40_000 + "@", 3: "+1" + " 2" * 20_000, 4: "1." * 20_000, 5: "1 " * 20_000 + "x@y.z"}  # what is slow is the plain patterns
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check([r for r in pii.digest(pii.find(df)).collect() if r.doc_id != 9], texts)


def test_many_entities_in_one_text_take_linear_time(spark):
    """20,000 entities, and 60,000 of them among long gaps; several kinds; all replaced."""
    dense = " ".join(f"user{i}@mail{i}.org 10.0.{i % 256}.{i // 256} tel +49 170 {1000000 + i}" for i in range(7000))
    wide = ("lorem ipsum dolor sit amet " * 8).join(f"name{i % 50}@x.org" for i in range(20_000))
    texts = {1: dense, 2: wide, 3: "nothing here"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    began = time.time()
    check(pii.digest(pii.find(df)).collect(), texts)
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert time.time() - began < 90
    assert out[3] == texts[3] and "@" not in out[1] + out[2] and not re.search("[0-9]", out[1])
    assert out[2].count("<EMAIL>") == 20_000 and out[1].count("<IP>") == 7000


def test_disclosing_terms(spark):
    """A name seen only near an address is removed wherever its document says it, common words stay."""
    filler = [(100 + i, f"the weather of day {i} is fine and the market is open again when we write to you at home please") for i in range(60)]
    far = " ".join(["the market is open again"] * 9)
    told = [(i, f"please write to Zephyrine at ed@press.org when the market is open {i}. {far}. Zephyrine") for i in range(4)]
    one = [(50, f"please write to Quillon at only@once.org. {far}"), (51, "Zephyrine and Quillon with no address")]
    df = spark.createDataFrame([*told, *filler, *one], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    for i in range(4):
        assert "Zephyrine" not in out[i] and "ed@press.org" not in out[i] and "<EMAIL>" in out[i]
        assert "when the market is open" in out[i]
    assert "Quillon" not in out[50] and "please write to" in out[50] and out[51] == one[1][1]  # without the entity
    assert all(out[d] == t for d, t in filler)
    spans = {r.doc_id: r.spans for r in pii.digest(pii.find(df)).collect()}
    at = told[0][1].index("Zephyrine")
    assert f"term:{at}:{at + 9}" in spans[0] and f"term:{len(told[0][1]) - 9}:{len(told[0][1])}" in spans[0]


def brute_terms(texts, context=10, generalise=0.8):
    """Term spans of each text, from plain positions."""
    items, n_t = {}, Counter()
    for d, t in texts.items():
        spans = [(m.start(), m.end(), (k, m[0].lower() if k == "email" else m[0] if k == "ip" else re.sub("[^0-9]", "", m[0]))) for k, p in PLAIN.items() for m in re.finditer(p, t) if passes(k, m[0])]
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{2,}", t)]
        clear = [w for w in words if not any(a < w[1] and w[0] < b for a, b, _ in spans)] if spans else []
        n_t.update({w[2] for w in words})
        both = sorted([(w[1], -9, w, None) for w in clear] + [(s[0], -i, None, s) for i, s in enumerate(spans)], key=lambda x: x[:2])
        items[d] = (spans, clear, both)
    n_c, n_ct = Counter(), Counter()
    near = {}
    for d, (spans, _, both) in items.items():
        n_c.update({s[2] for s in spans})
        near[d] = {(both[j][3][2], x[2][2]) for i, x in enumerate(both) if x[2] for j in range(max(0, i - context), min(len(both), i + context + 1)) if both[j][3]}
        n_ct.update(near[d])
    n, out = len(texts), {}
    for d, (_, clear, _) in items.items():
        told = {w for c, w in near[d] if n_c[c] < n and math.log2(n * n_ct[c, w] / n_c[c] / n_t[w]) / math.log2(n / n_c[c]) >= generalise - 1e-12}
        out[d] = [f"term:{a}:{b}" for a, b, w in clear if w in told]
    return out


def test_terms_against_brute_force(spark):
    rnd = random.Random(4)
    vocab = "alpha beta gamma delta epsilon zeta theta kappa lambda sigma".split()
    texts = {}
    for i in range(80):
        parts = [rnd.choice([*vocab, *vocab, f"rare{rnd.choice('abcdefgh')}{rnd.choice('abcdefgh')}", f"u{rnd.randint(0, 5)}@x.org", "10.0.0.7", "\u00e9a@b.cd", f"+49 170 123456{rnd.randint(0, 9)}"]) for _ in range(rnd.randint(0, 60))]
        texts[i] = " ".join(p if i % 3 else p.replace("@", "") for p in parts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("term")] for r in pii.digest(pii.find(df)).collect()}
    want = brute_terms(texts)
    assert got == want and sum(map(len, want.values())) > 20


def test_replacing_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(pii, "PIECE", 7)
    text = "h\u00e9 \U0001f600 write me@exam-ple.org, +49 170 1234567 or 4111 1111 1111 1111!"
    df = spark.createDataFrame([(1, text), (2, "write or"), (3, "h\u00e9 write or")] + [(i, "write or h\u00e9") for i in range(9, 30)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.sanitise(df).collect()}[1] == "h\u00e9 \U0001f600 write <EMAIL>, <PHONE> or <CARD>!"


def test_odd_rows_and_empty_table(odd, empty):
    assert pii.find(odd).count() == odd.count()
    out = pii.sanitise(odd)
    assert out.schema.names == odd.schema.names
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(((r.doc_id, r.text) for r in odd.collect()), key=str)
    assert pii.find(empty).count() == 0 and pii.sanitise(empty).count() == 0
