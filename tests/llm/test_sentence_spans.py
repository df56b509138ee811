import random
import re

import numpy as np
import pytest

from millrace.llm import queries, sentence_spans
from millrace.llm import textops as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def hashes(words):
    """The hash of each word, and of it with the next one of its sentence."""
    data = [lower(x).encode() for x in words]
    off = np.cumsum([0, *map(len, data)])
    h = [int(x) for x in T.span_hashes(np.frombuffer(b"".join(data), np.uint8), T.Spans(off[:-1], off[1:], off[:-1]))]
    return [int(T.mix(np.array([(a * T._P + b) % 2**64], np.uint64))[0]) for a, b in zip(h, [*h[1:], 0], strict=True)]


def cut(t):
    """Sentences of a text, as lists of word ranges."""
    out, cur = [], []
    for m in WORD.finditer(t):
        if cur:
            p = t[cur[-1][0] : cur[-1][1]]
            if p[-1] in ".!?" or (len(p) > 1 and p[-1] in "\"')]" and p[-2] in ".!?") or "\n" in t[cur[-1][1] : m.start()]:
                out.append(cur)
                cur = []
        cur.append(m.span())
    out += [cur] if cur else []
    pieces = []
    for x in out:
        if len(x) <= 24:
            pieces.append(x)
            continue
        h = hashes([t[a:b] for a, b in x])
        begins = sorted({0} | {min(range(i, i + 12), key=lambda j: (h[j], j)) for i in range(len(x) - 11)})
        pieces += [x[a:b] for a, b in zip(begins, [*begins[1:], len(x)], strict=True)]
    return pieces


def brute(rows):
    seen, out = set(), {}
    for doc_id, t in sorted(rows):
        s = cut(t)
        keys = [" ".join(lower(t[a:b]) for a, b in x) for x in s]
        gone = set()
        for i in range(len(s) - 2):
            j = i + 3
            while j < len(s) and sum(map(len, s[i:j])) < 16:
                j += 1
            k = tuple(keys[i:j])
            gone |= set(range(i, j)) if k in seen else set()
            seen.add(k)
        text = "".join(t[s[i][0][0] : (s[i + 1][0][0] if i + 1 < len(s) else len(t))] for i in range(len(s)) if i not in gone)
        lead = t[: s[0][0][0]] if s else t
        out[doc_id] = (len(s), len(gone), ",".join(f"{s[i][0][0]}:{s[i][-1][1]}" for i in sorted(gone)), lead + text)
    return out


def test_query_against_brute_force(spark, sf_dir, docs):
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.removed, r.text) for r in queries.op3_substring_dedup(spark, sf_dir).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got == want and any(v[1] for v in want.values())


@pytest.mark.parametrize("seed", range(6))
def test_passages_of_over_50_words_are_found_wherever_they_stand(spark, seed):
    """Shared passages in the middle of longer stretches, with stops or without."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    stop = lambda: rnd.choice(["", "", "", "", "", "", "", "."]) if seed % 2 else ""
    own = lambda n: " ".join(word() + stop() for _ in range(n))
    passages = [own(rnd.randint(51, 80)) for _ in range(6)]
    rows = [(10 * i + j, f"{own(rnd.randint(0, 60))} {p} {own(rnd.randint(0, 60))}.") for j, p in enumerate(passages) for i in range(4)]
    got = {r.doc_id: r for r in sentence_spans.dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()}
    for d, t in rows:
        if d < 10:
            assert got[d].text == t
            continue
        p = passages[d % 10].split()
        left = got[d].text.split()
        assert got[d].n_removed and sum(x in left for x in p) <= 36  # at most a window at each end stays, and one more cut
        assert len(t.split()) - len(left) <= len(p)  # nothing but the passage goes


def test_odd_rows_and_empty_table(odd, empty):
    out = sentence_spans.dedup(odd)
    assert out.schema == odd.schema
    texts = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = [(r.doc_id, "" if r.doc_id == 8 else r.text) for r in odd.collect()]  # 8 repeats what 7 says
    assert [t for t in texts if t[0] != 4] == sorted([t for t in want if t[0] != 4], key=str)
    assert sentence_spans.dedup(empty).count() == 0
