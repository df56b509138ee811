import math
import random
import re
from collections import Counter

import numpy as np

from millrace.llm import perplexity, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_plain_rules_against_brute_force(spark, sf_dir, docs, odd):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in queries.op7_quality_rules(spark, sf_dir).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}
    rows = perplexity.assess(odd).collect()
    assert len(rows) == odd.count()
    texts = {(r.doc_id, *brute(r.text)) for r in odd.collect()}
    assert {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows} == texts


K = perplexity.ORDER


def symbols(t):
    return [" "] * (K - 1) + [*re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", t.lower()))]


class Brute:
    """Interpolated modified Kneser-Ney with dictionaries."""

    def __init__(self, texts):
        self.count = [Counter() for _ in range(K)]
        for t in texts:
            s = symbols(t)
            self.count[K - 1].update(tuple(s[i - K + 1 : i + 1]) for i in range(K - 1, len(s)))
        for k in range(K - 2, -1, -1):
            self.count[k] = Counter(g[1:] for g in self.count[k + 1])
        self.d = []
        for c in self.count:
            n = [sum(v == i for v in c.values()) for i in range(1, 5)]
            if not n[0] or not n[1]:
                self.d.append([0, 0.5, 1, 1.5])
                continue
            y = n[0] / (n[0] + 2 * n[1])
            d = [0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1]]
            d.append(3 - 4 * y * n[3] / n[2] if n[2] else d[2])
            self.d.append([min(max(x, 0.01), i) if i else 0 for i, x in enumerate(d)])
        self.of = [{} for _ in range(K)]
        for k, c in enumerate(self.count):
            for g, v in c.items():
                self.of[k].setdefault(g[:-1], []).append(v)

    def p(self, g):
        if not g:
            return 1 / (len(self.count[0]) + 1)
        k, c = len(g) - 1, self.count[len(g) - 1]
        mine = self.of[k].get(g[:-1])
        if not mine:
            return self.p(g[1:])
        v = c.get(g, 0)
        return (max(v - self.d[k][min(v, 3)], 0) + sum(self.d[k][min(x, 3)] for x in mine) * self.p(g[1:])) / sum(mine)

    def log_ppl(self, t):
        s = symbols(t)
        return -sum(math.log(self.p(tuple(s[i - K + 1 : i + 1]))) for i in range(K - 1, len(s))) / (len(s) - K + 1)


def test_model_bands_and_verdicts_against_brute_force(spark):
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("abcd\u00e9\u4e00") for _ in range(rnd.randint(1, 5))) for _ in range(40)]
    rows = []
    for i in range(120):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(40, 90))]
        if i % 17 == 0:
            words = ["".join(rnd.choice("zyxw9") for _ in range(6)) for _ in words]
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(words), ["en", "fr", None, "rare"][0 if i % 9 else i % 4]))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = {r.doc_id: r for r in perplexity.assess(df, prior=10).collect()}
    model = Brute([t for _, t, _ in rows])
    want = {d: model.log_ppl(t) for d, t, _ in rows}
    for d, x in want.items():
        assert abs(got[d].log_ppl - x) < 1e-5

    def band(ids):
        v = sorted(math.floor(got[d].log_ppl * 1000) for d in ids)
        q1, q3 = v[-(-len(v) // 4) - 1] / 1000, v[-(-3 * len(v) // 4) - 1] / 1000
        wide = max(q3 - q1, 0.01)
        return q1 - wide * perplexity.REACH[0], q3 + wide * perplexity.REACH[1]

    good = [d for d, t, _ in rows if not brute(t)[-1]]
    whole, verdicts = band(good), Counter()
    for d, t, lang in rows:
        same = [x for x in good if rows[x][2] == lang]
        own = band(same) if same else whole
        w = len(same) / (len(same) + 10)
        slack = perplexity.SHORT / math.sqrt(brute(t)[0])
        lo, hi = (w * a + (1 - w) * b for a, b in zip(own, whole, strict=True))
        kept = d in good and lo - slack <= got[d].log_ppl <= hi + slack
        assert got[d].kept == kept
        verdicts[kept, d in good] += 1
    assert verdicts[True, True] > 50 and verdicts[False, True] > 3
    assert {r.doc_id for r in perplexity.accept(df, prior=10).collect()} == {d for d in got if got[d].kept}


def test_every_context_sums_to_one_and_pruning_leaves_the_rest_to_the_back_off(spark, monkeypatch):
    texts = ["abab cab", "bca bab 12", "aab \U0001f600 aab"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    table = perplexity.symbols()
    for rare in (1 << 21, 20, 2):
        monkeypatch.setattr(perplexity, "RARE", rare)
        model = perplexity.fit(df)
        assert len(model.grams[K - 1].hash) <= rare and (rare > 2 or not len(model.grams[0].hash)) and all((np.diff(h.hash.astype(object)) > 0).all() for h in model.grams)
        known = sorted({int(table[ord(c)]) for c in "abc 1\U0001f600"} | {4000})
        seen = [table[[ord(c) for c in symbols(t)]] for t in texts]
        contexts = {tuple(s[i - K + 1 : i].tolist()) for s in seen for i in range(K - 1, len(s))} | {(5, 6, 7, 8)}
        for c in contexts:
            number = 0
            for x in c:
                number = number << perplexity.BITS | x
            p = np.exp(model.log_prob(np.array([number << perplexity.BITS | x for x in known])))
            free = 0 if len(model.grams[0].hash) == len(known) - 1 else (len(known) - 1 - len(model.grams[0].hash)) * p[-1]
            assert abs(p.sum() - free - 1) < 1e-5


def test_no_ngram_is_left_out_however_many_there_are(spark, monkeypatch):
    """More n-grams than the arrays hold: the same log-perplexities and verdicts as by all of them."""
    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("abcde\u00e9\u4e00") for _ in range(rnd.randint(1, 5))) for _ in range(30)]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(50, 70))) + (" zq" * (i % 3)), ["en", "fr", None][i % 3]) for i in range(30)]
    rows += [(30, "", "en"), (31, None, None), (32, rows[4][1], "fr"), (33, " ".join("".join(rnd.choice("zyxw9") for _ in range(6)) for _ in range(60)), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    whole = {r.doc_id: r.kept for r in perplexity.assess(df).collect()}
    model = Brute([t for _, t, _ in rows if t])
    for rare in (500, 2):
        monkeypatch.setattr(perplexity, "RARE", rare)
        got = {r.doc_id: r for r in perplexity.assess(df).collect()}
        for d, t, _ in rows:
            assert got[d].log_ppl is None if not t else abs(got[d].log_ppl - model.log_ppl(t)) < 1e-5
        assert {d: r.kept for d, r in got.items()} == whole
    assert {r.doc_id for r in perplexity.accept(df).collect()} == {d for d, k in whole.items() if k}


def test_bands_reject_noise_and_keep_prose(spark):
    rnd = random.Random(2)
    common = "the a of and to in is was it for on as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
    prose = [" ".join(rnd.choice(common) for _ in range(rnd.randint(60, 300))).capitalize() + "." for _ in range(200)]
    noise = " ".join("".join(chr(97 + (i * 7 + j * 13 + j * j) % 26) for j in range(9)) for i in range(120))
    rows = [(i, t, "en") for i, t in enumerate(prose)] + [(999, noise, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in perplexity.assess(df).collect()}
    assert not got.pop(999) and all(got.values())
    assert {r.doc_id for r in perplexity.accept(df).collect()} == set(got)


def test_accept_agrees_with_assess(docs):
    kept = {r.doc_id for r in perplexity.assess(docs).where("kept").collect()}
    assert {r.doc_id for r in perplexity.accept(docs).collect()} == kept


def test_odd_rows_and_empty_table(odd, empty):
    assert perplexity.accept(odd).schema == odd.schema
    assert perplexity.accept(odd).collect() is not None
    assert perplexity.assess(empty).count() == 0 and perplexity.accept(empty).count() == 0
    assert all(r.log_ppl is None or math.isfinite(r.log_ppl) for r in perplexity.assess(odd).collect())
