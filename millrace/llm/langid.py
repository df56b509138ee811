"""Language identification in two steps: the family, then the language within it.

A text is a vector of hashed letter trigrams: square roots of counts, scaled to
length 1.  A softmax regression picks the family; within it every pair of
languages has a linear support vector machine, and the language that wins most
pairs (ties: the larger sum of margins) is predicted.  The score is the family's
probability times the winner's mean pairwise probability.

The classifiers are fitted on a bounded sample: ``sample`` texts of each language,
those with the least hashes of (id, text), drawn after a hash threshold computed
from the language's count, so no language is gathered or sorted as a whole.  What
reaches the driver is sample * DIM * 4 bytes for each language.  Every text,
whole, is predicted.

Defined cases: null text and text without a letter are ``und`` with score 0; rows
with null language are predicted but not learned from; without any labelled row
everything is ``und``; languages that FAMILIES doesn't list form the family
``other``; a null id isn't held out; repeated rows are predicted alike; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T
from .common import prepare, spool, text_hash

DIM, SAMPLE, ROWS = 4096, 300, 512

# Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), "other")


_fold: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane, 0 for all else."""
    if not _fold:
        t = np.zeros(1 << 16, np.uint64)
        for cp in range(1 << 16):
            c = chr(cp)
            if c.isalpha():
                t[cp] = ord(c.lower()[0])
        _fold.append(t)
    return _fold[0]


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each text, and whether it has a letter."""
    n = len(texts)
    cp = np.frombuffer("".join(f"  {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(n), [len(t) + 3 for t in texts])
    fold = _letters()
    c = fold[np.minimum(cp, 0xFFFF)]
    high = np.flatnonzero(cp > 0xFFFF)
    if len(high):
        c[high] = [ord(chr(cp[i]).lower()[0]) if chr(cp[i]).isalpha() else 0 for i in high]
    # white space and other characters are one border however many follow each other
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    keep[1:] |= row[1:] != row[:-1]
    c, row = c[keep], row[keep]
    if len(c) < 3:
        return np.zeros((n, DIM), np.float32), np.zeros(n, bool)
    g = T.mix(c[:-2] * np.uint64(0x9E3779B1) + T.mix(c[1:-1] + np.uint64(11)) * np.uint64(3) + T.mix(c[2:] + np.uint64(29)) * np.uint64(7))
    ok = (row[:-2] == row[2:]) & (c[1:-1] != 0)
    at = row[1:-1] * DIM + (g & np.uint64(DIM - 1)).astype(np.int64)
    x = np.sqrt(np.bincount(at[ok], minlength=n * DIM).astype(np.float32)).reshape(n, DIM)
    has = np.bincount(row[c != 0], minlength=n) > 0
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), has


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, passes: int = 400, still: float = 1e-5) -> tuple[np.ndarray, float]:
    """Linear support vector machine by dual coordinate descent; y is -1 or 1.

    Ends when a pass moves no coefficient by more than ``still`` times c, or after ``passes``.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    alpha, w, q = np.zeros(len(x)), np.zeros(x.shape[1]), (x * x).sum(1)
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(len(x)):
            a = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / q[i], 0.0), c)
            if a != alpha[i]:
                most = max(most, abs(a - alpha[i]))
                w += (a - alpha[i]) * y[i] * x[i]
                alpha[i] = a
        if most <= still * c:
            break
    return w[:-1].astype(np.float32), float(w[-1])


def softmax_fit(x: np.ndarray, y: np.ndarray, k: int, steps: int = 150, rate: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    w, b, t = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32), np.eye(k, dtype=np.float32)[y]
    weight = (1 / np.maximum(np.bincount(y, minlength=k), 1)).astype(np.float32)[y][:, None] / k
    for _ in range(steps):
        g = (softmax(x @ w + b) - t) * weight
        w -= rate * (x.T @ g + 1e-4 * w)
        b -= rate * g.sum(0)
    return w, b


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    langs: dict[str, list[str]] = field(default_factory=dict)
    w: np.ndarray | None = None
    b: np.ndarray | None = None
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(x @ self.w + self.b)
        best, lang, score = p.argmax(1), np.empty(len(x), object), np.zeros(len(x))
        for f, name in enumerate(self.families):
            at, langs = np.flatnonzero(best == f), self.langs[name]
            if not len(at):
                continue
            votes, margin, prob = (np.zeros((len(at), len(langs))) for _ in range(3))
            for i, a in enumerate(langs):
                for j in range(i + 1, len(langs)):
                    w, b = self.pairs[a, langs[j]]
                    m = x[at] @ w + b
                    s = 1 / (1 + np.exp(-2 * m))
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    margin[:, i] += m
                    margin[:, j] -= m
                    prob[:, i] += s
                    prob[:, j] += 1 - s
            win = (votes + 1e-6 * np.tanh(margin)).argmax(1)
            lang[at] = np.array(langs, object)[win]
            within = prob[np.arange(len(at)), win] / (len(langs) - 1) if len(langs) > 1 else 1.0
            score[at] = p[at, f] * within
        return lang, np.clip(score, 0, 1)


def fit(x: np.ndarray, lang: list[str]) -> Model:
    by: dict[str, list[str]] = {}
    for name in sorted(set(lang)):
        by.setdefault(family_of(name), []).append(name)
    m = Model(sorted(by), by)
    code = np.array(lang, object)
    m.w, m.b = softmax_fit(x, np.array([m.families.index(family_of(v)) for v in lang]), len(m.families))
    for langs in by.values():
        for i, a in enumerate(langs):
            for b in langs[i + 1 :]:
                at = (code == a) | (code == b)
                m.pairs[a, b] = svm(x[at], np.where(code[at] == a, 1.0, -1.0))
    return m


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, *, sample: int = SAMPLE) -> Model | None:
    """docs: doc_id, lang, text; those that are held out or have no language aren't used."""
    has_letter = F.col("text").rlike(r"\p{L}")
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    spark = docs.sparkSession
    part = spark.createDataFrame([(k, min(1.0, 4 * sample / n)) for k, n in counts.items()], "t_lang string, part double")
    key = F.xxhash64("doc_id", text_hash())
    few = rows.join(F.broadcast(part), F.col("lang") == F.col("t_lang")).withColumn("key", key)
    few = few.where((F.pmod("key", F.lit(1 << 20)) / (1 << 20) < F.col("part")) & has_letter)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("n") <= sample).select("lang", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                b = batch.slice(lo, ROWS)
                x = vectors(T.column(b, "text").to_pylist())[0]
                yield pa.record_batch([T.column(b, "lang"), T.column(b, "key"), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "key", "x"])

    got = sorted(few.mapInArrow(run, "lang string, key long, x binary").collect(), key=lambda r: (r.lang, r.key))
    if not got:
        return None
    return fit(np.stack([np.frombuffer(r.x, np.float32) for r in got]), [r.lang for r in got])


def identify(docs: DataFrame, *, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    spark = docs.sparkSession
    prepare(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(train(slim, sample=sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for chunk, _, _ in T.chunks(batch):
                for lo in range(0, chunk.num_rows, ROWS):
                    part = chunk.slice(lo, ROWS)
                    lang, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                    x, has = vectors([t or "" for t in T.column(part, "text").to_pylist()])
                    if model is not None and has.any():
                        lang[has], score[has] = model.predict(x[has])
                    yield pa.record_batch([T.column(part, "doc_id"), T.column(part, "out"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return slim.select("doc_id", held_out().alias("out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
