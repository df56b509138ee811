"""Quality rules: plain text rules, then n-gram perplexity bands.

The model is an n-gram model of code points with modified Kneser-Ney smoothing,
counted by Spark over every whole text.  Texts are lower-cased, runs of white space are
one space, digits are one symbol.  Code points below ``EXACT`` are symbols of their own,
the others share EXACT symbols by hash, so an n-gram of ORDER symbols is one 60-bit
number, its context and its suffix are parts of that number, and its hash, a
bijection of the number, is free of collisions.

The counts are aggregated before the shuffle and after it, and grow with the corpus.
No n-gram is left out of the verdicts, however many there are (``learn``).  Up to ``RARE``
different n-grams one task estimates the model, which is collected and broadcast (12 bytes
for each n-gram or context) as sorted arrays of hashes beside arrays of log-probabilities
and back-off weights; a hash is found from its first bits and steps from there.
Beyond RARE, Spark's aggregations and joins estimate the same model from all n-grams
(``probabilities``).  As the texts that are scored are those it was counted on, each
n-gram has its own log-probability there: those of at least one in RARE of all (RARE at most)
are broadcast, the others of each text are joined to the table and added up.
``fit`` alone, which the queries don't call, makes a model of bounded size for any texts.

Discounts come from the counts of counts of each order.  Where no n-gram of an order
was counted once, or none twice, they can't be estimated and are 0.5, 1 and 1.5; where
none was counted three times the last discount is that of two.

Bands: for each language (null is a language of its own) the quartiles of the
log-perplexity of the documents that pass the plain rules, exact to a thousandth, give
a lower limit ``reach[0]`` interquartile ranges below the first quartile and an upper one
``reach[1]`` above the third.  The lower one is far out, as good texts that the corpus
repeats are low too: the model has seen them.  Each limit is drawn towards the one of all documents with the weight of ``prior``
documents, so rare labels aren't judged by a handful of texts, and no count is a
switch.  The mean over a short text varies more, so both limits give way by ``SHORT`` /
sqrt(words).  Repetitive text falls below the lower limit, noise above the upper one.

Defined cases: null text has no words and fails; an empty table gives no rows;
repeated rows are judged alike; any further columns pass through ``accept`` and
are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from . import textops as T
from .common import prepare, spool, text_hash

ORDER, BITS, EXACT, RARE = 5, 12, 1 << 11, 1 << 21
#: Least words of a document, and the greatest part of its words in repeated windows.
MIN_WORDS, MAX_REPEAT = 50, 0.5
REACH, PRIOR, SHORT = (4.0, 1.0), 100, 1.0
SYMBOL_CHARS = "#*$%&|<>"
SPACE = 0x20

_RULE = np.zeros(256, bool)
_RULE[list(SYMBOL_CHARS.encode())] = True
_table: list[np.ndarray] = []


def symbols() -> np.ndarray:
    """The symbol of each code point."""
    if not _table:
        t = EXACT + (T.mix(np.arange(0x110000, dtype=np.uint64)) % np.uint64(EXACT)).astype(np.int64)
        for cp in range(EXACT):
            low = chr(cp).lower()
            t[cp] = 0x30 if low.isdigit() else ord(low) if len(low) == 1 and ord(low) < EXACT else cp
        t[[SPACE, *range(0x09, 0x0E)]] = SPACE
        _table.append(t.astype(np.uint16))
    return _table[0]


def codes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each n-gram of ORDER symbols: its number and its text's row; and the n-grams of each text.

    Each text is led by ORDER - 1 spaces, so it has one n-gram for each of its symbols.
    """
    n = len(off) - 1
    cp, row = T.code_points(buf, off)
    sym = symbols()[cp]
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != SPACE) | (sym[:-1] != SPACE) | (row[1:] != row[:-1])
    sym, row = sym[keep], row[keep]
    if not len(sym):
        return np.zeros(0, np.int64), row, np.zeros(n, np.int64)
    wide = np.full(len(sym) + (ORDER - 1) * n, SPACE, np.uint16)
    at = np.arange(len(sym), dtype=np.int32) + (ORDER - 1) * row  # where the n-gram of a symbol begins
    wide[at + (ORDER - 1)] = sym
    size = len(wide) - ORDER + 1
    code = wide[:size].astype(np.int64)
    for j in range(1, ORDER):
        code <<= BITS
        code |= wide[j : size + j]
    return code[at], row, np.bincount(row, minlength=n)


def count_ngrams(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """code, n: how often each n-gram of ORDER symbols occurs in the corpus."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, off in T.chunks(batch):
                found = pc.value_counts(pa.array(codes(buf, off)[0]))
                yield pa.record_batch([found.field(0), found.field(1)], names=["code", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Hashes:
    """Numbers as a sorted array of their hashes, beside an array of values."""

    def __init__(self, number: np.ndarray, value: np.ndarray):
        h = T.mix(number.astype(np.uint64))
        order = np.argsort(h)
        self.hash, self.value = h[order], value[order].astype(np.float32)
        self.begin: np.ndarray | None = None

    def find(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each number is there, and where."""
        if not len(self.hash):
            return np.zeros(len(number), bool), np.zeros(len(number), np.int32)
        if self.begin is None:  # where the hashes of each first bits begin
            self.bits = np.uint64(max(1, len(self.hash).bit_length()))
            self.begin = np.searchsorted(self.hash, np.arange(1 << int(self.bits), dtype=np.uint64) << (np.uint64(64) - self.bits)).astype(np.int32)
        h = T.mix(number.astype(np.uint64))
        at = self.begin[(h >> (np.uint64(64) - self.bits)).astype(np.int64)]
        last = len(self.hash) - 1
        np.minimum(at, last, out=at)
        held = self.hash[at]
        todo = np.flatnonzero((held < h) & (at < last))
        while len(todo):
            at[todo] += 1
            held[todo] = self.hash[at[todo]]
            todo = todo[(held[todo] < h[todo]) & (at[todo] < last)]
        return held == h, at

    def __getstate__(self) -> dict:
        return {"hash": self.hash, "value": self.value, "begin": None}


@dataclass
class Model:
    """For order k + 1: grams[k], log-probabilities of the last symbol; contexts[k], log back-off
    weights of what precedes; other: log-probability that the lowest order falls back to."""

    grams: list[Hashes]
    contexts: list[Hashes]
    other: float

    def log_prob(self, code: np.ndarray) -> np.ndarray:
        """Log-probability of the last symbol of each n-gram, by backing off."""
        there, at = self.grams[-1].find(code)
        out = np.where(there, self.grams[-1].value[at], 0.0) if len(self.grams[-1].hash) else np.zeros(len(code))
        todo = np.flatnonzero(~there)
        number = code[todo]
        for k in range(ORDER - 1, -1, -1):
            if not len(todo):
                return out
            if k < ORDER - 1:
                number = number & ((1 << (BITS * (k + 1))) - 1)
                there, at = self.grams[k].find(number)
                out[todo[there]] += self.grams[k].value[at[there]]
                todo, number = todo[~there], number[~there]
            there, at = self.contexts[k].find(number >> BITS)
            out[todo[there]] += self.contexts[k].value[at[there]]
        out[todo] += self.other
        return out


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, of how many n-grams occur once to four times."""
    if not n[0] or not n[1]:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1]]
    d.append(3 - 4 * y * n[3] / n[2] if n[2] else d[2])
    return np.clip(d, [0, 0.01, 0.01, 0.01], [0, 1, 2, 3])


def estimate(code: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """Interpolated modified Kneser-Ney: for each order (from 0) the numbers and log-probabilities
    of its n-grams (True) and the numbers and log back-off weights of its contexts (False)."""
    by = np.argsort(code)
    grams, count = [code[by]], [n[by].astype(np.float64)]
    for k in range(ORDER - 1, 0, -1):  # lower orders count the different symbols that precede
        g, c = np.unique(grams[0] & ((1 << (BITS * k)) - 1), return_counts=True)
        grams.insert(0, g)
        count.insert(0, c.astype(np.float64))
    below = np.zeros(0)
    for k in range(ORDER):
        g, c = grams[k], count[k]
        d = discounts([int((c == i).sum()) for i in range(1, 5)])[np.minimum(c, 3).astype(int)]
        which, at = np.unique(g >> BITS, return_inverse=True)
        total = np.bincount(at, c)
        free = np.bincount(at, d) / total  # the mass that discounting sets free
        lower = 1 / (len(g) + 1) if k == 0 else below[np.searchsorted(grams[k - 1], g & ((1 << (BITS * k)) - 1))]
        below = np.maximum(c - d, 0) / total[at] + free[at] * lower
        yield k, True, g, np.log(below)
        yield k, False, which, np.log(np.maximum(free, 1e-12))


def assemble(parts: Iterator[tuple[int, bool, np.ndarray, np.ndarray]]) -> Model:
    held = {(k, is_gram): Hashes(number, value) for k, is_gram, number, value in parts}
    return Model([held[k, True] for k in range(ORDER)], [held[k, False] for k in range(ORDER)], -float(np.log(len(held[0, True].hash) + 1)))


def arrays(counts: DataFrame) -> Model:
    """The model of these counts, estimated by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            rows = pa.Table.from_batches(held)
            for k, is_gram, number, value in estimate(rows["code"].to_numpy(), rows["n"].to_numpy()):
                size = len(number)
                yield pa.record_batch([pa.array(np.full(size, k, np.int8)), pa.array(np.full(size, is_gram)), pa.array(number), pa.array(value.astype(np.float32))], names=["k", "is_gram", "number", "value"])

    made = counts.repartition(1).mapInArrow(run, "k byte, is_gram boolean, number long, value float").toArrow()  # RARE rows at most
    k, is_gram, number, value = (made[c].to_numpy() for c in ("k", "is_gram", "number", "value"))
    return assemble((i, g, number[at], value[at]) for i in range(ORDER) for g in (True, False) for at in [np.flatnonzero((k == i) & (is_gram == g))])


def fit(docs: DataFrame, *, text_col: str = "text") -> Model | None:
    """A model of at most RARE n-grams of each order, for any texts; None where the corpus has no characters.

    Of more than RARE n-grams those rarer than one in RARE of all are left to the back-off.
    """
    counts = spool(count_ngrams(docs, text_col=text_col))
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    if not total:
        return None
    return arrays(counts if distinct <= RARE else counts.where(F.col("n") >= -(-total // RARE)))


def probabilities(counts: DataFrame) -> DataFrame:
    """code, value: the log-probability of each n-gram by all n-grams, as ``estimate`` has it, over many tasks."""

    def tail(k: int) -> Column:  # an n-gram's last k symbols
        return F.col("g").bitwiseAND(F.lit((1 << (BITS * k)) - 1))

    grams = [counts.select(F.col("code").alias("g"), F.col("n").alias("c"))]
    for k in range(ORDER - 1, 0, -1):  # lower orders count the different symbols that precede
        grams.insert(0, spool(grams[0].groupBy(tail(k).alias("g")).agg(F.count("*").alias("c"))))
    below = None
    for k, rows in enumerate(grams):
        class_of = F.least("c", F.lit(5))
        found = {r.i: r.n for r in rows.groupBy(class_of.alias("i")).agg(F.count("*").alias("n")).collect()}  # five rows at most
        d = discounts([found.get(i, 0) for i in range(1, 5)]).tolist()
        rows = rows.withColumn("h", F.shiftright("g", BITS))
        free = sum((F.count(F.when(F.least("c", F.lit(3)) == i, 1)) * F.lit(d[i]) for i in (1, 2, 3)), F.lit(0.0))
        contexts = rows.groupBy("h").agg(F.sum("c").alias("total"), free.alias("free"))
        rows = rows.join(contexts, "h")
        if below is None:
            rows = rows.withColumn("p", F.lit(1 / (sum(found.values()) + 1)))
        else:
            rows = rows.withColumn("s", tail(k)).join(below, "s")
        off = F.when(F.col("c") == 1, d[1]).when(F.col("c") == 2, d[2]).otherwise(d[3])
        p = F.greatest(F.col("c") - off, F.lit(0.0)) / F.col("total") + F.col("free") / F.col("total") * F.col("p")
        below = spool(rows.select(F.col("g").alias("s"), p.alias("p")))
    return below.select(F.col("s").alias("code"), F.log("p").cast("float").alias("value"))


def learn(docs: DataFrame, *, text_col: str = "text") -> tuple[Model | None, DataFrame | None]:
    """The model of all n-grams, to score these same texts by; and code, value of those it doesn't hold (None: it holds all)."""
    counts = spool(count_ngrams(docs, text_col=text_col))
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    if not total:
        return None, None
    if distinct <= RARE:
        return arrays(counts), None
    found = spool(probabilities(counts).join(counts, "code"))
    often = F.col("n") >= -(-total // RARE)  # RARE rows at most
    head = found.where(often).select("code", "value").toArrow()
    none = Hashes(np.zeros(0, np.int64), np.zeros(0))
    model = Model([none] * (ORDER - 1) + [Hashes(head["code"].to_numpy(), head["value"].to_numpy())], [none] * ORDER, 0.0)
    return model, found.where(~often).select("code", "value")


METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_ppl double"


def _repeats(h: np.ndarray, row: np.ndarray, n: int, k: int = 3) -> np.ndarray:
    """Words of each row that lie in a k-word window found twice or more in the row."""
    grams, at = T.gram_hashes(h, row, k)
    key = grams ^ T.mix(row[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + k, -1)
    return np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=n)


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The plain rules' figures for each text of a chunk."""
    n = len(off) - 1
    w = T.words(buf, off)
    chars = T.char_lengths(buf, off)
    n_words = np.bincount(w.row, minlength=n)
    word_chars = np.bincount(w.row, chars[w.end] - chars[w.start], minlength=n).astype(np.int64)
    rule = np.concatenate([[0], np.cumsum(_RULE[buf])])
    h = T.span_hashes(buf, w)
    # lines with a word, whole, equal to an earlier line of the same text
    line = T.runs(buf != 0x0A, off)
    if len(line):
        filled = np.concatenate([[0], np.cumsum(~T.SPACE[buf])])
        keep = filled[line.end] > filled[line.start]
        line = T.Spans(line.start[keep], line.end[keep], line.row[keep])
    key = T.span_hashes(buf, line) ^ T.mix(line.row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    dup = order[1:][key[order][1:] == key[order][:-1]]
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": rule[off[1:]] - rule[off[:-1]], "n_dup_lines": np.bincount(line.row[dup], minlength=n), "n_repeat_words": _repeats(h, w.row, n)}
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > 100 * MAX_REPEAT * n_words)
    return out


def perplexity(buf: np.ndarray, off: np.ndarray, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """Log-perplexity of each text of a chunk, and whether it has none."""
    if model is None:
        return np.zeros(len(off) - 1), np.ones(len(off) - 1, bool)
    code, row, count = codes(buf, off)
    return -np.bincount(row, model.log_prob(code), minlength=len(count)) / np.maximum(count, 1), count == 0


def score(docs: DataFrame, model: Model | None, *, keep: list[str], text_col: str = "text", rest: DataFrame | None = None) -> DataFrame:
    """The columns in keep, and METRICS; log_ppl is null for a text without characters.

    rest: the n-grams that the model doesn't hold (``learn``).
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__mr_text"))
    names = [x.split()[0] for x in METRICS.split(", ")]
    joined = rest is not None
    more = ["__mr_at", "__mr_chars", "__mr_codes", "__mr_times"] if joined else []

    def others(buf: np.ndarray, off: np.ndarray, first: int) -> list[pa.Array]:
        """A number for each text, its n-grams, and which of them the model doesn't hold, how often."""
        code, row, count = codes(buf, off)
        out = ~shared.value.grams[-1].find(code)[0]
        by = np.lexsort((code[out], row[out]))
        code, row = code[out][by], row[out][by]
        new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]))) if len(code) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(code)))
        cut = pa.array(np.searchsorted(row[new], np.arange(len(count) + 1)).astype(np.int32))
        return [pa.array(np.arange(len(count)) + first), pa.array(count), pa.ListArray.from_arrays(cut, pa.array(code[new])), pa.ListArray.from_arrays(cut, pa.array(times))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, buf, off in T.chunks(batch, "__mr_text"):
                m = measure(buf, off)
                log_ppl, none = perplexity(buf, off, shared.value)
                cols = [pa.array(m[x]) for x in names[:-1]] + [pa.array(log_ppl, mask=none)]
                yield pa.record_batch([*part.columns[:-1], *cols, *(others(buf, off, at) if joined else [])], names=[*part.schema.names[:-1], *names, *more])
                at += len(off) - 1

    schema = StructType(list(docs.select(*[F.col(f"`{c}`") for c in keep]).schema))
    for field in METRICS.split(", "):
        schema = schema.add(*field.split())
    if not joined:
        return src.mapInArrow(run, schema)
    for name in more:
        schema = schema.add(name, LongType() if name in more[:2] else ArrayType(LongType()))
    scored = spool(src.mapInArrow(run, schema))
    met = scored.select("__mr_at", F.explode(F.arrays_zip(F.col("__mr_codes").alias("code"), F.col("__mr_times").alias("times"))).alias("x"))
    part = F.round(F.col("value").cast("double") * (1 << 30)).cast("long") * F.col("times")  # whole numbers add up alike in any order
    lacking = met.select("__mr_at", "x.code", "x.times").join(rest, "code").groupBy("__mr_at").agg((F.sum(part.cast("decimal(38,0)")).cast("double") / (1 << 30)).alias("__mr_sum"))
    full = F.col("log_ppl") - F.coalesce("__mr_sum", F.lit(0.0)) / F.greatest("__mr_chars", F.lit(1))
    return scored.join(lacking, "__mr_at", "left").withColumn("log_ppl", full).select(*[F.col(f"`{c}`") for c in keep], *names)


def bands(scored: DataFrame, *, lang_col: str = "lang", reach: tuple[float, float] = REACH, prior: int = PRIOR) -> DataFrame:
    """band_lang, low, high: one row for each language, and one of all (is_all).

    Quartiles are read from counts of thousandths, so they don't depend on how rows are dealt out.
    """
    passed = scored.where("not base_failed and log_ppl is not null").select(F.col(lang_col).alias("band_lang"), F.floor(F.col("log_ppl") * 1000).alias("bin"))
    each = spool(passed.groupBy("band_lang", "bin").agg(F.count("*").alias("n"))).withColumn("is_all", F.lit(False))
    every = each.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("band_lang"), "bin", "n", F.lit(True).alias("is_all"))
    group = Window.partitionBy("is_all", "band_lang")
    seen = each.unionByName(every).withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))

    def quartile(i: int) -> Column:
        return F.min(F.when(F.col("upto") * 4 >= F.col("total") * i, F.col("bin"))) / 1000.0

    found = seen.groupBy("is_all", "band_lang").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.first("total").alias("n"))
    wide = F.greatest(F.col("q3") - F.col("q1"), F.lit(0.01))
    own = spool(found.select("is_all", "band_lang", "n", (F.col("q1") - wide * reach[0]).alias("low"), (F.col("q3") + wide * reach[1]).alias("high")))
    whole = own.where("is_all").first()
    if whole is None:
        return own.select("band_lang", "low", "high", "is_all")
    weight = F.when(F.col("is_all"), F.lit(1.0)).otherwise(F.col("n") / (F.col("n") + prior))
    return own.select("band_lang", *[(weight * F.col(c) + (1 - weight) * F.lit(whole[c])).alias(c) for c in ("low", "high")], "is_all")


def judge(scored: DataFrame, limits: DataFrame, *, lang_col: str = "lang") -> DataFrame:
    """scored with kept: neither a plain rule nor its language's band rejects it."""
    whole = limits.where("is_all").first()  # one row; none where nothing passes the plain rules
    low, high = (whole.low, whole.high) if whole else (0.0, -1.0)
    own = limits.where("not is_all").select("band_lang", "low", "high")
    out = scored.join(own, F.col(lang_col).eqNullSafe(F.col("band_lang")), "left")
    slack = SHORT / F.sqrt(F.greatest("n_words", F.lit(1)))
    inside = F.coalesce(F.col("log_ppl").between(F.coalesce("low", F.lit(low)) - slack, F.coalesce("high", F.lit(high)) + slack), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & inside).drop("band_lang", "low", "high")


def assess(docs: DataFrame, *, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", reach: tuple[float, float] = REACH, prior: int = PRIOR) -> DataFrame:
    """One row for each document: id, language, METRICS and kept."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    model, rest = learn(slim)
    scored = spool(score(slim, model, keep=["doc_id", "lang"], rest=rest))
    return judge(scored, spool(bands(scored, reach=reach, prior=prior)))


def accept(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", reach: tuple[float, float] = REACH, prior: int = PRIOR) -> DataFrame:
    """The documents that neither the plain rules nor their language's band reject.

    Texts aren't shuffled: they are scored again under the limits, which are a few
    rows, one for each language, and go to the scoring tasks with the model.  Where the
    model doesn't hold all n-grams, the verdicts are joined to the texts by their hashes.
    """
    spark = docs.sparkSession
    model, rest = learn(docs.select(F.col(text_col).alias("text")))
    named = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    if rest is not None:
        scored = spool(score(named.withColumn("th", text_hash()), model, keep=["lang", "th"], rest=rest))
        good = judge(scored, spool(bands(scored, reach=reach, prior=prior))).where("kept").select(F.col("lang").alias("__mr_l"), F.col("th").alias("__mr_t")).distinct()
        src = docs.withColumns({"__mr_lang": F.col(lang_col).cast("string"), "__mr_th": text_hash(text_col)})
        return src.join(good, (F.col("__mr_th") == F.col("__mr_t")) & F.col("__mr_lang").eqNullSafe(F.col("__mr_l")), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    found = bands(spool(score(named, model, keep=["lang"])), reach=reach, prior=prior).collect()  # a row for each language
    own = {r.band_lang: (r.low, r.high) for r in found if not r.is_all}
    every = next(((r.low, r.high) for r in found if r.is_all), (0.0, -1.0))
    shared = spark.sparkContext.broadcast(model)
    del model
    src = docs.withColumn("__mr_lang", F.col(lang_col).cast("string")).withColumn("__mr_text", F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in T.chunks(batch, "__mr_text"):
                log_ppl, none = perplexity(buf, off, shared.value)
                lim = np.array([own.get(x, every) for x in T.column(part, "__mr_lang").to_pylist()])
                m = measure(buf, off)
                slack = SHORT / np.sqrt(np.maximum(m["n_words"], 1))
                ok = ~m["base_failed"] & ~none & (log_ppl >= lim[:, 0] - slack) & (log_ppl <= lim[:, 1] + slack)
                yield part.select(part.schema.names[:-2]).filter(pa.array(ok))

    return src.mapInArrow(run, docs.schema)
