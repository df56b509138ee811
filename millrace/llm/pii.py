"""Personal data: patterns, then information-theoretic sanitisation.

Base entities are found by patterns, leftmost and non-overlapping for each kind.
Around them the corpus tells which other words give an entity away.  With
document frequencies over the whole corpus, the disclosure of entity c by term t is

    PMI(c; t) / IC(c),   PMI = log2(N n(c,t) / (n(c) n(t))),   IC = log2(N / n(c))

which is 1 if t occurs only near c (seeing t gives all the information about c)
and 0 if t and c are independent.  n(c,t) counts the documents in which t is among
the ``context`` words and entities on either side of c.  A term that discloses an
entity of its document by ``generalise`` at least is a term span wherever it stands in that
document: it is generalised, or from ``remove`` on removed.  One document is enough:
a word that occurs nowhere else and stands next to an address tells all about it.

Only DataFrame functions are used, and each takes time in proportion to a text's
length, however many entities it holds.  Matches leave the scan as lengths (what lies
before each, and its own); running sums over a document's matches make positions of
them, and windows over its words and entities by position make their contexts.  Only
documents with a match are expanded, and repeated rows once.  Counting the corpus's
terms is one map-side combined aggregation of 64-bit hashes.  Texts aren't shuffled
to find spans; to replace them, those with a match are.

The patterns are written so that matching takes linear time: repetitions are
possessive and a match can only start where the plain pattern's could, which
leaves the matches unchanged.

Defined cases: null text is empty and has no spans; a null id is an id; repeated
rows get the same answer (and count as documents of their own in n); an entity
that every document holds has no information and discloses nothing; a word that
touches an entity is part of it and no term; an empty table gives no rows;
``sanitise`` keeps further columns.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spool

KINDS = ("email", "ip", "card", "phone")
CONTEXT, GENERALISE, REMOVE = 10, 0.8, 0.95
#: Code points of a text that are replaced at once.
PIECE = 4096

# The patterns, with a cheap text that any match contains.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": (rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", ""),
    "phone": (r"\+[0-9](?:[\x20().-]*+[0-9]){7,14}+(?![\x20().-]*+[0-9])", "+"),
}
TERM = r"\p{L}{2,}+"
NOT_TERM = r"[^\p{L}]+"


TERM_KIND = len(KINDS)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, evaluated once: as a lambda's variable the optimizer can't copy it into loops."""
    return F.element_at(F.transform(F.array(value), body), 1)


def located(text: Column, pattern: str, made: Callable[[Column, Column, Column], Column]) -> Column:
    """What made gives for each match of a pattern: the code points between it and the match before, its own, its value."""
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))
    return bound(found, lambda x: F.transform(x["values"], lambda v, i: made(F.length(F.get(x["gaps"], i)), F.length(v), v)))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.split(F.reverse(x), "")
    each = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, c: a + c) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(value, r"\."), lambda p: F.right(F.concat(F.lit("00"), p), F.lit(3)).cast("int") <= 255)
    if kind == "card":
        return luhn(digits(value))
    return F.lit(True)


def _item(kind: int, gap: Column, size: Column, ok: Column, h: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), gap.alias("gap"), size.alias("size"), ok.alias("ok"), h.alias("h"))


def _none() -> Column:
    return F.array().cast("array<struct<kind:int,gap:int,size:int,ok:boolean,h:bigint>>")


def _has(text: Column, kind: str) -> Column:
    pattern, mark = PATTERNS[kind]
    return F.contains(text, F.lit(mark)) & text.rlike(pattern) if mark else text.rlike(pattern)


def _entities(text: Column) -> Column:
    """Items of all matches, those that fail too (their lengths count): h is a hash of the entity."""

    def of(no: int, kind: str) -> Column:
        same = {"email": F.lower, "ip": lambda v: v}.get(kind, digits)
        return F.when(_has(text, kind), located(text, PATTERNS[kind][0], lambda g, n, v: _item(no, g, n, valid(kind, v), F.xxhash64(F.lit(kind), same(v))))).otherwise(_none())

    return F.concat(*[of(i, k) for i, k in enumerate(KINDS)])


def _words(text: Column) -> Column:
    return located(text, TERM, lambda g, n, v: _item(TERM_KIND, g, n, F.lit(True), F.xxhash64(F.lower(v))))


def find_base(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, items: the matches of each document and, if there are any, its words, as lengths."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items = bound(_entities(F.col("text")), lambda e: F.when(F.size(e) > 0, F.concat(e, _words(F.col("text")))).otherwise(e))
    return src.select("doc_id", F.xxhash64("doc_id", F.xxhash64("text")).alias("key"), items.alias("items"))


def placed(found: DataFrame, *, context: int = CONTEXT) -> DataFrame:
    """key, copies, kind, start, end, h, near: entities and clear words of each different document with a match.

    near: for a word, the entities within ``context`` words and entities of it.
    """
    once = found.where(F.size("items") > 0).groupBy("key").agg(F.first("items").alias("items"), F.count("*").alias("copies"))
    rows = once.select("key", "copies", F.posexplode("items").alias("n", "x")).select("key", "copies", "n", "x.kind", "x.gap", "x.size", "x.ok", "x.h")
    so_far = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("key", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", so_far.cast("int")).withColumn("start", F.col("end") - F.col("size")).where("ok")
    word = F.col("kind") == TERM_KIND
    # an entity that begins before a word's end and ends after its begin touches the word
    order = Window.partitionBy("key").orderBy("at", F.col("kind").desc(), "n")
    rows = rows.withColumn("at", F.when(word, F.col("end")).otherwise(F.col("start")))
    reach = F.max(F.when(~word, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("reach", reach).where(~word | F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)))
    near = F.collect_list(F.when(~word, F.col("h"))).over(order.rowsBetween(-context, context))
    return rows.select("key", "copies", "kind", "start", "end", "h", F.when(word, F.array_distinct(near)).alias("near"))


def term_documents(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """t, n_t: in how many documents of the corpus each term occurs."""
    words = F.array_distinct(F.split(F.lower(F.col(text_col)), NOT_TERM))
    return docs.select(F.explode(words).alias("w")).where(F.length("w") >= 2).select(F.xxhash64("w").alias("t")).groupBy("t").agg(F.count("*").alias("n_t"))


def disclosing(pairs: DataFrame, rows: DataFrame, terms: DataFrame, n: int, *, generalise: float = GENERALISE) -> DataFrame:
    """c, t, disclosure: the terms that reveal an entity by ``generalise`` at least.

    pairs: key, copies, c, t, each once; rows: what ``placed`` found; terms: t, n_t;
    n: the documents of the corpus.
    """
    joint = pairs.groupBy("c", "t").agg(F.sum("copies").alias("n_ct"))
    each = rows.where(F.col("kind") < TERM_KIND).select("key", "copies", F.col("h").alias("c")).distinct().groupBy("c").agg(F.sum("copies").alias("n_c"))
    known = joint.join(terms, "t").join(each, "c").where(F.col("n_c") < n)
    pmi = F.log2(F.lit(float(n)) * F.col("n_ct") / F.col("n_c") / F.col("n_t"))
    out = known.withColumn("disclosure", pmi / F.log2(F.lit(float(n)) / F.col("n_c")))
    return out.where(F.col("disclosure") >= generalise).select("c", "t", "disclosure")


def located_spans(docs: DataFrame, found: DataFrame, *, text_col: str = "text", context: int = CONTEXT, generalise: float = GENERALISE) -> DataFrame:
    """key, kind, start, end, disclosure: the spans of each different document, terms under TERM_KIND."""
    rows = spool(placed(found, context=context))
    words = rows.where(F.col("kind") == TERM_KIND)
    pairs = spool(words.where(F.size("near") > 0).select("key", "copies", F.explode("near").alias("c"), F.col("h").alias("t")).distinct())
    told = disclosing(pairs, rows, term_documents(docs, text_col=text_col), found.count(), generalise=generalise)
    hit = pairs.join(told, ["c", "t"]).groupBy("key", F.col("t").alias("h")).agg(F.max("disclosure").alias("disclosure"))
    terms = words.join(hit, ["key", "h"]).select("key", "kind", "start", "end", "disclosure")
    base = rows.where(F.col("kind") < TERM_KIND).select("key", "kind", "start", "end", F.lit(None).cast("double").alias("disclosure"))
    return base.unionByName(terms)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each document: doc_id, key and spans (kind, start, end, disclosure), by kind and then by start."""
    found = spool(find_base(docs, id_col=id_col, text_col=text_col))
    each = located_spans(docs, found, text_col=text_col, **options).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "disclosure"))).alias("spans"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,disclosure:double>>")
    return found.select("doc_id", "key").join(each, "key", "left").select("doc_id", "key", F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    def of(no: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == no)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < TERM_KIND)
    return found.select("doc_id", *[of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _marks(spans: DataFrame, remove: float) -> DataFrame:
    """key, marks: for each PIECE code points of a document, by number, what is to be replaced there, in order.

    Spans that overlap are replaced as one, by the first one's mark.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    mark = F.when(F.col("kind") < TERM_KIND, F.get(names, F.col("kind"))).when(F.col("disclosure") >= remove, "").otherwise("<TERM>")
    rows = spans.select("key", "start", "end", mark.alias("mark"))
    order = Window.partitionBy("key").orderBy("start", "end", "mark")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", (F.col("start") >= F.coalesce(before, F.lit(0))).cast("int"))
    rows = rows.withColumn("group", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = rows.groupBy("key", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("mark", F.struct("start", "end", "mark")).alias("mark"))
    first, last = F.floor(F.col("start") / PIECE).cast("int"), F.floor((F.col("end") - 1) / PIECE).cast("int")
    cut = whole.select("key", "start", "end", "mark", first.alias("first"), F.explode(F.sequence(first, last)).alias("piece"))
    lo = F.greatest(F.col("start") - F.col("piece") * PIECE, F.lit(0))
    hi = F.least(F.col("end") - F.col("piece") * PIECE, F.lit(PIECE))
    one = F.struct(lo.alias("start"), hi.alias("end"), F.when(F.col("piece") == F.col("first"), F.col("mark")).otherwise("").alias("mark"))
    pieces = cut.groupBy("key", "piece").agg(F.sort_array(F.collect_list(one)).alias("marks"))
    return pieces.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("piece", "marks"))).alias("marks"))


def _replaced(text: Column, marks: Column) -> Column:
    def one(piece: Column, mine: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(piece, acc["at"] + 1, s["start"] - acc["at"]), s["mark"]).alias("out"))

        return F.aggregate(mine, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(piece, acc["at"] + 1, F.lit(PIECE))))

    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p, i: F.coalesce(one(p, F.try_element_at(marks, i)), p)), "")


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, **options) -> DataFrame:
    """docs with entities replaced by their kind, and disclosing terms generalised or removed.

    Documents without any match pass as they are; the others meet their marks by a join.
    """
    found = spool(find_base(docs, id_col=id_col, text_col=text_col))
    marks = _marks(located_spans(docs, found, text_col=text_col, **options), remove).select(F.col("key").alias("__mr_found"), F.col("marks").alias("__mr_marks"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    may = functools.reduce(lambda a, b: a | b, [_has(text, k) for k in KINDS])
    plain = docs.where(~may)
    rows = docs.where(may).withColumn("__mr_key", F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text)))
    joined = rows.join(marks, F.col("__mr_key") == F.col("__mr_found"), "left")
    new = F.when(F.col("__mr_marks").isNull(), F.col(text_col)).otherwise(_replaced(F.col(text_col), F.col("__mr_marks")))
    return plain.unionByName(joined.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]))
