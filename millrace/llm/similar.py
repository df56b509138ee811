"""Near-copies by the Jaccard similarity of word shingles: shared prefixes, then verified.

Work is done on distinct texts (words without regard to case and white space).  All
shingles have one order, rare ones first.  Two sets of similarity s share a shingle among
the first g - ceil(s g) + 1 of each (g: its size), so joining on these prefixes meets
every pair of that similarity: none is left to chance.  What is rare is read from
counts of shingles by cells (``rarity``); any order is right, a good one meets fewer pairs.

Of the shingles that a pair shares, those outside the prefixes are at most the longer rest of
the two, so pairs that share too few in their prefixes, and pairs of too different
sizes, can't be near enough and are left out.  Every other candidate's similarity is
computed from the two sets before it is linked, so nothing below ``similarity`` is linked.

Buckets (texts whose prefixes hold one shingle) of up to ``max_bucket`` texts are joined with
themselves.  In a larger one each text is paired with the bucket's most central text, the
one that meets most others over all its buckets: in a family of near-copies that is what the
others were made from, or like it.  Texts that this doesn't bring into their centre's
component are put together again, bucket by bucket, and so on for ``TURNS`` turns.  That
is only a short way: at the end every pair of a large bucket that the links found
so far leave in different components and that can be near enough is met (``apart``),
so the components are those of all pairs.

There the texts of one centre are compared by their changes: the shingles that a
text has and the centre has not, then those that the centre has and the text has not.
Two texts differ in what differs between their changes.  If d = (1 - s) / (1 + s) and a text of
size g has c changes, its need is (c - d g) / 2, and a pair of similarity s shares
at least as many changes as the needs of both.  A text that isn't linked to the centre
needs more than d / 2 of the centre's size, and no text less than the negative of that, so all
such pairs share a change, at a place of either text's order from which enough changes
are left.  Changes that a family's texts made each for itself are shared with none, and are
what such a text has first.  What remains are texts that leave out the same of
their centre: a family that only leaves out, many of its texts a fifth or more, still meets in
proportion to the square of those texts.

Defined cases: texts without words are all alike; a text of fewer words than a
shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T
from .common import connected_components, prepare, spool, text_hash

SHINGLE, SIMILARITY = 5, 0.8
MAX_BUCKET, TURNS = 16, 3
#: Cells that shingles are counted by, and the segments in which the counts travel.
CELL_BITS, SEGMENTS = 22, 64
#: Texts of a change that one task meets with those outside the largest component.
BLOCK = 4096
#: Texts of one centre that one task compares with it.
DEALT = 256
#: Above any error of products of sizes and similarities, far below the least difference of counts.
EPS = 1e-6


def shingles(buf: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of a chunk's texts, their rows, and a hash of each text's words (0 if none)."""
    n = len(off) - 1
    w = T.words(buf, off)
    h = T.span_hashes(T.LOWER[buf], w)
    count = np.bincount(w.row, minlength=n)
    lead = np.cumsum(count) - count
    whole = np.zeros(n, np.uint64)
    has = np.flatnonzero(count)
    if len(has):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * T.powers(T._P, len(h)), out=total[1:])
        a, b = lead[has], lead[has] + count[has]
        whole[has] = T.mix((total[b] - total[a]) * T.powers(T._PINV, len(h) + 1)[a] + count[has].astype(np.uint64))
    g, at = T.gram_hashes(h, w.row, k)
    short = np.flatnonzero((count > 0) & (count < k))
    row = np.concatenate([w.row[at], short]).astype(np.int64)
    order = np.argsort(row, kind="stable")
    return np.concatenate([g, whole[short]])[order], row[order], whole


def cells(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def rarity(docs: DataFrame, *, text_col: str = "text", shingle: int = SHINGLE) -> np.ndarray:
    """How often shingles of each cell occur, up to 65,535 (and 255 of one task): the order from rare to common."""
    prepare(docs.sparkSession)
    size = (1 << CELL_BITS) // SEGMENTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = np.zeros(1 << CELL_BITS, np.uint32), []

        def add() -> None:
            if held:
                np.add(n, np.bincount(np.concatenate(held), minlength=len(n)), out=n, casting="unsafe")
                held.clear()

        for batch in batches:
            for _, buf, off in T.chunks(batch):
                held.append(cells(shingles(buf, off, shingle)[0]))
                if sum(map(len, held)) >= len(n):
                    add()
        add()
        parts = np.minimum(n, 255).astype(np.uint8).reshape(SEGMENTS, size)
        some = np.flatnonzero(parts.any(axis=1))
        for i in some.tolist():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([parts[i].tobytes()], pa.binary())], names=["segment", "n"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[i] = total.get(i, np.zeros(size, np.uint32)) + np.frombuffer(n.as_buffer(), np.uint8)
        for i, n in total.items():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([np.minimum(n, 65535).astype(np.uint16).tobytes()], pa.binary())], names=["segment", "n"])

    schema = "segment int, n binary"
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, schema).repartition("segment").mapInArrow(add_up, schema)
    out = np.zeros((SEGMENTS, size), np.uint16)
    for r in found.toLocalIterator():
        out[r.segment] = np.frombuffer(r.n, np.uint16)
    return out.ravel()


def beyond(size: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles of a set lie beyond its prefix."""
    return np.ceil(similarity * size - EPS).astype(np.int64) - 1


def keys(docs: DataFrame, order: Broadcast, *, text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """k, fp: the shingles of each text's prefix (copies can repeat them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        for batch in batches:
            for _, buf, off in T.chunks(batch):
                g, row, whole = shingles(buf, off, shingle)
                once = np.zeros(len(whole), bool)
                once[np.unique(whole, return_index=True)[1]] = True
                g, row = g[once[row]], row[once[row]]
                by = np.lexsort((g, rank[cells(g)], row))
                g, row = g[by], row[by]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
                g, row = g[new], row[new]
                size = np.bincount(row, minlength=len(whole))
                place = np.arange(len(g)) - (np.cumsum(size) - size)[row]
                head = place < (size - beyond(size, similarity))[row]
                yield pa.record_batch([pa.array(g[head].view(np.int64)), pa.array(whole[row[head]].view(np.int64))], names=["k", "fp"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "k long, fp long")


def prints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th and fp (hash of the words) of each document."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in T.chunks(batch):
                whole = shingles(buf, off, shingle)[2]
                yield pa.record_batch([T.column(part, "doc_id"), T.column(part, "th"), pa.array(whole.view(np.int64))], names=["doc_id", "th", "fp"])

    return src.mapInArrow(run, "doc_id long, th long, fp long")


def _near_sizes(similarity: float) -> Column:
    return F.least("size", "size_b") >= similarity * F.greatest("size", "size_b") - EPS


def _enough(pairs: DataFrame, similarity: float) -> DataFrame:
    """a, b: the pairs (a row for each prefix shingle met) that can be near enough.

    ``other`` and ``other_b``: how many more of their prefixes' shingles may be shared.
    """
    low = F.col("fp") < F.col("b")
    rest = F.greatest("size", "size_b")
    met = pairs.groupBy(F.when(low, F.col("fp")).otherwise(F.col("b")).alias("a"), F.when(low, F.col("b")).otherwise(F.col("fp")).alias("b")).agg(
        F.count("*").alias("m"), F.first(F.least("other", "other_b")).alias("more"), F.first(F.ceil(rest * similarity - EPS) - 1).alias("beyond"), F.first(F.col("size") + F.col("size_b")).alias("sum")
    )
    return met.where(F.col("m") + F.col("more") + F.col("beyond") >= similarity / (1 + similarity) * F.col("sum") - EPS).select("a", "b")


def _theirs(rows: DataFrame, *on: str) -> DataFrame:
    return rows.select(*on, *[F.col(c).alias("b" if c == "fp" else f"{c}_b") for c in rows.columns if c not in on])


def buckets(rows: DataFrame) -> DataFrame:
    """k, fp, weight, size, n, centre, size_b: the rows whose key others share, with their bucket's size and centre."""
    size = rows.groupBy("k").agg(F.count("*").alias("n"), F.max_by(F.struct("fp", "size"), F.struct("weight", "fp")).alias("c")).where("n > 1")
    return spool(rows.join(size, "k").select("k", "fp", "weight", "size", "n", F.col("c.fp").alias("centre"), F.col("c.size").alias("size_b")))


def candidates(held: DataFrame, *, similarity: float, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """a, b: the pairs of the texts of small buckets, and of large ones' texts and centres, that can be near enough."""
    large = held.groupBy("fp").agg(F.count(F.when(F.col("n") > max_bucket, 1)).alias("other"))
    small = held.where(F.col("n") <= max_bucket).select("k", "fp", "size").join(large, "fp")
    every = small.join(_theirs(small, "k"), "k").where(F.col("fp") < F.col("b")).where(_near_sizes(similarity))
    star = held.where(F.col("n") > max_bucket).where("fp <> centre").where(_near_sizes(similarity))
    star = star.select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b"))
    return _enough(every, similarity).union(star).distinct()


def changes(rows: DataFrame, order: Broadcast, similarity: float) -> DataFrame:
    """centre, e, fp, root, size, need, room: the changes by which each text can meet one of another component.

    room: the changes of the text's order from this one on, less the text's need.  A pair's first
    common change leaves each of the two room for the other's need.
    """
    d = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        for batch in batches:
            e, need, room = [], [], []
            of = [[x.values.to_numpy() for x in T.column(batch, c)] for c in ("grams", "grams_c")]
            for g, c in zip(*of, strict=True):
                new, gone = np.setdiff1d(g, c, assume_unique=True), np.setdiff1d(c, g, assume_unique=True)
                count = rank[cells(new.view(np.uint64))]
                by = np.argsort(count, kind="stable")
                both = np.concatenate([new[by], gone])
                common = len(g) - len(new)
                mine = (len(both) - d * len(g)) / 2
                # texts near the centre are in its component, so they meet only others, which need more
                theirs = d * len(c) / 2 if common / (len(g) + len(c) - common) >= similarity else mine - d * len(g) / similarity
                left = len(both) - np.arange(len(both)) - mine
                shared = np.concatenate([count[by] > 1, np.ones(len(gone), bool)])  # what occurs once meets nothing
                at = shared & (left >= theirs - EPS)
                e.append(both[at])
                need.append(mine)
                room.append(left[at])
            n = [len(x) for x in e]
            if sum(n):
                again = np.repeat(np.arange(len(n)), n)
                own = [T.column(batch, c).take(pa.array(again)) for c in ("centre", "fp", "root", "size")]
                yield pa.record_batch([own[0], pa.array(np.concatenate(e)), *own[1:], pa.array(np.array(need)[again]), pa.array(np.concatenate(room))], names=["centre", "e", "fp", "root", "size", "need", "room"])

    return rows.mapInArrow(run, "centre long, e long, fp long, root long, size int, need double, room double")


def apart(many: DataFrame, roots: DataFrame, sets: DataFrame, order: Broadcast, *, similarity: float) -> DataFrame:
    """a, b: every pair of a large bucket that lies in different components and can be near enough.

    Met by common changes; of the texts of a change those outside their largest
    component are met with all, in blocks.
    """
    own = roots.select(F.col("v").alias("fp"), "root")
    texts = spool(many.select("centre", "fp").distinct().join(own, "fp", "left").select("centre", "fp", F.coalesce("root", "fp").alias("root")))
    split = texts.groupBy("centre").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    split = spool(split.select("centre", F.ceil(F.col("n") / DEALT).cast("int").alias("blocks")))
    mine = texts.join(split, "centre").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int")).join(sets, "fp")
    heads = split.join(sets.select(F.col("fp").alias("centre"), F.col("grams").alias("grams_c")), "centre")
    heads = heads.select("centre", "grams_c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = spool(changes(mine.join(heads, ["centre", "block"]).select("centre", "fp", "root", "size", "grams", "grams_c"), order, similarity))
    parts = rows.groupBy("centre", "e", "root").agg(F.count("*").alias("c")).groupBy("centre", "e")
    parts = parts.agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("r"), F.sum("c").alias("n")).where("r > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    held = spool(rows.join(parts, ["centre", "e"]).withColumns({"is_main": F.col("root") == F.col("main"), "blocks": blocks, "block": F.pmod(F.xxhash64("fp"), blocks).cast("int")}).drop("main", "r", "n"))
    left = held.where("not is_main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("is_main", "blocks")
    right = _theirs(held.drop("blocks"), "centre", "e", "block")
    room = (F.col("room") >= F.col("need_b") - EPS) & (F.col("room_b") >= F.col("need") - EPS)
    pairs = left.join(right, ["centre", "e", "block"]).where("root <> root_b and (is_main_b or fp < b)").where(room & _near_sizes(similarity))
    return spool(pairs.select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b")).distinct())


def shingle_sets(docs: DataFrame, wanted: DataFrame, *, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """fp, grams, size: the distinct shingles of the texts whose hash is in wanted (column th)."""
    once = docs.groupBy(text_hash(text_col).alias("th")).agg(F.first(text_col).alias("text"))  # copies meet before the shuffle
    texts = once.join(wanted, "th", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, off in T.chunks(batch):
                g, row, whole = shingles(buf, off, shingle)
                cut = np.searchsorted(row, np.arange(len(off)))
                sets = [np.unique(g[a:b]).view(np.int64) for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.record_batch([pa.array(whole.view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "grams"])

    return texts.mapInArrow(run, "fp long, grams array<long>").dropDuplicates(["fp"]).withColumn("size", F.size("grams"))


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges whose sets' Jaccard similarity is ``similarity`` or more."""
    one = sets.select(F.col("fp").alias("a"), F.col("grams").alias("ga"))
    two = sets.select(F.col("fp").alias("b"), F.col("grams").alias("gb"))
    common = F.size(F.array_intersect("ga", "gb"))
    is_near: Column = common / (F.size("ga") + F.size("gb") - common) >= similarity
    return edges.join(one, "a").join(two, "b").where(is_near).select("a", "b")


def links(docs: DataFrame, texts: DataFrame, *, text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, max_bucket: int = MAX_BUCKET, turns: int = TURNS) -> DataFrame:
    """Edges a, b between distinct texts (columns fp, th) that connect all near-copies."""
    order = docs.sparkSession.sparkContext.broadcast(rarity(docs, text_col=text_col, shingle=shingle))
    key = Window.partitionBy("k")
    met = keys(docs, order, text_col=text_col, shingle=shingle, similarity=similarity).withColumns({"lo": F.min("fp").over(key), "hi": F.max("fp").over(key)})
    met = spool(met.where("lo <> hi").select("k", "fp").distinct())
    sets = spool(shingle_sets(docs, texts.join(met, "fp", "left_semi").select("th"), text_col=text_col, shingle=shingle))
    n = met.groupBy("k").agg(F.count("*").alias("n"))
    weights = met.join(n, "k").groupBy("fp").agg(F.sum("n").alias("weight"))
    weights = spool(weights.join(sets.select("fp", "size"), "fp"))
    rows = met.join(weights, "fp")
    done = roots = many = None
    for turn in range(1, turns + 1):
        held = buckets(rows)
        pairs = candidates(held, similarity=similarity, max_bucket=max_bucket)
        if roots is not None:
            pairs = _across(pairs, roots)
        found = spool(verified(pairs, sets, similarity))
        done = found if done is None else done.union(found)
        large = held.where(F.col("n") > max_bucket)
        if large.limit(1).count() == 0:  # all buckets were joined in full
            break
        many = large if many is None else many
        roots = spool(connected_components(done))
        mine, theirs = roots.select(F.col("v").alias("fp"), F.col("root").alias("own")), roots.select(F.col("v").alias("centre"), F.col("root").alias("head"))
        split = F.coalesce("own", "fp") != F.coalesce("head", "centre")
        rows = large.join(mine, "fp", "left").join(theirs, "centre", "left").where(split).select("k", "fp", "weight", "size")
    if many is None:
        return done
    if turn > 1 and large.limit(1).count() == 0:  # roots lack the last turn's links
        roots = spool(connected_components(done))
    rest = apart(many, roots, sets, order, similarity=similarity)
    return done.union(spool(verified(rest, sets, similarity)))


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose texts lie in different components."""
    of = [roots.select(F.col("v").alias(x), F.col("root").alias(f"r{x}")) for x in "ab"]
    return pairs.join(of[0], "a", "left").join(of[1], "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def components(docs: DataFrame, found: DataFrame, **options) -> DataFrame:
    """fp, root (one text of its component) and component_id (least doc_id there), of what prints() found."""
    texts = spool(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("th").alias("th")))
    roots = connected_components(links(docs, texts, **options))
    at = texts.join(roots, texts.fp == roots.v, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = at.groupBy("root").agg(F.min("least").alias("component_id"))
    return at.join(best, "root").select("fp", "root", "component_id")
