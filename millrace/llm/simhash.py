"""SimHash near-duplicates: pigeonhole blocks, joined on, then verified.

A fingerprint is cut into ``blocks`` parts.  Fingerprints that differ in at most
``max_bits`` bits agree in ``blocks - max_bits`` parts at least, so joining on
every choice of that many parts meets every close pair.  Work is done on distinct
fingerprints: a group of copies is one row however large it is.

Buckets of up to ``max_bucket`` fingerprints are joined with themselves and every
pair's Hamming distance is verified.  A larger bucket isn't expanded into pairs:
each of its fingerprints is filed under itself and its 64 one-bit neighbours
(for max_bits = 2), and fingerprints filed under the same value are at most two
bits apart, and all that are at most two bits apart share such a value.  Linking
each to the least of its file gives the same components with 65 rows for each
fingerprint, and drops nothing.

Defined cases: a null or blank text has fingerprint 0 and is linked like any
other; a null id takes part but never becomes a component's id unless all of its
component's ids are null; repeated rows are returned as often as they come;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import similar
from . import textops as T
from .common import connected_components, prepare, spool, text_hash

SEED = 42


def fingerprints_of(buf: np.ndarray, off: np.ndarray, shingle: int = 3) -> np.ndarray:
    """The 64-bit fingerprint of each text of a chunk."""
    n = len(off) - 1
    buf = T.LOWER[buf]
    w = T.words(buf, off)
    out = np.zeros(n, np.uint64)
    if not len(w):
        return out
    # words of the chunk joined by single spaces, so that a shingle is one slice
    size = w.end - w.start + 1
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.arange(at[-1]) + np.repeat(w.start - at[:-1], size)
    flat[at[1:] - 1] = 0
    joined = buf[flat]
    joined[at[1:] - 1] = 0x20
    data = joined.tobytes()
    count = np.bincount(w.row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    width = np.minimum(count, shingle)  # a shorter text is one shingle
    k = np.where(count > 0, count - width + 1, 0)
    row = np.repeat(np.arange(n), k)
    lead = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[:-1], k)
    last = lead + width[row] - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[a:b], SEED) for a, b in zip(at[lead].tolist(), (at[last + 1] - 1).tolist(), strict=True)), np.uint64, len(lead))
    has = np.flatnonzero(k)
    begin = (np.cumsum(k) - k)[has]
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
    out[has] = np.packbits(2 * ones > k[has][:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, th (hash of the text), fp (long, the fingerprint's 64 bits)."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in T.chunks(batch):
                fp = fingerprints_of(buf, off, shingle).view(np.int64)
                yield pa.record_batch([T.column(part, "doc_id"), T.column(part, "th"), pa.array(fp)], names=["doc_id", "th", "fp"])

    return src.mapInArrow(run, "doc_id long, th long, fp long")


def masks(max_bits: int, blocks: int) -> list[int]:
    """A mask for each choice of blocks that must agree."""
    cut = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:], strict=False)]
    return [sum(c) for c in combinations(part, blocks - max_bits)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, *, max_bits: int = 2, blocks: int = 5, max_bucket: int = 32) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp) that connect all close ones."""
    if max_bits != 2:
        raise ValueError("the exact way for large buckets is written for max_bits = 2")
    keys = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for i, m in enumerate(masks(max_bits, blocks))])).alias("x")).select("fp", "x.c", "x.k")
    shared = keys.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    held = spool(keys.join(shared, ["c", "k"]))
    few = held.where(F.col("n") <= max_bucket).select("c", "k", "fp")
    other = few.select("c", "k", F.col("fp").alias("b"))

    def near(a: str, b: str) -> Column:
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits

    pairs = few.join(other, (few.c == other.c) & (few.k == other.k) & (F.col("fp") < F.col("b")) & near("fp", "b")).select(F.col("fp").alias("a"), "b")
    many = held.where(F.col("n") > max_bucket).select("fp").distinct()
    filed = many.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])).alias("v"))
    least = filed.groupBy("v").agg(F.min("fp").alias("b"), F.max("fp").alias("hi")).where("b < hi").drop("hi")
    stars = filed.join(least, "v").where("fp <> b").where(near("fp", "b")).select(F.col("fp").alias("a"), "b")
    return pairs.union(stars).distinct()


def components(prints: DataFrame, **options) -> DataFrame:
    """fp, root (one fingerprint of its component) and component_id (least doc_id there)."""
    fps = spool(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(fps.select("fp"), **options))
    at = fps.join(roots, fps.fp == roots.v, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = at.groupBy("root").agg(F.min("least").alias("component_id"))
    return at.join(best, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = similar.SHINGLE, similarity: float | None = similar.SIMILARITY, **options) -> DataFrame:
    """One row for each document: doc_id, th, fp, root and component_id.

    Documents are linked by the similarity of their shingles (``similar``; fp is then
    a hash of the words), or with ``similarity=None`` by their fingerprints' bits.
    """
    if similarity is None:
        prints = spool(fingerprint(docs, id_col=id_col, text_col=text_col, shingle=shingle))
        linked = components(prints, **options)
    else:
        prints = spool(similar.prints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
        linked = similar.components(docs, prints, text_col=text_col, shingle=shingle, similarity=similarity, **options)
    return prints.join(linked, "fp").select("doc_id", "th", "fp", "root", "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without near-copies: of each component the one with the smallest id.

    Rows that share that id (repeated rows, or two texts under one id) are put in
    the order of their texts' hashes, and of a hash of all columns but maps, and the first
    stays, so one row stays of every component however the rows are dealt out; null ids
    come last.  Columns are those of docs.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("th").alias("th"))
    first = found.groupBy("root").agg(F.min(order).alias("m"))
    first = first.select(F.xxhash64(F.when(~F.col("m.none"), F.col("m.id")), F.col("m.th")).alias("__mr_first")).distinct()
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.withColumns({"__mr_key": F.xxhash64(F.col(id_col).cast("long"), text_hash(text_col)), "__mr_row": F.xxhash64(*hashed)})
    kept = rows.join(first, F.col("__mr_key") == F.col("__mr_first"), "left_semi")
    again = F.row_number().over(Window.partitionBy("__mr_key").orderBy("__mr_row"))
    return kept.withColumn("__mr_again", again).where("__mr_again = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
