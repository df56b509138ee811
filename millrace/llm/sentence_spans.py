"""Substring dedup by sliding sentence spans.

A text is cut into sentences, at line ends and after . ! or ? before white space.
A sentence of more than ``long_words`` words (a table, a list, a text without stops) is
cut further where its content says so: in every window of ``window`` words before
the word whose hash (with the next word's) is least.  What precedes a shared passage
thus moves no cut beyond its first ``window`` words, and no piece is longer than that.

A run starts at each sentence and takes in at least ``run`` sentences, and more until it
holds ``least_words`` words or the text ends, so a run of a few short words isn't taken for
a repeated passage, and no start is left out.  Every run is hashed, without regard to
case and white space, and counted over the whole corpus.  The first occurrence of a run, in
the order of (id, text hash, position), stays; sentences that any other occurrence
covers are removed.

Defined cases: null text has no sentences and stays null; a document all of whose
sentences are removed becomes the empty text; a text of fewer than ``run``
sentences is never touched; null ids come last in the order; repeated rows (same
id and text) are one document and get the same answer; an empty table gives no
rows; ``dedup`` keeps further columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textops as T
from .common import prepare, spool, text_hash

RUN, LONG_WORDS, WINDOW, LEAST_WORDS = 3, 24, 12, 16

_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[list(b"\"')]")] = True


def sentences(buf: np.ndarray, off: np.ndarray, long_words: int = LONG_WORDS, window: int = WINDOW) -> tuple[T.Spans, np.ndarray, np.ndarray]:
    """Byte ranges of the sentences of a chunk, their hashes and their numbers of words."""
    w = T.words(buf, off)
    n = len(w)
    z = np.zeros(0, np.int64)
    if not n:
        return T.Spans(z, z, z), np.zeros(0, np.uint64), z
    last = buf[w.end - 1]
    stop = _STOP[last] | (_CLOSE[last] & (w.end - w.start > 1) & _STOP[buf[np.maximum(w.end - 2, 0)]])
    lines = np.concatenate([[0], np.cumsum(buf == 0x0A)])
    new = np.ones(n, bool)
    new[1:] = stop[:-1] | (w.row[1:] != w.row[:-1]) | (lines[w.start[1:]] > lines[w.end[:-1]])
    h = T.span_hashes(T.LOWER[buf], w)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, n))
    which = np.repeat(np.arange(len(begin)), size)
    at = np.flatnonzero((which[: n - window + 1] == which[window - 1 :]) & (size[which[: n - window + 1]] > long_words)) if n >= window else z
    if len(at):
        after = np.append(h[1:], np.uint64(0))
        after[:-1][new[1:]] = 0
        key = np.lib.stride_tricks.sliding_window_view(T.mix(h * np.uint64(T._P) + after), window)
        for lo in range(0, len(at), 1 << 17):
            some = at[lo : lo + (1 << 17)]
            new[some + key[some].argmin(1)] = True
    a = np.flatnonzero(new)
    b = np.append(a[1:], n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * T.powers(T._P, n), out=total[1:])
    hash_ = T.mix((total[b] - total[a]) * T.powers(T._PINV, n + 1)[a] + (b - a).astype(np.uint64))
    return T.Spans(w.start[a], w.end[b - 1], w.row[a]), hash_, b - a


def runs(s: T.Spans, words: np.ndarray, run: int = RUN, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First sentence and end (exclusive) of every run of a chunk's sentences."""
    n = len(s)
    total = np.concatenate([[0], np.cumsum(words)])
    start = np.arange(n)
    until = np.searchsorted(s.row, s.row, "right")  # where the text's sentences end
    end = np.maximum(start + run, np.searchsorted(total, total[:-1] + least_words))
    ok = start + run <= until
    return start[ok], np.minimum(end, until)[ok]


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("th"))


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long_words: int = LONG_WORDS, window: int = WINDOW, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, th, pos, hash: every run of sentences."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in T.chunks(batch):
                s, h, words = sentences(buf, off, long_words, window)
                at, end = runs(s, words, run, least_words)
                total = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(h * T.powers(T._P, len(h)), out=total[1:])
                g = T.mix((total[end] - total[at]) * T.powers(T._PINV, len(h) + 1)[at] + (end - at).astype(np.uint64))
                count = np.bincount(s.row, minlength=len(off) - 1)
                pos = at - (np.cumsum(count) - count)[s.row[at]]
                pick = pa.array(s.row[at])
                yield pa.record_batch([T.column(part, "doc_id").take(pick), T.column(part, "th").take(pick), pa.array(pos.astype(np.int32)), pa.array(g.view(np.int64))], names=["doc_id", "th", "pos", "hash"])

    return _slim(docs, id_col, text_col).mapInArrow(work, "doc_id long, th long, pos int, hash long")


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("th").alias("th"), F.col("pos").alias("pos"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """key, starts: for each document (hash of id and text) where its non-first repeated runs start."""
    every = spool(spans(docs, **options))
    first = every.groupBy("hash").agg(F.min(_order()).alias("m"), F.count("*").alias("n")).where("n > 1").select("hash", "m")
    again = every.join(first, "hash").where(F.col("m") != _order())
    return again.groupBy(F.xxhash64("doc_id", "th").alias("key")).agg(F.collect_set("pos").alias("starts"))


def _removed(starts: list[list[int] | None], s: T.Spans, words: np.ndarray, n: int, run: int, least_words: int) -> np.ndarray:
    """Which sentences of a chunk are covered by the runs that start at the given ones."""
    count = np.bincount(s.row, minlength=n)
    lead = np.cumsum(count) - count
    first, end = runs(s, words, run, least_words)
    until = np.zeros(len(s) + 1, np.int64)
    until[first] = end
    at = np.concatenate([np.zeros(0, np.int64), *(lead[r] + np.array(x) for r, x in enumerate(starts) if x)]).astype(np.int64)
    step = np.zeros(len(s) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, until[at], -1)
    return np.cumsum(step[:-1]) > 0


def _apply(docs: DataFrame, found: DataFrame, text_col: str, id_col: str, run: int, long_words: int, window: int, least_words: int, digest: bool) -> DataFrame:
    src = docs.withColumn("__mr_key", F.xxhash64(F.col(id_col).cast("long"), text_hash(text_col)))
    joined = src.join(found.select(F.col("key").alias("__mr_k2"), F.col("starts").alias("__mr_starts")), F.col("__mr_key") == F.col("__mr_k2"), "left").drop("__mr_key", "__mr_k2")
    schema = StructType(list(docs.schema))
    if digest:
        schema = schema.add("n_sentences", "long").add("n_removed", "long").add("removed", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in T.chunks(batch, text_col):
                n = len(off) - 1
                s, _, words = sentences(buf, off, long_words, window)
                gone = _removed(T.column(part, "__mr_starts").to_pylist(), s, words, n, run, least_words)
                # a removed sentence goes with the white space that follows it
                step = np.zeros(len(buf) + 1, np.int64)
                until = np.append(s.start[1:], len(buf))
                until = np.minimum(until, off[s.row + 1])
                np.add.at(step, s.start[gone], 1)
                np.add.at(step, until[gone], -1)
                keep = np.cumsum(step[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(keep)])[off].astype(np.int64)
                text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(left.tobytes()), pa.py_buffer(buf[keep].tobytes())).cast(pa.string())
                i = part.schema.get_field_index(text_col)
                null = part.column(i).is_null()
                cols = [part.column(k) for k, f in enumerate(part.schema.names) if f != "__mr_starts"]
                cols[i] = pc.if_else(null, pa.scalar(None, pa.string()), text)
                names = [f for f in part.schema.names if f != "__mr_starts"]
                if digest:
                    chars = T.char_lengths(buf, off)
                    base = chars[off[:-1]]
                    out = [[] for _ in range(n)]
                    for k in np.flatnonzero(gone):
                        r = s.row[k]
                        out[r].append(f"{chars[s.start[k]] - base[r]}:{chars[s.end[k]] - base[r]}")
                    cols += [pa.array(np.bincount(s.row, minlength=n)), pa.array(np.bincount(s.row[gone], minlength=n)), pa.array([",".join(x) for x in out], pa.string())]
                    names += ["n_sentences", "n_removed", "removed"]
                yield pa.record_batch(cols, names=names)

    return joined.mapInArrow(work, schema)


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long_words: int = LONG_WORDS, window: int = WINDOW, least_words: int = LEAST_WORDS, digest: bool = False) -> DataFrame:
    """docs with the repeated sentences removed from their texts.

    digest adds n_sentences, n_removed and removed (start:end of the removed
    sentences in the old text, code points, comma-joined).
    """
    prepare(docs.sparkSession)
    found = repeated(docs, id_col=id_col, text_col=text_col, run=run, long_words=long_words, window=window, least_words=least_words)
    return _apply(docs, found, text_col, id_col, run, long_words, window, least_words, digest)
