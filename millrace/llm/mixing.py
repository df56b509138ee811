"""Mixing sources to target weights, in blocks of a fixed number of words.

Each source's documents, in the order of their ids, are one stream of words that
is cut into blocks of one length, ``block_words``, or in a source of fewer than ``FEW``
such blocks the FEW-th part of its words (one word at least), so that rounding to blocks
moves no source by more than half of such a part; only a source's last block is shorter.
A mix has ``shards`` output shards.  For every shard a multinomial draw says how
many slots each source gets, with probabilities in proportion to what the source
is still to give, so the sum over shards meets the source's target.  A source's
n-th slot maps through a pseudorandom permutation of the source's block indices
(another one for each pass over the source), and slots are joined to blocks by
that index.  No block is used more than three times, as targets stop there.

The running offset of a document in its source comes from one range sort of
(source, id, size) rows and a sum for each partition and source, so a source of
any size is spread over tasks.  What reaches the driver is a row for each source,
and for each pair of partition and source that meet (partitions + sources); joins back to
these rows are broadcast only where Spark finds them small.  The draws are made again by
every task that lays out slots, from the sources' numbers of slots.

Defined cases: null text has size 0 and gives nothing; a null source is a source
of its own, the last; null ids come last within their source; repeated rows are
documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import prepare, spool, text_hash

BLOCK_WORDS, FEW, SHARDS, MOST, SEED = 128, 256, 256, 3, 20240
#: Slots that a task lays out, about.
TASK_SLOTS = 1 << 18


def sizes(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, th, size: the number of words of each document."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), text_hash(text_col).alias("th"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in T.chunks(batch):
                n = np.bincount(T.words(buf, off).row, minlength=len(off) - 1)
                yield pa.record_batch([*part.columns[:3], pa.array(n)], names=["doc_id", "source", "th", "size"])

    return src.mapInArrow(run, "doc_id long, source string, th long, size long")


def targets(size: list[int], weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> list[float]:
    """Share of all sizes for each source by its weight, none above most times its size."""
    w = [weights[i % len(weights)] for i in range(len(size))]
    out, open_, left = [0.0] * len(size), set(range(len(size))), float(sum(size))
    while open_:
        total = sum(w[i] for i in open_)
        over = [i for i in sorted(open_) if left * w[i] / total > most * size[i]]
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = float(most * size[i])
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n), by a Feistel network that is walked until it is below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    low = (np.uint64(1) << half) - np.uint64(1)
    x, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        a, b = x[todo] >> half[todo], x[todo] & low[todo]
        for r in range(4):
            a, b = b, a ^ (T.mix(b + key[todo].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r << 56)) & low[todo])
        x[todo] = (a << half[todo]) | b
        todo &= x >= n.astype(np.uint64)
    return x.astype(np.int64)


@dataclass
class Mix:
    """sources: a row for each source; rows: documents with their place in their source; slots: the mix."""

    sources: list[dict]
    rows: DataFrame
    slots: DataFrame

    def pieces(self) -> DataFrame:
        """row, source_no, block, at (first word within the document), n: a document's part in each block."""
        w = F.col("width")
        first, last = F.expr("start div width"), F.expr("(start + size - 1) div width")
        p = self.rows.where("size > 0").select("row", "source_no", "start", "size", "width", F.explode(F.sequence(first, last)).alias("block"))
        at = F.greatest(F.col("block") * w - F.col("start"), F.lit(0))
        return p.select("row", "source_no", "block", at.alias("at"), (F.least((F.col("block") + 1) * w - F.col("start"), "size") - at).alias("n"))

    def taken(self) -> DataFrame:
        """rows with taken: the words of the document in the mix, repeats counted."""
        # the planner takes the slots for as small as the draws they come from: merge, never broadcast
        used = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"))
        got = self.pieces().join(used.hint("merge"), ["source_no", "block"]).groupBy("row").agg(F.sum(F.col("n") * F.col("uses")).alias("taken"))
        return self.rows.join(got, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def draw(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each shard (row) and source (column): multinomial draws that use up every source's slots."""
    left = np.array(slots, np.int64)
    each = -(-int(left.sum()) // max(shards, 1))
    out = np.zeros((shards, len(left)), np.int64)
    for i in range(shards):
        need = min(each, int(left.sum()))
        while need > 0:  # what a source can't give any more is drawn again from the others
            rng = np.random.Generator(np.random.PCG64([seed, i, need]))
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[i] += got
            left -= got
            need -= int(got.sum())
    return out


def plan(docs: DataFrame, *, block_words: int = BLOCK_WORDS, shards: int = SHARDS, weights: tuple[int, ...] = (1, 2, 3), seed: int = SEED, **columns: str) -> Mix:
    spark = docs.sparkSession
    ordered = sizes(docs, **columns).orderBy(F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), "th")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, at, before, carry = TaskContext.get().partitionId(), 0, object(), 0
        for batch in batches:
            size, source = batch.column(3).to_numpy(), batch.column(1).to_pylist()
            if not source:
                continue
            total = np.concatenate([[0], np.cumsum(size)])
            new = np.array([x != y for x, y in zip(source, [before, *source], strict=False)])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            base = np.where(lead >= 0, total[lead], -carry)
            start = total[:-1] - base
            carry, before = int(total[-1] - base[-1]), source[-1]
            row = (pid << 33) + at + np.arange(len(size))
            at += len(size)
            yield pa.record_batch([*batch.columns, pa.array(start), pa.array(row), pa.array(np.full(len(size), pid, np.int32))], names=["doc_id", "source", "th", "size", "local", "row", "pid"])

    placed = spool(ordered.mapInArrow(place, "doc_id long, source string, th long, size long, local long, row long, pid int"))
    sums = placed.groupBy("source", "pid").agg(F.sum("size").alias("size")).collect()  # partitions + sources rows
    names = sorted({r.source for r in sums}, key=lambda s: (s is None, (s or "").encode()))
    number, base, size = {s: i for i, s in enumerate(names)}, [], [0] * len(names)
    for r in sorted(sums, key=lambda r: (number[r.source], r.pid)):
        i = number[r.source]
        base.append([r.source, r.pid, i, size[i]])
        size[i] += r["size"]
    goal = targets(size, weights)
    width = [min(block_words, max(1, s // FEW)) for s in size]
    blocks = [-(-s // w) for s, w in zip(size, width, strict=True)]
    n_slots = [min(MOST * b, round(t * b / s)) if s else 0 for s, t, b in zip(size, goal, blocks, strict=True)]
    sources = [{"source": s, "source_no": i, "size": size[i], "target": goal[i], "width": width[i], "blocks": blocks[i], "slots": n_slots[i]} for i, s in enumerate(names)]
    bases = spark.createDataFrame([(*b, width[b[2]]) for b in base], "b_source string, b_pid int, source_no int, base long, width long")
    rows = placed.join(bases, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("pid") == F.col("b_pid")))
    rows = rows.select("row", "doc_id", "source", "th", "source_no", "size", "width", (F.col("local") + F.col("base")).alias("start"))
    return Mix(sources, rows, _slots(spark, n_slots, blocks, shards, seed))


def _slots(spark, n_slots: list[int], blocks: list[int], shards: int, seed: int) -> DataFrame:
    """shard, position, source_no, slot, block: one row for each slot of the mix.

    A shard's slots are laid out in parts of TASK_SLOTS, so tasks are as many as the mix needs.
    """
    total = sum(n_slots)
    parts = max(1, -(-total // (shards * TASK_SLOTS)))  # of each shard
    tasks = min(shards * parts, max(spark.sparkContext.defaultParallelism, total // TASK_SLOTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = draw(n_slots, shards, seed)
        before = np.cumsum(counts, axis=0) - counts
        within = np.cumsum(counts, axis=1) - counts
        size = counts.sum(axis=1)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                shard, part = divmod(x, parts)
                for j in np.flatnonzero(counts[shard]).tolist():
                    n, begin = int(counts[shard, j]), int(within[shard, j])
                    # the part's share of the shard's slots that are this source's
                    lo = max(0, part * int(size[shard]) // parts - begin)
                    hi = min(n, (part + 1) * int(size[shard]) // parts - begin)
                    if lo >= hi:
                        continue
                    k = np.arange(lo, hi)
                    slot, full = int(before[shard, j]) + k, np.full(len(k), 1)
                    key = seed + 7919 * (j + 1) + 104729 * (slot // blocks[j])
                    block = permute(slot % blocks[j], full * blocks[j], key)
                    position = permute(begin + k, full * int(size[shard]), full * (seed + 15485863 * (shard + 1)))
                    yield pa.record_batch([pa.array(full.astype(np.int32) * shard), pa.array(position), pa.array(full.astype(np.int32) * j), pa.array(slot), pa.array(block)], names=["shard", "position", "source_no", "slot", "block"])

    return spark.range(0, shards * parts, 1, max(1, tasks)).mapInArrow(run, "shard int, position long, source_no int, slot long, block long")


def mixed_blocks(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: shard, position, source, block, doc_ids, n_words and text of each slot.

    A block's pieces are gathered once, by (source, block), and joined to the slots
    that use it; a block holds block_words pieces at most.
    """
    mix = plan(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    key = F.xxhash64("doc_id", "source", "th")
    # each different text once; rows that repeat it are on the other side of a join, which can be split
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), text_hash(text_col).alias("th"), F.col(text_col).alias("text"))
    texts = src.groupBy(key.alias("key")).agg(F.first("text", ignorenulls=True).alias("text"))
    places = mix.rows.where("size > 0").select(key.alias("key"), "doc_id", "source_no", "width", "start")
    placed = places.join(texts, "key").select("doc_id", "source_no", "width", "start", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in T.chunks(batch):
                w = T.words(buf, off)
                n = np.bincount(w.row, minlength=len(off) - 1)
                lead = np.cumsum(n) - n
                offset = T.column(part, "start").to_numpy()[w.row] + np.arange(len(w)) - lead[w.row]
                block = offset // T.column(part, "width").to_numpy()[w.row]
                new = np.ones(len(w), bool)
                new[1:] = (w.row[1:] != w.row[:-1]) | (block[1:] != block[:-1])
                a = np.flatnonzero(new)
                b = np.append(a[1:], len(w))
                data = buf.tobytes()
                text = [data[s:e].decode("utf-8", "replace") for s, e in zip(w.start[a].tolist(), w.end[b - 1].tolist(), strict=True)]
                pick = pa.array(w.row[a])
                yield pa.record_batch([T.column(part, "source_no").take(pick), pa.array(block[a]), pa.array(offset[a]), T.column(part, "doc_id").take(pick), pa.array(b - a), pa.array(text, pa.string())], names=["source_no", "block", "at", "doc_id", "n", "text"])

    pieces = placed.mapInArrow(cut, "source_no int, block long, at long, doc_id long, n long, text string")
    whole = pieces.groupBy("source_no", "block").agg(F.sort_array(F.collect_list(F.struct("at", "doc_id", "n", "text"))).alias("p"))
    names = docs.sparkSession.createDataFrame([(s["source_no"], s["source"]) for s in mix.sources], "source_no int, source string")
    out = mix.slots.join(whole.hint("merge"), ["source_no", "block"]).join(names, "source_no")
    total = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return out.select("shard", "position", "source", "block", F.col("p.doc_id").alias("doc_ids"), total.alias("n_words"), F.array_join("p.text", "\n").alias("text"))


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    mix = plan(docs, **options)
    per = docs.sparkSession.createDataFrame([(s["source_no"], s["size"], s["target"]) for s in mix.sources], "source_no int, source_size long, target double")
    return mix.taken().join(per, "source_no").select("doc_id", "size", "source_size", "target", "taken", "source")
