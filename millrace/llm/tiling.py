"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased runs of letters, marks and digits; a character of a script
that is written without spaces (``ALONE``) is a token of its own.  Documents are
joined to the benchmark's items by the hashes of their seeds, the runs of
``min_match`` tokens.  For a document and an item that share seeds, the longest
match whose tokens are all unmarked is marked, again and again, until none of
min_match tokens is left (ties: the first in the document, then in the item).  Tiles
may lie in any order, so reordered passages count in full.  A document is
contaminated by an item if tiles cover ``threshold`` of its tokens.

Matches are found by running Karp-Rabin: the hash of any window of either text is a
difference of two running sums, so the windows of one length are compared in one
pass, and the greatest length that both texts share is found by bisection.  Equal
hashes are verified against the tokens.  No pairs of positions are kept: a document
and an item take memory in proportion to their lengths, however repetitive they are.
A document's seeds are joined to a block's in pieces of ``PIECE`` positions, or of
one document, which meets each seed of the block once at most.

The benchmark is taken in blocks of bounded size, each sent to all tasks; any
number of blocks is handled, and the documents aren't shuffled.

Defined cases: null and blank texts match nothing; an item of fewer than
min_match tokens has no seed and matches nothing; an item without an id is judged
like any other and reported under null; repeated rows are judged alike;
items with one id and different texts are judged apart; an empty table on
either side gives no matches; further columns of documents pass through.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import prepare

MIN_MATCH, THRESHOLD = 4, 0.5
#: Bytes of benchmark text in one block; seed positions that are joined at once.
BLOCK_BYTES, PIECE = 16 << 20, 1 << 20
#: Kana and ideographs, which are written without spaces.
ALONE = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """For each code point: 0 between tokens, 1 part of one, 2 a token of its own."""
    if not _classes:
        t = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), np.uint8, 0x110000)
        for lo, hi in ALONE:
            t[lo : hi + 1] *= 2
        _classes.append(t)
    return _classes[0]


def token_spans(buf: np.ndarray, off: np.ndarray) -> T.Spans:
    """Byte ranges of the tokens of a chunk's (lower-cased) texts."""
    kind = classes()[buf]  # right for ASCII
    if len(buf) and buf.max() >= 0x80:
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = np.repeat(classes()[cp], np.diff(np.append(lead, len(buf))))
    else:
        lead = np.arange(len(buf))
    if not len(kind):
        return T.runs(kind > 0, off)
    # a token begins at a text's begin, after what is no token, and around characters that stand alone
    new = np.zeros(len(kind) + 1, bool)
    new[off] = True
    new[lead] |= kind[lead] == 2
    new[1:] |= kind == 0
    new[lead[1:]] |= kind[lead[:-1]] == 2
    inside = kind > 0
    start = np.flatnonzero(inside & new[:-1])
    last = np.append(~inside[1:], True) | new[1:]
    return T.Spans(start, np.flatnonzero(inside & last) + 1, np.searchsorted(off, start, "right") - 1)


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a column of texts, and the row of each."""
    batch = pa.record_batch([pc.utf8_lower(pc.fill_null(col, "").cast(pa.string()))], names=["text"])
    h, row, at = [], [], 0
    for part, buf, off in T.chunks(batch):
        w = token_spans(buf, off)
        h.append(T.span_hashes(buf, w))
        row.append(w.row + at)
        at += part.num_rows
    return (np.concatenate(h), np.concatenate(row)) if h else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Seeds:
    """The tokens of a block of items, and its seeds sorted by hash."""

    def __init__(self, ids: list[int | None], texts: list[str], k: int):
        self.token, self.item = tokens(pa.array(texts, pa.string()))
        self.k, self.ids = k, ids
        self.length = np.bincount(self.item, minlength=len(ids))
        self.first = np.cumsum(self.length) - self.length
        g, at = T.gram_hashes(self.token, self.item, k)
        order = np.argsort(g, kind="stable")
        self.hash, self.pos = g[order], at[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hash & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def candidates(self, h: np.ndarray, row: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
        """Row and item of each pair whose shared seeds hold ``threshold`` of the item's tokens, which bounds what tiles cover."""
        g, at = T.gram_hashes(h, row, self.k)
        maybe = np.flatnonzero(self.seen[(g & np.uint64(0xFFFFF)).astype(np.int64)])
        g, r = g[maybe], row[at[maybe]]
        order = np.lexsort((g, r))  # each of a row's seeds once
        g, r = g[order], r[order]
        once = np.ones(len(g), bool)
        once[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        g, r = g[once], r[once]
        lo, hi = np.searchsorted(self.hash, g, "left"), np.searchsorted(self.hash, g, "right")
        met = np.flatnonzero(hi > lo)
        r, lo, n = r[met], lo[met], (hi - lo)[met]
        begin = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else met
        total = np.append(np.cumsum(n) - n, n.sum())
        cut = np.append(begin, len(r))
        i = 0
        while i < len(begin):  # whole rows, of PIECE positions in all
            j = max(i + 1, int(np.searchsorted(total[cut], total[cut[i]] + PIECE, "right")) - 1)
            a, b = cut[i], cut[j]
            m = n[a:b]
            s = np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            under = (np.repeat(r[a:b], m) * np.int64(len(self.token)) + self.pos[s])[:, None] + np.arange(self.k)
            under = np.unique(under.ravel())
            pair, covered = np.unique(under // len(self.token) * len(self.ids) + self.item[under % len(self.token)], return_counts=True)
            for p in pair[covered >= threshold * self.length[pair % len(self.ids)]].tolist():
                yield divmod(p, len(self.ids))
            i = j


class _Windows:
    """A text's unmarked tokens and the hashes of its windows."""

    def __init__(self, token: np.ndarray):
        self.token, self.free = token, np.ones(len(token), bool)
        self.total = np.zeros(len(token) + 1, np.uint64)
        np.cumsum(token * T.powers(T._P, len(token)), out=self.total[1:])
        self.back = T.powers(T._PINV, len(token) + 1)

    def count(self) -> None:
        """How many unmarked tokens follow each other from each place on."""
        stop = np.append(~self.free, True)
        at = np.arange(len(stop))
        until = np.minimum.accumulate(np.where(stop, at, len(stop))[::-1])[::-1]
        self.left = (until - at)[:-1]

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of n unmarked tokens."""
        at = np.flatnonzero(self.left >= n)
        return at, T.mix((self.total[at + n] - self.total[at]) * self.back[at])


def tile(a: np.ndarray, b: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (position in a, position in b, length) of two texts' token hashes."""
    x, y = _Windows(a), _Windows(b)
    x.count()
    y.count()

    def shared(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        p, hp = x.of(n)
        q, hq = y.of(n)
        keep = np.isin(hp, hq)
        return p[keep], hp[keep], q, hq

    seeds = shared(k)
    for side, at in ((x, seeds[0]), (y, seeds[2][np.isin(seeds[3], seeds[1])])):
        cover = np.zeros(len(side.free) + 1, np.int64)  # only tokens under shared seeds can be tiled
        np.add.at(cover, at, 1)
        np.add.at(cover, at + k, -1)
        side.free = np.cumsum(cover[:-1]) > 0
        side.count()
    out: list[tuple[int, int, int]] = []
    top = int(min(x.left.max(initial=0), y.left.max(initial=0)))
    while top >= k:
        lo, hi = k - 1, top
        while lo < hi:  # the greatest length that both share
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if len(shared(mid)[0]) else (lo, mid - 1)
        if lo < k:
            break
        p, hp, q, hq = shared(lo)
        where: dict[int, list[int]] = {}
        for g, j in zip(hq.tolist()[::-1], q.tolist()[::-1], strict=True):
            where.setdefault(g, []).append(j)  # the first is last
        open_ = {g for g in set(hp.tolist()) if g in where}
        for g, i in zip(hp.tolist(), p.tolist(), strict=True):
            if not open_:
                break
            if g not in open_ or not x.free[i : i + lo].all():
                continue
            mine = where[g]
            while mine:
                j = mine.pop()
                if y.free[j : j + lo].all() and np.array_equal(a[i : i + lo], b[j : j + lo]):
                    x.free[i : i + lo] = y.free[j : j + lo] = False
                    out.append((i, j, lo))
                    break
            if not mine:
                open_.discard(g)
        x.count()
        y.count()
        top = lo - 1
    return out


def matches(col: pa.Array, seeds: Seeds, threshold: float) -> list[tuple[int, int | None, float, int, int]]:
    """Row, item id, coverage, tiles and longest tile of each contaminated row and item."""
    h, row = tokens(col)
    cut = np.searchsorted(row, np.arange(len(col) + 1))
    out = []
    for r, it in seeds.candidates(h, row, threshold):
        first, n = seeds.first[it], int(seeds.length[it])
        tiles = tile(h[cut[r] : cut[r + 1]], seeds.token[first : first + n], seeds.k)
        coverage = sum(t[2] for t in tiles) / n
        if coverage >= threshold:
            out.append((r, seeds.ids[it], coverage, len(tiles), max(t[2] for t in tiles)))
    return out


def blocks(bench: DataFrame, *, id_col: str = "item_id", text_col: str = "text", k: int = MIN_MATCH, block_bytes: int = BLOCK_BYTES) -> Iterator[Seeds]:
    """The benchmark's seeds, block by block; a block is about block_bytes of text."""
    size = bench.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = -(-size // block_bytes)
    for b in range(n):
        part = bench.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)) == b).where(F.col(text_col).isNotNull())
        rows = part.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).orderBy("i", "t").collect()  # one block
        if rows:
            yield Seeds([r.i for r in rows], [r.t for r in rows], k)


def contaminated(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, coverage, tiles, longest: one row for each document and item that it leaks."""
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, coverage double, tiles long, longest long"
    out = spark.createDataFrame([], schema)
    for seeds in blocks(bench, id_col=item_col, text_col=item_text, k=min_match, block_bytes=block_bytes):
        shared = spark.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, _, _ in T.chunks(batch):
                    if found := matches(T.column(part, "text"), shared.value, threshold):
                        row, item, coverage, n, longest = zip(*found, strict=True)
                        yield pa.record_batch([T.column(part, "doc_id").take(pa.array(row)), pa.array(item, pa.int64()), pa.array(coverage), pa.array(n), pa.array(longest)], names=["doc_id", "item_id", "coverage", "tiles", "longest"])

        out = out.union(src.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, bench: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    spark = docs.sparkSession
    prepare(spark)
    out = docs
    for seeds in blocks(bench, id_col=item_col, text_col=item_text, k=min_match, block_bytes=block_bytes):
        shared = spark.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, _, _ in T.chunks(batch, text_col):
                    ok = np.ones(part.num_rows, bool)
                    ok[[m[0] for m in matches(T.column(part, text_col), shared.value, threshold)]] = False
                    yield part.filter(pa.array(ok))

        out = out.mapInArrow(run, docs.schema)
    return out
