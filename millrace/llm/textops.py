"""Array programs over Arrow text columns, run inside mapInArrow.

A column's bytes are handled as one array: words are found by a byte table,
and hashes of any span come from running polynomial sums modulo 2**64, so the
work per byte is a few array operations and none is per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text is a chunk of its own.
CHUNK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 64, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(p: int, n: int) -> np.ndarray:
    """The first n powers of p; kept are those for one chunk, those for a longer text are made anew."""
    have = _powers.get(p)
    if have is None or len(have) < n:
        x = np.full(max(n, CHUNK + 1), p, np.uint64)
        x[0] = 1
        have = np.cumprod(x, dtype=np.uint64)
        if n <= CHUNK + 1:
            _powers[p] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the bytes of their texts and the offsets; null is empty."""
    col = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").cast(pa.large_string())
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if n and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


@dataclass
class Spans:
    """Byte ranges and the row that each belongs to."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def runs(inside: np.ndarray, off: np.ndarray) -> Spans:
    """Maximal runs of True that don't cross a row's end."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return Spans(z, z, z)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Spans(start, end, np.searchsorted(off, start, "right") - 1)


def words(buf: np.ndarray, off: np.ndarray) -> Spans:
    return runs(~SPACE[buf], off)


def span_hashes(buf: np.ndarray, s: Spans) -> np.ndarray:
    """64-bit hash of each span's bytes, equal for equal bytes."""
    if not len(s):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * powers(_P, len(buf)), out=total[1:])
    return mix((total[s.end] - total[s.start]) * powers(_PINV, len(buf) + 1)[s.start] + (s.end - s.start).astype(np.uint64))


def gram_hashes(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive items of one row, and the index of the first item."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    x = np.zeros(len(at), np.uint64)
    for j in range(k):
        x = mix(x * np.uint64(_P) + h[at + j])
    return x, at


def code_points(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a chunk's texts and the row of each; bytes that aren't UTF-8 become U+FFFD."""
    n = len(off) - 1
    cp = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    count = np.diff(lead[off])
    if len(cp) != count.sum():  # decode text by text
        parts = [np.frombuffer(buf[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(off, off[1:], strict=False)]
        count = np.array([len(p) for p in parts], np.int64)
        cp = np.concatenate(parts) if parts else cp
    return cp, np.repeat(np.arange(n, dtype=np.int32), count)


def char_lengths(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Code points before each byte, one longer than the bytes."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
