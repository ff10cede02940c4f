"""Vectorised text primitives for code that runs inside Arrow map tasks.

Every helper works on one slice of a record batch, so memory is bounded by the
slice size (a single longer text forms a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

SLICE_BYTES = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 2**64)
_pow = {"n": 0}


def word_table(separators: bytes) -> np.ndarray:
    """256 flags: True where a byte belongs to a word."""
    t = np.ones(256, dtype=bool)
    t[list(separators)] = False
    return t


#: words are runs of anything but these
SPACES = word_table(b" \t\n\x0b\x0c\r")
#: words are runs of ASCII letters, digits and everything beyond ASCII
ALNUM = word_table(bytes(b for b in range(128) if not chr(b).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each."""
    if TaskContext.get():  # whole texts come and go in long-lived workers, whose freed memory goes back to the system; the driver's pool stays as it is
        pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and n + 1 offsets; null is empty."""
    a = pc.fill_null(column, "").cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n + 1:
        m = max(n + 1, SLICE_BYTES + 65536)
        up, down = np.full(m, _BASE, np.uint64), np.full(m, _INV, np.uint64)
        up[0] = down[0] = 1
        _pow.update(n=m, up=np.cumprod(up), down=np.cumprod(down))
    return _pow["up"], _pow["down"]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal ranges hash alike wherever they stand."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and row of every word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = table[data]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    at = off[:-1][off[:-1] < len(data)]
    first[at] = m[at]
    at = off[1:][off[1:] > 0] - 1
    last[at] = m[at]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(s, off)))


def row_bounds(row: np.ndarray, n: int) -> np.ndarray:
    """n + 1 offsets of the rows in a sorted row index."""
    return np.searchsorted(row, np.arange(n + 1))


def ngram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive hashes (length len(h) - k + 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g = mix(g * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n])
    return g


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of all k-word shingles; a row of 1 to k - 1 words has one, the whole row."""
    g = ngram_hash(h, k)
    keep = row[: len(g)] == row[k - 1 :] if len(g) else np.zeros(0, bool)
    at = np.flatnonzero(keep)
    g, r = g[keep], row[: len(keep)][keep]
    b = row_bounds(row, n_rows)
    n = np.diff(b)
    for size in range(1, k):
        short = np.flatnonzero(n == size)
        if len(short):
            x = ngram_hash(h, size)[b[short]] + np.uint64(size)
            g, r, at = np.concatenate([g, mix(x)]), np.concatenate([r, short]), np.concatenate([at, b[short]])
    order = np.argsort(at, kind="stable")
    return g[order], r[order], at[order]


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and n + 1 bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def sequence_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each range of 64-bit values."""
    up, down = _powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values.copy()) * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    i = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[i] == values


def starts(*keys: np.ndarray) -> np.ndarray:
    """Flags of the first row of each run of equal keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new
