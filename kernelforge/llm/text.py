"""Vectorised text primitives shared by the training-data operators.

Everything works on Arrow string buffers as numpy byte arrays, so the cost is a
few nanoseconds a byte and memory is bounded by ``limit`` bytes of text at a
time plus the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Most texts in a block have numbers of so many bits; a shingle's value has the other 52.
ROW_BITS = 12
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))

#: Separator bytes of the two word definitions: white space, or all ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.array([c < 0x30 or 0x3A <= c <= 0x40 or 0x41 <= c <= 0x60 and not 0x41 <= c <= 0x5A or 0x7B <= c <= 0x7F for c in range(256)])
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (splitmix64)."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
LOWER_VALUE = BYTE_VALUE[LOWER]


def powers(n: int, base: np.uint64) -> np.ndarray:
    p = np.full(n + 1, base, U64)
    p[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(p)


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            self.up, self.down = powers(n, _BASE), powers(n, _BASE_INV)
        return self.up, self.down


def prefix_hash(values: np.ndarray, p: Powers) -> np.ndarray:
    """C with C[j] - C[i] = sum of values[k] * base**k over i <= k < j."""
    up, _ = p.get(len(values))
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray, p: Powers) -> np.ndarray:
    """64-bit hash of each span [start, end), equal for equal contents wherever they stand."""
    _, down = p.get(len(c))
    return mix((c[end] - c[start]) * down[start] + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type):
        col = pc.fill_null(col, b"") if col.null_count else col
    else:
        if not pa.types.is_string(col.type) and not pa.types.is_large_string(col.type):
            col = col.cast(pa.large_string())
        if col.null_count:
            col = pc.fill_null(col, "")
    _, offs, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if offs is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, name: str = "text", limit: int = 1 << 18, rows: int = 1 << ROW_BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of parts of a batch, of about ``limit`` bytes (what caches hold) of whole texts."""
    buf, off = string_buffer(batch.column(name))
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, min(i + rows, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(buf: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each maximal run of non-separator bytes; runs never cross texts."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~separators[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[off[:-1]] = True
    before = np.concatenate(([False], word[:-1])) & ~first[:-1]
    after = np.concatenate((word[1:], [False])) & ~first[1:]
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return np.searchsorted(off, start, "right") - 1, start, end


def word_hashes(buf: np.ndarray, off: np.ndarray, separators: np.ndarray, p: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of the words, A-Z lower-cased."""
    row, start, end = words(buf, off, separators)
    c = prefix_hash(LOWER_VALUE[buf], p)
    return row, start, end, span_hash(c, start, end, p)


_SHINGLE = mix(np.arange(101, 101 + 64, dtype=U64))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes; position i stands for words i to i + n - 1."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for j in range(n):
        out += mix(h[j : j + m] ^ _SHINGLE[j]) * (_SHINGLE[j] | U64(1))
    return mix(out)


def shingle_sets(row: np.ndarray, h: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of at most 2 ** ROW_BITS rows: (52-bit values in the high bits, sorted by row and value; offsets of n_rows + 1).

    A row of fewer than ``size`` words has the whole sequence as its one shingle;
    a row without words has none.
    """
    g = gram_hashes(h, size)
    g_row = row[: len(g)]
    inside = g_row == row[size - 1 : size - 1 + len(g)] if len(g) else np.zeros(0, bool)
    values, rows = [g[inside]], [g_row[inside]]
    count = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
    first = np.concatenate(([0], np.cumsum(count)))
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            acc = np.zeros(len(short), U64)
            for j in range(n):
                acc += mix(h[first[short] + j] ^ _SHINGLE[j]) * (_SHINGLE[j] | U64(1))
            values.append(mix(acc ^ U64(n)))
            rows.append(short)
    rest = U64(64 - ROW_BITS)
    both = np.sort(np.concatenate([(r.astype(U64) << rest) | (v >> U64(ROW_BITS)) for v, r in zip(values, rows, strict=True)]))
    if len(both):
        both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    return both << U64(ROW_BITS), np.searchsorted(both, np.arange(n_rows + 1, dtype=U64) << rest if n_rows < 1 << ROW_BITS else np.concatenate((np.arange(n_rows, dtype=U64) << rest, [U64(2**64 - 1)])))


def per_row(ufunc, values: np.ndarray, offsets: np.ndarray, empty):
    """ufunc.reduceat over rows, with ``empty`` for rows without values."""
    n = len(offsets) - 1
    out = np.full((n, *values.shape[1:]), empty, values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = ufunc.reduceat(values, offsets[full], axis=0)
    return out
