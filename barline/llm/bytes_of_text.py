"""Texts of an Arrow batch as one byte array, and the vectorised helpers built on it.

The operators that run Python inside tasks read a column's UTF-8 buffer as it lies in the batch.
A batch is worked through in chunks of about 256 KB of whole texts, so memory is bounded by
the longest single text and not by the batch.
"""

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and row offsets; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n, start = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[start : start + n + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Row ranges of at most `size` bytes, or of one row where that is longer."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit (64-bit xor-multiply-shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values of a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed * 0x632BE59BD9B4E019 % 2**64))


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
    """Maximal runs of bytes that are no separators, never across rows: starts, ends, row numbers."""
    inside = ~separator[data]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the longest n asked for."""
    got = _POWERS.get((base, 0))
    if got is None or len(got) < n:
        size = max(n, CHUNK_BYTES + 1)
        got = np.full(size, np.uint64(base))
        got[0] = 1
        got = np.cumprod(got)
        _POWERS[(base, 0)] = got
    return got[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of byte spans: sums of per-byte values times powers, normalised to the span's start."""
    table = seeded(seed, 256) | np.uint64(1)
    base = int(seeded(seed + 1, 1)[0]) | 5
    inverse = pow(base, -1, 2**64)
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * _powers(base, n), out=total[1:])
    raw = (total[ends] - total[starts]) * _powers(inverse, n + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _ODD)


def combine(hashes: np.ndarray, width: int, seed: int = 7) -> np.ndarray:
    """Hashes of `width` neighbours at each position; the last width - 1 positions are left out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = seeded(seed, width) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += hashes[k : k + n] * factors[k]
    return mix(out)


def per_row_key(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes made distinct between rows, so that one sort groups by row and hash."""
    return mix(hashes ^ mix((rows.astype(np.uint64) + np.uint64(1)) * _ODD))
