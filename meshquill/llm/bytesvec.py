"""Vectorised work on the UTF-8 bytes of Arrow text columns.

The separators of words are ASCII, so words can be found on bytes. Everything
runs over slices of bounded size; no Python object is made for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_rng = np.random.default_rng(20250131)
#: Two independent families of byte values and bases.
_TABLES = [_rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
SEP = np.zeros(256, bool)
SEP[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(n, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * BLOCK:
            _powers[base] = have
    return have[:n]


def as_array(col) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    return col


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    col = as_array(col)
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if offs is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def row_slices(offsets: np.ndarray, size: int = BLOCK):
    """(first, end) row ranges of about size bytes, one row at least."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; a word never crosses two rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SEP[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[0] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1] = False
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _hash_block(data: np.ndarray, s: np.ndarray, e: np.ndarray, family: int) -> np.ndarray:
    n, base = len(data), _BASES[family]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLES[family][data] * powers(base, n), out=sums[1:])
    h = (sums[e] - sums[s]) * powers(pow(base, -1, 1 << 64), n)[s]
    return mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray, spans=None, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, words before each row): polynomial hashes by
    prefix sums, block by block."""
    starts, ends = spans or word_spans(data, offsets)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        b = starts[i]
        out[i:j] = _hash_block(data[b : ends[j - 1]], starts[i:j] - b, ends[i:j] - b, family)
        i = j
    return out, np.searchsorted(starts, offsets)
