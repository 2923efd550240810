"""Vectorised word splitting and hashing over Arrow string buffers.

The word operators of this subpackage read UTF-8 bytes straight from Arrow
buffers.  A word is a maximal run of bytes of one class, so every word rule
used here (ASCII separators only) can be decided byte by byte.  Hashes are
64 bits wide and depend on nothing but the word's lower-cased bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; temporary arrays take about 30 times as much.
SEGMENT = 1 << 20

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 3


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release_memory() -> None:
    """Hand freed memory back; workers live long and would keep the largest batch's."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def _mix(h: np.ndarray) -> np.ndarray:
    """Finalise uint64 hashes so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _byte_values() -> np.ndarray:
    v = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    v[ord("A") : ord("Z") + 1] = v[ord("a") : ord("z") + 1]
    return v


def _classes(separators: list[tuple[int, int]]) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    for lo, hi in separators:
        t[lo : hi + 1] = False
    return t


#: ``[^\x20\x09-\x0D]+``
SPACE_WORDS = _classes([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM_WORDS = _classes([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

_VALUES = _byte_values()
_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        _POW = _powers(_BASE, n)
        _INV = _powers(pow(_BASE, -1, 1 << 64), n)
    return _POW, _INV


def string_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1 of them) of a string array; null counts as empty."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    if array.null_count:
        array = pc.fill_null(array, "")
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, dtype=width)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, size: int = 4 * SEGMENT) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer row stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _segment(data: np.ndarray, breaks: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    if len(breaks):  # rows touch here
        first[breaks] = inside[breaks]
        last[breaks - 1] = inside[breaks - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * power[: len(data)], out=sums[1:])
    return starts, ends, _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and hashes of all words, and each row's first word (n + 1)."""
    cuts, lo, total = [], 0, len(data)
    while lo < total:
        hi = min(total, lo + SEGMENT)
        while hi < total:  # move on to a separator, so that no word is cut
            gap = np.flatnonzero(~table[data[hi : hi + SEGMENT]])
            if len(gap):
                hi += int(gap[0])
                break
            hi = min(total, hi + SEGMENT)
        cuts.append((lo, hi))
        lo = hi
    parts = []
    for lo, hi in cuts:
        inner = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "left")]
        s, e, h = _segment(data[lo:hi], np.unique(inner) - lo, table)
        parts.append((s + lo, e + lo, h))
    if not parts:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    s, e, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return s, e, h, np.searchsorted(s, offsets, "left")


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions are left out."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for k in range(1, n):
        out *= np.uint64(0xA0761D6478BD642F)
        out += h[k : k + m]
    return _mix(out)


def hash_words(text: str, table: np.ndarray) -> np.ndarray:
    """Word hashes of one text."""
    data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    return words(data, np.array([0, len(data)]), table)[2]
