"""Words of many texts at once: boundaries and 64-bit hashes straight from Arrow's UTF-8 buffers.

A word is a maximal run of characters other than space and U+0009 to U+000D. Those are
single bytes in UTF-8, so whole batches are scanned as one byte array; no string is made.
A word's bytes go through two unlike 64-bit hashes, eight bytes at a time, which are then mixed into one:
words of one hash would have to agree in both. Words over LONG bytes are hashed by BLAKE2.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_M3, _M4 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
LONG = 512  # bytes
CUT = 1 << 20  # bytes of a longer text that are scanned at a time

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a uint64 over all others."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def mix_other(x: np.ndarray) -> np.ndarray:
    """Another finaliser, with shifts and factors of its own."""
    x = (x ^ (x >> np.uint64(33))) * _M3
    x = (x ^ (x >> np.uint64(29))) * _M4
    return x ^ (x >> np.uint64(32))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of a lane


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range of bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = end - start
    length = size.astype(np.uint64)
    lane = lanes[start] & _LEFT[np.minimum(size, 8)]
    one, two = mix(length * _GOLD + lane), mix_other((length + np.uint64(1)) * _M3 ^ lane)
    k, live = 8, np.flatnonzero((size > 8) & (size <= LONG))
    while len(live):
        lane = lanes[start[live] + k] & _LEFT[np.minimum(size[live] - k, 8)]
        one[live], two[live] = mix(one[live] * _GOLD + lane), mix_other(two[live] * _M3 ^ lane)
        k += 8
        live = live[size[live] > k]
    out = mix(one + mix_other(two ^ _GOLD))
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def scan(data: np.ndarray, lower: bool = False, new_text: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word in data; new_text holds positions at which a text begins."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    if new_text is not None:
        cut = new_text[(new_text > 0) & (new_text < n)]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, hashes(LOWER[data] if lower else data, start, end)


def _scan_long(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """scan() of one long text, in cuts at white space, so that little is held for each byte of it."""
    parts, lo = [], 0
    while lo < len(data):
        hi = lo + CUT
        while hi < len(data) and not (space := SPACE[data[hi : hi + CUT]]).any():
            hi += CUT
        hi = min(len(data), hi + int(space.argmax())) if hi < len(data) else len(data)
        start, end, value = scan(data[lo:hi], lower)
        parts.append((start + lo, end + lo, value))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about size bytes each (more only where one text is longer)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of texts: its first text, the word range of each text, and start, end and hash of the words.

    The word range has one more entry than the block has texts. Positions count from the block's first byte.
    """
    for lo, hi in blocks(data, offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        piece = data[offsets[lo] : offsets[hi]]
        start, end, value = _scan_long(piece, lower) if hi == lo + 1 and len(piece) > 2 * CUT else scan(piece, lower, at)
        yield lo, np.searchsorted(start, at), start, end, value


def shingles(value: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of width words; the whole sequence as one where there are fewer."""
    if not len(value):
        return value
    width = min(width, len(value))
    out = np.full(len(value) - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        out = mix(out * _GOLD + value[k : len(value) - width + 1 + k])
    return out
