"""CRC-32 of many spans of bytes at once, by position tables.

The register of CRC-32 is linear in the bytes: a span's value is the exclusive or of what each byte
gives at its distance from the span's end, and of a constant for the span's length. Tables hold both
for distances up to BLOCK. Longer spans are cut into blocks from their end, whose values are folded.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256  # largest distance in the tables
_ALL = np.uint32(0xFFFFFFFF)
_POLYNOMIAL = np.uint32(0xEDB88320)


def _byte_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = (value >> np.uint32(1)) ^ np.where(value & np.uint32(1), _POLYNOMIAL, np.uint32(0))
    return value


_BYTE = _byte_table()


def _advance(register: np.ndarray, zeros: int = 1) -> np.ndarray:
    """Registers after so many zero bytes."""
    for _ in range(zeros):
        register = (register >> np.uint32(8)) ^ _BYTE[register & np.uint32(255)]
    return register


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.zeros((BLOCK + 1, 256), np.uint32)  # at[0]: a byte behind the span gives nothing
    at[1] = _BYTE
    length = np.full(BLOCK + 1, _ALL)
    for d in range(1, BLOCK + 1):
        if d > 1:
            at[d] = _advance(at[d - 1])
        length[d] = _advance(length[d - 1 : d])[0]
    fold = np.stack([_advance(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), BLOCK) for k in range(4)])
    return at.reshape(-1), length, fold


_AT, _LENGTH, _FOLD = _tables()


def _given(data: np.ndarray, start: np.ndarray, end: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """What the bytes of each span give; the spans cover lo to hi in order, each with what is behind it up to the next."""
    size = np.diff(start, append=hi)
    distance = np.repeat(end.astype(np.int32), size) - np.arange(lo, hi, dtype=np.int32)
    np.clip(distance, 0, BLOCK, out=distance)
    return np.bitwise_xor.reduceat(_AT.take((distance << 8) + data[lo:hi]), start - lo)


def _long(data: np.ndarray, start: int, end: int) -> np.uint32:
    """One span of more than BLOCK bytes, block by block."""
    edges = np.arange(end, start, -BLOCK)[::-1]
    begin = np.concatenate([[start], edges[:-1]])
    given = _given(data, begin, edges, start, end)
    register = int(_LENGTH[edges[0] - start])
    fold = _FOLD.tolist()
    for k, value in enumerate(given.tolist()):
        if k:
            register = fold[0][register & 255] ^ fold[1][register >> 8 & 255] ^ fold[2][register >> 16 & 255] ^ fold[3][register >> 24]
        register ^= value
    return np.uint32(register) ^ _ALL


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of data; the spans have a byte or more and lie one behind the other."""
    if not len(start):
        return np.zeros(0, np.uint32)
    size = end - start
    out = _given(data, start, end, int(start[0]), int(end[-1])) ^ _LENGTH[np.minimum(size, BLOCK)] ^ _ALL
    for i in np.flatnonzero(size > BLOCK):
        out[i] = _long(data, int(start[i]), int(end[i]))
    return out
