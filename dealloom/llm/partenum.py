"""Signatures for an exact Jaccard self-join (PartEnum), for sets of 64-bit features.

Sizes fall in bands [lo, hi] with hi = floor(lo / threshold), so linked sets lie in one band or in
neighbouring ones. In a band two linked sets differ in at most k = floor(2 * hi * (1 - t) / (1 + t))
features. The feature domain is cut into floor(k / 2) + 1 groups of three parts: some group then
holds at most one difference, so at least two of its three parts are the same in both sets. One
signature is emitted for each group and each pair of its parts, in the set's own band and in the
next one.

Two empty parts would put all sets that lack features there into one signature, whose pairs grow with
the square of their number. But then the third part holds the group's one difference at most, so such
a pair of parts is signed by the third part instead: whole, and without each of its features in turn.
Two sets that differ in one feature of it share one of these, so no linked pair is ever lost.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from dealloom.llm.words import mix

PAIRS = ((0, 1), (0, 2), (1, 2))


@lru_cache(maxsize=64)
def bands(percent: int, up_to: int) -> np.ndarray:
    """Lower ends of the bands, beyond up_to by one band at least."""
    ends, lo = [1], 1
    while lo <= up_to:
        lo = lo * 100 // percent + 1
        ends.append(lo)
    return np.array([*ends, lo * 100 // percent + 1], np.int64)


def differences(hi: int, percent: int) -> int:
    """Most features in which two linked sets of at most hi features each differ."""
    return 2 * hi * (100 - percent) // (100 + percent)


def signatures(features: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of one set of distinct features; none where linked sets must be equal."""
    n = len(features)
    if not n:
        return np.zeros(0, np.uint64)
    lows = bands(percent, 1 << max(8, int(n).bit_length()))
    own = int(np.searchsorted(lows, n, "right")) - 1
    out = []
    spread = mix(features)
    for band in (own, own + 1):
        k = differences(int(lows[band + 1]) - 1, percent)
        if k < 1:
            continue
        groups = k // 2 + 1
        place = mix(spread + np.uint64(band + 1))
        cell = ((place >> np.uint64(32)) * np.uint64(3 * groups)) >> np.uint64(32)
        sums = np.zeros(3 * groups, np.uint64)
        cell = cell.astype(np.intp)
        np.add.at(sums, cell, place)
        empty = (np.bincount(cell, minlength=3 * groups) == 0).reshape(groups, 3)
        raw, sums = sums, mix(sums).reshape(groups, 3)
        code = (np.arange(groups, dtype=np.uint64) * np.uint64(4096) + np.uint64(band)) * np.uint64(4)
        for i, (a, b) in enumerate(PAIRS):
            signs = mix(mix(sums[:, a] + code + np.uint64(i)) ^ (sums[:, b] + np.uint64(0x2545F4914F6CDD1D)))
            bare = empty[:, a] & empty[:, b]
            if bare.any():
                third = 3 * np.flatnonzero(bare) + 3 - a - b
                held = np.flatnonzero(np.isin(cell, third))
                at = np.concatenate([third, cell[held]])
                left = raw[at] - np.concatenate([np.zeros(len(third), np.uint64), place[held]])
                signs = np.concatenate([signs[~bare], mix(mix(left + code[at // 3] + np.uint64(i)) ^ np.uint64(0x9FB21C651E98DF25))])
            out.append(signs)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
