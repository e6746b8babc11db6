"""Operator 8: packing of token pieces into sequences of a fixed length, by swap-based local search.

Documents are encoded once; pieces of the full length have a sequence of their own. All pieces are
dealt by hash to groups of about GROUP pieces, and each group is packed by itself in one task. Pieces
are first placed best fit in the order in which they come; then a local search takes the emptiest sequence
again and again and moves its pieces to others, best fit first, or exchanges them, one for one or two
for one. Each step raises the sum of squared fills, so sequences run empty. The search ends at the
least number of sequences that can hold the tokens, or where the STUCK emptiest ones cannot be
improved. A group of this size wastes a few sequences of some 2,000, and its memory does not depend on
the size of the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealloom.llm.annotate import annotate
from dealloom.llm.scratch import written
from dealloom.llm.word_bpe import load, text_blocks

GROUP = 4096
END = 0  # id after each document
STUCK = 16  # the search ends when so many of the emptiest sequences in turn cannot be improved
BREADTH = 24  # longest pieces of a sequence that are tried for exchanges


def in_order(length: list[int], size: int) -> np.ndarray:
    """Bin of each piece as they come: the fullest bin that has room for it, or a new one."""
    bin_of = np.zeros(len(length), np.int64)
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    open_rooms, bins = 0, 0  # bit r of open_rooms: some bin has room r
    for i, n in enumerate(length):
        above = open_rooms >> n
        if above and n < size:
            room = n + (above & -above).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            b, room, bins = bins, size, bins + 1
        bin_of[i] = b
        if room > n:
            rooms[room - n].append(b)
            open_rooms |= 1 << (room - n)
    return bin_of


def _step(n: np.ndarray, bin_of: np.ndarray, fill: np.ndarray, size: int, source: int) -> list[tuple[int, int]] | None:
    """Pieces and the bins they go to, so that source loses to a bin at least as full; None if nothing helps."""
    own = np.flatnonzero(bin_of == source)
    own = own[np.argsort(-n[own], kind="stable")]
    gap = np.where(fill >= fill[source], size - fill, -1)
    gap[source] = -1
    fits = gap.max() >= n[own]
    if fits.any():
        i = own[np.argmax(fits)]
        room = np.where(gap >= n[i], gap, size + 1)
        return [(int(i), int(room.argmin()))]
    room = np.where(gap[bin_of] > 0, gap[bin_of], -1)
    usable = np.flatnonzero(room > 0)
    if not len(usable):
        return None
    # One for one: the smallest piece elsewhere that i can replace.
    best, gain = None, 0
    for i in own[:BREADTH]:
        ok = usable[(n[usable] < n[i]) & (n[usable] + room[usable] >= n[i])]
        if len(ok) and n[i] - n[ok].min() > gain:
            a = int(ok[n[ok].argmin()])
            best, gain = [(int(i), int(bin_of[a])), (a, source)], n[i] - n[a]
    if best:
        return best
    # Two for one, either way round.
    for x, i in enumerate(own[:BREADTH]):
        for j in own[x + 1 : BREADTH]:
            both = n[i] + n[j]
            ok = usable[(n[usable] < both) & (n[usable] + room[usable] >= both)]
            if len(ok) and both - n[ok].min() > gain:
                a = int(ok[n[ok].argmin()])
                best, gain = [(int(i), int(bin_of[a])), (int(j), int(bin_of[a])), (a, source)], both - n[a]
    order = usable[np.argsort(bin_of[usable], kind="stable")]
    one, two = order[:-1], order[1:]
    near = bin_of[one] == bin_of[two]
    one, two = one[near], two[near]
    pair = n[one] + n[two]
    for i in own[:BREADTH]:
        ok = np.flatnonzero((pair < n[i]) & (pair + room[one] >= n[i]))
        if len(ok) and n[i] - pair[ok].min() > gain:
            a = ok[pair[ok].argmin()]
            best, gain = [(int(i), int(bin_of[one[a]])), (int(one[a]), source), (int(two[a]), source)], n[i] - pair[a]
    return best


def local_search(length: np.ndarray, bin_of: np.ndarray, size: int) -> np.ndarray:
    """Bin of each piece after moves and exchanges, each of which raises the sum of squared fills."""
    if not len(length):
        return bin_of
    fill = np.bincount(bin_of, length).astype(np.int64)
    least = -(-int(length.sum()) // size)
    stuck = np.zeros(len(fill), bool)
    while stuck.sum() < STUCK and np.count_nonzero(fill) > least:
        under = (fill > 0) & (fill < size) & ~stuck
        if np.count_nonzero(under) < 2:
            break
        source = int(np.where(under, fill, size).argmin())
        step = _step(length, bin_of, fill, size, source)
        if step is None:
            stuck[source] = True
            continue
        for i, b in step:
            fill[bin_of[i]] -= length[i]
            fill[b] += length[i]
            bin_of[i] = b
    return bin_of


def pack(length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    bin_of = local_search(length, in_order(length.tolist(), size), size)
    order = np.argsort(bin_of, kind="stable")
    before = np.cumsum(length[order]) - length[order]
    first = np.concatenate([[True], np.diff(bin_of[order]) != 0]) if len(order) else np.zeros(0, bool)
    offset = np.zeros(len(length), np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    return bin_of, offset


def pieces(docs: DataFrame, path: str, keep: list[str], size: int) -> DataFrame:
    """row, piece, start, length and ids_crc32 of each piece of each document's ids and the closing id."""

    def compute():
        bpe = load(path)
        end = int(END).to_bytes(4, "little")

        def of(texts: pa.Array) -> Iterator[tuple[int, int, list]]:
            for lo, part in text_blocks(texts):
                at, sizes, crcs = [0], [], []
                for forms in bpe.encode_texts(part):
                    ids = b"".join([*forms, end])
                    for k in range(0, len(ids), 4 * size):
                        cut = ids[k : k + 4 * size]
                        sizes.append(len(cut) // 4)
                        crcs.append(zlib.crc32(cut))
                    at.append(len(sizes))
                rows = pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["length", "ids_crc32"])
                yield lo, len(part), [pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows)]

        return of

    out = annotate(docs, keep, compute, "pieces array<struct<length:bigint,ids_crc32:bigint>>")
    out = out.select("row", F.posexplode("pieces").alias("piece", "p"))
    return out.select("row", "piece", (F.col("piece").cast("long") * size).alias("start"), "p.length", "p.ids_crc32")


def packed(docs: DataFrame, path: str, keep: list[str], size: int = 2048, group: int = GROUP) -> DataFrame:
    """pieces() with sequence_id and offset: the place of each piece in a sequence of at most size tokens.

    A null or empty text is the closing id alone. Repeated rows are packed each by itself. An empty
    table gives an empty result. No piece is cut further and no document is left out.
    """
    # Written, so that the numbers of rows stay as they are; they deal equal rows to different groups.
    rows = written(pieces(docs, path, keep, size).withColumn("salt", F.monotonically_increasing_id()))
    groups = max(1, round(rows.count() / group))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("row", "piece", "ids_crc32", "salt"), F.lit(groups))).drop("salt")

    def place(table: pa.Table) -> pa.Table:
        bin_of, offset = pack(table.column("length").to_numpy(), size)
        ids = table.column("group").to_numpy() * (1 << 32) + bin_of
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    names = [f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("group").schema]
    return rows.groupBy("group").applyInArrow(place, ", ".join([*names, "sequence_id bigint", "offset bigint"]))
