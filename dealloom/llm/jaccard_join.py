"""Operator 1: exact Jaccard self-join of documents on word shingles, by PartEnum signatures.

Plan. One pass over the texts gives each document its set size, a 128-bit digest of its set and parity
bitmaps. Equal sets form one class with the smallest doc_id for its name, so copies never meet again.
A second pass emits signatures, once for each class and task, into one shuffle; only signatures shared
by two classes go on. Pairs that the bitmaps (a lower bound of the number of differing shingles) do not
exclude are checked exactly on the texts in two rounds: first each class against the smallest and the
largest class of its groups, which joins nearly all; then, in blocks, all pairs of a group that are not
yet in one component. No link is lost, and no group's pairs are all emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealloom.llm import partenum
from dealloom.llm.annotate import small_batches
from dealloom.llm.scratch import components, written
from dealloom.llm.words import mix, shingles, utf8, words

BITMAP_BITS = 1024  # parity bitmap of a set; only a filter, the result does not depend on it
WIDEST = 1 << 16  # bits of the widest bitmap of a large set
SEEN = 100_000  # classes whose signatures a task remembers to have emitted
BLOCK = 256  # classes of one signature that one block holds
SALTS = 16  # blocks over which the partners of one class are spread when texts are compared
BROADCAST_IDS = 200_000  # document ids are broadcast up to this count, and shuffled beyond it


def _bitmap(features: np.ndarray, bits: int = BITMAP_BITS) -> bytes:
    at = (mix(features + np.uint64(7)) % np.uint64(bits)).astype(np.intp)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool)).tobytes()


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row, and the shingle sets of a block of rows."""
    data, offsets = utf8(batch.column("text"))
    for lo, at, _, _, value in words(data, offsets, lower=True):
        yield lo, [np.unique(shingles(value[a:b], width)) for a, b in zip(at, at[1:], strict=False)]


def _digest(found: np.ndarray) -> tuple[int, int]:
    one, two = mix(found).sum(dtype=np.uint64), mix(found ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return int(np.uint64(one).view(np.int64)), int(np.uint64(two).view(np.int64))


def _described(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, sets in _sets(batch, width):
            digests = [_digest(x) for x in sets]
            wide = [_bitmap(x, min(WIDEST, max(BITMAP_BITS, 1 << len(x).bit_length()))) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, len(sets)).cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                    pa.array([_bitmap(x) for x in sets], pa.binary()), pa.array(wide, pa.binary()),
                ],
                ["doc_id", "n", "h1", "h2", "bitmap", "wide"],
            )


def _signed(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Signatures of each set, with its first digest and size; a set that the task has met before emits none."""
    seen: set[int] = set()
    for batch in batches:
        for _, sets in _sets(batch, width):
            if len(seen) > SEEN:
                seen.clear()
            signs, digests, sizes = [np.zeros(0, np.int64)], [], []
            for found in sets:
                digest = _digest(found)[0]
                if len(found) and digest not in seen:
                    seen.add(digest)
                    signs.append(partenum.signatures(found, percent).view(np.int64))
                    digests.append(digest)
                    sizes.append(len(found))
            each = [len(x) for x in signs[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(signs)), pa.array(np.repeat(np.array(digests, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int64), each))], ["sign", "h1", "n"])


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that their wide bitmaps do not exclude; the wider one of a pair is folded, which keeps parities."""
    for batch in batches:
        one, two = batch.column("wide_a").to_pylist(), batch.column("wide_b").to_pylist()
        n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        sizes = np.array([(len(x), len(y)) for x, y in zip(one, two, strict=True)], np.int64).reshape(-1, 2)
        keep = np.zeros(len(n), bool)
        for a, b in np.unique(sizes, axis=0):
            some = np.flatnonzero((sizes == (a, b)).all(axis=1))
            least = min(a, b) // 8
            x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join([side[i] for i in some]), np.uint64).reshape(len(some), -1, least), axis=1) for side in (one, two))
            keep[some] = np.bitwise_count(x ^ y).sum(axis=1).astype(np.int64) * (100 + percent) <= n[some] * (100 - percent)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _cross_pairs(batches: Iterator[pa.RecordBatch], percent: int, all_links: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks, one after another in sorted rows: the pairs of classes that sizes and bitmaps do not exclude."""
    rest = None
    for batch in chain(batches, [None]):
        table = pa.Table.from_batches([x for x in (rest, batch) if x is not None]).combine_chunks() if rest is not None or batch is not None else None
        if table is None or not table.num_rows:
            continue
        key = np.stack([table.column(c).to_numpy() for c in ("sign", "x", "y")])
        run = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))])
        whole = len(run) if batch is None else int(np.searchsorted(run, run[-1]))
        rest = table.slice(whole).combine_chunks().to_batches()[0] if whole < len(run) else None
        run = run[:whole]
        ids, n, label, side = (table.column(c).to_numpy()[:whole] for c in ("id", "n", "label", "side"))
        bits = np.frombuffer(b"".join(table.column("bitmap").slice(0, whole).to_pylist()), np.uint64).reshape(whole, -1)
        one, step, out = np.arange(whole), 1, [np.zeros((2, 0), np.int64)]
        while len(one := one[one + step < whole]) and len(one := one[run[one] == run[one + step]]):
            two = one + step
            ok = ((side[one] != side[two]) | (side[one] == 2)) & (ids[one] != ids[two]) & (all_links | (label[one] != label[two]))
            ok &= np.minimum(n[one], n[two]) * 100 >= np.maximum(n[one], n[two]) * percent
            a, b = one[ok], two[ok]
            apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1)
            near = apart * (100 + percent) <= (n[a] + n[b]) * (100 - percent)
            out.append(np.sort(np.stack([ids[a[near]], ids[b[near]]]), axis=0))
            step += 1
        a, b = np.unique(np.concatenate(out, axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, salt, kind): the text of a comes first, then its partners' texts."""
    key, pivots = None, []
    for batch in batches:
        a, salt, kind, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "salt", "kind", "b"))
        data, offsets = utf8(batch.column("text"))
        out_a, out_b = [], []
        for lo, at, _, _, value in words(data, offsets, lower=True):
            for i in range(len(at) - 1):
                k, found = lo + i, np.unique(shingles(value[at[i] : at[i + 1]], width))
                if key != (a[k], salt[k]):
                    key, pivots = (a[k], salt[k]), []
                if kind[k] == 0:
                    pivots.append(found)
                    continue
                for other in pivots:
                    same = len(np.intersect1d(found, other, assume_unique=True))
                    if same and 100 * same >= percent * (len(found) + len(other) - same):
                        out_a.append(a[k])
                        out_b.append(b[k])
                        break
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


class JaccardJoin:
    """The join of one table: classes of equal sets, links between them, and components.

    docs has doc_id and text; other columns are ignored. Two documents link when their shingle sets
    have a Jaccard similarity of at least percent / 100. Texts without words, and null texts, have
    an empty set and link with nothing. Rows that share a doc_id count as one document; a null
    doc_id links with nothing and has a null component.
    """

    def __init__(self, docs: DataFrame, width: int = 3, percent: int = 90):
        self.width, self.percent = width, percent
        self.docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.described = written(self.docs.mapInArrow(partial(_described, width=width), "doc_id long, n long, h1 long, h2 long, bitmap binary, wide binary"))
        full = self.described.filter("n > 0 AND doc_id IS NOT NULL")
        self.classes = written(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")))
        rows = self.docs.filter("doc_id IS NOT NULL").mapInArrow(partial(_signed, width=width, percent=percent), "sign long, h1 long, n long")
        group = Window.partitionBy("sign")
        rows = rows.withColumns({"low": F.min("h1").over(group), "high": F.max("h1").over(group)}).filter("low < high").select("sign", "h1").distinct()
        # Digests become names of classes; few signatures are left by now.
        rows = rows.join(self.classes.select("h1", F.col("rep").alias("id"), "n"), "h1").drop("h1")
        self.shared = written(rows.withColumns({"low": F.min("id").over(group), "high": F.max("id").over(group)}).filter("low < high"))

    def _texts(self, ids: DataFrame) -> DataFrame:
        keep = written(ids.distinct())
        wanted = F.broadcast(keep) if keep.count() <= BROADCAST_IDS else keep
        return written(self.docs.join(wanted, "doc_id", "left_semi"))

    def _close(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose bitmaps do not exclude a link."""
        maps = self.described.filter("n > 0").select("doc_id", "n", "wide").dropDuplicates(["doc_id", "n"])
        side = lambda x: maps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}"))
        rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
        return rows.mapInArrow(partial(_near, percent=self.percent), "a long, b long").distinct()

    def _checked(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        none = F.lit(None).cast("long")
        asked = pairs.select(F.col("b").alias("doc_id"), "a", "salt", F.lit(1).alias("kind"), "b").unionByName(pairs.select(F.col("a").alias("doc_id"), "a", "salt", F.lit(0).alias("kind"), none.alias("b")).distinct())
        rows = asked.join(texts, "doc_id").select("a", "salt", "kind", "b", "text")
        rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
        return rows.mapInArrow(partial(_linked, width=self.width, percent=self.percent), "a long, b long")

    def _found(self, pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs, by their texts."""
        pairs = written(self._close(pairs))
        texts = self._texts(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")))
        return written(self._checked(pairs, texts).distinct())

    def _stars(self) -> DataFrame:
        ends = self.shared.select("id", "n", F.explode(F.array("low", "high")).alias("end")).filter("id <> end")
        return ends.select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b")).distinct()

    def _rest(self, label: DataFrame | None) -> DataFrame:
        """Candidate pairs of shared signatures: those between different components, or all where no labels are given."""
        rows = self.shared.select("sign", "id", "n")
        if label is not None:
            rows = rows.join(label.withColumnRenamed("vertex", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
            group = Window.partitionBy("sign")
            rows = rows.withColumns({"lo": F.min("label").over(group), "hi": F.max("label").over(group)}).filter("lo < hi").drop("lo", "hi")
        else:
            rows = rows.withColumn("label", F.lit(0).cast("long"))
        maps = self.described.select(F.col("doc_id").alias("id"), "n", "bitmap").dropDuplicates(["id", "n"])
        size = rows.groupBy("sign").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        rows = rows.join(size, "sign").join(maps, ["id", "n"])
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        # Block x meets block y for x <= y; side 2 marks a block that meets itself.
        met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.struct(F.least(F.col("block"), y).alias("x"), F.greatest(F.col("block"), y).alias("y"), F.when(F.col("block") == y, 2).when(F.col("block") < y, 0).otherwise(1).alias("side")))
        rows = rows.select("sign", "id", "n", "label", "bitmap", F.explode(met).alias("m")).select("sign", "id", "n", "label", "bitmap", "m.x", "m.y", "m.side")
        rows = rows.repartition("sign", "x", "y").sortWithinPartitions("sign", "x", "y")
        return rows.mapInArrow(partial(_cross_pairs, percent=self.percent, all_links=label is None), "a long, b long").distinct()

    def links(self) -> DataFrame:
        """All links (a, b), a < b, between classes; a class is named by its smallest doc_id."""
        return self._found(self._rest(None))

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) for each document row."""
        first = self._found(self._stars())
        links = first.union(self._found(self._rest(components(first)))).distinct()
        # A doc_id that stands for several rows ties their classes together.
        of_rows = self.described.filter("n > 0 AND doc_id IS NOT NULL").join(self.classes.drop("n"), ["h1", "h2"]).select("doc_id", "rep").distinct()
        ties = of_rows.withColumn("classes", F.count("*").over(Window.partitionBy("doc_id"))).filter("classes > 1 AND doc_id <> rep")
        ties = ties.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
        whole = written(components(links.unionByName(ties)))
        whole = whole.withColumnsRenamed({"vertex": "rep", "component": "found"})
        rows = self.described.select("doc_id", "n", "h1", "h2").join(self.classes.drop("n"), ["h1", "h2"], "left").join(whole, "rep", "left")
        alone = F.col("rep").isNull() | (F.col("n") == 0)
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).when(alone, F.col("doc_id")).otherwise(F.coalesce("found", "rep")).alias("component_id"))
