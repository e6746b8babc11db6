"""Operator 9: nearest neighbours by inner product, with cross-polytope hashing and exact reranking.

Rows are split into bands of like norm. A band's vectors are scaled by its largest norm and lifted by
one coordinate onto the unit sphere, where the largest inner product with a query is the smallest
angle; without bands, one long vector would push all others to one pole. Each table turns vectors by three rounds of
random signs and a fast Hadamard transform; the bucket is the nearest signed axis. From ROWS rows a
bucket on, the nearest of some axes of a second turn is added, so that buckets grow in number with
the rows, up to the square of the signed axes. A query looks in the buckets nearest to it in each of
TABLES tables of each band: in as many as hold the share RECALL of the neighbours of SAMPLE queries,
which meet all rows once for this fit. Buckets are compared in chunks of bounded size, by exact inner
products on the original vectors.

Equal vectors form one class, of which the smallest k + 1 ids are kept: no query can return more of
them. All other rows are indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealloom.llm.scratch import written

TABLES = 8
ROWS = 1024  # rows of a bucket from which on buckets are made finer
SAMPLE = 64  # queries of each vector length on which the number of probes is fitted
RECALL = 0.95  # share of their neighbours that the probes reach
CHUNK = 4096  # index rows, or queries, of a bucket that one task compares
BAND = 1.15  # largest ratio of norms in a band
SALTS = 64
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row; the row length is a power of two."""
    d, h = x.shape[1], 1
    while h < d:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), d)
        h *= 2
    return x / np.sqrt(d)


def turned(x: np.ndarray, table: int) -> np.ndarray:
    """x on a table's axes: pseudo-rotation after padding to a power of two."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([SEED, table, d])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], d))
    return y


def lifted(x: np.ndarray, most: np.ndarray | None) -> np.ndarray:
    """Points on the unit sphere; most is the log of the largest norm of each row's band, None for queries."""
    scale = np.abs(x).max(axis=1, keepdims=True)
    norm = np.linalg.norm(x / scale, axis=1, keepdims=True)
    unit = x / scale / norm
    if most is None:
        return np.hstack([unit, np.zeros_like(norm)])
    share = np.minimum(1.0, np.exp(np.log(scale) + np.log(norm) - most[:, None]))
    return np.hstack([unit * share, np.sqrt(1 - share**2)])


def signed_axes(x: np.ndarray, table: int, fine: int) -> list[np.ndarray]:
    """Each row on the signed axes of a table, and of its second turn if that has fine axes; axis d + i is the opposite of axis i."""
    turns = [turned(x, table), *([turned(x, TABLES + table)[:, :fine]] if fine else [])]
    return [np.hstack([y, -y]) for y in turns]


def bucket_of(x: np.ndarray, table: int, fine: int) -> np.ndarray:
    """The bucket of each row."""
    first, *second = (y.argmax(axis=1) for y in signed_axes(x, table, fine))
    return first * 2 * fine + second[0] if second else first


def distances(x: np.ndarray, table: int, fine: int) -> np.ndarray:
    """How far each row (down) is from the axes of each bucket (across); 0 for its own bucket."""
    first, *second = ((y.max(axis=1, keepdims=True) - y) ** 2 for y in signed_axes(x, table, fine))
    return (first[:, :, None] + second[0][:, None, :]).reshape(len(x), -1) if second else first


def nearest_buckets(x: np.ndarray, table: int, fine: int, n: int) -> np.ndarray:
    """The n buckets nearest to each row, in stretches of rows so that the distances stay small."""
    out, step = [], max(1, 2**22 // max(1, 4 * x.shape[1] * max(1, 4 * fine)))
    for at in range(0, len(x), step):
        far = distances(x[at : at + step], table, fine)
        out.append(np.argpartition(far, min(n, far.shape[1]) - 1, axis=1)[:, :n])
    return np.concatenate(out)


def probes_needed(query: np.ndarray, rows: np.ndarray, fine: int) -> np.ndarray:
    """How many buckets of each table a query has to look in until one table shows it each of the rows; both lifted."""
    need = np.full(len(rows), np.iinfo(np.int64).max)
    for table in range(TABLES):
        far = np.sort(mine := distances(query[None], table, fine)[0])
        need = np.minimum(need, np.searchsorted(far, mine[bucket_of(rows, table, fine)], "right"))
    return need


def axes_of_second_turn(rows: int, dim: int) -> int:
    """Axes (a power of two, or 0) that bring buckets of this many rows near ROWS rows each."""
    axes = 1 << max(1, dim.bit_length())  # of the lifted vectors
    share = rows / ROWS / (2 * axes)
    return min(axes, 1 << int(math.log2(share) - 1)) if share >= 2 else 0


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _hashed(fits: dict[int, tuple[int, int]], banded: bool):
    """Rows with each bucket that holds them (banded), or that they look in; fits has the second axes and probes by vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                fine, probes = fits[int(dim)]
                points = lifted(_matrix(part.column("vector")), part.column("most").to_numpy() if banded else None)
                names = ["id", "dim", "vector", *(["band"] if banded else [])]
                for t in range(TABLES):
                    found = bucket_of(points, t, fine)[:, None] if banded else nearest_buckets(points, t, fine, probes)
                    out = part.take(pa.array(np.repeat(np.arange(len(part)), found.shape[1])))
                    yield pa.RecordBatch.from_arrays([*(out.column(c) for c in names), pa.array(found.reshape(-1) + (t << 40), pa.int64())], [*names, "bucket"])

    return run


def _probes_of_sample(sample: dict[int, np.ndarray], fine: dict[int, int], k: int):
    """For each sampled query, the k best rows of the task: score and probes needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in set(np.unique(sizes).tolist()) & set(sample):
                part = batch.filter(pa.array(sizes == dim))
                x, most = _matrix(part.column("vector")), part.column("most").to_numpy()
                points = lifted(x, most)
                for i, near in enumerate(sample[dim] @ x.T):
                    top = np.argpartition(-near, min(k, len(near)) - 1)[:k]
                    score, rows = near[top], points[top]
                    if (dim, i) in best:
                        score, rows = np.concatenate([best[dim, i][0], score]), np.concatenate([best[dim, i][1], rows])
                        top = np.argsort(-score, kind="stable")[:k]
                        score, rows = score[top], rows[top]
                    best[dim, i] = score, rows
        for (dim, i), (score, rows) in best.items():
            need = probes_needed(lifted(sample[dim][i : i + 1], None)[0], rows, fine[dim])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(need), dim), pa.int32()), pa.array(np.full(len(need), i), pa.int32()), pa.array(score), pa.array(need, pa.int64())], ["dim", "query", "score", "need"])

    return run


def fitted(index: DataFrame, probes: DataFrame, k: int) -> dict[int, tuple[int, int]]:
    """By vector length: axes of the second turn, from the rows of the largest band, and probes, from a sample of queries.

    SAMPLE queries of each length and these figures go to the driver.
    """
    sizes = index.groupBy("dim", "band").count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    fine = {r.dim: axes_of_second_turn(r.n, r.dim) for r in sizes}
    drawn = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id")
    some: dict[int, list] = {}
    for r in probes.withColumn("r", F.row_number().over(drawn)).filter(F.col("r") <= SAMPLE).select("dim", "vector").collect():
        some.setdefault(r.dim, []).append(r.vector)
    sample = {dim: np.array(v, np.float64) for dim, v in some.items()}
    pairs = index.select("dim", "vector", "most").mapInArrow(_probes_of_sample(sample, fine, k + 1), "dim int, query int, score double, need long")
    # The best row is the query itself and needs one probe only.
    pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("dim", "query").orderBy(F.desc("score")))).filter(F.col("r").between(2, k + 1))
    need = {r.dim: math.ceil(r.need) for r in pairs.groupBy("dim").agg(F.percentile("need", F.lit(RECALL)).alias("need")).collect()}
    return {dim: (fine[dim], need.get(dim, 1)) for dim in fine}


def _compare(k: int):
    def run(key: tuple, queries: pa.Table, index: pa.Table) -> pa.Table:
        if not queries.num_rows or not index.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, x = _matrix(queries.column("vector").combine_chunks()), _matrix(index.column("vector").combine_chunks())
        names, ids = queries.column("id").to_numpy(), index.column("id").to_numpy()
        near = q @ x.T
        least = np.partition(near, max(0, len(x) - k), axis=1)[:, max(0, len(x) - k)] - 1e-9
        out = []
        for i, row in enumerate(near):
            some = np.flatnonzero(row >= least[i])
            exact = (x[some] * q[i]).sum(axis=1)
            best = np.lexsort((ids[some], -exact))[:k]
            out.append((np.full(len(best), names[i]), ids[some][best], exact[best]))
        return pa.table({"query": np.concatenate([o[0] for o in out]), "id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    return run


def search(vectors: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each query row.

    A query's own id is no candidate. Vectors that are null, zero, or hold a null or a non-finite
    component take no part, nor do rows without an id; vectors meet those of the same length only.
    Rows that repeat an id and a vector count once. Empty tables give empty results.
    """
    # Single-precision vectors travel as they are; all arithmetic is in double precision.
    number = "float" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "double"
    v = F.transform(F.col(vector_column), lambda x: x.cast(number))
    good = (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL").filter(good)
    rows = rows.withColumn("dim", F.size("vector"))
    # Members of a class of equal vectors: the smallest k + 1 ids, found within salts first.
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    ids = rows.select("id", "vector").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    few = ids.withColumn("r", rank("vector", "salt")).filter(F.col("r") <= k + 1).withColumn("r", rank("vector")).filter(F.col("r") <= k + 1)
    few = written(few.select("id", "vector"))
    lead = few.groupBy("vector").agg(F.min("id").alias("class"))
    members = few.join(lead, "vector").select("class", "id")
    index = lead.select(F.col("class").alias("id"), "vector", F.size("vector").alias("dim"))
    # Bands by the log of the norm; the largest component is taken out, so no square overflows.
    peak = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    index = index.withColumn("peak", peak).withColumn("log", F.log("peak") + F.log(F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / F.col("peak")) * (x / F.col("peak")))) / 2)
    index = written(index.select("id", "dim", "vector", "log"))
    longest = index.agg(F.max("log")).first()[0] or 0.0
    index = index.withColumn("band", F.floor((F.lit(longest) - F.col("log")) / math.log(BAND)))
    bands = written(index.groupBy("dim", "band").agg(F.max("log").alias("most")))
    whole = index
    index = index.join(bands, ["dim", "band"])
    asked = rows.filter(is_query.replace(id_column, "id")).select("id", "vector").distinct()
    asking = asked.groupBy("vector").agg(F.min("id").alias("query"))
    asker = asked.join(asking, "vector").select("query", F.col("id").alias("query_id"))
    probes = asking.select(F.col("query").alias("id"), "vector", F.size("vector").alias("dim"))

    def met_whole(asking: DataFrame, rows: DataFrame) -> DataFrame:
        """All of the rows for each of the queries, in chunks."""
        n, m = (max(1, -(-x.count() // CHUNK)) for x in (rows, asking))
        block = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
        all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        ask = asking.select("id", "dim", "vector", block(m).alias("query_part"), all_of(n).alias("part"))
        rows = rows.select("id", "dim", "vector", block(n).alias("part"), all_of(m).alias("query_part"))
        by = ["dim", "part", "query_part"]
        return ask.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(_compare(k + 1), "query long, id long, score double")

    schema = f"id long, dim int, vector array<{number}>, %sbucket long"
    index, probes = index.select("id", "dim", "vector", "band", "most"), probes.select("id", "dim", "vector")
    fits = fitted(index, probes, k)
    index = written(index.mapInArrow(_hashed(fits, True), schema % "band long, "))
    probes = written(probes.mapInArrow(_hashed(fits, False), schema % ""))
    # Chunks of a bucket: each chunk of queries meets each chunk of the index.
    chunks = lambda df, name, *by: df.groupBy("dim", "bucket", *by).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
    size = written(chunks(index, "parts", "band").join(chunks(probes, "query_parts"), ["dim", "bucket"]))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = index.join(size.toDF(*size.columns), ["dim", "bucket", "band"]).withColumn("part", place("parts")).withColumn("query_part", every("query_parts")).drop("parts", "query_parts")
    probes = probes.join(size.toDF(*size.columns), ["dim", "bucket"]).withColumn("query_part", place("query_parts")).withColumn("part", every("parts")).drop("parts", "query_parts")
    by = ["dim", "band", "bucket", "part", "query_part"]
    found = probes.groupBy(*by).cogroup(index.groupBy(*by)).applyInArrow(_compare(k + 1), "query long, id long, score double")
    found = written(found.distinct())
    # Queries for which the buckets held fewer than k + 1 classes, as in tiny tables, meet all of the index in chunks.
    enough = found.groupBy("query").agg(F.count("*").alias("n")).filter(F.col("n") > k).select(F.col("query").alias("id"))
    short = written(asking.select(F.col("query").alias("id"), F.size("vector").alias("dim"), "vector").join(enough, "id", "left_anti"))
    if not short.isEmpty():
        found = found.unionByName(met_whole(short, whole)).distinct()
    # The k + 1 best classes of a query hold its k best other rows.
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k + 1)
    pairs = found.select("query", F.col("id").alias("class"), "score").join(members, "class").select("query", "id", "score")
    pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k + 1)
    out = pairs.join(asker, "query").filter("id <> query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
