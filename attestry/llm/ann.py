"""Nearest neighbours by randomly rotated one-bit codes (RaBitQ, Gao and Long 2024).

A vector, less a centre, is rotated at random and kept as one sign bit for each dimension with two scalars:
its norm, and how well the signs stand for it. Inner products with a query are estimated from the signs; an
error bound on each estimate tells which vectors can still be among the nearest. Those are reranked by a matrix product in
double precision, whose own error bound leaves about k of them, and these are compared as the measure says. Every row is coded
and every query sees every code, in blocks: queries times rows, as the search is defined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ROWS = 4096  # coded vectors of a block
QUERIES = 2048  # queries of a block
#: Queries are broadcast up to this many bytes; beyond, blocks meet by a join.
BROADCAST_BYTES = 32 << 20
#: Rows that the centre is fitted on at most.
SAMPLE = 10_000
#: Queries compared at a time: bounds a worker's memory at STEP x ROWS vectors.
STEP = 32
#: Width of the error bound, in standard deviations of the estimate.
WIDTH = 1.9
#: Over any distance.
FAR = 1e300


def usable(v: Column) -> Column:
    """Neither null nor zero nor empty, and every component a finite number."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int = 1) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, norm of the residual, and its inner product with its signs' unit vector."""
    residual = (x - centre) @ turn
    norm = np.linalg.norm(residual, axis=1)
    unit = residual / np.maximum(norm, 1e-300)[:, None]
    return np.packbits(residual > 0, axis=1), norm, np.abs(unit).sum(1) / np.sqrt(x.shape[1])


def _squares(x: np.ndarray) -> np.ndarray:
    """Sums of squares, added up from the first component to the last, as a plain loop would."""
    out = x[..., 0] ** 2
    for i in range(1, x.shape[-1]):
        out = out + x[..., i] ** 2
    return out


def nearest(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, query_ids: np.ndarray, q: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance) of the k nearest of this block for each query; ties go to smaller ids. seen: counts of vectors, and of
    those that the error bounds let through to reranking."""
    dim = x.shape[1]
    length = (x**2).sum(1)
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    fit = np.maximum(fit, 1e-6)
    spread = np.where(fit < 1, np.sqrt(np.maximum(0, 1 - fit**2)) / fit, 0) * WIDTH / np.sqrt(max(1, dim - 1))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), STEP):
        part, own = q[at : at + STEP], query_ids[at : at + STEP]
        residual = (part - centre) @ turn
        size = np.linalg.norm(residual, axis=1)
        inner = residual.astype(np.float32) @ signs.T / np.sqrt(dim) / fit  # estimates of <unit vector, query residual>
        middle = norm**2 + size[:, None] ** 2 - 2 * norm * inner
        middle[ids[None] == own[:, None]] = np.inf
        slack = 2 * norm * spread * size[:, None] + 1e-5 * (norm**2 + size[:, None] ** 2)
        if len(ids) > k:
            # The k that look nearest, compared exactly, bound the k-th distance from above.
            first = np.argpartition(middle, k - 1, axis=1)[:, :k]
            bound = np.take_along_axis(middle, first, 1)
            bound = np.where(np.isinf(bound), FAR, _squares(x[first] - part[:, None])).max(1, keepdims=True)
        else:
            bound = np.full((len(part), 1), FAR)
        near = middle - slack <= bound * (1 + 1e-9)
        some = np.flatnonzero(near.any(0))
        if not len(some):
            continue
        if seen is not None:
            seen[0] += near.size
            seen[1] += int(near.sum())
        # Rerank: distances up to rounding; what is over the k-th by more than rounding can make isn't among the nearest.
        square, own_square = length[some], (part**2).sum(1)[:, None]
        far = square + own_square - 2 * (part @ x[some].T)
        far = np.where(near[:, some], far, np.inf)
        if len(some) > k:
            kth = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
            near = far <= kth + 1e-12 * dim * (square + own_square)
        else:
            near = np.isfinite(far)
        row, col = np.nonzero(near & np.isfinite(far))
        col = some[col]
        exact = np.sqrt(_squares(x[col] - part[row]))
        order = np.lexsort((ids[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        use = rank < k
        found.append((own[row[use]], ids[col[use]], exact[use]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def _blocks(df: DataFrame, size: int, dim: int, coded: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """block, ids, vectors and, if `coded` has centre and rotation, codes, norms and fits: packed rows of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        flat: list[np.ndarray] = []
        for batch in batches:
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            flat.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            held += batch.num_rows
            while held >= size:
                whole_ids, whole = np.concatenate(ids), np.concatenate(flat)
                yield row((part << 32) + n, whole_ids[:size], whole[:size])
                ids, flat, held, n = [whole_ids[size:]], [whole[size:]], held - size, n + 1
        if held:
            yield row((part << 32) + n, np.concatenate(ids), np.concatenate(flat))

    def row(block: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        x = np.ascontiguousarray(x, np.float64)
        parts = encode(x, *coded) if coded else (np.zeros(0, np.uint8),) * 3
        values = [block, ids.astype("<i8").tobytes(), x.tobytes(), *(p.tobytes() for p in parts)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), *[pa.binary()] * 5), strict=True)], names=["block", "ids", "vectors", "codes", "norms", "fits"])

    return df.mapInArrow(run, "block long, ids binary, vectors binary, codes binary, norms binary, fits binary")


def search(vectors: DataFrame, k: int = 10, every: int = 100, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` its k nearest of all other rows.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id; with fewer than k
    candidates all are given. Rows with a null id or an unusable vector (null, zero, empty, not finite), or one of another length than
    most, from which no distance is defined, take no part. Rows that repeat an id are candidates each, but not of their own id. An empty table gives no rows."""
    spark = common.configure(vectors.sparkSession)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = v.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return empty
    dim = sizes[0].dim
    v = v.where(F.size("v") == dim)
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    mean = sample.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).orderBy("i").collect()
    centre, turn = np.array([r.x for r in mean]), rotation(dim)
    asked = v.where(F.col("vec_id") % every == 0)
    n = asked.count()
    if not n:
        return empty
    blocks = -(-n // QUERIES)
    # Queries are dealt into as many even blocks as they need; each block is one row.
    queries = _blocks(asked.repartition(blocks, F.xxhash64("vec_id") % blocks).sortWithinPartitions("vec_id"), QUERIES, dim, None)
    queries = common.staged(queries.select("block", "ids", "vectors"), "queries")
    names = [r.block for r in queries.select("block").collect()]  # one for each 2048 queries or fewer
    codes = common.staged(_blocks(v, ROWS, dim, (centre, turn)), "codes")
    small = n * dim * 8 <= broadcast_bytes
    # A block of queries meets all coded blocks. When they are too many to broadcast, each goes to as many
    # salts as there are partitions, and a coded block to one of them.
    salts = 1 if small else common.partitions(spark)
    left = codes.withColumn("q_block", F.explode(F.array(*[F.lit(x) for x in names]))).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
    right = queries.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    met = left.join(F.broadcast(right) if small else right, ["q_block", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = {name: batch.column(j)[i].as_buffer() for j, name in enumerate(batch.schema.names)}
                ids, x, q_ids, q = (np.frombuffer(get[c], t) for c, t in (("ids", "<i8"), ("vectors", "<f8"), ("q_ids", "<i8"), ("q_vectors", "<f8")))
                bits = np.frombuffer(get["codes"], np.uint8).reshape(len(ids), -1)
                out = nearest(ids, x.reshape(-1, dim), bits, np.frombuffer(get["norms"]), np.frombuffer(get["fits"]), q_ids, q.reshape(-1, dim), centre, turn, k)
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in out], names=["query_id", "vec_id", "score"])

    columns = ["ids", "vectors", "codes", "norms", "fits", "q_ids", "q_vectors"]
    close = met.select(*columns).mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return close.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
