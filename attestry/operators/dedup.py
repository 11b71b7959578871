"""Exact and greedy near-duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sharing import with_checkpoints


def first_by_key(df: DataFrame, keys: list[str], ord_column: str = "ord") -> DataFrame:
    """The first row of each key in order; null keys are a key. A minimum combines before the shuffle, so a hot key is one row a task."""
    out = df.groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*df.columns), ord_column).alias("__first"))
    return out.select("__first.*")


def similar_pairs(vectors: DataFrame, tolerance: float, block_rows: int = 2000) -> DataFrame:
    """i < j, sim: all pairs of ids whose vectors' cosine reaches the tolerance.

    Rows are packed into blocks and blocks meet in a triangle, so each pair is compared once, by a matrix product, and only
    pairs over the tolerance become rows. Exact, and quadratic in the number of rows like the definition; blocks bound memory."""
    import numpy as np
    import pyarrow as pa

    def pack(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for at in range(0, len(rows), block_rows):
                x = np.array(rows[at : at + block_rows], float)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + n]), pa.array([ids[at : at + block_rows].astype("<i8").tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["block", "ids", "x"])
                n += 1

    def meet(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                bi, bj = batch.column(0)[k].as_py(), batch.column(3)[k].as_py()
                ids, other = (np.frombuffer(batch.column(c)[k].as_buffer(), "<i8") for c in (1, 4))
                x, y = np.frombuffer(batch.column(2)[k].as_buffer()).reshape(len(ids), -1), np.frombuffer(batch.column(5)[k].as_buffer()).reshape(len(other), -1)
                sim = x @ y.T
                r, c = np.nonzero(sim >= tolerance)
                if bi == bj:
                    r, c = r[r < c], c[r < c]
                a, b = ids[r], other[c]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sim[r, c])], ["i", "j", "sim"])

    spark = vectors.sparkSession
    rows = vectors.select(F.col("id").cast("long"), F.col("vector").cast("array<double>"))
    rows = rows.repartition(max(1, spark.sparkContext.defaultParallelism), F.xxhash64("id")).sortWithinPartitions("id")
    with_checkpoints(spark)
    blocks = rows.mapInArrow(pack, "block long, ids binary, x binary").checkpoint()
    # Blocks are numbered by a table of a row for each; every block goes to the row and the column of the triangle that it lies in.
    names = [r.block for r in blocks.select("block").collect()]
    numbered = blocks.join(spark.createDataFrame([(b, i) for i, b in enumerate(names)], "block long, n int"), "block")
    left = numbered.select("block", "ids", "x", F.col("n").alias("low"), F.explode(F.sequence(F.col("n"), F.lit(max(len(names) - 1, 0)))).alias("high"))
    right = numbered.select(F.col("block").alias("b2"), F.col("ids").alias("ids2"), F.col("x").alias("x2"), F.col("n").alias("high"), F.explode(F.sequence(F.lit(0), F.col("n"))).alias("low"))
    pairs = left.join(right, ["low", "high"]).select("block", "ids", "x", "b2", "ids2", "x2")
    return pairs.mapInArrow(meet, "i long, j long, sim double")


def greedy_removed(pairs: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """ids that a scan in ascending order removes: it keeps what isn't removed yet and removes all later ids paired with it.

    By rounds: an undecided id whose smaller partners are all removed is kept, and removes its larger partners. The result is
    that of the scan. Each round is a table in the checkpoint folder; chains of length n need n rounds at worst."""
    spark = with_checkpoints(pairs.sparkSession)
    edges = pairs.where("i < j").select("i", "j").distinct().checkpoint()
    removed = spark.createDataFrame([], "id long").checkpoint()
    for _ in range(max_rounds):
        # Among undecided ids, those without a smaller partner are kept now.
        kept = edges.select(F.col("i").alias("id")).distinct().join(edges.select(F.col("j").alias("id")).distinct(), "id", "left_anti")
        out = edges.join(kept, edges["i"] == kept["id"], "left_semi").select(F.col("j").alias("id")).distinct().checkpoint()
        if out.isEmpty():
            return removed
        removed = removed.unionAll(out).checkpoint()
        gone = out.unionAll(kept).checkpoint()
        edges = edges.join(gone.withColumnRenamed("id", "i"), "i", "left_anti").join(gone.withColumnRenamed("id", "j"), "j", "left_anti").select("i", "j").checkpoint()
    raise RuntimeError(f"pairs are left after {max_rounds} rounds")


def near_dup_greedy(vectors: DataFrame, tolerance: float = 0.95) -> DataFrame:
    """vectors(id, vector) without the near-duplicates that the greedy scan removes."""
    removed = greedy_removed(similar_pairs(vectors, tolerance))
    return vectors.join(removed, "id", "left_anti")
