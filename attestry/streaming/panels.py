"""Panel completeness over a stream of responses, and manifest-locked assignment of arriving records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import partition
from ..operators.validate import split_valid


def panel_stream(responses: DataFrame, watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Completeness of each panel by window and workspace, exact over the responses seen; late rows beyond the watermark drop by design.

    responses: a stream of workspace, record_uuid, chunk_id, user_id, status, n_retrieved_chunks, created_at. The state of a panel is
    the set of its chunks, of which a query has few. A panel is complete if as many chunks as its query retrieved have a submitted response."""
    late = responses.withWatermark("created_at", watermark).where(F.length("record_uuid") > 0)
    chunks = lambda *of: F.size(F.collect_set(F.when(F.col("status").isin(*of), F.col("chunk_id"))))
    panels = late.groupBy(F.window("created_at", window), "workspace", "record_uuid").agg(
        F.coalesce(F.max(F.when(F.col("n_retrieved_chunks") > 0, F.col("n_retrieved_chunks"))), F.lit(0)).alias("k"),
        F.size(F.collect_set("chunk_id")).alias("n_seen"),
        chunks("submitted").alias("n_submitted_chunks"),
        chunks("discarded").alias("n_discarded_chunks"),
        chunks("submitted", "discarded").alias("n_annotated_chunks"),
    )
    return panels.withColumn("panel_complete", (F.col("k") > 0) & (F.col("n_submitted_chunks") == F.col("k")))


def assign_stream(records: DataFrame, manifest_path: str, checkpoint: str, seed: int, fractions: dict[str, float], dataset_id: str = ""):
    """Start a query that assigns each micro-batch against the manifest table and appends what is new. A replayed batch adds nothing."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(manifest_path)
        known = spark.read.parquet(manifest_path) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None
        good, _ = split_valid(batch.withColumn("ord", F.monotonically_increasing_id()))
        unique = partition.last_by_uuid(partition.with_record_uuid(good))
        new = partition.assign(partition.units(unique), known, seed, fractions, str(batch_id), "", dataset_id).where("is_new")
        new.drop("is_new").write.mode("append").parquet(manifest_path)

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
