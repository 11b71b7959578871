"""Panels: the chunks of one query and what annotators did with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import k_bucket, task_of, true_tag

BUCKETS = ("k_lt_5", "k_eq_5", "k_gt_5")
_TASK_ORDER = {"retrieval": 0, "grounding": 1, "generation": 2}


def records_of(responses: DataFrame) -> DataFrame:
    """One row for each record (workspace, dataset, record_uuid, chunk_id) from one row for each response (status null: none)."""
    keys = ["workspace", "dataset", "record_uuid", "chunk_id"]
    return responses.groupBy(*keys).agg(
        F.max(F.coalesce("n_retrieved_chunks", F.lit(0))).alias("n_retrieved_chunks"),
        F.max(F.coalesce("min_submitted", F.lit(1))).alias("min_submitted"),
        F.count_if(F.col("status") == "submitted").alias("n_submitted"),
        F.count_if(F.col("status") == "discarded").alias("n_discarded"),
    )


def _orphan() -> Column:
    return F.coalesce(F.length("record_uuid"), F.lit(0)) == 0


def panel_completeness(records: DataFrame) -> DataFrame:
    """Export view, by record_uuid: k is the largest positive n_retrieved_chunks, 0 if none; a panel is complete if k > 0 and
    exactly k chunks have a submitted response. At most one integrity warning a panel: k differs from the chunks seen,
    or else some but not all records know k. Records without a uuid are orphans and don't count."""
    sub, dis, k = F.col("n_submitted") > 0, F.col("n_discarded") > 0, F.col("n_retrieved_chunks")
    # Chunks first, then panels: a distinct count for each condition would copy every row as often.
    chunks = records.where(~_orphan()).groupBy("record_uuid", "chunk_id").agg(
        F.max(F.when(k > 0, k)).alias("k"), F.bool_or(sub).alias("sub"), F.bool_or(dis).alias("dis"), F.bool_or(sub | dis).alias("any"), F.count(F.lit(1)).alias("n"), F.count_if(k > 0).alias("n_k")
    )
    seen = F.col("chunk_id").isNotNull()
    panels = chunks.groupBy("record_uuid").agg(
        F.coalesce(F.max("k"), F.lit(0)).alias("k"),
        F.count_if(seen).alias("n_seen"),
        F.count_if(seen & F.col("sub")).alias("n_submitted_chunks"),
        F.count_if(seen & F.col("dis")).alias("n_discarded_chunks"),
        F.count_if(seen & F.col("any")).alias("n_annotated_chunks"),
        F.sum("n").alias("n_records_seen"),
        F.sum("n_k").alias("n_with_k"),
    )
    warns = (F.col("k") > 0) & (F.col("k") != F.col("n_seen")) | (F.col("n_with_k") > 0) & (F.col("n_with_k") < F.col("n_seen"))
    return panels.withColumn("panel_complete", (F.col("k") > 0) & (F.col("n_submitted_chunks") == F.col("k"))).withColumn("integrity_warning", warns)


def completeness_by_k(panels: DataFrame) -> DataFrame:
    """k, bucket, n_panels, n_complete in order of k."""
    out = panels.groupBy("k").agg(F.count(F.lit(1)).alias("n_panels"), F.count_if("panel_complete").alias("n_complete"))
    return out.select("k", k_bucket("k").alias("bucket"), "n_panels", "n_complete").orderBy("k")


def completeness_by_bucket(panels: DataFrame) -> DataFrame:
    """bucket, n_panels, n_complete: always all three buckets."""
    spine = panels.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    sums = panels.groupBy(k_bucket("k").alias("bucket")).agg(F.count(F.lit(1)).alias("n_panels"), F.count_if("panel_complete").alias("n_complete"))
    return spine.join(sums, "bucket", "left").select("bucket", F.coalesce("n_panels", F.lit(0)).alias("n_panels"), F.coalesce("n_complete", F.lit(0)).alias("n_complete"))


def completeness_summary(panels: DataFrame, records: DataFrame) -> DataFrame:
    """One row: n_panels, n_complete, fraction_complete (0 if no panels), n_integrity_warnings, n_unknown_k, n_orphans_skipped."""
    sums = panels.agg(
        F.count(F.lit(1)).alias("n_panels"), F.count_if("panel_complete").alias("n_complete"), F.count_if("integrity_warning").alias("n_integrity_warnings"), F.count_if(F.col("k") == 0).alias("n_unknown_k")
    )
    orphans = records.agg(F.count_if(_orphan()).alias("n_orphans_skipped"))
    return sums.join(orphans).withColumn("fraction_complete", F.coalesce(F.try_divide("n_complete", "n_panels"), F.lit(0.0)))


def panel_status(records: DataFrame) -> DataFrame:
    """Live view, by (workspace, record_uuid): complete if every chunk seen has a submitted response; overlap_satisfied if every
    chunk has as many as the largest min_submitted of its records; integrity_ok if the metadata's k is absent or right."""
    chunks = records.where(~_orphan()).groupBy("workspace", "record_uuid", "chunk_id").agg(
        F.sum("n_submitted").alias("submitted"), F.max("min_submitted").alias("needed"), F.sum("n_discarded").alias("discarded"), F.max("n_retrieved_chunks").alias("k")
    )
    panels = chunks.groupBy("workspace", "record_uuid").agg(
        F.count(F.lit(1)).alias("k_records"),
        F.max(F.greatest("k", F.lit(0))).alias("k_metadata"),
        F.count_if(F.col("submitted") + F.col("discarded") > 0).alias("n_terminal"),
        F.count_if(F.col("submitted") > 0).alias("n_submitted"),
        F.bool_and(F.col("submitted") >= F.col("needed")).alias("overlap_satisfied"),
    )
    return panels.withColumn("panel_complete", F.col("n_submitted") == F.col("k_records")).withColumn("integrity_ok", (F.col("k_metadata") == 0) | (F.col("k_metadata") == F.col("k_records")))


def status_totals(status: DataFrame, records: DataFrame) -> DataFrame:
    """One row: n_panels, n_complete, n_overlap_satisfied, n_integrity_warnings, n_panels_unknown_k, n_orphans_skipped."""
    sums = status.agg(
        F.count(F.lit(1)).alias("n_panels"),
        F.count_if("panel_complete").alias("n_complete"),
        F.count_if("overlap_satisfied").alias("n_overlap_satisfied"),
        F.count_if(~F.col("integrity_ok")).alias("n_integrity_warnings"),
        F.count_if(F.col("k_metadata") == 0).alias("n_panels_unknown_k"),
    )
    return sums.join(records.agg(F.count_if(_orphan()).alias("n_orphans_skipped")))


def dataset_progress(snapshot: DataFrame) -> DataFrame:
    """workspace, dataset, task, total, completed, pending of a snapshot: a record is completed by as many users' submitted
    responses as its dataset asks for."""
    users = F.size(F.array_distinct(F.transform(F.filter("responses", lambda r: r["status"] == "submitted"), lambda r: r["user_id"])))
    done = F.coalesce(users, F.lit(0)) >= F.coalesce("min_submitted", F.lit(1))
    task = task_of("dataset")
    return snapshot.groupBy("workspace", "dataset", task.alias("task")).agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed"), F.count_if(~done).alias("pending"))


def task_progress(datasets: DataFrame) -> DataFrame:
    """Totals, completed and pending by nothing, by task, by (workspace, task) and by (workspace, dataset, task), in one pass.

    datasets: workspace, dataset, task, total, completed, pending. `level` is grand, task, workspace or dataset."""
    order = " ".join(f"WHEN '{t}' THEN {n}" for t, n in _TASK_ORDER.items())
    return datasets.sparkSession.sql(
        f"""SELECT CASE WHEN grouping(task) = 1 THEN 'grand' WHEN grouping(workspace) = 1 THEN 'task' WHEN grouping(dataset) = 1 THEN 'workspace' ELSE 'dataset' END AS level,
                   workspace, dataset, task, coalesce(sum(total), 0) AS total, coalesce(sum(completed), 0) AS completed, coalesce(sum(pending), 0) AS pending
            FROM {{datasets}} GROUP BY GROUPING SETS ((), (task), (workspace, task), (workspace, dataset, task))
            ORDER BY grouping(task) + grouping(workspace) + grouping(dataset) DESC, CASE task {order} ELSE 99 END, workspace, dataset""",
        datasets=datasets,
    )


def tag_actions(records: DataFrame) -> DataFrame:
    """Adds `action` (tag, clear, already or none) to records of retrieval panels.

    A panel is partial if some but not all of its chunks have a submitted response. A record of a partial panel without
    any submitted or discarded response should be tagged; `tags` has its needs_completion values so far."""
    chunks = records.where(~_orphan()).groupBy("workspace", "record_uuid", "chunk_id").agg(F.bool_or(F.col("n_submitted") > 0).alias("done"))
    facts = chunks.groupBy("workspace", "record_uuid").agg(F.count("chunk_id").alias("k"), F.count_if(F.col("done") & F.col("chunk_id").isNotNull()).alias("done"))
    partial = facts.select("workspace", "record_uuid", ((F.col("done") > 0) & (F.col("done") < F.col("k"))).alias("partial"))
    joined = records.join(partial, ["workspace", "record_uuid"])
    should = F.col("partial") & (F.col("n_submitted") + F.col("n_discarded") == 0)
    tagged = true_tag("tags")
    action = F.when(should & tagged, "already").when(should, "tag").when(tagged, "clear").otherwise("none")
    return joined.withColumn("action", action).drop("partial")
