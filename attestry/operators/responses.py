"""Live records with nested responses become one typed row for each record and annotator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import yes_no
from ..schemas import LABEL_COLUMNS, TEXT_COLUMNS, annotation_columns, export_columns
from .constraints import Rule, RULES, with_violations


def select_datasets(snapshot: DataFrame, task: str | None = None, workspace: str | None = None) -> DataFrame:
    """Records of one workspace, if given, and of datasets named after the task, alone or with more after `_`."""
    out = snapshot
    if workspace is not None:
        out = out.where(F.col("workspace") == workspace)
    if task is not None:
        out = out.where((F.col("dataset") == task) | F.col("dataset").startswith(f"{task}_"))
    return out


def annotation_rows(snapshot: DataFrame, users: DataFrame | None, task: str, include_discarded: bool = False) -> DataFrame:
    """One row for each (record, user) whose response counts.

    A user's status is that of the first response seen, each answer the last. Production and calibration records may share a
    frame. Responses are filtered for each user in all tasks. Unknown users keep their id as name; a missing uuid is empty."""
    questions = [*LABEL_COLUMNS[task], "notes", "discard_reason", "discard_notes"]
    keep = ["workspace", "dataset", "calibration", "record_uuid", "chunk_id", "record_status", "inserted_at", "updated_at", "fields", "metadata"]
    statuses = ["submitted", "discarded"] if include_discarded else ["submitted"]
    record = snapshot.where(F.exists("responses", lambda r: r["status"].isin(statuses))).withColumn("__record", F.monotonically_increasing_id())
    each = record.select("__record", *keep, F.posexplode("responses").alias("pos", "r"))
    answer = lambda q: F.max_by(F.when(F.col("r.question_name") == q, F.col("r.value")), F.when(F.col("r.question_name") == q, F.col("pos"))).alias(q)
    grouped = each.groupBy("__record", F.col("r.user_id").alias("user_id")).agg(*[F.first(c).alias(c) for c in keep], F.min_by("r.status", "pos").alias("response_status"), *[answer(q) for q in questions])
    rows = grouped.where(F.col("response_status").isin(statuses))
    if users is not None:
        rows = rows.join(users.select(F.col("id").alias("user_id"), "username"), "user_id", "left")
        name = F.coalesce("username", "user_id")
    else:
        name = F.col("user_id")
    meta = lambda k: F.get(F.filter(F.map_entries("metadata"), lambda e: e["key"] == k), F.lit(0))["value"]
    values: dict[str, Column] = {
        "record_uuid": F.coalesce("record_uuid", F.lit("")),
        "annotator_id": name,
        "task": F.lit(task),
        "language": meta("language"),
        "calibration": F.coalesce("calibration", F.lit(False)),
        "created_at": F.coalesce("updated_at", "inserted_at"),
        "chunk_id": F.coalesce("chunk_id", F.lit("")),
        "doc_id": F.coalesce(meta("doc_id"), F.lit("")),
        "chunk_rank": F.coalesce(meta("chunk_rank").try_cast("int"), F.lit(0)),
        "n_retrieved_chunks": F.coalesce(meta("n_retrieved_chunks").try_cast("int"), F.lit(-1)),
        "notes": F.coalesce("notes", F.lit("")),
    }
    values |= {x: yes_no(x) for x in LABEL_COLUMNS[task]}
    values |= {x: F.col("fields")[x] for x in TEXT_COLUMNS[task]}
    return rows.select(*[values.get(c, F.col(c)).cast(kind).alias(c) for c, kind in annotation_columns(task)])


def missing_labels(df: DataFrame, task: str) -> DataFrame:
    """Submitted rows that lack a label, with the names of those labels."""
    lacks = F.array_compact(F.array(*[F.when(F.col(x).isNull(), F.lit(x)) for x in LABEL_COLUMNS[task]]))
    return df.withColumn("missing", F.when(F.col("response_status") == "submitted", lacks).otherwise(F.array().cast("array<string>"))).where(F.size("missing") > 0)


def export_rows(rows: DataFrame, task: str, panels: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Annotation rows with constraint columns and, for retrieval, those of the panel; a row without a panel has false and zeros."""
    out = with_violations(rows, task, submitted_only=True, rules=rules)
    if task == "retrieval":
        names = ("panel_complete", "n_annotated_chunks", "n_submitted_chunks", "n_discarded_chunks", "n_records_seen")
        if panels is None:
            out = out.withColumns({c: F.lit(False) if c == "panel_complete" else F.lit(0) for c in names})
        else:
            out = out.join(panels.select("record_uuid", *names), "record_uuid", "left").withColumns({c: F.coalesce(c, F.lit(False) if c == "panel_complete" else F.lit(0)) for c in names})
    return out.select(*[F.col(c).cast(kind).alias(c) for c, kind in export_columns(task)])
