"""Import of records, export of annotations, live status. A record store is an interface; a Parquet one is here."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import merged_metadata
from ..operators import completeness, constraints, partition, responses
from ..operators.validate import split_valid
from ..paths import Workspace
from ..schemas import MANIFEST, SNAPSHOT, TASKS
from ..settings import AnnotationSettings
from ..sharing import with_checkpoints
from ..sources import writers
from ..sources.readers import read_records


class RecordStore(Protocol):
    """Where annotators work: a live annotation server or a table."""

    def log(self, records: DataFrame) -> None: ...

    def snapshot(self) -> DataFrame: ...

    def users(self) -> DataFrame | None: ...

    def tag(self, actions: DataFrame) -> None: ...


@dataclass
class ParquetStore:
    """Records and responses as tables under a folder."""

    spark: SparkSession
    path: str

    def log(self, records: DataFrame) -> None:
        writers.upsert_records(records, f"{self.path}/records")

    def snapshot(self) -> DataFrame:
        writers.settle(self.spark, f"{self.path}/snapshot")
        return self.spark.read.schema(SNAPSHOT).parquet(f"{self.path}/snapshot")

    def tag(self, actions: DataFrame) -> None:
        """Set and clear the completion tags of records. actions: workspace, dataset, record_uuid, chunk_id, action (tag or clear)."""
        keys, path = ["workspace", "dataset", "record_uuid", "chunk_id"], f"{self.path}/snapshot"
        todo = actions.where(F.col("action").isin("tag", "clear")).select(*[F.col(k).alias(f"__{k}") for k in keys], "action").distinct()
        snapshot = self.snapshot()
        same = None
        for k in keys:
            one = F.coalesce(snapshot[k], F.lit("")) == F.col(f"__{k}")
            same = one if same is None else same & one
        tags = F.when(F.col("action") == "tag", F.array(F.lit("true"))).when(F.col("action") == "clear", F.array().cast("array<string>")).otherwise(F.col("tags"))
        staging = f"{path}.{uuid.uuid4().hex}.staging"
        snapshot.join(todo, same, "left").withColumn("tags", tags).select(*snapshot.columns).write.parquet(staging)
        writers.replace_table(self.spark, staging, path)

    def update_metadata(self, changes: DataFrame, remove: tuple[str, ...] = ()) -> None:
        """Merge metadata into records: updates win, removed keys go. changes: workspace, dataset, record_uuid, chunk_id, updates (a map)."""
        keys, path = ["workspace", "dataset", "record_uuid", "chunk_id"], f"{self.path}/snapshot"
        todo = changes.select(*[F.col(k).alias(f"__{k}") for k in keys], "updates")
        snapshot = self.snapshot()
        same = [F.coalesce(snapshot[k], F.lit("")) == F.col(f"__{k}") for k in keys]
        current = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
        merged = F.when(F.col("updates").isNotNull(), merged_metadata(current, F.col("updates"), list(remove)))
        staging = f"{path}.{uuid.uuid4().hex}.staging"
        snapshot.join(todo, same, "left").withColumn("metadata", F.coalesce(merged, "metadata")).select(*snapshot.columns).write.parquet(staging)
        writers.replace_table(self.spark, staging, path)

    def users(self) -> DataFrame | None:
        p, store = writers.hadoop(self.spark, f"{self.path}/users")
        return self.spark.read.parquet(f"{self.path}/users") if store.exists(p) else None


@dataclass(frozen=True)
class ImportResult:
    n_records: int
    n_errors: int
    errors: list[dict]
    counts: dict[str, int]
    partitions: list[dict]


def _manifest(spark: SparkSession, folder: Path, dataset_id: str) -> tuple[DataFrame | None, str]:
    path = str(folder / "manifest")
    p, store = writers.hadoop(spark, path)
    if not store.exists(p):
        return None, path
    out = spark.read.schema(MANIFEST + ", seed int").parquet(path)
    other = out.where(F.coalesce("dataset_id", F.lit("")) != dataset_id).limit(1).collect()
    if other:
        raise ValueError(f"the manifest is of dataset {other[0].dataset_id!r}, not {dataset_id!r}")
    return out, path


def import_records(spark: SparkSession, source: Any, store: RecordStore, settings: AnnotationSettings | None = None, workspace: Workspace | None = None, format: str = "auto", max_errors: int = 100) -> ImportResult:  # noqa: A002
    """Validate, assign, fan out, and then write the manifest: a failed fan-out leaves no assignments.

    The manifest's seed counts once there is one."""
    settings, workspace = settings or AnnotationSettings(), workspace or Workspace()
    good, bad = split_valid(read_records(spark, source, format))
    records = partition.last_by_uuid(partition.with_record_uuid(good)).persist()
    try:
        folder = workspace.imports(settings.dataset_id)
        manifest, path = _manifest(spark, folder, settings.dataset_id)
        seed = settings.partition_seed
        if manifest is not None and (first := manifest.select("seed").first()):
            seed = first.seed
        fractions = settings.fractions() if settings.calibration_enabled else {t: 0.0 for t in settings.tasks}
        import_id, now = uuid.uuid4().hex, datetime.now(timezone.utc).isoformat()
        assigned = partition.assign(partition.units(records, settings.tasks), manifest, seed, fractions, import_id, now, settings.dataset_id).persist()
        out = partition.fan_out(records, assigned, settings.dataset_id, settings.tasks)
        store.log(out)
        counts = {r.dataset: r.n for r in out.groupBy("dataset").agg(F.count("*").alias("n")).collect()}
        assigned.where("is_new").drop("is_new").withColumn("seed", F.lit(seed)).write.mode("append").parquet(path)
        summary = [r.asDict() for r in partition.partition_summary(assigned, fractions).collect()]
        errors = [r.asDict() for r in bad.orderBy("ord").limit(max_errors).collect()]
        return ImportResult(records.count(), bad.count(), errors, counts, summary)
    finally:
        records.unpersist()


def export_annotations(store: RecordStore, workspace: Workspace | None = None, export_id: str | None = None, tasks: list[str] | None = None, include_discarded: bool = False, dataset_id: str = "") -> dict:
    """One CSV for each task, and a sidecar. All CSVs appear or none; a submitted annotation without all of its labels is an error."""
    workspace, tasks = workspace or Workspace(), tasks or list(TASKS)
    export_id = export_id or f"{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}_{uuid.uuid4().hex[:8]}"
    folder = workspace.export(export_id)
    snapshot, users = store.snapshot(), store.users()
    panels = summary = None
    status = "not_requested"
    if "retrieval" in tasks:
        try:
            records = record_table(responses.select_datasets(snapshot, "retrieval"))
            panels = completeness.panel_completeness(records)
            summary = completeness.completeness_summary(panels, records).first().asDict()
            summary["by_k_bucket"] = {r.bucket: {"n_panels": r.n_panels, "n_complete": r.n_complete} for r in completeness.completeness_by_bucket(panels).collect()}
            summary["by_k"] = {str(r.k): {"n_panels": r.n_panels, "n_complete": r.n_complete} for r in completeness.completeness_by_k(panels).collect()}
            status = "ok"
        except Exception as e:  # the rows are worth more than the summary
            panels, summary, status = None, {"error": str(e)[:500]}, "failed"
    jobs, frames = {}, {}
    for task in tasks:
        rows = responses.annotation_rows(responses.select_datasets(snapshot, task), users, task, include_discarded)
        if bad := responses.missing_labels(rows, task).select("record_uuid", "annotator_id", "missing").limit(5).collect():
            raise ValueError(f"submitted {task} annotations lack labels: {[(r.record_uuid, r.annotator_id, r.missing) for r in bad]}")
        frames[task] = responses.export_rows(rows, task, panels if task == "retrieval" else None).persist()
        jobs[str(folder / f"{task}.csv")] = (frames[task], {"header_when_empty": True})
    try:
        writers.commit_all(jobs)
        meta = {
            "export_id": export_id, "created_at": datetime.now(timezone.utc).isoformat(), "dataset_id": dataset_id or None, "tasks": tasks, "include_discarded": include_discarded,
            "row_counts": {t: df.count() for t, df in frames.items()},
            "n_annotators": {t: df.select("annotator_id").distinct().count() for t, df in frames.items()},
            "calibration_enabled": not snapshot.where("calibration").isEmpty(),
            "constraint_summary": {r.constraint_id: r.n for t, df in frames.items() for r in constraints.violation_counts(df, t, submitted_only=True).collect()},
            "completeness_summary": summary, "completeness_status": status,
        }
        writers.atomic_json(folder / "meta.json", meta)
    finally:
        for df in frames.values():
            df.unpersist()
    return meta


def record_table(snapshot: DataFrame) -> DataFrame:
    """Snapshot records as the panel operators take them. A user with any submitted answer in a record counts as one submitted response."""
    users = lambda s: F.size(F.array_distinct(F.transform(F.filter("responses", lambda r: r["status"] == s), lambda r: r["user_id"])))
    k = F.coalesce(F.get(F.map_values(F.map_filter("metadata", lambda key, _: key == "n_retrieved_chunks")), F.lit(0)).try_cast("int"), F.lit(0))
    return snapshot.select(
        "workspace", "dataset", F.coalesce("record_uuid", F.lit("")).alias("record_uuid"), F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), k.alias("n_retrieved_chunks"), F.coalesce("min_submitted", F.lit(1)).alias("min_submitted"),
        F.greatest(users("submitted"), F.lit(0)).cast("long").alias("n_submitted"), F.greatest(users("discarded"), F.lit(0)).cast("long").alias("n_discarded"), "tags",
    )


def report_status(store: RecordStore, workspace_name: str | None = None, tag_partial_panels: bool = False) -> dict:
    """Panels, totals and the progress of all tasks from one snapshot; with tag_partial_panels the store's tags are set and cleared too."""
    whole = responses.select_datasets(store.snapshot(), None, workspace_name)
    records = record_table(responses.select_datasets(whole, "retrieval"))
    status = completeness.panel_status(records)
    if tag_partial_panels:  # what is reported is read before the tags change
        with_checkpoints(whole.sparkSession)
        status = status.checkpoint()
    progress = [r.asDict() for r in completeness.task_progress(completeness.dataset_progress(whole)).collect()]  # a row for each dataset and total
    out: dict[str, Any] = {"panels": status, "totals": completeness.status_totals(status, records).first().asDict(), "progress": progress}
    if tag_partial_panels:
        actions = completeness.tag_actions(records).select("workspace", "dataset", "record_uuid", "chunk_id", "action").checkpoint()
        counts = {r.action: r.n for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}
        out["actions"] = actions
        if counts.get("tag") or counts.get("clear"):
            store.tag(actions)
        out["tags"] = {"n_tagged": counts.get("tag", 0), "n_cleared": counts.get("clear", 0), "n_already_tagged": counts.get("already", 0)}
    return out


def status_table(progress: list[dict]) -> str:
    """Progress as aligned text: level, names, total, completed and pending."""
    rows = [("level", "name", "total", "completed", "pending")]
    rows += [(r["level"], "/".join(r[k] for k in ("workspace", "dataset", "task") if r[k]), *(str(r[k]) for k in ("total", "completed", "pending"))) for r in progress]
    widths = [max(len(r[i]) for r in rows) for i in range(5)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows)
