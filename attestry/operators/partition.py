"""Deterministic assignment of units to calibration or production, kept stable by a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dataset_name, record_id, record_uuid, uniform_digest, unit_id
from ..schemas import TASKS


def with_record_uuid(records: DataFrame) -> DataFrame:
    return records.withColumn("record_uuid", record_uuid("query", "answer", "context_set", F.transform("chunks", lambda c: c["chunk_id"])))


def last_by_uuid(records: DataFrame) -> DataFrame:
    """Of records with the same uuid the last one by ord stays, at the place of the first."""
    value = F.struct(*[c for c in records.columns if c not in ("record_uuid", "ord")])
    out = records.groupBy("record_uuid").agg(F.max_by(value, "ord").alias("v"), F.min("ord").alias("ord"))
    return out.select("record_uuid", "ord", "v.*").select(*records.columns)


def units(records: DataFrame, tasks: list[str] | None = None) -> DataFrame:
    """task, record_uuid, chunk_id (empty outside retrieval): one row for each chunk and one for each record and other task."""
    tasks = list(TASKS) if tasks is None else tasks
    chunk = records.select(F.lit("retrieval").alias("task"), "record_uuid", F.explode(F.transform("chunks", lambda c: c["chunk_id"])).alias("chunk_id"))
    whole = [t for t in tasks if t != "retrieval"]
    other = records.select(F.explode(F.array(*[F.lit(t) for t in whole] or [F.lit("")])).alias("task"), "record_uuid", F.lit("").alias("chunk_id")).where("task <> ''")
    return chunk.unionAll(other) if "retrieval" in tasks else other


def is_calibration(seed: Column | int, fractions: dict[str, float]) -> Column:
    """Whether a unit's digest is under its task's fraction of 2**32; 1 and more is always, 0 and less never."""
    unit = unit_id("record_uuid", "chunk_id")
    out = F.lit(False)
    for task, f in fractions.items():
        rule = F.lit(True) if f >= 1 else F.lit(False) if f <= 0 else uniform_digest(seed, F.col("task"), unit) < int(f * 2**32)
        out = F.when(F.col("task") == task, rule).otherwise(out)
    return out


def assign(units_: DataFrame, manifest: DataFrame | None, seed: int, fractions: dict[str, float], import_id: str = "", assigned_at: str = "", dataset_id: str = "") -> DataFrame:
    """units with is_calibration, is_new and provenance. A unit that the manifest has keeps its assignment; a new unit of
    a known record gets the same rule, so later tasks and chunks fill in without moving anything.

    The manifest joins by unit; nothing grows but with its rows."""
    keys = ["task", "record_uuid", "chunk_id"]
    computed = units_.dropDuplicates(keys).withColumn("computed", is_calibration(seed, fractions))
    fraction = F.lit(0.0)
    for task, f in fractions.items():
        fraction = F.when(F.col("task") == task, F.lit(float(f))).otherwise(fraction)
    old = ["is_calibration", "import_id", "calibration_fraction", "assigned_at"]
    if manifest is None:
        joined = computed.select("*", *[F.lit(None).alias(f"old_{c}") for c in old])
    else:
        known = manifest.where(F.coalesce("dataset_id", F.lit("")) == dataset_id).select(*keys, *[F.col(c).alias(f"old_{c}") for c in old])
        joined = computed.join(known, keys, "left")
    return joined.select(
        F.lit(dataset_id).alias("dataset_id"),
        *keys,
        F.coalesce(F.col("old_is_calibration").cast("boolean"), "computed").alias("is_calibration"),
        F.coalesce(F.col("old_import_id").cast("string"), F.lit(import_id)).alias("import_id"),
        F.coalesce(F.col("old_calibration_fraction").cast("double"), fraction).alias("calibration_fraction"),
        F.coalesce(F.col("old_assigned_at").cast("string"), F.lit(assigned_at)).alias("assigned_at"),
        F.col("old_is_calibration").isNull().alias("is_new"),
    )


def capped(assigned: DataFrame, remaining: dict[str, int], seed: int) -> DataFrame:
    """Optional: of a task's new calibration units only the `remaining` with the smallest digests stay calibration.

    Digests are spread evenly, so the place of the n-th is found in a histogram of their high bits, and only the units of one
    cell are ranked, however many a task has."""
    unit = unit_id("record_uuid", "chunk_id")
    new = F.col("is_new") & F.col("is_calibration")
    digest = uniform_digest(seed, F.col("task"), unit)
    marked = assigned.withColumn("__digest", F.when(new, digest)).withColumn("__cell", F.shiftright("__digest", 12))
    cells = marked.where(new).groupBy("task", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("task").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limit = F.lit(2**62)
    for task, n in remaining.items():
        limit = F.when(F.col("task") == task, F.lit(n)).otherwise(limit)
    placed = marked.join(cells.withColumn("__before", before), ["task", "__cell"], "left").withColumn("__limit", limit)
    edge = F.coalesce(new & (F.col("__before") < F.col("__limit")) & (F.col("__before") + F.col("__n") > F.col("__limit")), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("task", "__cell").orderBy("__digest", "record_uuid", "chunk_id"))
    sure = placed.where(~edge).withColumn("__over", F.coalesce(new & (F.col("__before") >= F.col("__limit")), F.lit(False)))
    out = sure.unionByName(placed.where(edge).withColumn("__over", F.col("__before") + rank > F.col("__limit")))
    return out.withColumn("is_calibration", F.col("is_calibration") & ~F.col("__over")).select(*assigned.columns)


def partition_summary(assigned: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """task, n_units, n_calibration, n_production, realised_fraction (0 if no units), configured_fraction: always a row for each task."""
    spine = assigned.sparkSession.createDataFrame([(t, float(fractions.get(t, 0.0))) for t in TASKS], "task string, configured_fraction double")
    sums = assigned.groupBy("task").agg(F.count(F.lit(1)).alias("n_units"), F.count_if("is_calibration").alias("n_calibration"))
    out = spine.join(sums, "task", "left").select("task", F.coalesce("n_units", F.lit(0)).alias("n_units"), F.coalesce("n_calibration", F.lit(0)).alias("n_calibration"), "configured_fraction")
    return out.withColumn("n_production", F.col("n_units") - F.col("n_calibration")).withColumn("realised_fraction", F.coalesce(F.try_divide("n_calibration", "n_units"), F.lit(0.0)))


def fan_out(records: DataFrame, assigned: DataFrame, dataset_id: str = "", tasks: list[str] | None = None) -> DataFrame:
    """Annotation records of all tasks: record_id, task, calibration, dataset, fields, metadata. Tasks that aren't deployed drop out."""
    text = F.map_filter(F.create_map(*[x for c in ("query", "answer", "context_set", "chunk") for x in (F.lit(c), F.col(c))]), lambda _, v: v.isNotNull())
    chunk = records.select("record_uuid", "language", F.lit("retrieval").alias("task"), "query", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("context_set"), F.size("chunks").alias("n_chunks"), F.explode("chunks").alias("c"))
    chunk = chunk.select("record_uuid", "language", "task", "query", "answer", "context_set", "n_chunks", "c.chunk_id", "c.doc_id", "c.chunk_rank", F.col("c.text").alias("chunk"))
    none = lambda kind: F.lit(None).cast(kind)
    shapes = {"grounding": ("answer", "context_set"), "generation": ("query", "answer")}
    rows = [chunk]
    for task, names in shapes.items():
        texts = [F.col(c) if c in names else none("string").alias(c) for c in ("query", "answer", "context_set")]
        rows.append(records.select("record_uuid", "language", F.lit(task).alias("task"), *texts, F.size("chunks").alias("n_chunks"), F.lit("").alias("chunk_id"), none("string").alias("doc_id"), none("int").alias("chunk_rank"), none("string").alias("chunk")))
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    if tasks is not None:
        every = every.where(F.col("task").isin(tasks))
    placed = every.join(assigned.select("task", "record_uuid", "chunk_id", F.col("is_calibration").alias("calibration")), ["task", "record_uuid", "chunk_id"])
    ident = F.when(F.col("task") == "retrieval", record_id("retrieval", "record_uuid", "chunk_id")).when(F.col("task") == "grounding", record_id("grounding", "record_uuid")).otherwise(record_id("generation", "record_uuid"))
    pairs = {"record_uuid": F.col("record_uuid"), "language": F.col("language"), "chunk_id": F.nullif(F.col("chunk_id"), F.lit("")), "doc_id": F.col("doc_id"), "chunk_rank": F.col("chunk_rank").cast("string"), "n_retrieved_chunks": F.when(F.col("task") == "retrieval", F.col("n_chunks").cast("string"))}
    meta = F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    return placed.select(ident.alias("record_id"), "task", "record_uuid", "chunk_id", "calibration", dataset_name(F.col("task"), F.col("calibration"), dataset_id).alias("dataset"), text.alias("fields"), meta.alias("metadata"))
