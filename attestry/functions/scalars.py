"""Scalar expressions. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

NUL = "\0"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends, as Python strips."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def non_blank(x: Column | str) -> Column:
    """False for null and for white space alone."""
    return F.coalesce(F.length(strip(x)) > 0, F.lit(False))


def yes_no(x: Column | str) -> Column:
    """Null stays null, `yes` is true, anything else false."""
    return F.when(col(x).isNotNull(), col(x) == "yes")


def record_uuid(query: Column | str, answer: Column | str, context_set: Column | str, chunk_ids: Column | str) -> Column:
    """SHA-256 of the record's content; chunk ids count in sorted order. A null field counts as an empty one."""
    ids = F.array_join(F.sort_array(col(chunk_ids)), "|")
    return F.sha2(F.concat_ws(NUL, *[F.coalesce(x, F.lit("")) for x in (col(query), col(answer), col(context_set), ids)]), 256)


def short_digest(x: Column | str) -> Column:
    return F.substring(F.sha2(col(x), 256), 1, 16)


def record_id(task: str, uuid: Column | str, chunk_id: Column | str | None = None) -> Column:
    """`ret-{uuid}-{digest}`, `gnd-{uuid}` or `gen-{uuid}`."""
    if task == "retrieval":
        return F.concat(F.lit("ret-"), col(uuid), F.lit("-"), short_digest(chunk_id))
    return F.concat(F.lit({"grounding": "gnd-", "generation": "gen-"}[task]), col(uuid))


def unit_id(uuid: Column | str, chunk_id: Column | str) -> Column:
    """`uuid:chunk_id`, or the uuid alone where there is no chunk."""
    return F.when(col(chunk_id).isNotNull() & (col(chunk_id) != ""), F.concat(col(uuid), F.lit(":"), col(chunk_id))).otherwise(col(uuid))


def uniform_digest(seed: Column | int, task: Column, unit: Column) -> Column:
    """The first 32 bits of SHA-256 of seed, task and unit, as a number from 0 to 2**32 - 1."""
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.conv(F.substring(F.sha2(F.concat_ws(NUL, seed, task, unit), 256), 1, 8), 16, 10).cast("bigint")


def dataset_name(task: Column, calibration: Column, dataset_id: Column | str | None = None) -> Column:
    """`{task}_{production|calibration}`, then `_{dataset_id}` unless it is empty."""
    given = F.lit(dataset_id) if dataset_id is None or isinstance(dataset_id, str) else dataset_id
    suffix = F.when(F.coalesce(F.length(given), F.lit(0)) > 0, given)
    return F.concat_ws("_", task, F.when(calibration, "calibration").otherwise("production"), suffix)


def task_of(dataset: Column | str) -> Column:
    return F.substring_index(col(dataset), "_", 1)


def k_bucket(k: Column | str) -> Column:
    return F.when(col(k) < 5, "k_lt_5").when(col(k) == 5, "k_eq_5").otherwise("k_gt_5")


def relevance_grade(relevant: Column | str, sufficient: Column | str) -> Column:
    return F.when(col(sufficient) == 1, 2).when(col(relevant) == 1, 1).otherwise(0)


def true_tag(x: Column | str) -> Column:
    """Whether any of the tags is `true`, whatever its case and white space; null: false."""
    return F.coalesce(F.exists(col(x), lambda v: F.lower(strip(v)) == "true"), F.lit(False))


def candidate_id(sequence: Column | str) -> Column:
    """`c` and the number with at least three digits."""
    text = col(sequence).cast("string")
    return F.concat(F.lit("c"), F.lpad(text, F.greatest(F.length(text), F.lit(3)), F.lit("0")))


def blueprint_json(fields: tuple[str, ...]) -> Column:
    """Canonical JSON of a blueprint: fixed field order, nulls kept, no white space."""
    return F.to_json(F.struct(*[F.col(f).cast("string").alias(f) for f in fields]), {"ignoreNullFields": "false"})


def merged_metadata(current: Column, updates: Column, remove: list[str]) -> Column:
    """Updates win and removed keys go; null if that changes nothing."""
    kept = F.map_filter(current, lambda k, _: ~F.array_contains(F.map_keys(updates), k) & ~k.isin(remove) if remove else ~F.array_contains(F.map_keys(updates), k))
    new = F.map_concat(kept, F.map_filter(updates, lambda k, _: ~k.isin(remove)) if remove else updates)
    order = lambda m: F.array_sort(F.map_entries(m))
    return F.when(~order(new).eqNullSafe(order(current)), new)


def csv_cell(x: Column | str, kind: str) -> Column:
    """Null is empty, booleans are lower-case, all else is its text."""
    return F.coalesce(F.lower(col(x).cast("string")) if kind == "boolean" else col(x).cast("string"), F.lit(""))


def register_sql(spark: SparkSession) -> None:
    """SQL functions for use in spark.sql: ndcg over grades in rank order, wilson_low and wilson_high, calibration_digest."""
    dcg = "aggregate(transform(g, (x, i) -> (pow(2D, x) - 1) / log2(i + 2D)), 0D, (a, x) -> a + x)"
    ideal = dcg.replace("transform(g,", "transform(reverse(array_sort(g)),")
    half = "z / (1 + z * z / n) * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))"
    centre = "(k / n + z * z / (2 * n)) / (1 + z * z / n)"
    for name, args, kind, body in (
        ("ndcg", "g ARRAY<INT>", "DOUBLE", f"coalesce({dcg} / nullif({ideal}, 0D), 0D)"),
        ("wilson_low", "k DOUBLE, n DOUBLE, z DOUBLE", "DOUBLE", f"if(n > 0, greatest(0D, {centre} - {half}), NULL)"),
        ("wilson_high", "k DOUBLE, n DOUBLE, z DOUBLE", "DOUBLE", f"if(n > 0, least(1D, {centre} + {half}), NULL)"),
        ("calibration_digest", "seed STRING, task STRING, unit STRING", "BIGINT", "cast(conv(substr(sha2(concat_ws(char(0), seed, task, unit), 256), 1, 8), 16, 10) AS BIGINT)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
