"""Declared contracts: task columns and table schemas. Schemas are never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

TASKS = ("retrieval", "grounding", "generation")

TEXT_COLUMNS = {"retrieval": ("query", "chunk"), "grounding": ("answer", "context_set"), "generation": ("query", "answer")}

# Label names of each task.
LABEL_COLUMNS = {
    "retrieval": ("topically_relevant", "evidence_sufficient", "misleading"),
    "grounding": ("support_present", "unsupported_claim_present", "contradicted_claim_present", "source_cited", "fabricated_source"),
    "generation": ("proper_action", "response_on_topic", "helpful", "incomplete", "unsafe_content"),
}

#: What names one labelled unit.
UNIT_KEYS = {"retrieval": ("record_uuid", "chunk_id"), "grounding": ("record_uuid",), "generation": ("record_uuid",)}

RESPONSE_STATUSES = ("submitted", "discarded")

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("chunk_rank", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)

IMPORT_RECORD = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("context_set", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("chunks", T.ArrayType(CHUNK)),
    ]
)

# Column names and kinds of the exported CSVs, in file order.
_ANNOTATION_BASE = (
    ("record_uuid", "string"),
    ("annotator_id", "string"),
    ("task", "string"),
    ("language", "string"),
    ("calibration", "boolean"),
    ("inserted_at", "timestamp"),
    ("created_at", "timestamp"),
    ("record_status", "string"),
    ("response_status", "string"),
    ("discard_reason", "string"),
    ("discard_notes", "string"),
)
_ANNOTATION_TEXTS = {
    "retrieval": (
        ("query", "string"),
        ("chunk", "string"),
        ("chunk_id", "string"),
        ("doc_id", "string"),
        ("chunk_rank", "int"),
        ("n_retrieved_chunks", "int"),
    ),
    "grounding": (
        ("answer", "string"),
        ("context_set", "string"),
    ),
    "generation": (
        ("query", "string"),
        ("answer", "string"),
    ),
}
_PANEL = (
    ("panel_complete", "boolean"),
    ("n_annotated_chunks", "int"),
    ("n_submitted_chunks", "int"),
    ("n_discarded_chunks", "int"),
    ("n_records_seen", "int"),
)


def _struct(fields) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in fields)) if fields else T.StructType([])


def annotation_columns(task: str) -> list[tuple[str, str]]:
    return [*_ANNOTATION_BASE, *_ANNOTATION_TEXTS[task], *((x, "boolean") for x in LABEL_COLUMNS[task]), ("notes", "string")]


def export_columns(task: str) -> list[tuple[str, str]]:
    """Annotation columns and what the export derives, in file order."""
    extra = [("constraint_violated", "boolean"), ("constraint_details", "string")]
    return [*annotation_columns(task), *extra, *(_PANEL if task == "retrieval" else ())]


def export_schema(task: str) -> T.StructType:
    return _struct(export_columns(task))


MANIFEST = "dataset_id string, task string, record_uuid string, chunk_id string, is_calibration boolean, import_id string, calibration_fraction double, assigned_at string"

SNAPSHOT = (
    "workspace string, dataset string, task string, calibration boolean, record_uuid string, chunk_id string, record_status string, inserted_at timestamp, updated_at timestamp, "
    "fields map<string,string>, metadata map<string,string>, tags array<string>, min_submitted int, responses array<struct<user_id:string,question_name:string,value:string,status:string>>"
)

BLUEPRINT_FIELDS = ("domain", "role", "language", "topic", "intent", "task", "difficulty", "format", "user_scenario", "information_need")
QUERY_ROW_FIELDS = ("query_id", "query", "domain", "role", "language", "topic", "intent", "task", "difficulty", "format")
