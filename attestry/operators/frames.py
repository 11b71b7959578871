"""Frames for an external classifier, and the merged view of all tasks."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import LABEL_COLUMNS, TEXT_COLUMNS, UNIT_KEYS


class Classifier(Protocol):
    def train(self, frame: DataFrame, settings: dict) -> str: ...

    def predict(self, frame: DataFrame, model: str) -> DataFrame: ...


def _names(task: str, labels: bool) -> dict[str, str]:
    out = dict(zip(TEXT_COLUMNS[task], ("text", "text_pair"), strict=False))
    if labels:
        out |= {x: f"label_{x}" for x in LABEL_COLUMNS[task]}
    return out


def to_classifier(df: DataFrame, task: str, labels: bool = True) -> DataFrame:
    """text, text_pair, label_..., and split_group (the record) where it is known; a name that is taken is an error."""
    names = _names(task, labels)
    out = {**names, **({"record_uuid": "split_group"} if "record_uuid" in df.columns else {})}
    if taken := sorted({x for x in out.values() if x in df.columns}):
        raise ValueError(f"reserved columns in the input: {taken}")
    if labels:
        df = df.withColumns({x: F.col(x).cast("int") for x in LABEL_COLUMNS[task]})
    return df.withColumnsRenamed(out)


def from_classifier(df: DataFrame, task: str) -> DataFrame:
    """The inverse names: predictions become a frame that can be scored."""
    names = {v: k for k, v in _names(task, True).items()} | {"split_group": "record_uuid"}
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def merged_tasks(retrieval: DataFrame, grounding: DataFrame, generation: DataFrame) -> DataFrame:
    """One row for each record_uuid of any task: retrieval labels reduced by OR, the others as they are."""
    r = retrieval.groupBy("record_uuid").agg(*[F.bool_or(F.col(x).cast("boolean")).alias(x) for x in LABEL_COLUMNS["retrieval"]])
    others = [df.select(*UNIT_KEYS[t], *[F.col(x).cast("boolean").alias(x) for x in LABEL_COLUMNS[t]]) for t, df in (("grounding", grounding), ("generation", generation))]
    return r.join(others[0], "record_uuid", "full_outer").join(others[1], "record_uuid", "full_outer")
