"""Alignment and assembly of generated queries; models are interfaces."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import blueprint_json
from ..schemas import BLUEPRINT_FIELDS, QUERY_ROW_FIELDS
from .dedup import first_by_key, near_dup_greedy


class Planner(Protocol):
    def plan(self, spec: dict, candidate_ids: list[str], memory: dict | None) -> list[dict]: ...


class Realizer(Protocol):
    def realize(self, blueprints: list[dict]) -> list[dict]: ...


class Summarizer(Protocol):
    def update(self, memory: dict | None, blueprints: list[dict]) -> dict: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


def align_first_by_id(items: DataFrame, expected: DataFrame, id_column: str = "candidate_id") -> DataFrame:
    """The first item of each expected id, with ord from `expected`; other ids and later items drop out."""
    first = first_by_key(items, [id_column]).drop("ord")
    return first.join(expected.select(id_column, "ord"), id_column)


def with_key(blueprints: DataFrame) -> DataFrame:
    """Adds content_key, the SHA-256 of the canonical JSON of the ten content fields."""
    return blueprints.withColumn("content_key", F.sha2(blueprint_json(BLUEPRINT_FIELDS), 256))


def deduplicate_blueprints(blueprints: DataFrame, embedder: Embedder | None, tolerance: float = 0.95) -> DataFrame:
    """Exact duplicates by content key go, then near-duplicates of their embedded texts; fewer than two need no embedding."""
    kept = first_by_key(with_key(blueprints), ["content_key"]).drop("content_key")
    if embedder is None or kept.count() < 2:
        return kept
    text = F.concat_ws(" | ", *[F.concat(F.lit(f"{f}: "), F.col(f)) for f in BLUEPRINT_FIELDS])

    def embed(batches):
        for pdf in batches:
            yield pdf.assign(vector=embedder.embed(list(pdf["text"])))[["id", "vector"]]

    vectors = kept.select(F.col("ord").alias("id"), text.alias("text")).mapInPandas(embed, "id long, vector array<double>")
    alive = near_dup_greedy(vectors, tolerance).select(F.col("id").alias("ord"))
    return kept.join(alive, "ord", "left_semi")


def assemble(realized: DataFrame, blueprints: DataFrame, run_id: str) -> DataFrame:
    """Query rows in order of the realized queries. A realized query without a blueprint is an error.

    Numbers follow ord over all rows, which must fit one sort: these are the queries of one generation run."""
    orphans = realized.join(blueprints, "candidate_id", "left_anti").select("candidate_id").limit(5).collect()
    if orphans:
        raise KeyError(f"no blueprint for {[r.candidate_id for r in orphans]}")
    joined = realized.select("candidate_id", "query", "ord").join(blueprints.drop("ord"), "candidate_id")
    number = F.row_number().over(Window.orderBy("ord"))
    return joined.withColumn("query_id", F.concat(F.lit(f"{run_id}_q"), number.cast("string"))).select(*QUERY_ROW_FIELDS)
