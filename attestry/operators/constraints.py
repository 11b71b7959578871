"""Logical constraints between labels, as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WARN, BLOCK = "warn", "block"


@dataclass(frozen=True)
class Rule:
    """If `when` has the value, `then` must have its value."""

    task: str
    constraint_id: str
    when: str
    when_value: bool
    then: str
    then_value: bool

    @property
    def text(self) -> str:
        return f"{self.task}: {self.when}={self.when_value} but {self.then}={not self.then_value}"

    def violated(self) -> Column:
        """Never null: a null antecedent doesn't apply, a null consequent violates."""
        return F.coalesce(F.col(self.when).cast("boolean") == self.when_value, F.lit(False)) & ~F.coalesce(F.col(self.then).cast("boolean") == self.then_value, F.lit(False))


RULES = (
    Rule("retrieval", "evidence_requires_relevance", "evidence_sufficient", True, "topically_relevant", True),
    Rule("retrieval", "evidence_excludes_misleading", "evidence_sufficient", True, "misleading", False),
    Rule("grounding", "contradiction_requires_unsupported", "contradicted_claim_present", True, "unsupported_claim_present", True),
    Rule("grounding", "fabricated_requires_cited", "fabricated_source", True, "source_cited", True),
)


def rules_of(task: str, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    ids = [r.constraint_id for r in rules]
    if twice := sorted({x for x in ids if ids.count(x) > 1}):
        raise ValueError(f"constraint ids repeat: {twice}")
    return [r for r in rules if r.task == task]


def with_violations(df: DataFrame, task: str, submitted_only: bool = False, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds constraint_violated and constraint_details (texts joined by `;`); with submitted_only, other rows violate nothing."""
    mine = rules_of(task, rules)
    guard = F.coalesce(F.col("response_status") == "submitted", F.lit(False)) if submitted_only else F.lit(True)
    details = F.concat_ws(";", *[F.when(guard & r.violated(), F.lit(r.text)) for r in mine]) if mine else F.lit("")
    return df.withColumn("constraint_details", details).withColumn("constraint_violated", F.col("constraint_details") != "")


def violation_counts(df: DataFrame, task: str, submitted_only: bool = False, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """constraint_id, n of the constraints that occur, from one pass that counts all of them."""
    mine = rules_of(task, rules)
    if not mine:
        return df.sparkSession.createDataFrame([], "constraint_id string, n long")
    guard = F.coalesce(F.col("response_status") == "submitted", F.lit(False)) if submitted_only else F.lit(True)
    sums = df.agg(*[F.count_if(guard & r.violated()).alias(r.constraint_id) for r in mine])
    each = F.array(*[F.struct(F.lit(r.constraint_id).alias("constraint_id"), F.col(r.constraint_id).alias("n")) for r in mine])
    return sums.select(F.explode(each).alias("x")).select("x.*").where("n > 0")
