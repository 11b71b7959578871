"""Contracts as data: every rule is counted in one pass, and an error names all that failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import non_blank, strip
from ..schemas import LABEL_COLUMNS, TEXT_COLUMNS, UNIT_KEYS


class ContractError(ValueError):
    """Rows or columns break the contract; `failures` maps a rule to the number of rows."""

    def __init__(self, message: str, failures: dict[str, int] | None = None) -> None:
        super().__init__(message)
        self.failures = failures or {}


def required_columns(task: str, mode: str) -> list[str]:
    out = [*TEXT_COLUMNS[task]]
    if mode in ("train", "score"):
        out += LABEL_COLUMNS[task]
    if mode == "score":
        out = [*UNIT_KEYS[task], *(["chunk_rank"] if task == "retrieval" else []), *out]
    return out


def rules(df: DataFrame, task: str, mode: str) -> dict[str, Column]:
    """name -> true where a row breaks it. Columns that are absent have no rule here."""
    kinds, out = dict(df.dtypes), {}
    for c in (x for x in required_columns(task, mode) if x in kinds):
        if c in LABEL_COLUMNS[task]:
            out[f"{c}: null"] = F.col(c).isNull()
            out[f"{c}: not 0 or 1"] = ~_binary(c, kinds[c])
        elif c == "chunk_rank":
            number = F.col(c).try_cast("int") if kinds[c] == "string" else F.col(c)
            out[f"{c}: not a rank"] = ~F.coalesce(number >= 1, F.lit(False))
        else:
            out[f"{c}: null"] = F.col(c).isNull()
            out[f"{c}: blank"] = F.col(c).isNotNull() & ~non_blank(F.col(c).cast("string"))
    return out


def _binary(c: str, kind: str) -> Column:
    if kind == "boolean":
        return F.lit(True)
    value = F.lower(strip(c)) if kind == "string" else F.col(c)
    good = value.isin("0", "1", "true", "false", "0.0", "1.0") if kind == "string" else value.isin(0, 1)
    return F.coalesce(good, F.lit(True))


def error_counts(df: DataFrame, task: str, mode: str = "score") -> DataFrame:
    """rule, n of the rules that rows break."""
    found = rules(df, task, mode)
    if not found:
        return df.sparkSession.createDataFrame([], "rule string, n long")
    sums = df.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(found.values())])
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n")) for i, name in enumerate(found)])
    return sums.select(F.explode(each).alias("x")).select("x.*").where("n > 0")


def validate(df: DataFrame, task: str, mode: str = "score") -> DataFrame:
    """df with labels and ranks as integers, or a ContractError that lists every broken rule. Extra columns stay.

    The frame must have rows. Predict mode refuses label columns and any `label_...` column."""
    missing = [c for c in required_columns(task, mode) if c not in df.columns]
    problems = [f"missing column {c}" for c in missing]
    if mode == "predict":
        problems += [f"label column {c} is not allowed" for c in df.columns if c in LABEL_COLUMNS[task] or c.startswith("label_")]
    found = rules(df, task, mode)
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(f"r{i}") for i, c in enumerate(found.values())]).first()
    failures = {name: counts[f"r{i}"] for i, name in enumerate(found) if counts[f"r{i}"]}
    if not counts["rows"]:
        problems.append("no rows")
    problems += [f"{name} ({n} rows)" for name, n in failures.items()]
    if problems:
        raise ContractError(f"{task} {mode} input: " + "; ".join(problems), failures)
    kinds = dict(df.dtypes)
    numbers = {c: _number(c, kinds[c]) for c in (*LABEL_COLUMNS[task], "chunk_rank") if c in kinds and mode != "predict" and c in required_columns(task, mode)}
    return df.withColumns(numbers)


def _number(c: str, kind: str) -> Column:
    if kind == "string":
        return F.when(F.lower(strip(c)).isin("true", "1", "1.0"), 1).when(F.lower(strip(c)).isin("false", "0", "0.0"), 0).otherwise(F.col(c).try_cast("int"))
    return F.col(c).cast("int")


def duplicate_units(df: DataFrame, task: str) -> DataFrame:
    """keys, n_rows: how many rows share their unit with another, for each key that must be unique."""
    keys = [UNIT_KEYS[task]] + ([("record_uuid", "chunk_rank")] if task == "retrieval" else [])
    parts = []
    for k in keys:
        groups = df.groupBy(*k).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        parts.append(groups.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows")).select(F.lit(",".join(k)).alias("keys"), "n_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def guard_unique_units(df: DataFrame, task: str) -> DataFrame:
    """df, or a ContractError that counts all rows of units that come more than once."""
    bad = {r["keys"]: r["n_rows"] for r in duplicate_units(df, task).where("n_rows > 0").collect()}
    if bad:
        raise ContractError("; ".join(f"{n} rows repeat {k}" for k, n in bad.items()), bad)
    return df


def import_errors() -> Column:
    """An array of what is wrong with an import record; empty if nothing."""
    ids = F.transform("chunks", lambda c: c["chunk_id"])
    n = F.coalesce(F.size("chunks"), F.lit(0))
    bad = lambda f: F.coalesce(F.exists("chunks", f), F.lit(False))
    checks = [
        *[(~non_blank(c), f"{c} is blank") for c in ("query", "answer", "context_set")],
        (n < 1, "chunks is empty"),
        (F.coalesce(F.size(F.array_distinct(ids)) != F.size("chunks"), F.lit(False)), "chunk_id repeats"),
        (bad(lambda c: ~non_blank(c["chunk_id"])), "chunk_id is blank"),
        (bad(lambda c: ~non_blank(c["text"])), "chunk text is blank"),
        (bad(lambda c: ~F.coalesce(c["chunk_rank"] >= 1, F.lit(False))), "chunk_rank is not a rank"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks]))


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, trimmed; and (ord, errors) of the others."""
    marked = records.withColumn("errors", import_errors())
    trimmed = {c: strip(c) for c in ("query", "answer", "context_set")}
    chunks = F.transform("chunks", lambda c: F.struct(strip(c["chunk_id"]).alias("chunk_id"), strip(c["doc_id"]).alias("doc_id"), c["chunk_rank"].alias("chunk_rank"), strip(c["text"]).alias("text")))
    good = marked.where(F.size("errors") == 0).drop("errors").withColumns(trimmed | {"chunks": chunks})
    return good, marked.where(F.size("errors") > 0).select("ord", "errors")
