"""Writers that show a file whole or not at all."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalars import csv_cell


def atomic_text(path: str | os.PathLike, text: str) -> None:
    """Under another name first, then renamed."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    other = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    try:
        other.write_text(text, encoding="utf-8")
        other.replace(path)
    finally:
        other.unlink(missing_ok=True)


def atomic_json(path: str | os.PathLike, value: Any) -> None:
    atomic_text(path, json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n")


def hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_csv(df: DataFrame, path: str, header_when_empty: bool = True) -> bool:
    """One CSV file in column order: nulls empty, booleans lower-case. Without rows: a header alone, or no file.

    Rows keep the frame's order if it is sorted. For large tables use write_table; one file is one task's work."""
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    cells = df.select(*[csv_cell(c, kinds[c]).alias(c) for c in df.columns])
    staging = f"{path}.{uuid.uuid4().hex}.staging"
    target, store = hadoop(spark, path)
    folder, _ = hadoop(spark, staging)
    try:
        cells.coalesce(1).write.options(header=True, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(staging)
        parts = [s.getPath() for s in store.listStatus(folder) if s.getPath().getName().startswith("part-")]
        text = next((p for p in parts), None)
        if text is None or store.getFileStatus(text).getLen() == 0:
            if not header_when_empty:
                return False
            out = store.create(target, True)
            out.write(bytearray((",".join(df.columns) + "\n").encode()))
            out.close()
            return True
        if not header_when_empty and df.isEmpty():
            return False
        store.mkdirs(target.getParent())
        store.delete(target, False)
        if not store.rename(text, target):
            raise OSError(f"cannot rename to {path}")
        return True
    finally:
        store.delete(folder, True)


def commit_all(jobs: dict[str, Any]) -> None:
    """Run the writers by path; if one fails, what the others wrote goes again."""
    done: list[tuple[SparkSession, str]] = []
    try:
        for path, (df, options) in jobs.items():
            if write_csv(df, path, **options):
                done.append((df.sparkSession, path))
    except Exception:
        for spark, path in done:
            p, store = hadoop(spark, path)
            store.delete(p, False)
        raise


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet, replaced as a whole; the way for large tables."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def replace_table(spark: SparkSession, staging: str, path: str) -> None:
    """Put a whole new table in place of an old one, which goes last: after a crash between, settle() finds one of them."""
    (new, store), (target, _), (old, _) = hadoop(spark, staging), hadoop(spark, path), hadoop(spark, f"{path}.old")
    store.delete(old, True)
    if store.exists(target) and not store.rename(target, old):
        raise OSError(f"cannot move {path}")
    if not store.rename(new, target):
        raise OSError(f"cannot rename to {path}")
    store.delete(old, True)


def settle(spark: SparkSession, path: str) -> bool:
    """Whether there is a table; one that a crash left under its old name comes back."""
    (target, store), (old, _) = hadoop(spark, path), hadoop(spark, f"{path}.old")
    if not store.exists(target) and store.exists(old):
        store.rename(old, target)
    return store.exists(target)


def upsert_records(df: DataFrame, path: str, key: str = "record_id") -> None:
    """A table of records by id: rows of df replace those with the same id. The new table is whole before the old one goes."""
    spark, new = df.sparkSession, df
    if settle(spark, path):
        old = spark.read.parquet(path)
        new = old.join(df.select(key), key, "left_anti").unionByName(df, allowMissingColumns=True)
    staging = f"{path}.{uuid.uuid4().hex}.staging"
    new.write.parquet(staging)
    replace_table(spark, staging, path)
