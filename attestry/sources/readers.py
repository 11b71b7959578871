"""Import records from JSON, JSONL, CSV, Parquet, ORC, pandas, datasets and lists; typed CSV tables."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CHUNK, IMPORT_RECORD

_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
_CHUNK_COLUMNS = ("chunk_text", "chunk_id", "doc_id", "chunk_rank")


class SourceError(ValueError):
    """A source's content isn't what its format promises."""


def with_order(df: DataFrame) -> DataFrame:
    """Adds `ord`, ascending in the order of a table's rows as Spark has them."""
    return df.withColumn("ord", F.monotonically_increasing_id())


def in_file_order(df: DataFrame) -> DataFrame:
    """Adds `ord` from 0, in order of the files' names and of the rows in each. df: straight from a reader of files.

    Spark packs the splits of several files by falling size, so where there are several the splits are counted first: a split's
    rows follow those of all splits before it. The counts are one row for each split."""
    if len(df.inputFiles()) < 2:
        return with_order(df)
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")).withColumn("__row", F.monotonically_increasing_id())
    splits = placed.groupBy("__file", "__start").agg(F.min("__row").alias("first"), F.count("*").alias("n")).collect()
    at, rows = 0, []
    for r in sorted(splits, key=lambda r: (r["__file"], r["__start"])):
        rows.append((r["__file"], r["__start"], at - r.first))
        at += r.n
    shift = df.sparkSession.createDataFrame(rows, "__file string, __start long, __shift long")
    return placed.join(shift, ["__file", "__start"]).select(*df.columns, (F.col("__row") + F.col("__shift")).alias("ord"))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files whose root is an array; another root is an error. A file is one row: JSON Lines is the form for large data."""
    text = in_file_order(spark.read.text(path, wholetext=True))
    bad = text.where(~F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("[")).count()
    if bad:
        raise SourceError(f"{path}: the root must be an array")
    parsed = text.select(F.from_json("value", T.ArrayType(IMPORT_RECORD)).alias("rows"), "ord")
    if parsed.where(F.col("rows").isNull()).count():
        raise SourceError(f"{path}: not valid JSON")
    return parsed.select(F.posexplode("rows").alias("pos", "r"), "ord").select("r.*", (F.shiftleft("ord", 32) + F.col("pos")).cast("long").alias("ord"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One record a line, read in splits; blank lines are skipped; an error names the first bad line, counted from 1 over all files."""
    lines = in_file_order(spark.read.text(path, lineSep="\n")).withColumn("line", F.regexp_replace("value", "\r$", ""))
    lines = lines.where(F.length(F.regexp_replace("line", r"(?U)\s+", "")) > 0)
    kind = F.expr("schema_of_variant(try_parse_json(line))")
    bad = lines.where(F.coalesce(~kind.startswith("OBJECT"), F.lit(True))).agg(F.min("ord").alias("p")).first().p
    if bad is not None:
        raise SourceError(f"{path}: line {bad + 1} is not a JSON object")
    return lines.select(F.from_json("line", IMPORT_RECORD).alias("r"), "ord").select("r.*", "ord")


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a JSON `chunks` column, or with one row for each chunk; no rows give no records; other columns are an error."""
    df = in_file_order(spark.read.options(**_CSV).csv(path))
    names = set(df.columns)
    if "chunks" in names:
        return _chunks_column(df, path)
    if names.issuperset(_CHUNK_COLUMNS):
        return nest_chunks(df)
    if df.isEmpty():
        return spark.createDataFrame([], T.StructType([*IMPORT_RECORD.fields, T.StructField("ord", T.LongType())]))
    raise SourceError(f"{path}: a `chunks` column or {', '.join(_CHUNK_COLUMNS)} are needed")


def _chunks_column(df: DataFrame, path: str) -> DataFrame:
    array = F.expr("schema_of_variant(try_parse_json(chunks))").startswith("ARRAY")
    bad = df.where(F.coalesce(~array, F.lit(True))).agg(F.min("ord").alias("o")).first().o
    if bad is not None:
        row = df.where(F.col("ord") <= bad).count()
        raise SourceError(f"{path}: chunks of row {row} is not a JSON array")
    text = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.select(*[text(c).alias(c) for c in ("query", "answer", "context_set", "language")], F.from_json("chunks", T.ArrayType(CHUNK)).alias("chunks"), "ord")


def nest_chunks(df: DataFrame) -> DataFrame:
    """Rows of chunks become records, at the place of their first row, with chunks in row order.

    Rows belong together by record_id, or else group, or else query, answer and context_set. Texts come from the first row."""
    key = next(([k] for k in ("record_id", "group") if k in df.columns), ["query", "answer", "context_set"])
    scalars = [c if c in df.columns else None for c in ("query", "answer", "context_set", "language")]
    first = F.struct(*[(F.col(c) if c else F.lit(None).cast("string")).alias(n) for c, n in zip(scalars, ("query", "answer", "context_set", "language"), strict=True)])
    chunk = F.struct("chunk_id", "doc_id", F.col("chunk_rank").cast("int").alias("chunk_rank"), F.col("chunk_text").alias("text"))
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]
    out = df.groupBy(*keys).agg(F.min_by(first, "ord").alias("f"), F.array_sort(F.collect_list(F.struct("ord", chunk.alias("c")))).alias("cs"), F.min("ord").alias("ord"))
    return out.select("f.*", F.transform("cs", lambda x: x["c"]).alias("chunks"), "ord")


def read_records(spark: SparkSession, source: Any, format: str = "auto") -> DataFrame:  # noqa: A002
    """Import records with `ord` from a path, a Spark or pandas DataFrame, a dataset with to_list, or a list of dicts."""
    if isinstance(source, DataFrame):
        return source if "ord" in source.columns else with_order(source)
    if hasattr(source, "to_list") and not hasattr(source, "iloc"):
        source = source.to_list()
    elif hasattr(source, "iloc"):
        source = [{str(k): v for k, v in r.items()} for r in source.to_dict("records")]
    if isinstance(source, (list, tuple)):
        rows = [json.dumps(r, ensure_ascii=False, default=lambda x: x.tolist() if hasattr(x, "tolist") else str(x)) for r in source]
        df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "ord long, value string")
        return df.select(F.from_json("value", IMPORT_RECORD).alias("r"), "ord").select("r.*", "ord")
    if not isinstance(source, (str, os.PathLike)):
        raise TypeError(f"cannot read records from {type(source).__name__}")
    path = os.fspath(source)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        raise FileNotFoundError(path)
    kind = os.path.splitext(path)[1].lower().lstrip(".") if format == "auto" else format
    readers = {"json": read_json_array, "jsonl": read_jsonl, "ndjson": read_jsonl, "csv": read_csv_records, "parquet": lambda s, p: in_file_order(s.read.parquet(p)), "orc": lambda s, p: in_file_order(s.read.orc(p))}
    if kind not in readers:
        raise SourceError(f"unknown format {kind!r}; known: {', '.join(readers)}")
    return readers[kind](spark, path)


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with exactly the schema's columns, in any order; empty cells are null where that is allowed. `ord` follows the file.

    Cells are read as text and cast, so `NA` and digits stay text; a cell that can't be cast is an error when it is read."""
    raw = spark.read.options(**_CSV, inferSchema=False).csv(path)
    names = {f.name for f in schema.fields}
    if extra := sorted(set(raw.columns) - names):
        raise SourceError(f"{path}: unknown columns {extra}")
    if missing := [f.name for f in schema.fields if f.name not in raw.columns and not f.nullable]:
        raise SourceError(f"{path}: missing columns {missing}")
    cells = []
    for f in schema.fields:
        value = F.col(f.name) if f.name in raw.columns else F.lit(None).cast("string")
        value = F.nullif(value, F.lit("")) if f.nullable or not isinstance(f.dataType, T.StringType) else F.coalesce(value, F.lit(""))
        cells.append(value.cast(f.dataType).alias(f.name))
    return in_file_order(raw).select(*cells, "ord")


def read_eval_csv(spark: SparkSession, path: str) -> DataFrame:
    """Any CSV with all columns as text, and `ord`."""
    return in_file_order(spark.read.options(**_CSV, inferSchema=False).csv(path))
