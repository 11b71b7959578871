"""Helpers that all operators share: the shared folder, staged tables, Arrow row streams."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sharing import shared_folder

#: Words: everything between ASCII white space.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
WORD = re.compile(WORD_PATTERN)
#: Rows and bytes of an Arrow batch. Texts can be long, so bytes are what bounds a worker; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Session settings that bound the memory of a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/attestry/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **write: str) -> DataFrame:
    """Write a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**{"compression": "zstd"} | write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing lazy reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a schema string; needs the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def stream(df: DataFrame, each: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow over column lists. `each` runs once in a task and returns the function of a batch. If that function has `last`, this
    gives the rows after all batches; if it has `end`, that is called when the task's rows are over or the task ends otherwise, so that a
    reused worker keeps nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = each()
        try:
            for batch in batches:
                out = f({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in kinds], schema=kinds)
            if hasattr(f, "last"):
                out = f.last()
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in kinds], schema=kinds)
        finally:
            getattr(f, "end", int)()
            pa.default_memory_pool().release_unused()

    kinds = arrow_schema(schema)
    return df.mapInArrow(run, schema)


def bucketed(df: DataFrame, key: str, name: str, dealt: bool = False) -> DataFrame:
    """A staged table dealt by `key` (hash) into as many buckets as there are shuffle partitions: later joins and groups by that
    key alone move the other side, not these rows. dealt: rows lie by the key already, so they aren't moved to be written."""
    spark, path, table = df.sparkSession, new_path(df.sparkSession, name), f"attestry_{uuid.uuid4().hex}"
    n = partitions(spark)
    (df if dealt else df.repartition(n, key)).write.bucketBy(n, key).format("parquet").options(compression="zstd", path=path).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolves it, so that the catalog's entry can go; the files stay
    spark.sql(f"DROP TABLE {table}")
    out.staged_at = path
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[x for x in df.columns if x in names])


def chunks(items: Iterable, size: int) -> Iterator[list]:
    block: list = []
    for x in items:
        block.append(x)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def public_tokenizer(name: str) -> str:
    """Path of a public tokenizer file; the folder can be set by PUBLIC_TOKENIZERS."""
    if folder := os.environ.get("PUBLIC_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
