"""Evaluation frames derived from the driver's tables, each with an explicit, total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def retrieval_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several annotators' retrieval labels, from lineitem."""
    order = ["l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("record_uuid"),
        F.concat(F.lit("c"), "l_linenumber").alias("chunk_id"),
        F.col("l_linenumber").cast("int").alias("chunk_rank"),
        F.concat(F.lit("s"), "l_suppkey").alias("annotator_id"),
        F.concat(F.lit("q"), "l_orderkey").alias("query"),
        F.concat(F.lit("p"), "l_partkey").alias("chunk"),
        F.col("l_returnflag").isin("R", "A").cast("int").alias("topically_relevant"),
        (F.col("l_linestatus") == "F").cast("int").alias("evidence_sufficient"),
        (F.col("l_discount") >= 0.05).cast("int").alias("misleading"),
        F.col("l_shipdate").alias("created_at"),
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long").alias("ord"),
    )


def grounding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("record_uuid"),
        F.concat(F.lit("a"), "o_orderkey").alias("answer"),
        F.concat(F.lit("ctx"), "o_custkey").alias("context_set"),
        (F.col("o_orderstatus") == "F").cast("int").alias("support_present"),
        (F.col("o_totalprice") > 200000).cast("int").alias("unsupported_claim_present"),
        F.col("o_orderpriority").like("1-%").cast("int").alias("contradicted_claim_present"),
        (F.col("o_custkey") % 3 != 0).cast("int").alias("source_cited"),
        (F.col("o_orderkey") % 7 == 0).cast("int").alias("fabricated_source"),
        F.col("o_orderkey").alias("ord"),
    )


def generation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return joined.select(
        F.col("doc_id").cast("string").alias("record_uuid"),
        F.concat_ws(":", "lang", "source").alias("query"),
        F.col("text").alias("answer"),
        F.col("quality").cast("int").alias("proper_action"),
        (F.col("n_chars") > 1000).cast("int").alias("response_on_topic"),
        F.col("quality").cast("int").alias("helpful"),
        (1 - F.col("quality")).cast("int").alias("incomplete"),
        F.col("toxic").cast("int").alias("unsafe_content"),
        F.col("doc_id").alias("ord"),
    )


def iaa_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("a"), (F.col("user_id") % 20).cast("string")).alias("annotator_id"),
        F.get_json_object("props", "$.k").cast("int").alias("item"),
        F.col("ts").alias("created_at"),
        (F.col("event_id") % 10 != 0).alias("calibration"),
        F.when(F.col("event_type") == "error", "discarded").otherwise("submitted").alias("response_status"),
        F.col("event_type").isin("click", "purchase").cast("int").alias("label_1"),
        (F.col("value") > 100).cast("int").alias("label_2"),
        (F.col("event_id") % 2 == 1).cast("int").alias("label_3"),
        F.struct("ts", "event_id").alias("ord"),
    )


def snapshot_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each response of a live record, from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    k = li.groupBy("l_orderkey").agg(F.count_distinct("l_linenumber").cast("int").alias("k"))
    known = F.when(F.col("l_orderkey") % 5 == 0, 0).when(F.col("l_orderkey") % 11 == 0, F.col("k") + 1).otherwise(F.col("k"))
    calibration = F.col("l_orderkey") % 10 == 0
    return li.join(k, "l_orderkey").select(
        F.col("l_orderkey").cast("string").alias("record_uuid"),
        F.col("l_linenumber").cast("string").alias("chunk_id"),
        F.col("l_suppkey").cast("string").alias("user_id"),
        F.when(F.col("l_returnflag") == "A", "submitted").when(F.col("l_returnflag") == "R", "discarded").otherwise("draft").alias("status"),
        F.concat(F.lit("ws"), (F.col("l_orderkey") % 3).cast("string")).alias("workspace"),
        F.when(calibration, "retrieval_calibration").otherwise("retrieval_production").alias("dataset"),
        F.when(calibration, 3).otherwise(1).alias("min_submitted"),
        known.alias("n_retrieved_chunks"),
        F.col("l_discount"),
        F.col("l_linestatus"),
        F.col("l_tax"),
    )


def query_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import records: a user turn, the assistant's next turn, and three documents as chunks."""
    c = table(spark, sf_dir, "conversations")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.agg(F.count("*").alias("n_documents"))
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = user.join(reply, ["conv_id", "turn"]).join(F.broadcast(n))
    each = pairs.select("conv_id", "turn", "query", "answer", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i"), "n_documents")
    each = each.withColumn("doc_id", (F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("i")) % F.col("n_documents"))
    chunk = F.struct(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), (F.col("i") + 1).alias("chunk_rank"), "text")
    out = each.join(docs, "doc_id").groupBy("conv_id", "turn", "query", "answer").agg(F.array_sort(F.collect_list(F.struct("i", chunk.alias("c")))).alias("cs"))
    return out.select(
        "conv_id", "turn", "query", "answer", F.concat(F.lit("ctx"), "conv_id").alias("context_set"), F.lit(None).cast("string").alias("language"), F.transform("cs", lambda x: x["c"]).alias("chunks"), F.struct("conv_id", "turn").alias("ord")
    )


def bad_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """generation_labels with broken rows."""
    g = generation_labels(spark, sf_dir)
    quality = F.when(F.col("ord") % 17 == 0, 2).when(F.col("ord") % 19 == 0, None).otherwise(F.col("proper_action"))
    return g.withColumns({"answer": F.when(F.col("ord") % 13 == 0, " ").otherwise(F.col("answer")), "proper_action": quality, "helpful": quality, "incomplete": 1 - quality})
