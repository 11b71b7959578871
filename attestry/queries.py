"""The queries of the engine's own operators, by name, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions.stats import z_value
from .operators import agreement, completeness, constraints, dedup, frames, metrics, partition, querygen, validate
from .operators.consolidate import consolidate
from .operators.validate import split_valid
from .schemas import BLUEPRINT_FIELDS
from .sources.readers import nest_chunks

Z = repr(z_value(0.05))
LABELS = ("topically_relevant", "evidence_sufficient", "misleading")
FRACTIONS = {"retrieval": 0.1, "grounding": 0.2, "generation": 0.3}
SEED = 42


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Scoring


def consolidate_majority(spark: SparkSession, sf: str) -> DataFrame:
    out = consolidate(fx.retrieval_labels(spark, sf), "retrieval")
    return out.select("record_uuid", "chunk_id", "chunk_rank", "annotator_id", "chunk", *LABELS, "ord")


def _per_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.retrieval_labels(spark, sf).repartition("record_uuid")
    return metrics.retrieval_per_query(consolidate(rows, "retrieval"))


def retrieval_per_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_per_query(spark, sf))


def retrieval_corpus_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.retrieval_corpus(_per_query(spark, sf)))


def grounding_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.grounding_scores(consolidate(fx.grounding_labels(spark, sf), "grounding")))


def conditional_fabrication(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.conditional_fabrication(fx.grounding_labels(spark, sf)))


def generation_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.generation_scores(consolidate(fx.generation_labels(spark, sf), "generation")))


def bootstrap_ci_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    from .plans.score import bootstrap_means

    return bootstrap_means(_per_query(spark, sf).withColumn("ord", F.col("record_uuid").cast("long")), list(metrics.RETRIEVAL_METRICS), n_resamples=200, alpha=0.05, seed=SEED)


# Agreement


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.long_form(agreement.filtered(fx.iaa_rows(spark, sf)), ["label_1", "label_2", "label_3"])


def iaa_filtered(spark: SparkSession, sf: str) -> DataFrame:
    rows = agreement.filtered(fx.iaa_rows(spark, sf), exclude=["a3", "a7"], after="2024-01-02", before="2024-01-20")
    return rows.groupBy("annotator_id").agg(F.count("*").alias("n"), F.min("item").alias("first_item"), F.sum("label_1").alias("ones"))


def krippendorff_alpha(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agreement.krippendorff(agreement.item_counts(_long(spark, sf))))


def krippendorff_nominal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agreement.krippendorff_nominal(_long(spark, sf)))


def pct_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agreement.percentage_agreement(agreement.item_counts(_long(spark, sf))))


def cohen_kappa_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agreement.cohen_kappa(_long(spark, sf)))


# Constraints and panels


def constraint_violations(spark: SparkSession, sf: str) -> DataFrame:
    r = constraints.with_violations(fx.retrieval_labels(spark, sf), "retrieval").select(F.concat_ws("/", "record_uuid", "ord").alias("unit"), "constraint_violated", "constraint_details")
    g = constraints.with_violations(fx.grounding_labels(spark, sf), "grounding").select(F.col("record_uuid").alias("unit"), "constraint_violated", "constraint_details")
    return r.unionAll(g)


def constraint_summary(spark: SparkSession, sf: str) -> DataFrame:
    return constraints.violation_counts(fx.retrieval_labels(spark, sf), "retrieval").unionAll(constraints.violation_counts(fx.grounding_labels(spark, sf), "grounding"))


def _panels(spark: SparkSession, sf: str) -> DataFrame:
    return completeness.panel_completeness(completeness.records_of(fx.snapshot_responses(spark, sf)))


def panel_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return _panels(spark, sf)


def completeness_by_k(spark: SparkSession, sf: str) -> DataFrame:
    return completeness.completeness_by_k(_panels(spark, sf))


def completeness_by_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return completeness.completeness_by_bucket(_panels(spark, sf))


def completeness_summary(spark: SparkSession, sf: str) -> DataFrame:
    records = completeness.records_of(fx.snapshot_responses(spark, sf))
    return rounded(completeness.completeness_summary(completeness.panel_completeness(records), records))


def panel_status_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return completeness.panel_status(completeness.records_of(fx.snapshot_responses(spark, sf)))


def status_totals(spark: SparkSession, sf: str) -> DataFrame:
    records = completeness.records_of(fx.snapshot_responses(spark, sf))
    return completeness.status_totals(completeness.panel_status(records), records)


def progress_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Datasets of three tasks; an order's status is the record's progress."""
    o = fx.table(spark, sf, "orders")
    task = F.element_at(F.array(F.lit("retrieval"), F.lit("grounding"), F.lit("generation")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    kind = F.when(F.col("o_orderkey") % 10 == 0, "calibration").otherwise("production")
    rows = o.select(F.concat(F.lit("ws"), (F.col("o_custkey") % 4).cast("string")).alias("workspace"), F.concat_ws("_", task, kind).alias("dataset"), task.alias("task"), (F.col("o_orderstatus") == "F").alias("done"))
    datasets = rows.groupBy("workspace", "dataset", "task").agg(F.count("*").alias("total"), F.count_if("done").alias("completed"), F.count_if(~F.col("done")).alias("pending"))
    return completeness.task_progress(datasets)


def tag_actions(spark: SparkSession, sf: str) -> DataFrame:
    records = completeness.records_of(fx.snapshot_responses(spark, sf))
    tags = F.when(F.col("record_uuid").cast("long") % 4 == 0, F.array(F.lit(" True "))).when(F.col("record_uuid").cast("long") % 4 == 1, F.array(F.lit("false")))
    out = completeness.tag_actions(records.withColumn("tags", tags))
    return out.select("workspace", "dataset", "record_uuid", "chunk_id", "action")


def export_rows_with_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Responses pivoted to rows, with users, constraints and panels, through nested records."""
    from .operators import responses

    s = fx.snapshot_responses(spark, sf).groupBy("workspace", "dataset", "record_uuid", "chunk_id", "user_id").agg(F.max("status").alias("status"), F.max("l_discount").alias("d"), F.max("l_linestatus").alias("ls"), F.max("l_tax").alias("t"), F.max("n_retrieved_chunks").alias("k"), F.max("min_submitted").alias("min_submitted"))
    yes = lambda c: F.when(c, "yes").otherwise("no")
    answers = F.array(*[F.struct("user_id", F.lit(q).alias("question_name"), v.alias("value"), "status") for q, v in (("topically_relevant", yes(F.col("ls") == "F")), ("evidence_sufficient", yes(F.col("t") > 0.04)), ("misleading", yes(F.col("d") >= 0.05)))])
    nested = s.withColumn("a", answers).groupBy("workspace", "dataset", "record_uuid", "chunk_id").agg(F.flatten(F.array_sort(F.collect_list("a"))).alias("responses"), F.max("k").alias("k"))
    none = F.lit(None)
    meta = F.create_map(F.lit("n_retrieved_chunks"), F.col("k").cast("string"))
    snapshot = nested.select("workspace", "dataset", F.lit("retrieval").alias("task"), F.col("dataset").endswith("calibration").alias("calibration"), "record_uuid", "chunk_id", F.lit("completed").alias("record_status"), none.cast("timestamp").alias("inserted_at"), none.cast("timestamp").alias("updated_at"), F.create_map(F.lit("query"), F.col("record_uuid"), F.lit("chunk"), F.col("chunk_id")).alias("fields"), meta.alias("metadata"), "responses")
    users = fx.table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("username"))
    rows = responses.annotation_rows(snapshot, users, "retrieval", include_discarded=True)
    out = responses.export_rows(rows, "retrieval", _panels(spark, sf))
    return out.select("record_uuid", "chunk_id", "annotator_id", "calibration", "response_status", *[F.col(x).cast("int").alias(x) for x in LABELS], "n_retrieved_chunks", "constraint_violated", "constraint_details", "panel_complete", F.col("n_submitted_chunks").cast("long").alias("n_submitted_chunks"), F.col("n_records_seen").cast("long").alias("n_records_seen"))


# Import


def _imported(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = split_valid(fx.query_pairs(spark, sf))
    return partition.last_by_uuid(partition.with_record_uuid(good))


def record_uuid(spark: SparkSession, sf: str) -> DataFrame:
    return _imported(spark, sf).select("conv_id", "turn", "record_uuid")


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    return partition.assign(partition.units(_imported(spark, sf)), None, SEED, FRACTIONS)


def calibration_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf).select("task", "record_uuid", "chunk_id", "is_calibration")


def partition_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(partition.partition_summary(_assigned(spark, sf), FRACTIONS))


def manifest_lock_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """First import: conversations under the middle id, retrieval only, at another fraction. Second: everything."""
    records = _imported(spark, sf)
    half = fx.table(spark, sf, "conversations").agg(F.max("conv_id").alias("top"))
    early = records.join(F.broadcast(half)).where("conv_id * 2 < top").drop("top")
    first = partition.assign(partition.units(early, ["retrieval"]), None, SEED, {"retrieval": 0.5}, import_id="first")
    second = partition.assign(partition.units(records), first, SEED, FRACTIONS, import_id="second")
    return rounded(second.select("task", "record_uuid", "chunk_id", "is_calibration", "import_id", "calibration_fraction", "is_new"))


def denormalised_to_nested(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.retrieval_labels(spark, sf).select(F.col("record_uuid").alias("record_id"), "query", F.lit("a").alias("answer"), F.lit("x").alias("context_set"), F.lit(None).cast("string").alias("language"), F.col("chunk").alias("chunk_text"), "chunk_id", F.col("annotator_id").alias("doc_id"), "chunk_rank", "ord")
    out = nest_chunks(rows)
    flat = F.array_join(F.transform("chunks", lambda c: F.concat_ws(":", c["chunk_id"], c["doc_id"], c["chunk_rank"].cast("string"), c["text"])), "|")
    return out.select("query", F.size("chunks").cast("long").alias("n_chunks"), flat.alias("chunks"))


def fan_out_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = partition.fan_out(_imported(spark, sf), _assigned(spark, sf), "demo")
    return out.groupBy("dataset").agg(F.count("*").alias("n"), F.min("record_id").alias("first_id"), F.count("metadata.chunk_rank").alias("n_ranks"))


# Dedup and alignment


def exact_dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_key"))
    return dedup.first_by_key(docs, ["content_key"], "doc_id")


def near_dup_greedy(spark: SparkSession, sf: str) -> DataFrame:
    vectors = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return dedup.near_dup_greedy(vectors, 0.3).select("id")


def blueprint_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical JSON keys of blueprints made from events, and the first of each."""
    text = lambda c: F.col(c).cast("string")
    e = fx.table(spark, sf, "events")
    columns = {
        "domain": text("event_type"),
        "role": F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")),
        "language": F.lit("en"),
        "topic": F.when(F.col("user_id") % 3 > 0, F.concat(F.lit('say "'), (F.col("user_id") % 3).cast("string"), F.lit('"'))),
    }
    blueprints = e.select(F.col("event_id").alias("ord"), *[columns.get(c, F.lit(None).cast("string")).alias(c) for c in BLUEPRINT_FIELDS])
    return dedup.first_by_key(querygen.with_key(blueprints), ["content_key"]).select("ord", "content_key")


def import_record_errors(spark: SparkSession, sf: str) -> DataFrame:
    """What validation says of import records with blank texts, repeated chunk ids and ranks below 1."""
    pairs = fx.query_pairs(spark, sf)
    broken = F.transform(
        "chunks",
        lambda c: c.withField("chunk_id", F.when((F.col("conv_id") % 5 == 0) & (c["chunk_rank"] == 3), F.get("chunks", F.lit(0))["chunk_id"]).otherwise(c["chunk_id"])).withField("chunk_rank", F.when(F.col("conv_id") % 7 == 0, 0).otherwise(c["chunk_rank"])),
    )
    rows = pairs.withColumn("chunks", F.when(F.col("conv_id") % 11 == 0, F.array().cast(pairs.schema["chunks"].dataType)).otherwise(broken)).withColumn("query", F.when(F.col("turn") % 4 == 2, F.lit(" \t")).otherwise(F.col("query")))
    _, bad = split_valid(rows)
    return bad.select("ord.conv_id", "ord.turn", F.array_join("errors", "; ").alias("errors"))


def submitted_without_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Submitted generation annotations that lack labels, and which."""
    from .operators import responses

    rows = fx.bad_generation(spark, sf).withColumn("response_status", F.when(F.col("ord") % 2 == 0, "submitted").otherwise("discarded"))
    return responses.missing_labels(rows, "generation").select("record_uuid", F.array_join("missing", ",").alias("missing"))


def align_first_by_id(spark: SparkSession, sf: str) -> DataFrame:
    items = fx.table(spark, sf, "events").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("candidate_id"), F.col("event_id").alias("item"), F.struct("ts", "event_id").alias("ord"))
    expected = fx.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("candidate_id"), F.col("c_custkey").alias("ord"))
    return querygen.align_first_by_id(items, expected)


def assemble_queries(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "nation").select(F.concat(F.lit("c"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("candidate_id"), F.col("n_nationkey").alias("ord"), "n_name", "n_regionkey")
    text = lambda x: F.lit(None).cast("string").alias(x)
    blueprints = c.select("candidate_id", "ord", F.col("n_name").alias("domain"), F.col("n_regionkey").cast("string").alias("role"), *[text(x) for x in ("language", "topic", "intent", "task", "difficulty", "format", "user_scenario", "information_need")])
    realized = c.where("n_nationkey % 3 <> 0").select("candidate_id", F.concat(F.lit("what about "), "n_name").alias("query"), (-F.col("ord")).alias("ord"))
    return querygen.assemble(realized, blueprints, "run").select("query_id", "query", "domain", "role")


def duplicate_unit_guard(spark: SparkSession, sf: str) -> DataFrame:
    return validate.duplicate_units(fx.retrieval_labels(spark, sf), "retrieval")


def validation_error_counts(spark: SparkSession, sf: str) -> DataFrame:
    return validate.error_counts(fx.bad_generation(spark, sf), "generation", "train")


def classifier_frame(spark: SparkSession, sf: str) -> DataFrame:
    out = frames.to_classifier(consolidate(fx.retrieval_labels(spark, sf), "retrieval"), "retrieval")
    return out.groupBy("label_topically_relevant", "label_evidence_sufficient", "label_misleading").agg(F.count("*").alias("n"), F.count_distinct("split_group").alias("n_groups"), F.min("text_pair").alias("first_pair"))


def merged_task_view(spark: SparkSession, sf: str) -> DataFrame:
    out = frames.merged_tasks(fx.retrieval_labels(spark, sf), fx.grounding_labels(spark, sf), fx.generation_labels(spark, sf))
    return out.select("record_uuid", *[F.col(c).cast("int").alias(c) for c in out.columns if c != "record_uuid"])


def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The registered SQL functions, called from SQL."""
    from .functions.scalars import register_sql

    register_sql(spark)
    fx.table(spark, sf, "lineitem").createOrReplaceTempView("__attestry_lineitem")
    return rounded(
        spark.sql(
            """WITH q AS (SELECT l_orderkey, transform(array_sort(collect_list(struct(l_linenumber, l_suppkey, l_partkey, IF(l_linestatus = 'F', 2, IF(l_returnflag = 'R', 1, 0)) AS g))), x -> x.g) AS g,
                                 count_if(l_linestatus = 'F') AS k, count(*) AS n FROM __attestry_lineitem GROUP BY l_orderkey)
               SELECT l_orderkey, ndcg(g) AS ndcg, wilson_low(k, n, 1.96D) AS low, wilson_high(k, n, 1.96D) AS high, calibration_digest('42', 'retrieval', cast(l_orderkey AS STRING)) AS digest FROM q"""
        )
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    skip = {"rounded", "queries", "oracle_sql", "nest_chunks", "split_valid", "consolidate", "z_value"}
    return {k: v for k, v in globals().items() if callable(v) and not k.startswith("_") and k not in skip and getattr(v, "__module__", "") == __name__}


# The same in SQL.

_RET = """ret AS (SELECT CAST(l_orderkey AS VARCHAR) AS record_uuid, 'c' || l_linenumber AS chunk_id, CAST(l_linenumber AS INT) AS chunk_rank, 's' || l_suppkey AS annotator_id, 'q' || l_orderkey AS query, 'p' || l_partkey AS chunk,
  CAST(l_returnflag IN ('R','A') AS INT) AS topically_relevant, CAST(l_linestatus = 'F' AS INT) AS evidence_sufficient, CAST(l_discount >= 0.05 AS INT) AS misleading,
  row_number() OVER (PARTITION BY l_orderkey
          ORDER BY l_linenumber, l_suppkey, l_partkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS ord
          FROM lineitem)"""
_VOTES = ", ".join(f"sum({x}) OVER u AS v_{x}" for x in LABELS)
_MATCH = " AND ".join(f"(2 * v_{x} = n OR {x} = CAST(2 * v_{x} > n AS INT))" for x in LABELS)
_TAKE = ", ".join(f"CASE WHEN 2 * v_{x} <> n THEN CAST(2 * v_{x} > n AS INT) ELSE {x} END AS {x}" for x in LABELS)
_CON = f"""{_RET}, votes AS (SELECT *, count(*) OVER u AS n, min(ord) OVER u AS first_ord, {_VOTES} FROM ret WINDOW u AS (PARTITION BY record_uuid, chunk_id)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY record_uuid, chunk_id ORDER BY CASE WHEN {_MATCH} THEN 0 ELSE 1 END, ord) AS r FROM votes),
 con AS (SELECT record_uuid, chunk_id, chunk_rank, annotator_id, chunk, {_TAKE}, first_ord AS ord FROM ranked WHERE r = 1)"""
_PQ = f"""{_CON}, graded AS (SELECT *, CASE WHEN evidence_sufficient = 1 THEN 2 WHEN topically_relevant = 1 THEN 1 ELSE 0 END AS g FROM con),
 placed AS (SELECT *, row_number() OVER (PARTITION BY record_uuid ORDER BY chunk_rank) AS p, row_number() OVER (PARTITION BY record_uuid
          ORDER BY g DESC) AS i FROM graded),
 pq AS (SELECT record_uuid, avg(topically_relevant) AS topical_precision, CAST(max(evidence_sufficient) AS DOUBLE) AS sufficiency_hit, avg(evidence_sufficient) AS sufficiency_rate, avg(misleading) AS misleading_rate,
   coalesce(1.0 / min(CASE WHEN topically_relevant = 1 THEN p END), 0) AS reciprocal_rank,
          coalesce(sum((pow(2, g) - 1) / log2(p + 1)) / nullif(sum((pow(2, g) - 1) / log2(i + 1)), 0), 0) AS ndcg, count(*) AS n_chunks,
          max(chunk_rank) AS top_rank FROM placed GROUP BY record_uuid)"""
_GRD = """grd AS (SELECT CAST(o_orderkey AS VARCHAR) AS record_uuid, CAST(o_orderstatus = 'F' AS INT) AS support_present, CAST(o_totalprice > 200000 AS INT) AS unsupported_claim_present, CAST(o_orderpriority LIKE '1-%' AS INT) AS contradicted_claim_present,
  CAST(o_custkey % 3 <> 0 AS INT) AS source_cited, CAST(o_orderkey % 7 = 0 AS INT) AS fabricated_source FROM orders)"""
_GEN = """gen AS (SELECT CAST(doc_id AS VARCHAR) AS record_uuid, lang || ':' || source AS query, text AS answer, quality AS proper_action, CAST(n_chars > 1000 AS INT) AS response_on_topic, quality AS helpful, 1 - quality AS incomplete, toxic AS unsafe_content, doc_id
          FROM labels JOIN documents USING (doc_id))"""
_MID = f"(k / n + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n)"
_HALF = f"{Z} / (1 + {Z} * {Z} / n) * sqrt(k / n * (1 - k / n) / n + {Z} * {Z} / (4 * n * n))"


def _rates(source: str, rates: dict[str, str], where: str = "TRUE") -> str:
    each = " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST(count(*) AS DOUBLE) AS n, CAST(sum({c}) AS DOUBLE) AS k FROM {source} WHERE {where}" for m, c in rates.items())
    return f"SELECT metric, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS successes, round(k / n, 6) AS point, round(greatest(0, {_MID} - {_HALF}), 6) AS ci_lower, round(least(1, {_MID} + {_HALF}), 6) AS ci_upper FROM ({each}) WHERE n > 0"


_IAA = """iaa AS (SELECT 'a' || (user_id % 20) AS annotator_id, CAST(json_extract_string(props, '$.k') AS INT) AS item, ts AS created_at, event_id, event_id % 10 <> 0 AS calibration,
          CASE WHEN event_type = 'error' THEN 'discarded' ELSE 'submitted' END AS response_status,
  CAST(event_type IN ('click','purchase') AS INT) AS label_1, CAST(value > 100 AS INT) AS label_2, CAST(event_id % 2 = 1 AS INT) AS label_3
          FROM events),
 kept AS (SELECT * FROM iaa WHERE calibration AND response_status = 'submitted')"""
_LONG = f"""{_IAA}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item, annotator_id ORDER BY created_at DESC, event_id DESC) AS r FROM kept)
          WHERE r = 1),
 long AS ({" UNION ALL ".join(f"SELECT item, annotator_id, 'label_{i}' AS label, label_{i} AS value FROM last WHERE label_{i} IS NOT NULL" for i in (1, 2, 3))}),
 mk AS (SELECT label, item, count(*) AS m, sum(value) AS k FROM long GROUP BY ALL)"""
_ALPHA = f"""WITH {_LONG}, s AS (SELECT label, sum(2.0 * k * (m - k) / (m - 1)) AS o, sum(m) AS n, sum(k) AS ones, count(*) AS n_items FROM mk WHERE m >= 2
          GROUP BY label)
 SELECT label, round(CASE WHEN ones = 0 OR ones = n THEN 1.0 ELSE 1 - (o / n) / (2.0 * ones * (n - ones) / (CAST(n AS DOUBLE) * (n - 1))) END, 6) AS alpha, n_items
          FROM s"""
_SNAP = """kk AS (SELECT l_orderkey AS o, count(DISTINCT l_linenumber) AS k FROM lineitem GROUP BY 1),
 resp AS (SELECT CAST(l_orderkey AS VARCHAR) AS record_uuid, CAST(l_linenumber AS VARCHAR) AS chunk_id, CAST(l_suppkey AS VARCHAR) AS user_id,
          CASE l_returnflag WHEN 'A' THEN 'submitted' WHEN 'R' THEN 'discarded' ELSE 'draft' END AS status, 'ws' || (l_orderkey % 3) AS workspace,
   CASE WHEN l_orderkey % 10 = 0 THEN 'retrieval_calibration' ELSE 'retrieval_production' END AS dataset,
          CASE WHEN l_orderkey % 10 = 0 THEN 3 ELSE 1 END AS min_submitted,
          CASE WHEN l_orderkey % 5 = 0 THEN 0 WHEN l_orderkey % 11 = 0 THEN k + 1 ELSE k END AS n_retrieved_chunks, l_orderkey, l_discount, l_linestatus, l_tax
   FROM lineitem JOIN kk ON o = l_orderkey),
 rec AS (SELECT workspace, dataset, record_uuid, chunk_id, max(n_retrieved_chunks) AS kr, max(min_submitted) AS ms,
          count(*) FILTER (status = 'submitted') AS ns, count(*) FILTER (status = 'discarded') AS nd FROM resp GROUP BY ALL)"""
_PAN = f"""{_SNAP}, pan0 AS (SELECT record_uuid, coalesce(max(kr) FILTER (kr > 0), 0) AS k, count(DISTINCT chunk_id) AS n_seen,
          count(DISTINCT chunk_id) FILTER (ns > 0) AS n_submitted_chunks, count(DISTINCT chunk_id) FILTER (nd > 0) AS n_discarded_chunks,
          count(DISTINCT chunk_id) FILTER (ns > 0 OR nd > 0) AS n_annotated_chunks,
   count(*) AS n_records_seen, count(*) FILTER (kr > 0) AS n_with_k FROM rec GROUP BY 1),
 pan AS (SELECT *, k > 0 AND n_submitted_chunks = k AS panel_complete, (k > 0 AND k <> n_seen) OR (n_with_k > 0 AND n_with_k < n_seen) AS integrity_warning
          FROM pan0)"""
_STAT = f"""{_SNAP}, ch AS (SELECT workspace, record_uuid, chunk_id, sum(ns) AS s, sum(nd) AS d, max(ms) AS need, max(kr) AS kr FROM rec GROUP BY ALL),
 st AS (SELECT workspace, record_uuid, count(*) AS k_records, max(kr) AS k_metadata, count(*) FILTER (s + d > 0) AS n_terminal,
          count(*) FILTER (s > 0) AS n_submitted, bool_and(s >= need) AS overlap_satisfied FROM ch GROUP BY ALL),
 stat AS (SELECT *, n_submitted = k_records AS panel_complete, k_metadata = 0 OR k_metadata = k_records AS integrity_ok FROM st)"""
_BUCKET = "CASE WHEN k < 5 THEN 'k_lt_5' WHEN k = 5 THEN 'k_eq_5' ELSE 'k_gt_5' END"
_STRIP = lambda x: f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_PAIR = f"""nd AS (SELECT count(*) AS n FROM documents),
          pr AS (SELECT u.conv_id, u.turn, {_STRIP('u.text')} AS query, {_STRIP('a.text')} AS answer, 'ctx' || u.conv_id AS context_set
          FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
 ch AS (SELECT conv_id, turn, i, 'd' || ((conv_id * 7 + turn * 3 + i) % n) AS chunk_id FROM pr, nd, (SELECT unnest([0, 1, 2]) AS i)),
 imp0 AS (SELECT conv_id, turn, sha256(query || chr(0) || answer || chr(0) || context_set || chr(0) || string_agg(chunk_id, '|'
          ORDER BY chunk_id)) AS record_uuid FROM pr JOIN ch USING (conv_id, turn) WHERE query <> '' AND answer <> ''
          GROUP BY conv_id, turn, query, answer, context_set),
 imp AS (SELECT record_uuid, max((conv_id, turn))[1] AS conv_id, max((conv_id, turn))[2] AS turn FROM imp0 GROUP BY 1)"""
_UNIT = """un AS (SELECT 'retrieval' AS task, record_uuid, chunk_id, record_uuid || ':' || chunk_id AS unit, conv_id FROM imp JOIN ch USING (conv_id, turn)
          UNION ALL SELECT t, record_uuid, '', record_uuid, conv_id FROM imp, (SELECT unnest(['grounding', 'generation']) AS t)),
 dig AS (SELECT *, CAST('0x' || substr(sha256('42' || chr(0) || task || chr(0) || unit), 1, 8) AS BIGINT) AS d FROM un),
 asg AS (SELECT *, d < CASE task WHEN 'retrieval' THEN 429496729 WHEN 'grounding' THEN 858993459 ELSE 1288490188 END AS is_calibration FROM dig)"""
_TRUTH = """CASE WHEN evidence_sufficient = 1 AND topically_relevant = 0 THEN 'retrieval: evidence_sufficient=True but topically_relevant=False' END,
          CASE WHEN evidence_sufficient = 1 AND misleading = 1 THEN 'retrieval: evidence_sufficient=True but misleading=True' END"""
_GTRUTH = """CASE WHEN contradicted_claim_present = 1 AND unsupported_claim_present = 0 THEN 'grounding: contradicted_claim_present=True but unsupported_claim_present=False' END,
          CASE WHEN fabricated_source = 1 AND source_cited = 0 THEN 'grounding: fabricated_source=True but source_cited=False' END"""


def oracle_sql() -> dict[str, str]:
    names = ("topical_precision", "sufficiency_hit", "sufficiency_rate", "misleading_rate", "reciprocal_rank", "ndcg")
    every = ["topically_relevant", "evidence_sufficient", "misleading", "support_present", "unsupported_claim_present", "contradicted_claim_present", "source_cited", "fabricated_source", "proper_action", "response_on_topic", "helpful", "incomplete", "unsafe_content"]
    bad = "bad AS (SELECT doc_id, query, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE answer END AS answer, CASE WHEN doc_id % 17 = 0 THEN 2 WHEN doc_id % 19 = 0 THEN NULL ELSE proper_action END AS q, response_on_topic, unsafe_content FROM gen)"
    wilson = lambda z: (f"(k / n + {z} * {z} / (2 * n)) / (1 + {z} * {z} / n)", f"{z} / (1 + {z} * {z} / n) * sqrt(k / n * (1 - k / n) / n + {z} * {z} / (4 * n * n))")
    mid, half = wilson("1.96")
    return {
        "consolidate_majority": f"WITH {_CON} SELECT * FROM con",
        "retrieval_per_query": f"WITH {_PQ} SELECT record_uuid, {', '.join(f'round({m}, 6) AS {m}' for m in names)}, n_chunks, top_rank FROM pq",
        "retrieval_corpus_scores": f"""WITH {_PQ}, c AS (SELECT count(*) AS n_queries, max(top_rank) AS top_k, {', '.join(f'avg({m}) AS {m}' for m in names)},
          sum(sufficiency_hit) AS k, CAST(count(*) AS DOUBLE) AS n FROM pq)
          SELECT n_queries, top_k, {', '.join(f'round({m}, 6) AS {m}' for m in names)},
          round(greatest(0, {_MID} - {_HALF}), 6) AS sufficiency_hit_low, round(least(1, {_MID} + {_HALF}), 6) AS sufficiency_hit_high FROM c""",
        "grounding_scores": f"WITH {_GRD} " + _rates("grd", metrics.LABEL_METRICS["grounding"]),
        "conditional_fabrication": f"WITH {_GRD} " + _rates("grd", {"conditional_fabrication_rate": "fabricated_source"}, "source_cited = 1"),
        "generation_scores": f"WITH {_GEN} " + _rates("gen", metrics.LABEL_METRICS["generation"]),
        "iaa_filtered": f"""WITH {_IAA} SELECT annotator_id, count(*) AS n, min(item) AS first_item, sum(label_1)::BIGINT AS ones FROM kept
          WHERE annotator_id NOT IN ('a3', 'a7') AND created_at >= TIMESTAMP '2024-01-02' AND created_at <= TIMESTAMP '2024-01-20' GROUP BY 1""",
        "krippendorff_alpha": _ALPHA,
        "krippendorff_nominal": _ALPHA,
        "pct_agreement": f"""WITH {_LONG} SELECT label, round(avg((k * (k - 1) / 2.0 + (m - k) * (m - k - 1) / 2.0) / (m * (m - 1) / 2.0)), 6) AS pct_agreement FROM mk
          WHERE m >= 2 GROUP BY label""",
        "cohen_kappa_pairs": f"""WITH {_LONG}, s AS (SELECT a.annotator_id AS annotator_a, b.annotator_id AS annotator_b, a.label, count(*)::DOUBLE AS n,
          sum((a.value = b.value)::INT) AS agree, sum(a.value) AS a1, sum(b.value) AS b1 FROM long a
          JOIN long b ON a.item = b.item AND a.label = b.label AND a.annotator_id < b.annotator_id GROUP BY ALL)
          SELECT annotator_a, annotator_b,
          round(avg(CASE WHEN a1 * b1 + (n - a1) * (n - b1) <> n * n THEN (agree / n - (a1 * b1 + (n - a1) * (n - b1)) / (n * n)) / (1 - (a1 * b1 + (n - a1) * (n - b1)) / (n * n)) END), 6) AS kappa,
          max(n)::BIGINT AS n_shared_items FROM s GROUP BY 1, 2 HAVING count(CASE WHEN a1 * b1 + (n - a1) * (n - b1) <> n * n THEN 1 END) > 0""",
        "constraint_violations": f"""WITH {_RET}, {_GRD} SELECT unit, d <> '' AS constraint_violated, d AS constraint_details
          FROM (SELECT record_uuid || '/' || ord AS unit, concat_ws(';', {_TRUTH}) AS d FROM ret UNION ALL
          SELECT record_uuid, concat_ws(';', {_GTRUTH}) FROM grd)""",
        "constraint_summary": f"""WITH {_RET}, {_GRD} SELECT * FROM (SELECT 'evidence_requires_relevance' AS constraint_id, count(*) AS n FROM ret
          WHERE evidence_sufficient = 1 AND topically_relevant = 0 UNION ALL SELECT 'evidence_excludes_misleading', count(*) FROM ret
          WHERE evidence_sufficient = 1 AND misleading = 1 UNION ALL SELECT 'contradiction_requires_unsupported', count(*) FROM grd
          WHERE contradicted_claim_present = 1 AND unsupported_claim_present = 0 UNION ALL SELECT 'fabricated_requires_cited', count(*) FROM grd
          WHERE fabricated_source = 1 AND source_cited = 0) WHERE n > 0""",
        "panel_completeness": f"WITH {_PAN} SELECT * FROM pan",
        "completeness_by_k": f"""WITH {_PAN} SELECT k, {_BUCKET} AS bucket, count(*) AS n_panels, count(*) FILTER (panel_complete) AS n_complete FROM pan GROUP BY 1, 2""",
        "completeness_by_bucket": f"""WITH {_PAN} SELECT b AS bucket, count(k) AS n_panels, count(*) FILTER (panel_complete) AS n_complete
          FROM (SELECT unnest(['k_lt_5', 'k_eq_5', 'k_gt_5']) AS b) LEFT JOIN pan ON b = {_BUCKET} GROUP BY 1""",
        "completeness_summary": f"""WITH {_PAN} SELECT count(*) AS n_panels, count(*) FILTER (panel_complete) AS n_complete, count(*) FILTER (integrity_warning) AS n_integrity_warnings,
          count(*) FILTER (k = 0) AS n_unknown_k, CAST(0 AS BIGINT) AS n_orphans_skipped,
          round(count(*) FILTER (panel_complete) / count(*), 6) AS fraction_complete FROM pan""",
        "panel_status_overlap": f"WITH {_STAT} SELECT * FROM stat",
        "status_totals": f"""WITH {_STAT} SELECT count(*) AS n_panels, count(*) FILTER (panel_complete) AS n_complete, count(*) FILTER (overlap_satisfied) AS n_overlap_satisfied,
          count(*) FILTER (NOT integrity_ok) AS n_integrity_warnings,
          count(*) FILTER (k_metadata = 0) AS n_panels_unknown_k, CAST(0 AS BIGINT) AS n_orphans_skipped FROM stat""",
        "progress_grouping_sets": """WITH o AS (SELECT 'ws' || (o_custkey % 4) AS workspace, ['retrieval', 'grounding', 'generation'][o_orderkey % 3 + 1] AS task, o_orderkey, o_orderstatus = 'F' AS done
          FROM orders), d AS (SELECT workspace, task || CASE WHEN o_orderkey % 10 = 0 THEN '_calibration' ELSE '_production' END AS dataset, task, done
          FROM o)
          SELECT CASE WHEN grouping(task) = 1 THEN 'grand' WHEN grouping(workspace) = 1 THEN 'task' WHEN grouping(dataset) = 1 THEN 'workspace' ELSE 'dataset' END AS level, workspace, dataset, task,
          count(*) AS total, count(*) FILTER (done) AS completed, count(*) FILTER (NOT done) AS pending FROM d
          GROUP BY GROUPING SETS ((), (task), (workspace, task), (workspace, dataset, task))""",
        "tag_actions": f"""WITH {_SNAP}, f AS (SELECT workspace, record_uuid, count(DISTINCT chunk_id) AS k, count(DISTINCT chunk_id) FILTER (ns > 0) AS done FROM rec
          GROUP BY ALL)
          SELECT workspace, dataset, record_uuid, chunk_id,
          CASE WHEN done > 0 AND done < k AND ns + nd = 0 THEN CASE WHEN record_uuid::BIGINT % 4 = 0 THEN 'already' ELSE 'tag' END WHEN record_uuid::BIGINT % 4 = 0 THEN 'clear' ELSE 'none' END AS action
          FROM rec JOIN f USING (workspace, record_uuid)""",
        "export_rows_with_completeness": f"""WITH {_PAN}, u AS (SELECT workspace, dataset, record_uuid, chunk_id, user_id, max(status) AS status, max(l_discount) AS d, max(l_linestatus) AS ls,
          max(l_tax) AS t FROM resp GROUP BY ALL),
          k2 AS (SELECT workspace, dataset, record_uuid, chunk_id, max(n_retrieved_chunks) AS k FROM resp GROUP BY ALL),
          e AS (SELECT u.*, k2.k AS kmeta, CAST(ls = 'F' AS INT) AS topically_relevant, CAST(t > 0.04 AS INT) AS evidence_sufficient, CAST(d >= 0.05 AS INT) AS misleading
          FROM u JOIN k2 USING (workspace, dataset, record_uuid, chunk_id) WHERE status IN ('submitted', 'discarded')),
          x AS (SELECT *, CASE WHEN status = 'submitted' THEN concat_ws(';', {_TRUTH}) ELSE '' END AS details FROM e)
          SELECT x.record_uuid, x.chunk_id,
          coalesce(s_name, user_id) AS annotator_id, dataset = 'retrieval_calibration' AS calibration, status AS response_status, topically_relevant, evidence_sufficient, misleading, kmeta::INT AS n_retrieved_chunks, details <> '' AS constraint_violated, details AS constraint_details, panel_complete, n_submitted_chunks, n_records_seen
          FROM x LEFT JOIN supplier ON s_suppkey::VARCHAR = user_id AND s_suppkey % 2 = 0 LEFT JOIN pan ON pan.record_uuid = x.record_uuid""",
        "record_uuid": f"WITH {_PAIR} SELECT conv_id, turn, record_uuid FROM imp",
        "calibration_assignment": f"WITH {_PAIR}, {_UNIT} SELECT task, record_uuid, chunk_id, is_calibration FROM asg",
        "partition_summary": f"""WITH {_PAIR}, {_UNIT} SELECT task, count(*) AS n_units, count(*) FILTER (is_calibration) AS n_calibration,
          CASE task WHEN 'retrieval' THEN 0.1::DOUBLE WHEN 'grounding' THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END AS configured_fraction,
          count(*) FILTER (NOT is_calibration) AS n_production, round(count(*) FILTER (is_calibration) / count(*), 6) AS realised_fraction FROM asg
          GROUP BY task""",
        "manifest_lock_backfill": f"""WITH {_PAIR}, {_UNIT}, top AS (SELECT max(conv_id) AS top FROM conversations), m AS (SELECT asg.*, task = 'retrieval' AND conv_id * 2 < top AS old
          FROM asg, top)
          SELECT task, record_uuid, chunk_id, CASE WHEN old THEN d < 2147483648 ELSE is_calibration END AS is_calibration,
          CASE WHEN old THEN 'first' ELSE 'second' END AS import_id,
          CASE WHEN old THEN 0.5::DOUBLE WHEN task = 'retrieval' THEN 0.1::DOUBLE WHEN task = 'grounding' THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END AS calibration_fraction, NOT old AS is_new
          FROM m""",
        "denormalised_to_nested": f"""WITH {_RET} SELECT query, count(*) AS n_chunks, string_agg(chunk_id || ':' || annotator_id || ':' || chunk_rank || ':' || chunk, '|'
          ORDER BY ord) AS chunks FROM ret GROUP BY record_uuid, query""",
        "fan_out_counts": f"""WITH {_PAIR}, {_UNIT} SELECT task || CASE WHEN is_calibration THEN '_calibration' ELSE '_production' END || '_demo' AS dataset, count(*) AS n,
          min(CASE task WHEN 'retrieval' THEN 'ret-' || record_uuid || '-' || substr(sha256(chunk_id), 1, 16) WHEN 'grounding' THEN 'gnd-' || record_uuid ELSE 'gen-' || record_uuid END) AS first_id,
          count(*) FILTER (task = 'retrieval') AS n_ranks FROM asg GROUP BY 1""",
        "exact_dedup_first": """SELECT min(doc_id) AS doc_id, content_key FROM (SELECT doc_id, sha256(text) AS content_key FROM documents) GROUP BY content_key""",
        "near_dup_greedy": """WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
          p AS (SELECT a.id AS i, b.id AS j FROM v a JOIN v b ON a.id < b.id AND list_cosine_similarity(a.x, b.x) >= 0.3),
          s AS (SELECT i, list(j) AS js, row_number() OVER (ORDER BY i) AS n FROM p GROUP BY i),
          r AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS gone
                UNION ALL SELECT s.n, CASE WHEN list_contains(r.gone, s.i) THEN r.gone ELSE list_concat(r.gone, s.js) END FROM r
          JOIN s ON s.n = r.n + 1)
          SELECT id FROM v WHERE NOT list_contains((SELECT gone FROM r ORDER BY n DESC LIMIT 1), id)""",
        "blueprint_keys": """WITH b AS (SELECT event_id AS ord, '{"domain":"' || event_type || '","role":"r' || (user_id % 5) || '","language":"en","topic":'
            || CASE WHEN user_id % 3 > 0 THEN '"say \\"' || (user_id % 3) || '\\""' ELSE 'null' END
            || ',"intent":null,"task":null,"difficulty":null,"format":null,"user_scenario":null,"information_need":null}' AS body FROM events)
          SELECT min(ord) AS ord, sha256(body) AS content_key FROM b GROUP BY body""",
        "import_record_errors": f"""WITH {_PAIR}, t AS (SELECT conv_id, turn, bool_or({_STRIP('d.text')} = '') AS no_text FROM ch JOIN documents d ON 'd' || d.doc_id = ch.chunk_id
          GROUP BY conv_id, turn),
          x AS (SELECT conv_id, turn, concat_ws('; ', CASE WHEN turn % 4 = 2 OR query = '' THEN 'query is blank' END,
          CASE WHEN answer = '' THEN 'answer is blank' END,
            CASE WHEN conv_id % 11 = 0 THEN 'chunks is empty' END, CASE WHEN conv_id % 11 > 0 AND conv_id % 5 = 0 THEN 'chunk_id repeats' END,
            CASE WHEN conv_id % 11 > 0 AND no_text THEN 'chunk text is blank' END,
          CASE WHEN conv_id % 11 > 0 AND conv_id % 7 = 0 THEN 'chunk_rank is not a rank' END) AS errors FROM pr JOIN t USING (conv_id, turn))
          SELECT conv_id, turn, errors FROM x WHERE errors <> ''""",
        "submitted_without_labels": """SELECT CAST(doc_id AS VARCHAR) AS record_uuid, 'proper_action,helpful,incomplete' AS missing
          FROM labels JOIN documents USING (doc_id) WHERE doc_id % 19 = 0 AND doc_id % 17 <> 0 AND doc_id % 2 = 0""",
        "align_first_by_id": """WITH e AS (SELECT 'c' || user_id AS candidate_id, event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
          SELECT candidate_id, item, c_custkey AS ord FROM e JOIN customer ON 'c' || c_custkey = candidate_id WHERE r = 1 AND c_custkey % 2 = 0""",
        "assemble_queries": """SELECT 'run_q' || row_number() OVER (ORDER BY -n_nationkey) AS query_id, 'what about ' || n_name AS query, n_name AS domain, n_regionkey::VARCHAR AS role
          FROM nation WHERE n_nationkey % 3 <> 0""",
        "duplicate_unit_guard": f"""WITH {_RET} SELECT 'record_uuid,chunk_id' AS keys, coalesce(sum(c), 0)::BIGINT AS n_rows FROM (SELECT count(*) AS c FROM ret
          GROUP BY record_uuid, chunk_id HAVING count(*) > 1) UNION ALL SELECT 'record_uuid,chunk_rank', coalesce(sum(c), 0)::BIGINT
          FROM (SELECT count(*) AS c FROM ret GROUP BY record_uuid, chunk_rank HAVING count(*) > 1)""",
        "validation_error_counts": f"""WITH {_GEN}, {bad}, r AS (SELECT 'answer: blank' AS rule, count(*) FILTER ({_STRIP('answer')} = '') AS n FROM bad
          {" ".join(f"UNION ALL SELECT '{c}: null', count(*) FILTER (q IS NULL) FROM bad UNION ALL SELECT '{c}: not 0 or 1', count(*) FILTER (q NOT IN (0, 1)) FROM bad" for c in ("proper_action", "helpful"))}
          UNION ALL SELECT 'incomplete: null', count(*) FILTER (q IS NULL) FROM bad UNION ALL SELECT 'incomplete: not 0 or 1',
          count(*) FILTER (1 - q NOT IN (0, 1)) FROM bad) SELECT rule, n FROM r WHERE n > 0""",
        "classifier_frame": f"""WITH {_CON} SELECT topically_relevant AS label_topically_relevant, evidence_sufficient AS label_evidence_sufficient, misleading AS label_misleading,
          count(*) AS n, count(DISTINCT record_uuid) AS n_groups, min(chunk) AS first_pair FROM con GROUP BY 1, 2, 3""",
        "merged_task_view": f"""WITH {_RET}, {_GRD}, {_GEN}, r AS (SELECT record_uuid, {', '.join(f'max({x}) AS {x}' for x in LABELS)} FROM ret GROUP BY 1)
          SELECT record_uuid, {', '.join(every)} FROM r FULL JOIN grd USING (record_uuid) FULL JOIN gen USING (record_uuid)""",
        "sql_functions": f"""WITH l AS (SELECT l_orderkey, CASE WHEN l_linestatus = 'F' THEN 2 WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS g, l_linenumber, l_suppkey, l_partkey
          FROM lineitem),
          p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, g) AS a,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY g DESC) AS b FROM l),
          q AS (SELECT l_orderkey,
          coalesce(sum((pow(2, g) - 1) / log2(a + 1)) / nullif(sum((pow(2, g) - 1) / log2(b + 1)), 0), 0) AS ndcg, CAST(count(*) FILTER (g = 2) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n
          FROM p GROUP BY 1)
          SELECT l_orderkey, round(ndcg, 6) AS ndcg, round(greatest(0, {mid} - {half}), 6) AS low,
          round(least(1, {mid} + {half}), 6) AS high, CAST('0x' || substr(sha256('42' || chr(0) || 'retrieval' || chr(0) || l_orderkey), 1, 8) AS BIGINT) AS digest
          FROM q""",
    }
