"""The queries of this package, by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, common, decontam, html, langid, packing, simhash, substring, tokenstore, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return common.configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang").where(~common.held_out(F.col("doc_id"))))
    return langid.identify(docs, model).withColumn("held_out", common.held_out(F.col("doc_id")))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4, width=4)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokenstore.round_trip(table(spark, sf_dir, "documents"), common.public_tokenizer("word_bpe_49k.json"), 2)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), common.public_tokenizer("byte_bpe_50k.json"), 2048, 0)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"), window=50)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~common.held_out(F.col("doc_id")))
    model = toxicity.fit(labels, docs)
    out = toxicity.score(docs, model, threshold=0.3)
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLE_SQL = {
    "op4_warc": f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x,
          max(page_id) OVER (PARTITION BY sha1(b)) AS owner FROM p)
      SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
        array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', CAST(1 + ((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS INT), 1)), '') AS payload_digest,
        CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to FROM h""",
    "op7_nearest_neighbours": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
      d AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_sum(list_transform(list_zip(q.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
          FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS k FROM d)
          SELECT query_id, CAST(k AS INT) AS rank, vec_id, score FROM r WHERE k <= 10""",
    "op8_substring_dedup": """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
      s AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) AS i FROM w),
          k AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h FROM s),
      m AS (SELECT h, min(doc_id) AS low FROM k GROUP BY h), g AS (SELECT doc_id, list(i) AS starts FROM k JOIN m USING (h) WHERE low < doc_id
          GROUP BY doc_id),
      c AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 50)))) AS gone FROM g),
      o AS (SELECT w.doc_id, len(ws) AS n, coalesce(len(gone), 0) AS r,
          CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM w LEFT JOIN c USING (doc_id))
      SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM o""",
}


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it expresses; kernels, XXH64, token ids, trained models and bins have none."""
    return ORACLE_SQL
