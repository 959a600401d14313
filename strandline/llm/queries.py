"""One query for each operator of this package, over whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import licenses, media, mixing, ngramjoin, packing, substring, toxicity, vectors, warc, wrapper


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_and_read(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.repeated_passages_removed(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("kept", lambda x: F.concat_ws("-", x["start"], x["end"]))
    return out.select("doc_id", "n_units", "n_removed", F.array_join(spans, ",").alias("kept_spans"), "text")


def op4_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"))


def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), training=lambda c: ~toxicity.held_out(c))
    out = toxicity.scored(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_texts(_table(spark, sf_dir, "pages"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_progressive_jpeg, op2_license_scan, op3_substring_dedup, op4_mixing_weights, op5_best_fit_packing, op6_warc_normaliser, op7_toxicity, op8_main_text, op9_ngram_join, op10_embedding_near_dedup)}
ORACLE_SQL: dict[str, str] = {
    "op6_warc_normaliser": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
        m AS (SELECT payload_digest, max(page_id) AS holder FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, d.payload_digest AS payload_digest,
               CASE WHEN holder IS NOT NULL AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN holder IS NOT NULL AND holder <> page_id THEN holder END AS refers_to
        FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND d.payload_bytes >= 1000
    """,
}
