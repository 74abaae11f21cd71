"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, jaccard_join, lm_scoring, packing, periodic_runs, secret_scan, substring_dedup, suffix_pieces, telephony, toxicity, url_filters, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; Arrow batches are bounded by bytes, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passage_report(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.audio_columns(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_pieces.encoding_report(table(spark, sf_dir, "documents"), tokenizer_file(suffix_pieces.MODEL))


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(packing.TOKENIZER))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


URL_RULES = (
    url_filters.Rule("org", "/", True),
    url_filters.Rule("example.org", "/es/", False),
    url_filters.Rule("example.org", "/en/1", False),
    url_filters.Rule("com", "/fr/", True),
    url_filters.Rule("com", "/de/", False),
)


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judged(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.withColumn("purity", F.round("purity", 9))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_media_columns": op2_media_columns,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_secret_scans": op5_secret_scans,
    "op6_toxicity": op6_toxicity,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_warc": op9_warc,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_url_filters": op11_url_filters,
    "op12_periodic_runs": op12_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest FROM p),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS largest FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM g""",
    "op11_url_filters": url_filters.judged_sql(URL_RULES),
}
