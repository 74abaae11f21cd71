"""The jobs as registered queries: each runs twice into one new folder, and gives what then stands there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.catalog import DECODED, HEX, READS, WITH
from gridloom.sources.tables import new_path

from . import lane_counts, sample_barcodes
from .shared import as_it_stands


def job1_sample_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = new_path(spark, "job1")
    for _ in range(2):
        sample_barcodes.run(spark, f"{sf_dir}/documents.parquet", f"{top}/sheet", f"{top}/checkpoint")
    return as_it_stands(spark, f"{top}/sheet", sample_barcodes.SCHEMA)


def job2_lane_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = new_path(spark, "job2")
    for _ in range(2):
        lane_counts.run(spark, f"{sf_dir}/part.parquet", f"{sf_dir}/orders.parquet", top)
    spots = as_it_stands(spark, f"{top}/spots", lane_counts.SPOTS)
    lanes = as_it_stands(spark, f"{top}/lanes", lane_counts.LANES)
    rates = lanes.select("lane", F.col("n_reads").alias("lane_reads"), "n_correct", "n_wrong", "n_erased", "precision", "recall")
    return spots.join(rates, "lane")


_S = sample_barcodes.Settings()
_G_MOST = int(_S.length * _S.g_max)

QUERIES = {"job1_sample_barcodes": job1_sample_barcodes, "job2_lane_counts": job2_lane_counts}
ORACLE_SQL = {
    "job1_sample_barcodes": f"""
WITH t AS (SELECT doc_id, coalesce(nullif(source, ''), 'none') AS plate, md5(coalesce(text, '')) AS sign FROM documents WHERE doc_id IS NOT NULL),
 d AS (SELECT doc_id, min(struct_pack(sign := sign, plate := plate)) AS m FROM t GROUP BY doc_id),
 u AS (SELECT doc_id, m.sign AS sign, m.plate AS plate FROM d),
 f AS (SELECT sign, min(doc_id) AS owner FROM u GROUP BY sign),
 c AS (SELECT sign, k, translate(substr(md5('{_S.seed}' || k || ':' || sign), 1, {_S.length}), {HEX}) AS seq FROM f, range({_S.attempts}) r(k)),
 q AS (SELECT *, length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq) AS gc, length(regexp_replace(seq, '[^G]', '', 'g')) / length(seq) AS g, list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda r: length(r))) AS run FROM c),
 b AS (SELECT sign, min(k) AS k FROM q WHERE gc BETWEEN {_S.gc[0]} AND {_S.gc[1]} AND g <= {_S.g_max} AND run <= {_S.run_max} GROUP BY sign),
 p AS (SELECT q.sign, seq AS raw, b.k FROM q LEFT JOIN b ON b.sign = q.sign WHERE q.k = coalesce(b.k, 0)),
 l AS (SELECT *, list_reduce(list_prepend('', list_transform(range(1, length(raw) + 1), lambda i: substr(raw, i::INT, 1))), lambda s, x: s || CASE WHEN x = 'G' AND length(regexp_replace(s, '[^G]', '', 'g')) >= {_G_MOST} THEN 'T' ELSE x END) AS less FROM p),
 s AS (SELECT sign, coalesce(k, -1)::INT AS attempt, CASE WHEN k IS NOT NULL THEN raw ELSE array_to_string(list_transform(regexp_extract_all(less, 'A+|C+|G+|T+'),
   lambda r: regexp_replace(r, '(.{{{_S.run_max}}}).', CASE WHEN left(r, 1) IN ('A', 'T') THEN '\\1C' ELSE '\\1A' END, 'g')), '') END AS barcode FROM l)
SELECT doc_id, u.sign, owner, doc_id <> owner AS copy, barcode, attempt, round(length(regexp_replace(barcode, '[^GC]', '', 'g')) / length(barcode), 6) AS gc, round(length(regexp_replace(barcode, '[^G]', '', 'g')) / length(barcode), 6) AS g,
 list_max(list_transform(regexp_extract_all(barcode, 'A+|C+|G+|T+'), lambda r: length(r)))::INT AS run, 0::BIGINT AS batch, plate
FROM u JOIN f ON f.sign = u.sign JOIN s ON s.sign = u.sign""",
    "job2_lane_counts": WITH
    + READS
    + DECODED
    + """, x AS (SELECT o_orderstatus AS lane, flat.* FROM flat JOIN orders ON o_orderkey = key),
 l AS (SELECT lane, count(*) AS lane_reads, count(*) FILTER (truth = decoded) AS n_correct, count(decoded) - count(*) FILTER (truth = decoded) AS n_wrong, count(*) - count(decoded) AS n_erased,
  round(coalesce(count(*) FILTER (truth = decoded) / nullif(count(decoded), 0), 0), 6) AS precision, round(count(decoded) / count(*), 6) AS recall FROM x GROUP BY lane),
 p AS (SELECT lane, (decoded // 50)::INT AS row, (decoded % 50)::INT AS col, (decoded // 200)::INT AS block_row, count(*) AS n_reads, count(*) FILTER (dist = 0) AS n_exact, count(*) FILTER (truth = decoded) AS n_right, round(avg(dist), 6) AS mean_distance
  FROM x GROUP BY lane, decoded)
SELECT * FROM p JOIN l USING (lane)""",
}
