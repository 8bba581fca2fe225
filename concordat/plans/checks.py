"""Queries of the data checks of the core: skewed keys (p2), orphan references (p3), two copies (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.operators import balance, orphans, reconcile
from concordat.sources.tables import load


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return balance.heavy_values(load(spark, d, "contributions"), ["ms_code", "section_id"], "id", "text", 0.05)


def p2_per_key(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "contributions")
    parts = [balance.per_key(c, k, "id", "text").select(F.lit(k).alias("field_name"), F.col(k).alias("key_value"), "n_rows", "n_ids", "mean_chars") for k in ("ms_code", "section_id")]
    return parts[0].unionByName(parts[1])


def p2_named(spark: SparkSession, d: str) -> DataFrame:
    """Contributions by the name of their state; the matching side (populations) goes to the shards of the large states only."""
    c = load(spark, d, "contributions").select("id", "ms_code")
    p = load(spark, d, "populations").select(F.col("code").alias("ms_code"), "nom", "population")
    return balance.replicate_join(c, p, "ms_code", ["id"]).groupBy("ms_code", "nom", "population").agg(F.count(F.lit(1)).alias("n_rows"))


def _p3(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "analyses").select("contribution_id", "analysed_at")
    c = load(spark, d, "contributions").select("id", "document_id", "loaded_at")
    f = load(spark, d, "fr_reference").select("document_id", "section_id", "updated_at")
    one = orphans.labelled(orphans.find(a, c, [("contribution_id", "id")]), "analyses", F.col("contribution_id"), "analysed_at")
    two = orphans.labelled(orphans.find(c, load(spark, d, "library_documents").select("id"), [("document_id", "id")]), "contributions", F.col("id"), "loaded_at")
    s = load(spark, d, "segments").select("document_id", "section_id")
    three = orphans.labelled(orphans.find(f, s, [("document_id", "document_id"), ("section_id", "section_id")]), "fr_reference", F.concat("document_id", F.lit("/"), "section_id"), "updated_at")
    return one.unionByName(two).unionByName(three)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _p3(spark, d).distinct()


def p3_by_month(spark: SparkSession, d: str) -> DataFrame:
    return _p3(spark, d).groupBy("tbl", "ref_month").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("rec_key").alias("n_keys"))


def _p5(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.differences(load(spark, d, "segments"), load(spark, d, "segments_copy"), "id", "only_in_segments", "only_in_copy")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).select("id", "diff_kind").distinct()


def p5_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).groupBy("diff_kind").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {f.__name__: f for f in (p2_found, p2_per_key, p2_named, p3_found, p3_by_month, p5_found, p5_by_kind)}

_P3 = """
SELECT 'analyses' AS tbl, coalesce(strftime(analysed_at, '%Y-%m'), 'none') AS ref_month, CAST(contribution_id AS varchar) AS rec_key
  FROM analyses WHERE contribution_id IS NOT NULL AND contribution_id NOT IN (SELECT id FROM contributions WHERE id IS NOT NULL)
UNION ALL
SELECT 'contributions', coalesce(strftime(loaded_at, '%Y-%m'), 'none'), CAST(id AS varchar)
  FROM contributions WHERE document_id <> '' AND document_id NOT IN (SELECT id FROM library_documents WHERE id IS NOT NULL)
UNION ALL
SELECT 'fr_reference', coalesce(strftime(updated_at, '%Y-%m'), 'none'), document_id || '/' || section_id
  FROM fr_reference f WHERE document_id <> '' AND section_id <> ''
   AND NOT EXISTS (SELECT 1 FROM segments s WHERE s.document_id = f.document_id AND s.section_id = f.section_id)
"""
_FIELDS = ("document_id", "section_id", "section_label", "section_kind", "section_order", "ms_code", "contribution_kind", "text", "page_start", "page_end")
_P5 = (
    "WITH b AS (SELECT DISTINCT * FROM segments_copy) SELECT id, 'only_in_segments' AS diff_kind FROM segments WHERE id NOT IN (SELECT id FROM b)"
    " UNION ALL SELECT id, 'only_in_copy' FROM b WHERE id NOT IN (SELECT id FROM segments)"
    + "".join(f" UNION ALL SELECT a.id, '{c}' FROM segments a JOIN b USING (id) WHERE a.{c} IS DISTINCT FROM b.{c}" for c in _FIELDS)
)

ORACLE = {
    "p2_found": " UNION ALL ".join(
        f"SELECT '{k}' AS field_name, {k} AS key_value FROM contributions WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) >= 0.05 * (SELECT count(*) FROM contributions)" for k in ("ms_code", "section_id")
    ),
    "p2_per_key": " UNION ALL ".join(
        f"SELECT '{k}' AS field_name, {k} AS key_value, count(*) AS n_rows, count(DISTINCT id) AS n_ids, sum(length(text)) / count(text) AS mean_chars FROM contributions GROUP BY {k}" for k in ("ms_code", "section_id")
    ),
    "p2_named": "SELECT ms_code, nom, population, count(*) AS n_rows FROM contributions LEFT JOIN populations ON ms_code = code GROUP BY ALL",
    "p3_found": f"SELECT DISTINCT * FROM ({_P3})",
    "p3_by_month": f"SELECT tbl, ref_month, count(*) AS n_rows, count(DISTINCT rec_key) AS n_keys FROM ({_P3}) GROUP BY tbl, ref_month",
    "p5_found": f"SELECT DISTINCT * FROM ({_P5})",
    "p5_by_kind": f"SELECT diff_kind, count(*) AS n_rows FROM (SELECT DISTINCT * FROM ({_P5})) GROUP BY diff_kind",
}
