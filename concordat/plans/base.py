"""The common inputs of the queries: deduplicated contributions, latest analyses, the two joined; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.operators import store
from concordat.sources.tables import load

ITEM = ["section_order", "section_id"]
TIES = ["stance", "score", "summary_fr", "evidence", "scrutiny", "deletion", "confidence", "method", "model"]


def contributions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Contributions without rows repeated whole; of the given columns and the id."""
    c = load(spark, d, "contributions")
    return (c.select("id", *[x for x in columns if x != "id"]) if columns else c).distinct()


def analyses(spark: SparkSession, d: str) -> DataFrame:
    """The latest analysis of each contribution."""
    a = load(spark, d, "analyses").drop("themes").filter(F.col("contribution_id").isNotNull())
    return store.latest(a, ["contribution_id"], "analysed_at", TIES)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Contributions with their latest analysis, or nulls."""
    c = contributions(spark, d, "document_id", *ITEM, "section_label", "ms_code", "kind", "text")
    return c.join(analyses(spark, d).withColumnRenamed("contribution_id", "id"), "id", "left")


def populations(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "populations")


_TIES = ", ".join(f"{t} NULLS LAST" for t in TIES)
WITH = f"""WITH c AS (SELECT DISTINCT * FROM contributions),
an AS (SELECT * EXCLUDE (rn, themes) FROM (SELECT *, row_number() OVER (PARTITION BY contribution_id ORDER BY analysed_at DESC NULLS LAST, {_TIES}) AS rn FROM analyses WHERE contribution_id IS NOT NULL) WHERE rn = 1),
sc AS (SELECT c.id, c.document_id, c.section_order, c.section_id, c.section_label, c.ms_code, c.kind, c.text, an.* EXCLUDE (contribution_id) FROM c LEFT JOIN an ON c.id = an.contribution_id),
m AS (SELECT section_order, section_id, ms_code AS party, min(score) AS score FROM sc WHERE score IS NOT NULL AND ms_code IS NOT NULL AND ms_code <> 'FR' GROUP BY ALL),
w AS (SELECT code AS party, population AS weight, population / sum(population) OVER () AS share FROM populations),
rates AS (SELECT x.party AS a, y.party AS b, count(*) AS shared, avg(CASE WHEN x.score = y.score THEN 1.0 ELSE 0.0 END) AS rate FROM m x JOIN m y ON x.section_order IS NOT DISTINCT FROM y.section_order AND x.section_id IS NOT DISTINCT FROM y.section_id AND x.party < y.party GROUP BY ALL HAVING count(*) >= 2)
"""
