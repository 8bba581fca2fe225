"""Queries of the operators on training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.llm import leaks, mixture, neardup, normalize, sentences, split, truncation
from concordat.sources.tables import load


def _both(spark: SparkSession, d: str, operator) -> DataFrame:
    """operator over segments and contributions, with the table's name first."""
    parts = [operator(load(spark, d, t).select("id", "text")).select(F.lit(t).alias("tbl"), "*") for t in ("segments", "contributions")]
    return parts[0].unionByName(parts[1])


def _p1(spark: SparkSession, d: str, table: str, least_words: int) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(load(spark, d, table), "id", "text", 3, 0.55, least_words)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [_p1(spark, d, t, 20).pairs().select(F.lit(t).alias("tbl"), "id_a", "id_b") for t in ("segments", "contributions")]
    return parts[0].unionByName(parts[1])


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of texts with 0.55 of their three-word sequences in common, directly or through others; of any length from three words, fewer have no sequence."""
    parts = [_p1(spark, d, t, 0).groups().select(F.lit(t).alias("tbl"), "key", "group_id", "n_links") for t in ("segments", "contributions")]
    return parts[0].unionByName(parts[1])


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, lambda df: split.split_oversized(df, "id", "text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).select("tbl", "rec_id").distinct()


def _p6(spark: SparkSession, d: str) -> DataFrame:
    a = normalize.normalize(load(spark, d, "contributions").select("id", "text"), "text").select(F.lit("contributions").alias("tbl"), F.col("id").alias("rec_id"), "canonical", "irregular", "changed")
    b = normalize.normalize(load(spark, d, "analyses").select("contribution_id", "evidence"), "evidence").select(F.lit("analyses").alias("tbl"), F.col("contribution_id").alias("rec_id"), "canonical", "irregular", "changed")
    return a.unionByName(b)


def p6_normalized(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d).filter(F.col("irregular") & F.col("rec_id").isNotNull()).select("tbl", "rec_id").distinct()


def p6_plain_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of the values of plain ASCII, which SQL can make too."""
    values = [(load(spark, d, t).select(F.lit(t).alias("tbl"), F.col(k).alias("rec_id"), F.col(c).alias("value")), normalize) for t, k, c in (("contributions", "id", "text"), ("analyses", "contribution_id", "evidence"))]
    parts = [n.normalize(df, "value").filter(F.col("value").rlike(normalize.PLAIN)) for df, n in values]
    return parts[0].unionByName(parts[1]).select("tbl", "rec_id", "canonical", "irregular", "changed")


def p7_truncated(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "analyses").select("contribution_id", "summary_fr", "evidence")
    c = load(spark, d, "contributions").select("id", "text")
    return truncation.find(a, "contribution_id", "summary_fr").unionByName(truncation.find(a, "contribution_id", "evidence", c))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_truncated(spark, d).select(F.col("id").alias("contribution_id"), "field_name").distinct()


def p7_by_model(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "analyses").select("contribution_id", "model", "summary_fr", "evidence")
    return truncation.shares(a, "contribution_id", ["summary_fr", "evidence"], "model", {"evidence": load(spark, d, "contributions").select("id", "text")})


def p7_values_by_model(spark: SparkSession, d: str) -> DataFrame:
    """How many values each model stored, which the shares are of, and whether the share is that of the truncated ones."""
    share = F.abs(F.col("share") - F.col("n_truncated") / F.col("n_values")) < 1e-12
    return p7_by_model(spark, d).select("model", "field_name", "n_values", (share & F.col("n_truncated").between(0, F.col("n_values"))).alias("consistent"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text")
    return leaks.find(docs, "doc_id", "text", load(spark, d, "eval_items"), "item_id", "passage")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


def _p9(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixture.draw(load(spark, d, "documents"), "doc_id", "text", "source", load(spark, d, "mix_targets"))


def p9_drawn(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)[1]


def p9_within_limits(spark: SparkSession, d: str) -> DataFrame:
    """Per source: no record is used more than max_repeats times, and a target called reachable is met to one record, the largest; every record of another source is used as often as it may be."""
    drawn, report = _p9(spark, d)
    uses = drawn.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.max("n").alias("most"))
    near = F.abs(F.col("drawn_tokens") - F.col("wanted_tokens")) <= F.col("largest")
    spent = F.col("n_uses") == F.col("n_records") * F.col("max_repeats")
    return report.join(uses, "source", "left").select("source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), F.when(F.col("reachable"), near).otherwise(spent).alias("as_reported"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(load(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p4_found, p4_pieces, p6_found, p6_normalized, p6_plain_forms, p7_found, p7_truncated, p7_by_model, p7_values_by_model, p8_found, p8_leaks, p9_drawn, p9_shares, p9_within_limits, p10_found)}

ORACLE = {
    "p4_found": " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS tbl, id AS rec_id FROM {t} WHERE length(text) > 2500" for t in ("segments", "contributions")),
    "p6_plain_forms": " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, {k} AS rec_id, regexp_replace(trim(regexp_replace(regexp_replace(lower({c}), ' +', ' ', 'g'), ' ?\n ?', chr(10), 'g')), '^\n+|\n+$', '', 'g') AS canonical, false AS irregular, false AS changed FROM {t} WHERE regexp_full_match({c}, '[\x20-\x7e\n]*')" for t, k, c in (("contributions", "id", "text"), ("analyses", "contribution_id", "evidence"))
    ),
    "p7_values_by_model": " UNION ALL ".join(f"SELECT model, '{c}' AS field_name, count({c}) AS n_values, true AS consistent FROM analyses WHERE {c} IS NOT NULL GROUP BY model" for c in ("summary_fr", "evidence")),
    "p9_within_limits": "SELECT source, true AS within_repeats, true AS as_reported FROM mix_targets",
}
