"""Queries from contributions to positions, coalitions and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from concordat.functions.lineage import cut
from concordat.operators import coalition as K, positions as P, store
from concordat.plans.base import ITEM, WITH, analyses, contributions, populations, scored
from concordat.sources.tables import load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL, to which the common tables are put in front."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql.removeprefix("RAW ") if sql.startswith("RAW ") else WITH + sql
        return f

    return register


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return P.matrix(scored(spark, d), ITEM, "ms_code", "score", "FR")


def _rates(spark: SparkSession, d: str) -> DataFrame:
    return P.agreement(_matrix(spark, d), ITEM)


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return K.shares(populations(spark, d), "code", "population")


def _alternation(patterns: list[str]) -> str:
    return "|".join(patterns).replace("'", "''")


_N = "count(*) AS n, count(*) FILTER (score = 2) AS n_2, count(*) FILTER (score = 1) AS n_1, count(*) FILTER (score = 0) AS n_0"


@query("j1_contributions_analyses", "SELECT id, document_id, section_id, ms_code, stance, score, method, analysed_at FROM sc")
def j1(spark, d):
    return scored(spark, d).select("id", "document_id", "section_id", "ms_code", "stance", "score", "method", "analysed_at")


@query("a1_matrix", "SELECT section_order, section_id, party, score FROM m")
def a1(spark, d):
    return _matrix(spark, d)


_LEX = f"""SELECT id, ms_code, section_order, section_id, kind, text,
 regexp_matches(lower(text), '{_alternation(P.OPPOSE)}') AS o, regexp_matches(lower(text), '{_alternation(P.ALIGNE)}') AS a, regexp_matches(lower(text), '{_alternation(P.PARTIEL)}') AS p,
 regexp_matches(lower(text), '{_alternation(P.SCRUTINY)}') AS s, regexp_matches(lower(text), '{_alternation(P.DELETION)}') AS d FROM c"""
_QUIET = "CASE WHEN text IS NULL THEN NULL WHEN d OR s OR o THEN 'oppose' WHEN kind = 'drafting' OR p THEN 'partiel' WHEN a THEN 'aligne' ELSE 'neutre' END"
_SPOKEN = "CASE WHEN text IS NULL THEN NULL WHEN o OR d THEN 'oppose' WHEN a AND p THEN 'partiel' WHEN a AND s THEN 'partiel' WHEN a THEN 'aligne' WHEN p THEN 'partiel' ELSE 'neutre' END"
_SCORE = "CASE {0} WHEN 'aligne' THEN 2 WHEN 'partiel' THEN 1 WHEN 'oppose' THEN 0 END"


def _lexical(spark, d, silent=True):
    c = contributions(spark, d, *ITEM, "ms_code", "kind", "text")
    return P.lexical_stance(c, "text", F.col("kind"), F.lit(silent))


@query("m1_lexical_stance_silent", f"SELECT id, stance, {_SCORE.format('stance')} AS score, s AS scrutiny, d AS deletion, (CASE stance WHEN 'oppose' THEN 0.45 WHEN 'partiel' THEN 0.35 WHEN 'aligne' THEN 0.4 WHEN 'neutre' THEN 0.25 END)::DOUBLE AS confidence FROM (SELECT *, {_QUIET} AS stance FROM ({_LEX}))")
def m1_silent(spark, d):
    return _lexical(spark, d).select("id", F.col("lex_stance").alias("stance"), F.col("lex_score").alias("score"), F.col("lex_scrutiny").alias("scrutiny"), F.col("lex_deletion").alias("deletion"), F.col("lex_confidence").alias("confidence"))


@query("m1_lexical_stance_explicit", f"SELECT id, stance, {_SCORE.format('stance')} AS score FROM (SELECT *, {_SPOKEN} AS stance FROM ({_LEX}))")
def m1_explicit(spark, d):
    return _lexical(spark, d, False).select("id", F.col("lex_stance").alias("stance"), F.col("lex_score").alias("score"))


@query("j16_stance_by_reference", f"""SELECT id, CASE WHEN silent THEN {_QUIET} ELSE {_SPOKEN} END AS stance, silent FROM (SELECT l.*, f.document_id IS NULL AS silent FROM (SELECT l.*, c.document_id FROM ({_LEX}) l JOIN c USING (id)) l
 LEFT JOIN (SELECT DISTINCT document_id, section_id FROM fr_reference WHERE document_id IS NOT NULL AND section_id IS NOT NULL) f USING (document_id, section_id))""")
def j16(spark, d):
    """Each contribution read against the reference of its section; without one, under the rule of silence."""
    c = contributions(spark, d, "document_id", "section_id", "kind", "text")
    f = load(spark, d, "fr_reference").select("document_id", "section_id").distinct().withColumn("known", F.lit(True))
    held = c.join(f, ["document_id", "section_id"], "left").withColumn("silent", F.col("known").isNull())
    return P.lexical_stance(held, "text", F.col("kind"), F.col("silent")).select("id", F.col("lex_stance").alias("stance"), "silent")


@query("a1_matrix_by_text", f"SELECT section_order, section_id, ms_code AS party, min(score) AS score FROM (SELECT *, {_SCORE.format('stance')} AS score FROM (SELECT *, {_QUIET} AS stance FROM ({_LEX}) WHERE trim(text) <> '')) WHERE score IS NOT NULL AND ms_code IS NOT NULL AND ms_code <> 'FR' GROUP BY ALL")
def a1_text(spark, d):
    return P.matrix(_lexical(spark, d).filter(F.trim("text") != ""), ITEM, "ms_code", "lex_score", "FR")


@query("a2_party_ranking", f"SELECT party, avg(score) AS mean_score, {_N} FROM m GROUP BY party")
def a2(spark, d):
    return P.ranking(_matrix(spark, d))


@query("a3_contentious_items", f"SELECT section_order, section_id, avg(score) AS mean_score, stddev_samp(score) AS dispersion, {_N} FROM m GROUP BY ALL")
def a3(spark, d):
    return P.contentious(_matrix(spark, d), ITEM)


@query("a4_agreement", "SELECT a, b, shared, rate FROM rates")
def a4(spark, d):
    return _rates(spark, d)


@query("a5_shared_counts", "SELECT x.party AS a, y.party AS b, count(*) AS shared FROM m x JOIN m y USING (section_order, section_id) WHERE x.party < y.party GROUP BY ALL")
def a5(spark, d):
    return P.agreement(_matrix(spark, d), ITEM, 1).select("a", "b", "shared")


_REACH = """, e0 AS (SELECT a, b, round(rate, 3) AS rate FROM rates WHERE round(rate, 3) >= {t}), e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0),
reach AS (WITH RECURSIVE r(node, seen) AS (SELECT DISTINCT party, party FROM m UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a) SELECT node, min(seen) AS component FROM r GROUP BY node),
inner_ AS (SELECT component, avg(rate) AS cohesion FROM e0 JOIN reach ON a = node GROUP BY 1)
SELECT reach.component AS bloc, string_agg(node, ',' ORDER BY node) AS members, count(*) AS n, coalesce(max(cohesion), 0) AS cohesion, coalesce(sum(share), 0) AS share, count(*) >= 4 AND coalesce(sum(share), 0) > 1 - 0.65 AS blocking
FROM reach LEFT JOIN w ON w.party = node LEFT JOIN inner_ USING (component) GROUP BY reach.component"""
#: Rates of this data lie close together; this threshold gives several groups.
BLOC_THRESHOLD = 0.7


def _bloc_query(spark, d, threshold):
    m = cut(_matrix(spark, d))  # small, and read by every round
    return K.blocs(m.select("party").distinct(), P.agreement(m, ITEM), _weights(spark, d), threshold)


@query("a6_blocs", "RAW " + WITH.rstrip() + _REACH.format(t=BLOC_THRESHOLD))
def a6(spark, d):
    return _bloc_query(spark, d, BLOC_THRESHOLD)


@query("a6_blocs_default", "RAW " + WITH.rstrip() + _REACH.format(t=0.75))
def a6_default(spark, d):
    return _bloc_query(spark, d, 0.75)


def _weighted(spark, d):
    """Contributions whose text asks for more data protection count threefold; the match set is an input of the operator."""
    return scored(spark, d).withColumn("weight", F.when(F.lower("text").contains("data"), 3.0).otherwise(1.0))


_W = "(SELECT *, CASE WHEN contains(lower(text), 'data') THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sc WHERE score IS NOT NULL AND ms_code IS NOT NULL)"


@query("a7_weighted_matrix", f"SELECT section_order, section_id, ms_code AS party, sum(score * weight) / sum(weight) AS score FROM {_W} GROUP BY ALL")
def a7(spark, d):
    return P.weighted(_weighted(spark, d), ITEM, "ms_code", "score", "weight")


@query("a8_weighted_ranking", f"SELECT ms_code AS party, avg(score) AS raw_mean, sum(score * weight) / sum(weight) AS weighted_mean, sum(score * weight) / sum(weight) - avg(score) AS difference, count(*) AS n, count(*) FILTER (weight > 1) AS n_weighted FROM {_W} GROUP BY ALL")
def a8(spark, d):
    return P.weighted_ranking(_weighted(spark, d), "ms_code", "score", "weight")


@query("a9_targets", f"SELECT w.party, share, mean_score, coalesce(n, 0) AS n, coalesce(n_2, 0) AS n_2, coalesce(n_1, 0) AS n_1, coalesce(n_0, 0) AS n_0, CASE WHEN coalesce(n, 0) = 0 THEN 'silent' WHEN n_0 > n_2 THEN 'opposed' WHEN n_2 >= greatest(1, n / 2.0) THEN 'ally' ELSE 'persuade' END AS status FROM w LEFT JOIN (SELECT party, avg(score) AS mean_score, {_N} FROM m GROUP BY party) USING (party)")
def a9(spark, d):
    return P.targets(_matrix(spark, d), _weights(spark, d), "share")


_SIDES = "SELECT section_id AS item, party, min(score) AS score FROM m GROUP BY ALL"


def _sides(spark, d):
    return P.matrix(scored(spark, d), ["section_id"], "ms_code", "score", "FR").withColumnRenamed("section_id", "item")


@query("a10_majority_per_item", f"SELECT item, n_support, n_oppose, support_share, oppose_share, n_support / 27.0 AS states_share, greatest(0, 0.65 - support_share) AS missing_share, CASE WHEN n_oppose >= 4 AND oppose_share > 1 - 0.65::DOUBLE THEN 'blocked' WHEN n_support / 27.0 >= 0.55 AND support_share >= 0.65 THEN 'reached' ELSE 'not reached' END AS verdict FROM (SELECT item, count(*) FILTER (score = 2) AS n_support, count(*) FILTER (score = 0) AS n_oppose, coalesce(sum(share) FILTER (score = 2), 0)::DOUBLE AS support_share, coalesce(sum(share) FILTER (score = 0), 0)::DOUBLE AS oppose_share FROM ({_SIDES}) JOIN w USING (party) GROUP BY item)")
def a10(spark, d):
    return K.majority(_sides(spark, d), _weights(spark, d))


@query("a13_pivots", "SELECT w.party, share, n0 + 1 AS n_with, share0 + share AS share_with, n0 + 1 >= 4 AND share0 + share > 1 - 0.65::DOUBLE AS blocks, (n0 + 1) / 27.0 >= 0.55 AND share0 + share >= 0.65 AS reaches FROM w, (SELECT count(*) AS n0, sum(share) AS share0 FROM w WHERE party IN ('FR', 'DE', 'IT')) WHERE w.party NOT IN ('FR', 'DE', 'IT')")
def a13(spark, d):
    w = _weights(spark, d)
    return K.additions(w.select("party").filter(F.col("party").isin("FR", "DE", "IT")), w.select("party"), w)


@query("a16_coverage", "SELECT ms_code AS party, count(*) AS n, count(DISTINCT section_label) AS n_labels FROM c WHERE ms_code IS NOT NULL GROUP BY ALL")
def a16(spark, d):
    return contributions(spark, d).filter(F.col("ms_code").isNotNull()).groupBy(F.col("ms_code").alias("party")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("section_label").alias("n_labels"))


@query("a17_coverage_rate", "SELECT count(*) AS cells, count(DISTINCT (section_order, section_id)) AS n_items, count(DISTINCT party) AS n_parties, count(*) / (count(DISTINCT (section_order, section_id)) * count(DISTINCT party)) AS rate FROM m")
def a17(spark, d):
    g = _matrix(spark, d).agg(F.count(F.lit(1)).alias("cells"), F.countDistinct(F.struct(*ITEM)).alias("n_items"), F.countDistinct("party").alias("n_parties"))
    return g.withColumn("rate", F.col("cells") / (F.col("n_items") * F.col("n_parties")))


@query("a18_stance_breakdown", "SELECT ms_code AS party, count(*) FILTER (stance = 'aligne') AS aligne, count(*) FILTER (stance = 'partiel') AS partiel, count(*) FILTER (stance = 'oppose') AS oppose, count(*) FILTER (stance = 'neutre') AS neutre FROM sc WHERE ms_code IS NOT NULL AND stance IN ('aligne', 'partiel', 'oppose', 'neutre') GROUP BY ALL")
def a18(spark, d):
    kinds = ["aligne", "partiel", "oppose", "neutre"]
    s = scored(spark, d).filter(F.col("ms_code").isNotNull() & F.col("stance").isin(kinds))
    return s.groupBy(F.col("ms_code").alias("party")).pivot("stance", kinds).count().na.fill(0)


@query("a19_engagement", "SELECT ms_code AS party, count(*) AS n FROM c GROUP BY ALL")
def a19(spark, d):
    return contributions(spark, d, "ms_code").groupBy(F.col("ms_code").alias("party")).agg(F.count(F.lit(1)).alias("n"))


def _themes(spark, d):
    a = load(spark, d, "analyses").select("contribution_id", "stance", "themes").distinct()
    c = contributions(spark, d, "ms_code")
    return a.select(F.col("contribution_id").alias("id"), "stance", F.explode("themes").alias("theme")).filter("theme is not null").withColumn("theme", F.concat(F.upper(F.substring("theme", 1, 1)), F.lower(F.expr("substring(theme, 2)")))).join(c, "id")


_THEMES = "th AS (SELECT upper(theme[1]) || lower(theme[2:]) AS theme, stance, ms_code FROM (SELECT DISTINCT contribution_id, stance, themes, unnest(themes) AS theme, generate_subscripts(themes, 1) AS pos FROM (SELECT DISTINCT contribution_id, stance, themes FROM analyses)) JOIN c ON c.id = contribution_id WHERE theme IS NOT NULL)"


@query("a20_themes", "RAW " + WITH.rstrip() + f", {_THEMES} SELECT theme, count(*) AS n, count(DISTINCT ms_code) AS n_parties FROM th GROUP BY theme ORDER BY n DESC, theme LIMIT 20")
def a20(spark, d):
    return _themes(spark, d).groupBy("theme").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ms_code").alias("n_parties")).orderBy(F.desc("n"), "theme").limit(20)


@query("a21_dominant_stance", "RAW " + WITH.rstrip() + f", {_THEMES} SELECT theme, ms_code AS party, count(*) AS n, CASE min(CASE stance WHEN 'oppose' THEN 0 WHEN 'partiel' THEN 1 WHEN 'aligne' THEN 2 WHEN 'neutre' THEN 3 ELSE 4 END) WHEN 0 THEN 'oppose' WHEN 1 THEN 'partiel' WHEN 2 THEN 'aligne' WHEN 3 THEN 'neutre' END AS dominant FROM th GROUP BY ALL")
def a21(spark, d):
    return P.dominant(_themes(spark, d).withColumnRenamed("ms_code", "party"), ["theme", "party"], "stance", ["oppose", "partiel", "aligne", "neutre"])


_R = "CASE stance WHEN 'oppose' THEN 0 WHEN 'partiel' THEN 1 WHEN 'aligne' THEN 2 ELSE 3 END"


@query("a22_cell_text", f"SELECT section_id, party, string_agg(summary_fr, ' / ' ORDER BY rn) FILTER (rn <= 2) || CASE WHEN count(*) > 2 THEN ' (+ ' || (count(*) - 2)::VARCHAR || ' …)' ELSE '' END AS cell FROM (SELECT section_id, ms_code AS party, summary_fr, row_number() OVER (PARTITION BY section_id, ms_code ORDER BY {_R}, id, summary_fr) AS rn FROM sc WHERE ms_code IS NOT NULL AND summary_fr IS NOT NULL) GROUP BY ALL")
def a22(spark, d):
    """The first two summaries of a cell, most unfavourable first, and how many more there are."""
    s = scored(spark, d).filter(F.col("ms_code").isNotNull() & F.col("summary_fr").isNotNull())
    rank = F.when(F.col("stance") == "oppose", 0).when(F.col("stance") == "partiel", 1).when(F.col("stance") == "aligne", 2).otherwise(3)
    rn = F.row_number().over(Window.partitionBy("section_id", "ms_code").orderBy(rank, "id", "summary_fr"))
    two = s.withColumn("rn", rn).groupBy("section_id", F.col("ms_code").alias("party")).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("rn") == 1, F.col("summary_fr"))).alias("one"), F.max(F.when(F.col("rn") == 2, F.col("summary_fr"))).alias("two"))
    return two.select("section_id", "party", F.concat(F.concat_ws(" / ", "one", "two"), F.when(F.col("n") > 2, F.concat(F.lit(" (+ "), (F.col("n") - 2).cast("string"), F.lit(" …)"))).otherwise("")).alias("cell"))


@query("a32_kpis", "SELECT count(*) AS n, count(DISTINCT ms_code) AS n_parties, count(DISTINCT section_id) AS n_items, count(*) FILTER (stance IS NOT NULL) AS n_analysed FROM sc")
def a32(spark, d):
    return scored(spark, d).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ms_code").alias("n_parties"), F.countDistinct("section_id").alias("n_items"), F.count_if(F.col("stance").isNotNull()).alias("n_analysed"))


_CODED = f"(SELECT l.stance AS one, sc.stance AS two FROM (SELECT id, {_QUIET} AS stance FROM ({_LEX})) l JOIN sc USING (id) WHERE l.stance IS NOT NULL AND sc.stance IS NOT NULL)"


def _coded(spark, d):
    both = scored(spark, d).filter("text is not null and stance is not null")  # a text alone is enough for a lexical stance
    return P.lexical_stance(both, "text", F.col("kind"), F.lit(True)).select("section_id", F.col("lex_stance").alias("one"), F.col("stance").alias("two"))


@query("a34_kappa", f"SELECT total, same / total AS observed, (same / total - chance / total / total) / (1 - chance / total / total) AS kappa FROM (SELECT count(*)::DOUBLE AS total_, count(*) AS total, count(*) FILTER (one = two) AS same FROM {_CODED}), (SELECT sum(nx * ny)::DOUBLE AS chance FROM (SELECT one, count(*) AS nx FROM {_CODED} GROUP BY 1) JOIN (SELECT two, count(*) AS ny FROM {_CODED} GROUP BY 1) ON one = two)")
def a34(spark, d):
    return P.kappa(_coded(spark, d), "one", "two")


@query("a35_confusion", f"SELECT one, two, count(*) AS n FROM {_CODED} GROUP BY ALL")
def a35(spark, d):
    return _coded(spark, d).groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"))


@query("a36_class_agreement", f"SELECT two AS manual, count(*) AS n, avg(CASE WHEN one = two THEN 1.0 ELSE 0.0 END) AS rate FROM {_CODED} GROUP BY two")
def a36(spark, d):
    return _coded(spark, d).groupBy(F.col("two").alias("manual")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("one") == F.col("two")).cast("double")).alias("rate"))


@query("a38_total_share", "SELECT sum(population) AS total, sum(population) * 35 / 100 AS blocking_weight FROM populations")
def a38(spark, d):
    return populations(spark, d).agg(F.sum("population").alias("total"), (F.sum("population") * 35 / 100).alias("blocking_weight"))


@query("a39_batch_counters", "SELECT model, method, count(*) AS n, count(*) FILTER (confidence <= 0) AS n_failed, avg(confidence) AS mean_confidence, median(confidence) AS median_confidence FROM an GROUP BY ALL")
def a39(spark, d):
    return analyses(spark, d).groupBy("model", "method").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") <= 0).alias("n_failed"), F.avg("confidence").alias("mean_confidence"), F.median("confidence").alias("median_confidence"))


@query("a40_closest_pairs", "SELECT * FROM (SELECT 'closest' AS side, a, b, shared, rate FROM rates WHERE shared >= 3 ORDER BY round(rate, 9) DESC, a, b LIMIT 15) UNION ALL SELECT * FROM (SELECT 'farthest', a, b, shared, rate FROM rates WHERE shared >= 3 ORDER BY round(rate, 9), a, b LIMIT 15)")
def a40(spark, d):
    r = _rates(spark, d).filter("shared >= 3")
    key = F.round("rate", 9)
    near = r.orderBy(key.desc(), "a", "b").limit(15).select(F.lit("closest").alias("side"), "*")
    return near.unionByName(r.orderBy(key, "a", "b").limit(15).select(F.lit("farthest").alias("side"), "*"))


@query("a41_sides_of_item", f"SELECT item, string_agg(party, ',' ORDER BY party) FILTER (score = 2) AS supporters, string_agg(party, ',' ORDER BY party) FILTER (score = 0) AS opposers FROM ({_SIDES}) GROUP BY item")
def a41(spark, d):
    side = lambda v: F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(F.col("score") == v, F.col("party")))), ","), F.lit(""))
    return _sides(spark, d).groupBy("item").agg(side(2).alias("supporters"), side(0).alias("opposers"))


@query("w1_round_robin", "SELECT id, section_id, turn FROM (SELECT id, section_id, ms_code, row_number() OVER (PARTITION BY section_id ORDER BY ms_code NULLS FIRST, id) - 1 AS turn FROM c) ORDER BY turn, section_id NULLS FIRST, ms_code NULLS FIRST, id LIMIT 200")
def w1(spark, d):
    return P.round_robin(contributions(spark, d, "section_id", "ms_code"), "section_id", ["ms_code", "id"], 200).select("id", "section_id", "turn")


@query("w8_population_shares", "SELECT party, weight, share FROM w")
def w8(spark, d):
    return _weights(spark, d)


@query("f4_theme_overlap", "SELECT DISTINCT contribution_id FROM analyses WHERE list_has_any(themes, ['gouvernance', 'coûts'])")
def f4(spark, d):
    return load(spark, d, "analyses").filter(F.arrays_overlap("themes", F.array(F.lit("gouvernance"), F.lit("coûts")))).select("contribution_id").distinct()


@query("f5_missing_analyses", "SELECT id FROM sc WHERE stance IS NULL")
def f5(spark, d):
    return scored(spark, d).filter(F.col("stance").isNull()).select("id")


@query("f12_quote_ratio", "SELECT id, CASE WHEN q = '' THEN NULL WHEN contains(s, q) THEN 1.0 ELSE len(list_filter(list_filter(string_split(q, ' '), lambda x: length(x) > 3), lambda x: contains(s, x))) / nullif(len(list_filter(string_split(q, ' '), lambda x: length(x) > 3)), 0) END AS ratio FROM (SELECT id, trim(regexp_replace(lower(evidence), '[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) AS q, trim(regexp_replace(lower(text), '[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) AS s FROM sc WHERE evidence IS NOT NULL AND text IS NOT NULL)")
def f12(spark, d):
    s = scored(spark, d).filter("evidence is not null and text is not null")
    return s.select("id", P.quote_ratio(F.col("evidence"), F.col("text")).alias("ratio"))


@query("j18_silent_sections", "SELECT DISTINCT document_id, section_id FROM segments s WHERE NOT EXISTS (SELECT 1 FROM fr_reference f WHERE f.document_id = s.document_id AND f.section_id = s.section_id)")
def j18(spark, d):
    return load(spark, d, "segments").select("document_id", "section_id").distinct().join(load(spark, d, "fr_reference").select("document_id", "section_id"), ["document_id", "section_id"], "left_anti")


@query("j13_frames", "RAW " + WITH.rstrip() + f", t AS (SELECT section_order, section_id, ms_code AS party, min(score) AS score FROM (SELECT *, {_SCORE.format('stance')} AS score FROM (SELECT *, {_QUIET} AS stance FROM ({_LEX}) WHERE trim(text) <> '')) WHERE score IS NOT NULL AND ms_code IS NOT NULL AND ms_code <> 'FR' GROUP BY ALL) SELECT m.score AS by_reference, t.score AS by_text, count(*) AS n FROM m JOIN t USING (section_order, section_id, party) GROUP BY ALL")
def j13(spark, d):
    """The two frames of reference compared cell by cell."""
    m, t = _matrix(spark, d), a1_text(spark, d)
    both = m.withColumnRenamed("score", "by_reference").join(t.withColumnRenamed("score", "by_text"), [*ITEM, "party"])
    return both.groupBy("by_reference", "by_text").agg(F.count(F.lit(1)).alias("n"))


@query("t5_fraction_cap", "SELECT section_id, greatest(1, round_even(count(*) * 0.1, 0))::BIGINT AS cap FROM c GROUP BY ALL")
def t5(spark, d):
    return contributions(spark, d, "section_id").groupBy("section_id").agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * 0.1, 0).cast("bigint")).alias("cap"))


@query("a26_grouping_sets", "SELECT kind, ms_code AS party, stance, count(*) AS n, grouping(kind, ms_code, stance) AS level FROM sc GROUP BY GROUPING SETS ((kind), (ms_code), (stance), ())")
def a26(spark, d):
    s = scored(spark, d).select("kind", F.col("ms_code").alias("party"), "stance")
    s.createOrReplaceTempView("__scored")
    return spark.sql("SELECT kind, party, stance, count(*) AS n, grouping_id(kind, party, stance) AS level FROM __scored GROUP BY GROUPING SETS ((kind), (party), (stance), ())")
