"""Queries of acts cut into instructions, titles, orders, coalition reports, extracted positions, table rows, the store as a whole."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from concordat.functions import udtfs
from concordat.operators import alerts as AL, amend as A, coalition as K, positions as P, scoring, search as R, segment as G, sequence as S, store
from concordat.plans.base import WITH, contributions, populations, scored
from concordat.plans.documents import _DIFFERS, _acts
from concordat.plans.positions import _LEX, _QUIET
from concordat.plans.retrieval import QUESTION, _STATUS, _sql, j5
from concordat.sources.tables import load, open_store
from concordat.streaming import streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = WITH + sql
        return f

    return register


_PLACED = f"SELECT document_id, section_id, row_number() OVER (PARTITION BY document_id ORDER BY section_id) AS pos, regexp_extract(section_id, '(\\d+)', 1) AS num, new, kept FROM ({_DIFFERS})"


@query("x5_amending_split", rf"SELECT document_id, 'mod_32023r2854_' || section_id || '_' || pos AS section_id, 'Article premier · ' || pos || '. · règlement (UE) 2023/2854, Article ' || num AS section_label, 'modification' AS section_kind, CASE WHEN kept IS NULL THEN 'L''article ' || num || ' est supprimé.' ELSE 'L''article ' || num || ' est remplacé par le texte suivant:' || CASE WHEN trim(new, ' ' || chr(10)) = '' THEN '' ELSE chr(10) || '« ' || regexp_replace(regexp_replace(new, '\s*\n\s*', ' ', 'g'), '^\s+|\s+$', '', 'g') || ' »' END END AS text FROM ({_PLACED})")
def x5(spark, d):
    """Acts as one segment per instruction; their only own article amends and is left out."""
    return A.split_acts(_acts(spark, d), "document_id", "act").select("document_id", "section_id", "section_label", "section_kind", "text")


@query("a25_articles_touched", f"SELECT document_id, section_id, min(pos) - 1 AS first_seen, count(*) AS n FROM ({_PLACED}) GROUP BY ALL")
def a25(spark, d):
    """The articles an act touches, in the order in which they come up."""
    acts = A.instructions(_acts(spark, d), "document_id", "act")
    return acts.groupBy("document_id", "section_id").agg(F.min("position").cast("bigint").alias("first_seen"), F.count(F.lit(1)).alias("n"))


@query("a28_act_recap", f"SELECT document_id, 'règlement (UE) 2023/2854' AS act, '32023R2854' AS celex, 'Article premier' AS act_article, count(DISTINCT section_id) AS articles, count(*) AS changes FROM ({_PLACED}) GROUP BY document_id")
def a28(spark, d):
    acts = A.instructions(_acts(spark, d), "document_id", "act")
    return acts.groupBy("document_id", "act", "celex", "act_article").agg(F.count_distinct("section_id").alias("articles"), F.count(F.lit(1)).alias("changes"))


@query("j21_characterised", f"SELECT p.document_id, p.section_id, r.summary_fr AS what FROM ({_PLACED}) p LEFT JOIN (SELECT DISTINCT document_id, section_id, summary_fr FROM fr_reference) r ON r.document_id = p.document_id AND r.section_id = p.section_id")
def j21(spark, d):
    """Instructions with what is known of their article, by document and section."""
    known = load(spark, d, "fr_reference").select("document_id", "section_id", F.col("summary_fr").alias("what")).distinct()
    return A.instructions(_acts(spark, d), "document_id", "act").select("document_id", "section_id").join(known, ["document_id", "section_id"], "left")


_OWN = r"SELECT doc_id, label FROM (SELECT DISTINCT doc_id, replace(regexp_replace(lower(trim(x)), '\s+', ' ', 'g'), 'premier', '1') AS label FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?im)^[ \t]*(article\s+(?:premier|\d+))[ \t]*$', 1)) AS x FROM documents WHERE text IS NOT NULL))"


@query("j22_own_articles", _OWN)
def j22(spark, d):
    """The articles that a document itself enacts, by its headings."""
    heads = F.transform(F.regexp_extract_all("text", F.lit(r"(?im)^[ \t]*(article\s+(?:premier|\d+))[ \t]*$"), F.lit(1)), lambda x: F.replace(F.regexp_replace(F.lower(F.trim(x)), r"\s+", " "), F.lit("premier"), F.lit("1")))
    return load(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(F.array_distinct(heads)).alias("label"))


_HEADED = "SELECT id, document_id, section_order, section_label, CASE section_id WHEN 'art_2' THEN 'TITRE II — OBJET DU TEXTE' || chr(10) WHEN 'art_9' THEN 'chapter 3' || chr(10) || 'CHAPITRE IV : ' || chr(10) WHEN 'rec_12' THEN 'Titre premier' || chr(10) ELSE '' END || coalesce(text, '') AS text FROM segments"
_TITLE = r"(?im)^[^\S\n]*(?:TITRE|TITLE|CHAPITRE|CHAPTER)[^\S\n]+(?:[IVXLC]+|\d+|premier|first)\b[^\S\n]*[—\-–:.]?[^\S\n]*[^\n]{0,90}$"
_SUITE = r"trim(regexp_replace(h, '(?i)^\s*\w+\s+\w+\s*[—\-–:.]?\s*', ''), ' —-–:.')"
_NAMED = rf"CASE WHEN h <> '' THEN CASE WHEN regexp_matches(h, '(?i)^\s*tit') THEN 'Titre ' ELSE 'Chapitre ' END || upper(regexp_extract(h, '^\s*\w+\s+(\w+)', 1)) || CASE WHEN length({_SUITE}) > 3 THEN ', ' || upper({_SUITE}[1]) || lower({_SUITE}[2:]) ELSE '' END END"
_TITLED = f"SELECT document_id, section_label, arg_min(title, (section_order, id)) AS title FROM (SELECT *, last_value({_NAMED} IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY section_order, id ROWS UNBOUNDED PRECEDING) AS title FROM (SELECT *, coalesce(regexp_extract_all(text[:600], '{_TITLE}')[-1], '') AS h FROM ({_HEADED}))) WHERE title IS NOT NULL AND section_label <> '' GROUP BY ALL"


def _titled(spark, d):
    head = F.when(F.col("section_id") == "art_2", "TITRE II — OBJET DU TEXTE\n").when(F.col("section_id") == "art_9", "chapter 3\nCHAPITRE IV : \n").when(F.col("section_id") == "rec_12", "Titre premier\n").otherwise("")
    s = load(spark, d, "segments").select("id", "document_id", "section_order", "section_label", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))
    return S.titles(s, "document_id", ["section_order", "id"], "section_label", "text")


@query("x21_titles_from_text", _TITLED)
def x21(spark, d):
    """The title or chapter under which each label first stands, by the headings in the texts (put before three sections here)."""
    return _titled(spark, d)


@query("a29_bounds_by_title", rf"SELECT document_id, title, min(n) AS low, max(n) AS high FROM (SELECT document_id, title, TRY_CAST(regexp_extract(section_label, '(\d+)', 1) AS bigint) AS n FROM ({_TITLED})) WHERE n IS NOT NULL GROUP BY ALL")
def a29(spark, d):
    """The least and greatest number of an article under each title."""
    n = F.expr(r"try_cast(regexp_extract(section_label, '(\\d+)', 1) AS bigint)")
    return _titled(spark, d).withColumn("n", n).filter("n is not null").groupBy("document_id", "title").agg(F.min("n").alias("low"), F.max("n").alias("high"))


_T7 = r"coalesce(TRY_CAST(regexp_extract(section_id, '(\d+)', 1) AS bigint), 9999)"


@query("t7_article_order", rf"SELECT id, row_number() OVER (PARTITION BY document_id ORDER BY {_T7}, regexp_extract(section_id, '\d+([a-z]?)', 1), section_id) AS place FROM segments WHERE section_id IS NOT NULL")
def t7(spark, d):
    """Sections by their first number (9999 without one), then its letter."""
    n = F.coalesce(F.expr(r"try_cast(regexp_extract(section_id, '(\\d+)', 1) AS bigint)"), F.lit(9999))
    w = Window.partitionBy("document_id").orderBy(n, F.regexp_extract("section_id", r"\d+([a-z]?)", 1), "section_id")
    return load(spark, d, "segments").filter("section_id is not null").select("id", F.row_number().over(w).alias("place"))


_IMPACT = "CASE {0} WHEN 'majeur' THEN 0 WHEN 'mineur' THEN 1 WHEN 'redactionnel' THEN 2 WHEN 'nul' THEN 4 ELSE 3 END"
_CHANGED = f"SELECT document_id, root_id, status, CASE WHEN status = 'suppression' THEN 'majeur' WHEN status = 'ajout' THEN 'mineur' WHEN status = 'inchange' THEN 'nul' ELSE '' END AS impact FROM ({_STATUS})"


@query("t6_impact_order", f"SELECT document_id, root_id, impact, row_number() OVER (ORDER BY {_IMPACT.format('impact')}, document_id NULLS FIRST, root_id NULLS FIRST) AS place FROM ({_CHANGED}) ORDER BY place LIMIT 100")
def t6(spark, d):
    """The hundred weightiest changes of a comparison: by impact, then in the order of documents."""
    c = j5(spark, d).withColumn("impact", F.when(F.col("status") == "suppression", "majeur").when(F.col("status") == "ajout", "mineur").when(F.col("status") == "inchange", "nul").otherwise(""))
    rank = F.expr(_IMPACT.format("impact"))
    top = c.withColumn("r", rank).orderBy("r", "document_id", "root_id").limit(100)  # a report of fixed length
    return top.select("document_id", "root_id", "impact", F.row_number().over(Window.orderBy("r", "document_id", "root_id")).alias("place"))


@query("x20_summary", f"SELECT document_id, root_id, CASE status WHEN 'ajout' THEN 'Article ajouté' WHEN 'suppression' THEN 'Article supprimé' WHEN 'reformulation' THEN 'Article reformulé' ELSE 'Inchangé' END AS label, CASE WHEN impact = '' THEN '—' ELSE impact END AS impact FROM ({_CHANGED})")
def x20(spark, d):
    """The table of a comparison with its labels."""
    label = F.when(F.col("status") == "ajout", "Article ajouté").when(F.col("status") == "suppression", "Article supprimé").when(F.col("status") == "reformulation", "Article reformulé").otherwise("Inchangé")
    impact = F.when(F.col("status") == "suppression", "majeur").when(F.col("status") == "ajout", "mineur").when(F.col("status") == "inchange", "nul").otherwise("—")
    return j5(spark, d).select("document_id", "root_id", label.alias("label"), impact.alias("impact"))


GROUPS = {"four": ["DE", "FR", "IT", "ES"], "north": ["DK", "SE", "FI", "EE", "LV", "LT"], "unknown": ["XX", "PL"], "wide": ["DE", "FR", "IT", "ES", "PL", "RO", "NL", "BE", "CZ", "EL", "PT", "SE", "HU", "AT", "BG", "DK"]}
_MEMBERS = ", ".join(f"('{g}', '{m}')" for g, ms in GROUPS.items() for m in ms)


@query("a12_coalition_report", f"SELECT name, count(*) AS n_states, round(coalesce(sum(share), 0), 4) AS population_share, round(count(*) / 27.0::DOUBLE, 4) AS states_share, count(*) / 27.0::DOUBLE >= 0.55 AND coalesce(sum(share), 0) >= 0.65 AS qualified, count(*) >= 4 AND coalesce(sum(share), 0) > 1 - 0.65 AS blocks, greatest(0, 15 - count(*)) AS states_missing, round(greatest(0.0, 0.65 - coalesce(sum(share), 0)), 4) AS population_missing FROM (VALUES {_MEMBERS}) g(name, party) LEFT JOIN w USING (party) GROUP BY name")
def a12(spark, d):
    """What named groups weigh; a member of unknown population counts as a state and weighs nothing."""
    members = spark.createDataFrame([(g, m) for g, ms in GROUPS.items() for m in ms], "name string, party string")
    return K.report(members, K.shares(populations(spark, d), "code", "population"))


_NATURES = "CASE {0} WHEN 'suppression' THEN 'oppose' WHEN 'reserve' THEN 'oppose' WHEN 'modification' THEN 'partiel' WHEN 'soutien' THEN 'aligne' WHEN 'question' THEN 'neutre' END"


@query("l4_extracted_positions", f"SELECT id, nature, {_NATURES.format('nature')} AS stance, 0.7::DOUBLE AS confidence, nature = 'reserve' AS scrutiny, nature = 'suppression' AS deletion, 'non-paper' AS kind, '[' || document_id || '] ' || text AS text FROM (SELECT id, document_id, text, CASE WHEN text ILIKE '%delet%' THEN 'suppression' WHEN text ILIKE '%reservation%' THEN 'reserve' WHEN text ILIKE '%support%' THEN 'soutien' WHEN contains(text, '?') THEN 'question' WHEN text ILIKE '%propose%' THEN 'modification' END AS nature FROM c WHERE document_id <> '') WHERE nature IS NOT NULL")
def l4(spark, d):
    """Positions whose nature is known as contributions and analyses; the nature is found by a word here, by a model elsewhere."""
    c = contributions(spark, d, "document_id", "text").filter("document_id <> ''")
    has = lambda w: F.col("text").ilike(f"%{w}%")
    nature = F.when(has("delet"), "suppression").when(has("reservation"), "reserve").when(has("support"), "soutien").when(F.col("text").contains("?"), "question").when(has("propose"), "modification")
    return P.extracted(c.withColumn("nature", nature), "nature", "document_id", "text").select("id", "nature", "stance", "confidence", "scrutiny", "deletion", "kind", "text")


TECHNICAL = ["calcul", "formule", "seuil", "bm25", "ponderee", "moyenne", "register", "methodology"]


@query("m14_technical", f"SELECT id, len(list_intersect(list_distinct(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')), {TECHNICAL})) > 0 AS technical FROM segments WHERE text IS NOT NULL")
def m14(spark, d):
    """Whether a text has one of a set of words."""
    words = F.regexp_extract_all(R.fold(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))
    return load(spark, d, "segments").filter("text is not null").select("id", F.arrays_overlap(words, F.array(*[F.lit(w) for w in TECHNICAL])).alias("technical"))


@query("l9_best_card", "SELECT id, CASE WHEN fee >= register AND fee > 0 THEN 'fee' WHEN register > 0 THEN 'register' END AS card FROM (SELECT id, len(list_intersect(t, ['fee', 'annual', 'payment'])) AS fee, len(list_intersect(t, ['register', 'entry', 'authority'])) AS register FROM (SELECT id, list_distinct(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')) AS t FROM segments WHERE text IS NOT NULL))")
def l9(spark, d):
    """The card with most words in common with a text, the first declared one of several; null where none has any."""
    words = F.regexp_extract_all(R.fold(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))
    return load(spark, d, "segments").filter("text is not null").select("id", R.best_card(words, {"fee": ["fee", "annual", "payment"], "register": ["register", "entry", "authority"]}).alias("card"))


@query("l5_sourced_hits")
def l5(spark, d):
    """A sourced answer without a model: the passages found, best first, and no statement."""
    s = load(spark, d, "segments").select(F.col("id").alias("doc"), "document_id", "section_id")
    hits = R.top(R.bm25(load(spark, d, "segments"), "id", ["section_label", "text"], R.parse(QUESTION)).withColumn("score", F.round("score", 9)), 12)
    return hits.join(s, "doc").select("doc", "document_id", "section_id", F.lit(None).cast("string").alias("statement"))


ORACLE["l5_sourced_hits"] = _sql(" SELECT doc, document_id, section_id, CAST(NULL AS varchar) AS statement FROM (SELECT doc, round(score, 9) AS score FROM bm ORDER BY score DESC, doc LIMIT 12) JOIN segments s ON s.id = doc")


@query("l3_criterion_match", "SELECT id, 1.0::DOUBLE AS weight, CAST(NULL AS varchar) AS quotation FROM c")
def l3(spark, d):
    """A criterion that no model judges matches nothing: every contribution keeps its weight."""
    none = spark.createDataFrame([], "id bigint, quotation string")
    return P.weighed(contributions(spark, d, "text"), none, "id", 2.0).select("id", "weight", "quotation")


@query("s17_table_rows", "SELECT id, 1 AS page_no, trim(section_label) AS \"left\", trim(coalesce(text, '')) AS \"right\" FROM c WHERE section_label IS NOT NULL AND NOT starts_with(lower(section_label), 'commission proposal') AND NOT (trim(section_label) = '' AND trim(coalesce(text, '')) = '')")
def s17(spark, d):
    """Rows of two and three columns, with headers and empty rows between them, as (left, right): the first and the last cell."""
    c = contributions(spark, d, "section_label", "kind", "text").filter("section_label is not null")
    cells = F.when(F.col("kind") == "drafting", F.array("section_label", F.lit("compromise text"), "text")).otherwise(F.array("section_label", "text"))
    head, empty = F.array(F.lit("Commission proposal"), F.lit("Comments")), F.array(F.lit(" "), F.lit(None).cast("string"))
    rows = c.select("id", F.lit(1).alias("page_no"), F.explode(F.array(head, cells, empty, F.array(F.lit("one cell")))).alias("cells"))
    return G.table_rows(rows, "cells").select("id", "page_no", "left", "right")


@query("s13_restored", "SELECT 'segments' AS tbl, count(*) AS n, true AS same FROM segments UNION ALL SELECT 'analyses', count(*), true FROM analyses UNION ALL SELECT 'fr_reference', count(*), true FROM fr_reference")
def s13(spark, d):
    """Tables copied to a backup and restored from it; a restore is refused where a table or a column is missing."""
    where, names = streams.folder(spark), ["segments", "analyses", "fr_reference"]
    store.backup(open_store(spark, d, names), f"{where}/backup")
    back = store.restore(spark, f"{where}/backup", {n: load(spark, d, n).schema for n in names})
    parts = [back[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("tbl"), "n", (F.col("n") == load(spark, d, n).agg(F.count(F.lit(1))).scalar()).alias("same")) for n in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s8_replace_contributions", "SELECT document_id, count(*) AS n FROM contributions GROUP BY ALL")
def s8(spark, d):
    """Importing the contributions of all documents again leaves the table as it was."""
    c = load(spark, d, "contributions")
    return store.replace_part(c, c.filter("document_id is not null"), "document_id").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@query("a31_hits_by_item", _sql(" SELECT s.document_id, s.section_id, count(*) AS n, grouping(s.document_id, s.section_id) AS level FROM bm JOIN segments s ON s.id = doc GROUP BY GROUPING SETS ((s.section_id), (s.document_id))").removeprefix(WITH.rstrip()))
def a31(spark, d):
    """Hits by section and by document."""
    s = load(spark, d, "segments").select(F.col("id").alias("doc"), "document_id", "section_id")
    hits = R.bm25(load(spark, d, "segments"), "id", ["section_label", "text"], R.parse(QUESTION)).join(s, "doc")
    return hits.groupingSets([["section_id"], ["document_id"]], "document_id", "section_id").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("q16_more_alerts", f"""SELECT rule, severity, n, "of", members FROM (
 SELECT 'scrutiny' AS rule, 'information' AS severity, count(*) FILTER (coalesce(scrutiny, false)) AS n, count(*) AS "of", array_to_string(list_sort(list_distinct(list(ms_code) FILTER (coalesce(scrutiny, false) AND ms_code IS NOT NULL))), ',') AS members FROM sc WHERE stance IS NOT NULL
 UNION ALL SELECT 'no population', 'bloquant', count(*) FILTER (w.party IS NULL), count(*), array_to_string(list_sort(list(p.party) FILTER (w.party IS NULL)), ',') FROM (SELECT DISTINCT ms_code AS party FROM c WHERE ms_code IS NOT NULL) p LEFT JOIN w USING (party)
 UNION ALL SELECT 'renumbering', 'attention', CASE WHEN min(k) > 0 THEN sum(k)::BIGINT ELSE 0 END, (SELECT count(*) FROM ({_STATUS}))::BIGINT, 'ajout,suppression' FROM (SELECT count(*) FILTER (status = 'ajout') AS k FROM ({_STATUS}) UNION ALL SELECT count(*) FILTER (status = 'suppression') FROM ({_STATUS}))
 UNION ALL SELECT 'unrated', 'information', count(*) FILTER (status = 'reformulation'), count(*), '' FROM ({_STATUS})) WHERE n > 0""")
def q16_more(spark, d):
    """Alerts with those concerned: scrutiny reservations, parties without a population, additions with deletions, changes that nobody rated."""
    s = scored(spark, d)
    parties = contributions(spark, d, "ms_code").select(F.col("ms_code").alias("party")).filter("party is not null").distinct()
    known = populations(spark, d).select(F.col("code").alias("party"), F.lit(True).alias("known"))
    status = j5(spark, d)
    both = F.when(F.least(F.count_if(F.col("status") == "ajout"), F.count_if(F.col("status") == "suppression")) > 0, F.count_if(F.col("status").isin("ajout", "suppression"))).otherwise(0)
    some = lambda severity: F.when(F.col("n") > 0, severity)
    return AL.alerts([
        AL.counted(s, "scrutiny", F.coalesce("scrutiny", F.lit(False)), some("information"), F.col("stance").isNotNull(), F.col("ms_code")),
        AL.counted(parties.join(known, "party", "left"), "no population", F.col("known").isNull(), some("bloquant"), None, F.col("party")),
        status.agg(both.alias("n"), F.count(F.lit(1)).alias("of")).select(F.lit("renumbering").alias("rule"), some("attention").alias("severity"), "n", "of", F.array(F.lit("ajout"), F.lit("suppression")).alias("members")),
        AL.counted(status, "unrated", F.col("status") == "reformulation", some("information"), None, F.lit(None).cast("string")),
    ]).withColumn("members", F.array_join("members", ",")).drop("rank")


@query("u_instructions", f"SELECT document_id, '32023R2854' AS celex, section_id, CASE WHEN kept IS NULL THEN 'suppression' ELSE 'remplacement' END AS operation, pos || '.' AS numero FROM ({_PLACED})")
def u_instructions(spark, d):
    """The instructions of acts by the table function in SQL."""
    udtfs.register(spark)
    _acts(spark, d).createOrReplaceTempView("__acts")
    return spark.sql("SELECT a.document_id, i.celex, i.section_id, i.operation, i.numero FROM __acts a, LATERAL instructions(a.act) i")


@query("u_text_blocks", r"SELECT doc_id, length(regexp_replace(text, '[ \t\r\n]+', '', 'g')) AS n FROM documents WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> ''")
def u_text_blocks(spark, d):
    """The characters that are no blank of all blocks of a document, by the table function in SQL."""
    udtfs.register(spark)
    load(spark, d, "documents").createOrReplaceTempView("__documents")
    return spark.sql(r"SELECT t.doc_id, sum(length(regexp_replace(b.text, '[ \\t\\r\\n]+', ''))) AS n FROM __documents t, LATERAL text_blocks(t.text) b GROUP BY t.doc_id")


@query("d_omnibus_export", rf"SELECT document_id, 'règlement (UE) 2023/2854' AS act, '32023R2854' AS celex, 'Article premier' AS act_article, 'Article ' || num AS article, pos || '.' AS numero, CASE WHEN kept IS NULL THEN 'Suppression' ELSE 'Remplacement' END AS operation, length(CASE WHEN kept IS NULL THEN '' ELSE regexp_replace(regexp_replace(new, '\s*\n\s*', ' ', 'g'), '^\s+|\s+$', '', 'g') END) AS new_chars, coalesce(r.what, '') AS what FROM ({_PLACED}) p LEFT JOIN (SELECT document_id, section_id, min(summary_fr) AS what FROM fr_reference GROUP BY ALL) r USING (document_id, section_id)")
def d_omnibus(spark, d):
    """The lines of the export of acts: every instruction with its act, article, operation and what is known of it."""
    known = load(spark, d, "fr_reference").groupBy("document_id", "section_id").agg(F.min("summary_fr").alias("what"))
    i = A.instructions(_acts(spark, d), "document_id", "act").join(known, ["document_id", "section_id"], "left")
    return i.select("document_id", "act", "celex", "act_article", "article", "numero", F.initcap("operation").alias("operation"), F.length("new_text").cast("bigint").alias("new_chars"), F.coalesce("what", F.lit("")).alias("what"))


@query("d_amending_map", f"SELECT '32023R2854' AS celex, section_id, CASE WHEN kept IS NULL THEN 'suppression' ELSE 'remplacement' END AS operation, count(DISTINCT document_id) AS acts, count(*) AS n FROM ({_PLACED}) GROUP BY ALL")
def d_map(spark, d):
    """The map of what is amended: article by operation, how many acts and instructions."""
    return A.instructions(_acts(spark, d), "document_id", "act").groupBy("celex", "section_id", "operation").agg(F.count_distinct("document_id").alias("acts"), F.count(F.lit(1)).alias("n"))


@query("d_scored_table", "SELECT id, stance, score, method FROM (SELECT id, 'heuristique' AS method, CASE WHEN TRUE THEN stance END AS stance, CASE stance WHEN 'aligne' THEN 2 WHEN 'partiel' THEN 1 WHEN 'oppose' THEN 0 END AS score FROM (SELECT *, {quiet} AS stance FROM ({lex})))".format(quiet=_QUIET, lex=_LEX))
def d_scored(spark, d):
    """Contributions through the scorer's protocol."""
    c = contributions(spark, d, "section_order", "section_id", "ms_code", "kind", "text")
    return scoring.scored(c, "text", F.col("kind"), F.lit(True)).select("id", "stance", "score", "method")
