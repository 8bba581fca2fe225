"""Queries of the smaller operators: filters, lookups, orders, set operations, scalar functions, rules over results."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from concordat.functions import labels as L
from concordat.operators import amend as A, coalition as K, compare as C, positions as P, search as R, segment as G, sequence as S
from concordat.plans.base import ITEM, WITH, analyses, contributions, populations, scored
from concordat.plans.documents import _acts
from concordat.plans.positions import _matrix, _rates, _themes, _weights
from concordat.plans.texts import _KEY
from concordat.sources.tables import load
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


@query("s4_contributions_of_documents", "SELECT id, section_order, ms_code, stance FROM sc WHERE document_id IN (SELECT id FROM library_documents WHERE kind = 'wk_table') ORDER BY section_order, ms_code, id")
def s4(spark, d):
    tables = load(spark, d, "library_documents").filter("kind = 'wk_table'").select(F.col("id").alias("document_id"))
    return scored(spark, d).join(tables, "document_id", "left_semi").select("id", "section_order", "ms_code", "stance").orderBy("section_order", "ms_code", "id")


@query("s9_appended_ids", "SELECT count(*) AS n, count(DISTINCT id) AS n_ids FROM c")
def s9(spark, d):
    """Appended rows get ids from their content, so that writing them again changes nothing."""
    c = contributions(spark, d)
    new = c.withColumn("new_id", F.xxhash64("id", "document_id", "section_id", "text"))
    return new.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("new_id").alias("n_ids"))


@query("s24_contributions_csv", "SELECT ms_code, count(*) AS n, sum(length(text)) AS n_chars FROM c WHERE ms_code IS NOT NULL AND text IS NOT NULL AND text <> '' GROUP BY ALL")
def s24(spark, d):
    """The contributions through a CSV file and back, line breaks and quotes kept."""
    where = streams.folder(spark)
    options = {"header": True, "escape": '"', "multiLine": True, "lineSep": "\n"}
    contributions(spark, d, "ms_code", "text").filter("ms_code is not null and text is not null and text <> ''").write.options(**{k: v for k, v in options.items() if k != "multiLine"}).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(where)
    back = spark.read.options(**options).csv(where)
    return back.groupBy("ms_code").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("n_chars"))


@query("s29_audit", "SELECT contribution_id, model, sha256(evidence) AS prompt_sha256, length(evidence) AS prompt_chars, confidence > 0 AS ok FROM an WHERE evidence IS NOT NULL")
def s29(spark, d):
    return analyses(spark, d).filter("evidence is not null").select("contribution_id", "model", F.sha2("evidence", 256).alias("prompt_sha256"), F.char_length("evidence").alias("prompt_chars"), (F.col("confidence") > 0).alias("ok"))


@query("s31_postings_per_document", "SELECT document_id, sum(len(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+')) + len(regexp_extract_all(strip_accents(lower(coalesce(section_label, ''))), '[\\p{L}\\p{N}]+'))) AS n FROM segments GROUP BY ALL")
def s31(spark, d):
    s = load(spark, d, "segments")
    post = R.postings(s, "id", ["section_label", "text"]).groupBy(F.col("doc").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("id", "document_id").join(post, "id", "left").groupBy("document_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("deriv_p12_usual_name", "SELECT id, coalesce(CASE kind WHEN 'legal_text' THEN 'Texte' WHEN 'wk_table' THEN 'Tableau' END, nullif(version_label, ''), name) AS usual_name FROM library_documents")
def p12(spark, d):
    """A name by catalogue, else by label, else by file."""
    catalogue = spark.createDataFrame([("legal_text", "Texte"), ("wk_table", "Tableau")], "kind string, usual string")
    l = load(spark, d, "library_documents").join(F.broadcast(catalogue), "kind", "left")  # two rows
    return l.select("id", F.coalesce("usual", F.nullif("version_label", F.lit("")), "name").alias("usual_name"))


@query("deriv_p14_machine_names", "SELECT id, regexp_matches(coalesce(fichier, ''), '^[0-9a-f]{16}\\.(pdf|docx)$') AS machine FROM library_documents")
def p14(spark, d):
    return load(spark, d, "library_documents").select("id", F.coalesce("fichier", F.lit("")).rlike(r"^[0-9a-f]{16}\.(pdf|docx)$").alias("machine"))


@query("deriv_p18_article_of_text", "SELECT id, CASE WHEN n = '' THEN 'general' ELSE 'art_' || n END AS section FROM (SELECT id, regexp_extract(coalesce(text, '')[:300], '(?i)\\bart(?:icle|\\.)\\s*(\\d+)', 1) AS n FROM c)")
def p18(spark, d):
    n = F.regexp_extract(F.substring(F.coalesce("text", F.lit("")), 1, 300), r"(?i)\bart(?:icle|\.)\s*(\d+)", 1)
    return contributions(spark, d, "text").select("id", F.when(n == "", "general").otherwise(F.concat(F.lit("art_"), n)).alias("section"))


@query("deriv_p23_impact_remap", "SELECT document_id, section_id, 'redactionnel' AS impact FROM segments JOIN (SELECT id, text AS new FROM (SELECT DISTINCT id, text FROM segments_copy)) USING (id) WHERE text <> new")
def p23(spark, d):
    """A touched article whose change was rated nil is a matter of wording."""
    new = load(spark, d, "segments_copy").select("id", F.col("text").alias("new")).distinct()
    rated = load(spark, d, "segments").join(new, "id").filter("text <> new").withColumn("impact", F.lit("nul"))
    return rated.select("document_id", "section_id", F.when(F.col("impact") == "nul", "redactionnel").otherwise(F.col("impact")).alias("impact"))


@query("deriv_p27_display_row", "SELECT id, CASE stance WHEN 'aligne' THEN 'Aligné' WHEN 'partiel' THEN 'Partiel' WHEN 'oppose' THEN 'Opposé' WHEN 'neutre' THEN 'Neutre' ELSE 'Sans contribution' END AS stance, CASE WHEN scrutiny THEN 'oui' ELSE '' END AS scrutiny, CASE WHEN deletion THEN 'oui' ELSE '' END AS deletion FROM sc")
def p27(spark, d):
    # Stance labels.
    names = {"aligne": "Aligné", "partiel": "Partiel", "oppose": "Opposé", "neutre": "Neutre"}
    label = F.lit("Sans contribution")
    for k, v in names.items():
        label = F.when(F.col("stance") == k, v).otherwise(label)
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), "oui").otherwise("").alias(c)
    return scored(spark, d).select("id", label.alias("stance"), yes("scrutiny"), yes("deletion"))


@query("f1_scored_only", "SELECT id, score FROM sc WHERE score IS NOT NULL")
def f1(spark, d):
    return scored(spark, d).filter("score is not null").select("id", "score")


@query("f2_without_reference_party", "SELECT id FROM c WHERE ms_code <> 'FR'")
def f2(spark, d):
    return contributions(spark, d, "ms_code").filter("ms_code <> 'FR'").select("id")


@query("f3_multi_select", "SELECT 'two' AS choice, count(*) AS n FROM c WHERE ms_code IN ('DE', 'IT') UNION ALL SELECT 'none', count(*) FROM c")
def f3(spark, d):
    from concordat.operators.store import facet

    c = contributions(spark, d, "ms_code")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("choice"), "n")
    return n(facet(c, "ms_code", ["DE", "IT"]), "two").unionByName(n(facet(c, "ms_code", []), "none"))


@query("f6_non_empty", "SELECT id FROM c WHERE trim(coalesce(text, '')) NOT IN ('', '-', '–', '—')")
def f6(spark, d):
    return contributions(spark, d, "text").filter(~F.trim(F.coalesce("text", F.lit(""))).isin("", "-", "–", "—")).select("id")


@query("f7_min_length", "SELECT id FROM segments WHERE length(text) >= 120")
def f7(spark, d):
    return load(spark, d, "segments").filter(F.char_length("text") >= 120).select("id")


@query("f9_amending_acts", "SELECT DISTINCT document_id AS id FROM (SELECT a.document_id FROM segments a LEFT JOIN (SELECT DISTINCT id, text FROM segments_copy WHERE text IS NOT NULL) b USING (id) WHERE regexp_matches(a.section_id, '^art_\\d+$') AND a.text IS NOT NULL AND (b.id IS NULL OR (a.text <> b.text AND NOT regexp_matches(b.text, '[«»]'))))")
def f9(spark, d):
    acts = _acts(spark, d)
    formula, title = F.regexp_count("act", F.lit(r"(?i)est\s+modifi[ée]e?\s+comme\s+suit")), F.regexp_count("act", F.lit(r"(?im)^\s*modifications?\s+(?:du|de la|des)\s+(?:r[èe]glement|directive|d[ée]cision)"))
    return acts.filter((formula >= 1) & ((title >= 1) | (formula >= 3))).select(F.col("document_id").alias("id"))


@query("f13_search_in_instructions", "SELECT id FROM c WHERE contains(lower(text), 'retention') OR contains(lower(section_label), 'retention')")
def f13(spark, d):
    asked = "retention"
    return contributions(spark, d, "text", "section_label").filter(F.lower("text").contains(asked) | F.lower("section_label").contains(asked)).select("id")


@query("f14_above_word_cap", "SELECT id, len(string_split_regex(trim(text), '\\s+')) > 400 AS cut FROM segments WHERE text IS NOT NULL")
def f14(spark, d):
    return load(spark, d, "segments").filter("text is not null").select("id", (F.size(F.split(F.trim("text"), r"\s+")) > 400).alias("cut"))


@query("j11_party_population", "SELECT ms_code AS party, coalesce(sum(share), 0) AS share FROM (SELECT DISTINCT ms_code FROM c) LEFT JOIN w ON party = ms_code GROUP BY ALL")
def j11(spark, d):
    p = contributions(spark, d, "ms_code").select(F.col("ms_code").alias("party")).distinct()
    return p.join(_weights(spark, d), "party", "left").select("party", F.coalesce("share", F.lit(0.0)).alias("share"))


@query("j20_concepts_of_items", "SELECT theme, string_agg(DISTINCT section_id, ',' ORDER BY section_id) AS items FROM (SELECT DISTINCT theme, section_id FROM (SELECT unnest(themes) AS theme, contribution_id FROM analyses) JOIN c ON c.id = contribution_id WHERE theme IS NOT NULL AND section_id IS NOT NULL) GROUP BY theme HAVING count(DISTINCT section_id) > 1")
def j20(spark, d):
    """The inverted index from concept to the items that carry it, for concepts on more than one."""
    t = load(spark, d, "analyses").select(F.col("contribution_id").alias("id"), F.explode("themes").alias("theme")).filter("theme is not null")
    both = t.join(contributions(spark, d, "section_id"), "id").filter("section_id is not null").select("theme", "section_id").distinct()
    return both.groupBy("theme").agg(F.array_join(F.array_sort(F.collect_set("section_id")), ",").alias("items"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


@query("a11_blocking_minorities", "SELECT item, count(*) AS n, sum(share) AS share, count(*) >= 4 AND sum(share) > 1 - 0.65::DOUBLE AS blocks FROM (SELECT section_id AS item, party FROM m GROUP BY section_id, party HAVING min(score) = 0) JOIN w USING (party) GROUP BY item")
def a11(spark, d):
    no = P.matrix(scored(spark, d), ["section_id"], "ms_code", "score", "FR").filter("score = 0")
    g = no.join(_weights(spark, d), "party").groupBy(F.col("section_id").alias("item")).agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("share"))
    return g.withColumn("blocks", (F.col("n") >= K.BLOCKING_STATES) & (F.col("share") > 1 - K.POPULATION_SHARE))


@query("a14_best_additions", "SELECT party, share, n0 + 1 AS n_with, share0 + share AS share_with, n0 + 1 >= 4 AND share0 + share > 1 - 0.65::DOUBLE AS blocks, false AS reaches FROM w, (SELECT count(*) AS n0, sum(share) AS share0 FROM w WHERE party IN ('FR', 'DE')) WHERE party IN ('MT', 'ES', 'LU')")
def a14(spark, d):
    w = _weights(spark, d)
    return K.additions(w.select("party").filter(F.col("party").isin("FR", "DE")), w.select("party").filter(F.col("party").isin("MT", "ES", "LU")), w)


@query("a27_load_by_document", "SELECT document_id, count(DISTINCT section_id) AS n_items, count(*) AS n, count(*) FILTER (stance = 'oppose') AS n_oppose FROM sc GROUP BY ALL")
def a27(spark, d):
    return scored(spark, d).groupBy("document_id").agg(F.countDistinct("section_id").alias("n_items"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("stance") == "oppose").alias("n_oppose"))


@query("a30_audit_metrics", "SELECT count(*) AS n, avg(CASE WHEN confidence > 0 THEN 1.0 ELSE 0.0 END) AS ok, median(confidence) AS median_confidence FROM (SELECT * FROM an ORDER BY analysed_at DESC NULLS LAST, contribution_id LIMIT 1000)")
def a30(spark, d):
    last = analyses(spark, d).orderBy(F.col("analysed_at").desc_nulls_last(), "contribution_id").limit(1000)
    return last.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("confidence") > 0, 1.0).otherwise(0.0)).alias("ok"), F.median("confidence").alias("median_confidence"))


@query("a33_discriminates", "SELECT item, count(*) FILTER (score = 0) > 0.6 * count(*) AS one_sided FROM (SELECT section_id AS item, score FROM m) GROUP BY item")
def a33(spark, d):
    return _matrix(spark, d).groupBy(F.col("section_id").alias("item")).agg((F.count_if(F.col("score") == 0) > 0.6 * F.count(F.lit(1))).alias("one_sided"))


@query("a37_missing_to_block", "SELECT item, greatest(0, 4 - count(*)) AS states, greatest(0, 1 - 0.65::DOUBLE - sum(share)) AS share FROM (SELECT section_id AS item, party FROM m GROUP BY section_id, party HAVING min(score) = 0) JOIN w USING (party) GROUP BY item")
def a37(spark, d):
    b = a11(spark, d)
    return b.select("item", F.greatest(F.lit(0), F.lit(K.BLOCKING_STATES) - F.col("n")).alias("states"), F.greatest(F.lit(0.0), F.lit(1 - K.POPULATION_SHARE) - F.col("share")).alias("share"))


@query("w10_last_wins", "SELECT section_id, arg_max(source, (coalesce(updated_at, TIMESTAMP '1900-01-01'), document_id)) AS source FROM fr_reference WHERE section_id IS NOT NULL AND document_id IS NOT NULL AND source IS NOT NULL GROUP BY ALL")
def w10(spark, d):
    f = load(spark, d, "fr_reference").filter("section_id is not null and document_id is not null and source is not null")
    return f.groupBy("section_id").agg(F.max_by("source", F.struct(F.coalesce("updated_at", F.lit("1900-01-01").cast("timestamp_ntz")), "document_id")).alias("source"))


@query("w13_page_of_offset", "SELECT id, len(list_filter(range(0, length(text), 1000), lambda x: x <= strpos(text, '.') - 1)) AS page FROM segments WHERE contains(text, '.')")
def w13(spark, d):
    """The page, 1,000 characters each, on which the first full stop of a segment stands."""
    at = F.instr("text", ".") - 1
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / 1000).cast("int")), lambda x: x * 1000)
    return load(spark, d, "segments").filter(F.col("text").contains(".")).select("id", F.size(F.filter(starts, lambda x: x <= at)).cast("bigint").alias("page"))


@query("t3_head", "SELECT id FROM segments ORDER BY section_order, id LIMIT 60")
def t3(spark, d):
    return load(spark, d, "segments").orderBy("section_order", "id").select("id").limit(60)


@query("t4_largest", "SELECT ms_code, count(*) AS n FROM c GROUP BY ALL ORDER BY n DESC, ms_code NULLS FIRST LIMIT 5")
def t4(spark, d):
    return contributions(spark, d, "ms_code").groupBy("ms_code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ms_code").limit(5)


@query("t8_document_order", "SELECT id, row_number() OVER (ORDER BY CASE kind WHEN 'legal_text' THEN 0 WHEN 'wk_table' THEN 1 ELSE 2 END, version_date NULLS FIRST, name, id) AS place FROM library_documents")
def t8(spark, d):
    rank = F.when(F.col("kind") == "legal_text", 0).when(F.col("kind") == "wk_table", 1).otherwise(2)
    return load(spark, d, "library_documents").select("id", F.row_number().over(Window.orderBy(rank, "version_date", "name", "id")).alias("place"))


_SETS = "SELECT '{0}' AS side, count(*) AS n FROM (SELECT DISTINCT document_id, section_id FROM segments WHERE document_id IS NOT NULL AND section_id IS NOT NULL {1} SELECT DISTINCT document_id, section_id FROM contributions WHERE document_id IS NOT NULL AND section_id IS NOT NULL)"


@query("u1_set_operations", " UNION ALL ".join(_SETS.format(n, o) for n, o in (("union", "UNION"), ("both", "INTERSECT"), ("segments only", "EXCEPT"))))
def u1(spark, d):
    a, b = (load(spark, d, t).select("document_id", "section_id").na.drop().distinct() for t in ("segments", "contributions"))
    parts = [("union", a.union(b).distinct()), ("both", a.intersect(b)), ("segments only", a.exceptAll(b))]
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("side"), "n") for n, df in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("m4_folded", "SELECT id, array_to_string(regexp_extract_all(strip_accents(lower(text)), '[a-z]+'), ' ') AS folded FROM segments WHERE text IS NOT NULL")
def m4(spark, d):
    """The Latin words of a text in folded form; other scripts keep their accents."""
    return load(spark, d, "segments").filter("text is not null").select("id", F.array_join(F.regexp_extract_all(R.fold(F.col("text")), F.lit("[a-z]+"), F.lit(0)), " ").alias("folded"))


@query("m8_word_counts", "SELECT id, len(regexp_extract_all(text, '\\S+')) AS n FROM segments WHERE text IS NOT NULL")
def m8(spark, d):
    return load(spark, d, "segments").filter("text is not null").select("id", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).cast("bigint").alias("n"))


_STEMS = "list_transform(list_filter(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+'), lambda x: length(x) > 2), lambda x: CASE WHEN length(x) > 3 AND (ends_with(x, 's') OR ends_with(x, 'x')) THEN x[:-2] ELSE x END)"


@query("m13_stems", f"SELECT id, len(list_distinct({_STEMS})) AS n FROM segments WHERE text IS NOT NULL")
def m13(spark, d):
    """Distinct crude stems: words of more than two letters without a final s or x."""
    words = F.filter(F.regexp_extract_all(R.fold(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.length(x) > 2)
    stems = F.transform(words, lambda x: F.when((F.length(x) > 3) & x.rlike("[sx]$"), x.substr(F.lit(1), F.length(x) - 1)).otherwise(x))
    return load(spark, d, "segments").filter("text is not null").select("id", F.size(F.array_distinct(stems)).cast("bigint").alias("n"))


@query("m12_card_scores", f"SELECT id, 3 * len(list_intersect(list_distinct({_STEMS}), ['register', 'fee'])) + 2 * len(list_intersect(list_distinct({_STEMS}), ['annual', 'authority'])) AS score FROM segments WHERE text IS NOT NULL")
def m12(spark, d):
    """Help cards by weighted overlaps of stems: three for a key word, two for a word of the question."""
    words = F.filter(F.regexp_extract_all(R.fold(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.length(x) > 2)
    stems = F.transform(words, lambda x: F.when((F.length(x) > 3) & x.rlike("[sx]$"), x.substr(F.lit(1), F.length(x) - 1)).otherwise(x))
    overlap = lambda *w: F.size(F.array_intersect(stems, F.array(*[F.lit(x) for x in w])))
    return load(spark, d, "segments").filter("text is not null").select("id", (overlap("register", "fee") * 3 + overlap("annual", "authority") * 2).cast("bigint").alias("score"))


@query("m23_json_lists", "SELECT contribution_id, len(themes) AS n FROM analyses WHERE themes IS NOT NULL")
def m23(spark, d):
    """Themes as JSON text and back; malformed text becomes null."""
    a = load(spark, d, "analyses").filter("themes is not null").select("contribution_id", F.to_json("themes").alias("j"))
    return a.select("contribution_id", F.size(F.from_json("j", "array<string>")).cast("bigint").alias("n"))


@query("m24_json_in_text", "SELECT id, CASE WHEN contains(text, '{') OR contains(text, '}') THEN NULL ELSE ms_code END AS party FROM c WHERE text IS NOT NULL AND ms_code IS NOT NULL")
def m24(spark, d):
    """A JSON object found between other words."""
    c = contributions(spark, d, "text", "ms_code").filter("text is not null and ms_code is not null")
    said = F.concat("text", F.lit(' {"party": "'), "ms_code", F.lit('"} '))
    return c.select("id", F.from_json(F.regexp_extract(said, r"(?s)\{.*\}", 0), "party string")["party"].alias("party"))


@query("x2_left_cells", "SELECT * FROM (VALUES ('Article 5', 'art_5'), ('Art. 7a text', 'art_7a'), ('Recital 12', 'rec_12'), ('General comments', 'general'), ('Annex I', 'annex'), ('of the Article 5', NULL), ('', NULL)) t(cell, section_id)")
def x2(spark, d):
    t = spark.createDataFrame([(x,) for x in ("Article 5", "Art. 7a text", "Recital 12", "General comments", "Annex I", "of the Article 5", "")], "cell string")
    return t.select("cell", G.left_cell(F.col("cell"))[0].alias("section_id"))


@query("x3_merged_contributions", "SELECT document_id, section_id, ms_code, kind, min(id) AS first_id, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY document_id ORDER BY section_order, id, text, ms_code ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN section_id IS DISTINCT FROM lag(section_id) OVER w OR ms_code IS DISTINCT FROM lag(ms_code) OVER w OR kind IS DISTINCT FROM lag(kind) OVER w THEN 1 ELSE 0 END AS b FROM (SELECT DISTINCT id, document_id, section_order, section_id, ms_code, kind, text FROM contributions) WINDOW w AS (PARTITION BY document_id ORDER BY section_order, id, text, ms_code))) GROUP BY document_id, island, section_id, ms_code, kind")
def x3(spark, d):
    c = contributions(spark, d, "document_id", *ITEM, "ms_code", "kind", "text")
    i = S.islands(c, ["document_id"], ["section_order", "id", "text", "ms_code"], ["section_id", "ms_code", "kind"])
    return i.groupBy("document_id", "island", "section_id", "ms_code", "kind").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).drop("island")


@query("x16_article_status", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN b.id IS NULL AND regexp_matches(a.section_id, '^art_\\d+$') AND a.text IS NOT NULL THEN 'Supprimé' WHEN regexp_matches(a.section_id, '^art_\\d+$') AND a.text <> b.text THEN 'Modifié' ELSE 'Inchangé' END AS status FROM segments a LEFT JOIN (SELECT DISTINCT id, text FROM segments_copy WHERE text IS NOT NULL) b USING (id)) GROUP BY status")
def x16(spark, d):
    done = A.applied(load(spark, d, "segments"), A.instructions(_acts(spark, d), "document_id", "act"))
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("l2_derived_reference", "SELECT document_id, section_id, left(string_agg(text, ' ' ORDER BY id), 600) AS reference FROM c WHERE ms_code = 'FR' AND text IS NOT NULL AND document_id IS NOT NULL GROUP BY ALL")
def l2(spark, d):
    """The reference party's words on a section, where no model derives them."""
    c = contributions(spark, d, "document_id", "section_id", "ms_code", "text").filter("ms_code = 'FR' and text is not null and document_id is not null")
    before = F.sum(F.length("text") + 1).over(Window.partitionBy("document_id", "section_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    near = c.withColumn("before", F.coalesce(before, F.lit(0))).filter("before <= 600")  # only rows that reach into the 600 characters are collected
    lines = F.array_sort(F.collect_list(F.struct("id", F.substring("text", 1, 600).alias("text"))))
    return near.groupBy("document_id", "section_id").agg(F.substring(F.array_join(lines["text"], " "), 1, 600).alias("reference"))


@query("l7_rated_changes", "SELECT a.id, CASE WHEN a.text = b.text THEN 'nul' ELSE '' END AS impact FROM segments a JOIN (SELECT DISTINCT id, text FROM segments_copy) b USING (id) WHERE a.text IS NOT NULL AND b.text IS NOT NULL")
def l7(spark, d):
    b = load(spark, d, "segments_copy").select("id", F.col("text").alias("new")).distinct()
    return load(spark, d, "segments").join(b, "id").filter("text is not null and new is not null").select("id", F.when(F.col("text") == F.col("new"), "nul").otherwise("").alias("impact"))


@query("g2_mean_rates", "SELECT party, avg(rate) AS mean_rate, count(*) AS n FROM (SELECT a AS party, rate FROM rates UNION ALL SELECT b, rate FROM rates) GROUP BY party")
def g2(spark, d):
    """How much each party agrees with the others on the whole."""
    r = _rates(spark, d)
    return r.select(F.col("a").alias("party"), "rate").unionByName(r.select(F.col("b").alias("party"), "rate")).groupBy("party").agg(F.avg("rate").alias("mean_rate"), F.count(F.lit(1)).alias("n"))


@query("g3_version_layers", "SELECT l.id, row_number() OVER (PARTITION BY dossier ORDER BY version_date, id) - 1 AS layer FROM library_documents l WHERE version_date IS NOT NULL")
def g3(spark, d):
    """Longest-path layers of the graph in which each version of a dossier follows the earlier ones; on a chain that is its place."""
    l = load(spark, d, "library_documents").filter("version_date is not null")
    return l.select("id", (F.row_number().over(Window.partitionBy("dossier").orderBy("version_date", "id")) - 1).alias("layer"))
