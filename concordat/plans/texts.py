"""Queries of the text derivations: orders, labels, previews, version marks, carried titles, rejoined fragments."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from concordat.functions import labels as L
from concordat.operators import sequence as S
from concordat.plans.base import WITH, contributions
from concordat.sources.tables import load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = WITH + sql
        return f

    return register


_SECTION_ORDER = r"""CASE WHEN head IN ('expose','preambule','preamble','general','generalites','annexe','annexes') THEN CASE head WHEN 'expose' THEN -3000000 WHEN 'annexe' THEN 90000000 WHEN 'annexes' THEN 90000000 ELSE -2000000 END + CASE WHEN head = sid THEN 0 ELSE coalesce(try_cast(regexp_replace(rest, '\D', '', 'g') AS BIGINT), 0) END
 ELSE coalesce(try_cast(regexp_replace(body, '\D', '', 'g') AS BIGINT), 9900) * 1000 + CASE WHEN regexp_extract(body, '([a-z])', 1) = '' THEN 0 ELSE least(ascii(regexp_extract(body, '([a-z])', 1)) - 96, 26) END * 10 + least(coalesce(try_cast(regexp_extract(rest, '^[^_]*_(\d+)$', 1) AS BIGINT), 0), 9) + CASE WHEN head = 'art' THEN 0 ELSE 10000000 END END"""


@query("deriv_p1_section_order", f"SELECT section_id, {_SECTION_ORDER} AS place FROM (SELECT *, split_part(rest, '_', 1) AS body FROM (SELECT section_id, sid, split_part(sid, '_', 1) AS head, regexp_extract(sid, '^[^_]*_(.*)$', 1) AS rest FROM (SELECT DISTINCT section_id, lower(trim(section_id)) AS sid FROM c WHERE section_id IS NOT NULL)))")
def p1_order(spark, d):
    return contributions(spark, d, "section_id").select("section_id").distinct().filter("section_id is not null").select("section_id", L.section_order(F.col("section_id")).alias("place"))


@query("deriv_p2_char_count_check", "SELECT id, char_count, length(text) AS n_chars FROM c WHERE char_count IS DISTINCT FROM length(text)")
def p2_chars(spark, d):
    c = contributions(spark, d, "char_count", "text")
    return c.select("id", "char_count", F.char_length("text").cast("bigint").alias("n_chars")).filter(~F.col("char_count").eqNullSafe(F.col("n_chars")))


@query("deriv_p4_provision", r"""SELECT id, CASE WHEN regexp_matches(h, '(?i)\bart(?:icle)?s?\.?\s*(\d+\s*(?:bis|ter|quater)?)\s*[\(§]\s*(\d+[a-z]?)') THEN '§ ' || regexp_extract(h, '(?i)\bart(?:icle)?s?\.?\s*(\d+\s*(?:bis|ter|quater)?)\s*[\(§]\s*(\d+[a-z]?)\s*\)?(?:\s*\(\s*([a-z])\s*\))?', 2) || coalesce(' (' || nullif(regexp_extract(h, '(?i)\bart(?:icle)?s?\.?\s*(\d+\s*(?:bis|ter|quater)?)\s*[\(§]\s*(\d+[a-z]?)\s*\)?(?:\s*\(\s*([a-z])\s*\))?', 3), '') || ')', '')
 WHEN regexp_matches(h, '(?i)\b(?:recital|consid[ée]rant)s?\s*\(?(\d+[a-z]?)\)?') THEN 'considérant ' || regexp_extract(h, '(?i)\b(?:recital|consid[ée]rant)s?\s*\(?(\d+[a-z]?)\)?', 1)
 WHEN regexp_matches(h, '(?i)\bparagraph[e]?\s*\(?(\d+[a-z]?)\)?') THEN '§ ' || regexp_extract(h, '(?i)\bparagraph[e]?\s*\(?(\d+[a-z]?)\)?', 1)
 WHEN regexp_matches(h, '(?i)\bpoint\s*\(?([a-z])\)?\b') THEN 'point (' || regexp_extract(h, '(?i)\bpoint\s*\(?([a-z])\)?\b', 1) || ')' ELSE '' END AS provision FROM (SELECT id, coalesce(text, '')[:220] AS h FROM c)""")
def p4(spark, d):
    return contributions(spark, d, "text").select("id", L.provision(F.col("text")).alias("provision"))


@query("deriv_p5_preview", r"""SELECT id, array_to_string(parts[:9], ' ') || CASE WHEN len(parts) > 9 THEN '…' ELSE '' END AS preview FROM (SELECT id, string_split(regexp_replace(regexp_replace(trim(coalesce(text, '')), '(?i)^(?:[-–•\s]*)(?:we\s+|our\s+delegation\s+|the\s+delegation\s+)?(?:would\s+like\s+to\s+)?', ''), '\s+', ' ', 'g'), ' ') AS parts FROM c)""")
def p5(spark, d):
    return contributions(spark, d, "text").select("id", L.preview(F.col("text")).alias("preview"))


@query("deriv_p7_full_label")
def p7(spark, d):
    return contributions(spark, d, "section_label", "text").select("id", L.full_label(F.col("section_label"), F.col("text")).alias("label"))


@query("deriv_p8_subject")
def p8(spark, d):
    return load(spark, d, "segments").select("id", L.subject(F.col("text")).alias("subject"))


@query("deriv_p9_title_order", "SELECT * FROM (VALUES ('Titre I', 1), ('Titre II', 2), ('Titre IV', 3), ('Titre X', 4), ('Chapitre 2', 5), ('Chapitre III', 6), ('Annexe', 7)) t(title, place)")
def p9(spark, d):
    t = spark.createDataFrame([(x,) for x in ("Annexe", "Titre X", "Chapitre III", "Titre II", "Titre I", "Chapitre 2", "Titre IV")], "title string")
    return t.select("title", F.row_number().over(Window.orderBy(L.title_rank(F.col("title")))).alias("place"))


_NUMBER = "'3' || dossier[:4] || '{0}' || lpad(split_part(dossier, '/', 2), 4, '0')"


@query("deriv_p10_celex", f"SELECT doc_id, {_NUMBER.format('R')} AS bare, {_NUMBER.format('R')} AS named, {_NUMBER.format('L')} AS directive, {_NUMBER.format('R')} AS address, '' AS none FROM documents WHERE dossier IS NOT NULL")
def p10(spark, d):
    """Every dossier number as it stands, as regulation, as directive, as an address with the identifier in it, and a text that names no act."""
    dossier = F.col("dossier")
    direct = F.concat(F.lit("3"), F.substring(dossier, 1, 4), F.lit("R"), F.lpad(F.substring_index(dossier, "/", -1), 4, "0"))
    said = {"bare": dossier, "named": F.concat(F.lit("règlement (UE) "), dossier), "directive": F.concat(F.lit("directive (UE) "), dossier), "address": F.concat(F.lit("https://example.org/?uri=CELEX:"), direct), "none": F.lit("bonjour")}
    return load(spark, d, "documents").filter("dossier is not null").select("doc_id", *[L.celex(c).alias(n) for n, c in said.items()])


@query("deriv_p11_celex_both", "SELECT doc_id, '32' || dossier[2:4] || 'R' || lpad(split_part(dossier, '/', 2), 4, '0') AS year_first, '32002' || 'L' || lpad(doc_id % 900 + 1, 4, '0') AS number_first FROM documents WHERE dossier LIKE '20__/%'".replace("lpad(doc_id % 900 + 1, 4, '0')", "lpad(CAST(doc_id % 900 + 1 AS varchar), 4, '0')"))
def p11(spark, d):
    """Acts in both writings: year first, as the dossiers have it, and number first."""
    held = load(spark, d, "documents").filter("dossier like '20__/%'")
    number = (F.col("doc_id") % 900 + 1).cast("string")
    return held.select("doc_id", L.celex_both(F.concat(F.lit("règlement (UE) "), "dossier")).alias("year_first"), L.celex_both(F.concat(F.lit("directive "), number, F.lit("/2002/CE"))).alias("number_first"))


@query("deriv_p15_citation", "SELECT s.id, concat_ws(' · ', nullif(s.ms_code, ''), concat_ws(', ', l.name, nullif(s.section_label, ''), CASE WHEN s.page_start IS NULL THEN NULL WHEN s.page_end IS NULL OR s.page_start = s.page_end THEN 'p. ' || s.page_start ELSE 'p. ' || s.page_start || '-' || s.page_end END)) AS citation FROM segments s JOIN library_documents l ON l.id = s.document_id")
def p15(spark, d):
    s, l = load(spark, d, "segments"), load(spark, d, "library_documents").select(F.col("id").alias("document_id"), "name")
    return s.join(l, "document_id").select("id", L.citation(F.col("ms_code"), F.col("name"), F.col("section_label"), F.col("page_start"), F.col("page_end")).alias("citation"))


_KEY = r"CASE WHEN regexp_extract({0}, '(\d+)', 1) = '' THEN lower(trim({0})) ELSE CASE WHEN regexp_matches({0}, '(?i)(consid[ée]rant|recital)') THEN 'rec' WHEN regexp_matches({0}, '(?i)\b(annexe|annex)\b') THEN 'ann' ELSE 'art' END || '_' || regexp_extract({0}, '(\d+)', 1) END"


@query("deriv_p16_match_key", f"SELECT DISTINCT section_label, {_KEY.format('section_label')} AS match_key FROM segments WHERE section_label IS NOT NULL")
def p16(spark, d):
    return load(spark, d, "segments").select("section_label").distinct().filter("section_label is not null").select("section_label", L.match_key(F.col("section_label")).alias("match_key"))


@query("deriv_p19_version_kind", "SELECT doc_id, CASE WHEN regexp_matches(t, 'journal officiel de l''union|official journal of the european|\\boj l\\b|\\bjo l\\b') THEN 'jo' WHEN regexp_matches(t, 'provisional agreement|accord provisoire|\\btrilogue\\b|four[- ]column') THEN 'trilogue' WHEN regexp_matches(t, 'general approach|orientation g[ée]n[ée]rale') THEN 'orientation' WHEN regexp_matches(t, 'european parliament.{0,40}(?:mandate|position|report)|committee on industry|\\bimco\\b|\\blibe\\b|amendments adopted by the european parliament') THEN 'mandat_pe' WHEN regexp_matches(t, 'presidency compromise|compromise (?:text|proposal)|texte de compromis|revised compromise|compromis de la pr[ée]sidence') THEN 'compromis' WHEN regexp_matches(t, 'proposal for a\\s+(?:regulation|directive)|com\\(\\d{4}\\)\\s*\\d+|proposition de r[èe]glement|explanatory memorandum') THEN 'com' ELSE 'autre' END AS kind FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def p19(spark, d):
    return load(spark, d, "documents").select("doc_id", L.version_kind(F.col("text")).alias("kind"))


@query("deriv_p20_version_date", "SELECT id, CAST(version_date AS varchar) AS in_words, CAST(version_date AS varchar) AS in_numbers, CAST(version_date AS varchar) AS first_of_two FROM library_documents")
def p20(spark, d):
    """Every version's date written in words, in numbers, and before another one; none where there is none."""
    l = load(spark, d, "library_documents")
    words = F.concat(F.lit("Brussels, "), F.date_format("version_date", "d MMMM yyyy"))
    said = {"in_words": words, "in_numbers": F.concat(F.lit("le "), F.date_format("version_date", "d.M.yyyy"), F.lit(" 40 foo 2020")), "first_of_two": F.concat(F.lit("3.4.2024 "), words)}
    return l.select("id", *[L.version_date(c).alias(n) for n, c in said.items()])


@query("deriv_p22_author_guess", "SELECT id, min_by(code, (kind, code)) AS author FROM (SELECT c.id, p.code, CASE WHEN contains(lower(c.text[:800]), lower(p.nom)) THEN 0 ELSE 1 END AS kind FROM c JOIN populations p ON contains(lower(c.text[:800]), lower(p.nom)) OR regexp_matches(c.text[:800], '(^|\\n)' || p.code || '\\s')) GROUP BY id")
def p22(spark, d):
    """The party named at the head of a text: by name before code, then in the order of codes."""
    head = F.substring("text", 1, 800)
    c, p = contributions(spark, d, "text").select("id", head.alias("h")), load(spark, d, "populations").select("code", "nom")
    by_name = F.lower("h").contains(F.lower("nom"))
    met = c.join(F.broadcast(p), by_name | F.expr("h rlike concat('(^|\\\\n)', code, '\\\\s')"))  # a membership list
    return met.groupBy("id").agg(F.min_by("code", F.struct(F.when(by_name, 0).otherwise(1), "code")).alias("author"))


@query("deriv_p24_cut_at_word", r"SELECT id, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(text[:120], '\s+\S*$', '') || '…' END AS short FROM segments")
def p24(spark, d):
    return load(spark, d, "segments").select("id", L.cut_at_word(F.col("text"), 120).alias("short"))


@query("deriv_p25_duration", "SELECT * FROM (VALUES (10.0::DOUBLE, '10 secondes'), (90.0::DOUBLE, '2 minutes'), (1316.0::DOUBLE, '22 minutes'), (4000.0::DOUBLE, '1 h 07'), (40000.0::DOUBLE, '11 heures')) t(seconds, phrase)")
def p25(spark, d):
    return spark.createDataFrame([(10.0,), (90.0,), (1316.0,), (4000.0,), (40000.0,)], "seconds double").select("seconds", L.duration(F.col("seconds")).alias("phrase"))


@query("deriv_p26_escape_html", "SELECT id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') AS html FROM segments")
def p26(spark, d):
    return load(spark, d, "segments").select("id", L.escape_html(F.col("text")).alias("html"))


_HEAD = r"^(?:Chapter|Chapitre|Kapitel|Capítulo|Article|Artikel|Artículo) \d+"


@query("w2_carried_party", "SELECT id, document_id, last_value(ms_code IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY section_order, id ROWS UNBOUNDED PRECEDING) AS carried FROM segments")
def w2(spark, d):
    """Carry-forward along the order of a document: the last party named at or before each segment."""
    return S.carry_forward(load(spark, d, "segments"), ["document_id"], ["section_order", "id"], F.col("ms_code"), "carried").select("id", "document_id", "carried")


@query("w3_previous_version", "SELECT id, lag(id) OVER (PARTITION BY name_key, section_id ORDER BY version_date, document_id) AS previous FROM (SELECT s.id, s.section_id, s.document_id, l.dossier AS name_key, l.version_date FROM segments s JOIN library_documents l ON l.id = s.document_id WHERE l.version_date IS NOT NULL)")
def w3(spark, d):
    s = load(spark, d, "segments").select("id", "section_id", "document_id")
    l = load(spark, d, "library_documents").select(F.col("id").alias("document_id"), "dossier", "version_date").filter("version_date is not null")
    w = Window.partitionBy("dossier", "section_id").orderBy("version_date", "document_id")
    return s.join(l, "document_id").select("id", F.lag("id").over(w).alias("previous"))


@query("w4_islands", "SELECT document_id, ms_code, min(id) AS first_id, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY document_id ORDER BY section_order, id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN ms_code IS DISTINCT FROM lag(ms_code) OVER w THEN 1 ELSE 0 END AS b FROM segments WINDOW w AS (PARTITION BY document_id ORDER BY section_order, id))) GROUP BY document_id, island, ms_code")
def w4(spark, d):
    s = S.islands(load(spark, d, "segments").select("id", "document_id", "section_order", "ms_code"), ["document_id"], ["section_order", "id"], ["ms_code"])
    return s.groupBy("document_id", "island", "ms_code").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).drop("island")


@query("w9_first_wins", "SELECT section_label, id FROM (SELECT section_label, id, row_number() OVER (PARTITION BY section_label ORDER BY id) AS rn FROM segments) WHERE rn = 1")
def w9(spark, d):
    return load(spark, d, "segments").groupBy("section_label").agg(F.min("id").alias("id"))


@query("w11_packing", r"""SELECT id, CAST(i - 1 AS int) AS page_no, pages[i] AS page FROM (SELECT id, pages, unnest(range(1, len(pages) + 1)) AS i FROM (SELECT id, list_reduce(list_transform(parts, lambda x: [x]), lambda acc, x: CASE WHEN length(acc[-1]) + 2 + length(x[1]) <= 600 THEN list_concat(acc[:-2], [acc[-1] || chr(10) || chr(10) || x[1]]) ELSE list_concat(acc, x) END) AS pages FROM (SELECT id, list_filter(string_split_regex(text, '\n+'), lambda x: trim(x) <> '') AS parts FROM segments WHERE text IS NOT NULL) WHERE len(parts) > 0))""")
def w11(spark, d):
    """Lines of a segment packed in order into pages of at most 600 characters."""
    s = load(spark, d, "segments").select("id", F.filter(F.split("text", "\n+"), lambda x: F.trim(x) != "").alias("parts"))
    return s.select("id", F.posexplode(S.pack(F.col("parts"), 600)).alias("page_no", "page"))


@query("w12_quote_depth", "SELECT id, list_reduce(list_prepend(0, list_transform(regexp_extract_all(text, '[«»“”]'), lambda x: CASE WHEN x IN ('«', '“') THEN 1 ELSE -1 END)), lambda acc, x: greatest(acc + x, 0)) AS depth FROM segments")
def w12(spark, d):
    """Depth of quotation at the end of a text, never below 0."""
    signs = F.regexp_extract_all("text", F.lit("[«»“”]"), F.lit(0))
    return load(spark, d, "segments").select("id", S.running_floor(F.transform(signs, lambda x: F.when(x.isin("«", "“"), 1).otherwise(-1))).alias("depth"))


@query("j10_titles_by_bounds", "SELECT section_label, title FROM (SELECT section_label, title, row_number() OVER (PARTITION BY section_label ORDER BY declared) AS rn FROM (SELECT DISTINCT section_label, try_cast(regexp_extract(section_label, '(\\d+)', 1) AS BIGINT) AS n FROM segments) JOIN (VALUES ('Titre I', 1, 20, 1), ('Titre II', 15, 60, 2), ('Titre III', 61, 97, 3)) b(title, low, high, declared) ON n BETWEEN low AND high) WHERE rn = 1")
def j10(spark, d):
    bounds = spark.createDataFrame([("Titre I", 1, 20, 1), ("Titre II", 15, 60, 2), ("Titre III", 61, 97, 3)], "title string, low int, high int, declared int")
    items = load(spark, d, "segments").select("section_label").distinct()
    return S.within_bounds(items, F.nullif(F.regexp_extract("section_label", r"(\d+)", 1), F.lit("")).cast("bigint"), bounds).select("section_label", "title")


@query("a24_rejoined", "SELECT document_id, section_id AS root_id, section_label AS label, coalesce(text, '') AS text, 1 AS n_parts FROM segments WHERE NOT regexp_matches(section_id, '^[a-z]+_\\d+[a-z]?_\\d+$')")
def a24(spark, d):
    return S.rejoin(load(spark, d, "segments"), "document_id", "section_id", "section_label", "text")


@query("a29_bounds_by_kind", "SELECT section_kind, min(n) AS low, max(n) AS high FROM (SELECT section_kind, try_cast(regexp_extract(section_label, '(\\d+)', 1) AS BIGINT) AS n FROM segments) WHERE n IS NOT NULL GROUP BY 1")
def a29(spark, d):
    n = F.nullif(F.regexp_extract("section_label", r"(\d+)", 1), F.lit("")).cast("bigint")
    return load(spark, d, "segments").select("section_kind", n.alias("n")).filter("n is not null").groupBy("section_kind").agg(F.min("n").alias("low"), F.max("n").alias("high"))


@query("s30_content_hash", "SELECT id, sha256(text) AS sha, sha256(text)[:16] AS doc_id FROM segments WHERE text IS NOT NULL")
def s30(spark, d):
    h = F.sha2("text", 256)
    return load(spark, d, "segments").filter("text is not null").select("id", h.alias("sha"), F.substring(h, 1, 16).alias("doc_id"))
