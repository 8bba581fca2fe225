"""Queries of search, quotation checks, version comparison and request tracking."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from concordat.functions import labels as L
from concordat.operators import compare as C, positions as P, search as R, sequence as S
from concordat.plans.base import WITH, contributions, scored
from concordat.plans.texts import _KEY
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


QUESTION = 'quels sont les "annual fee" et le registre, article 9 ?'
QUESTIONS = {"fee": QUESTION, "register": "Which certification body keeps the register?", "phrase": '"the supervisory body" and "annual fee"', "article": "article 14 bis, considérant 12", "none": "zzzz"}
_POSTINGS = """SELECT id AS doc, f AS field, term, pos FROM (SELECT id, f, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT id, 'section_label' AS f, regexp_extract_all(strip_accents(lower(section_label)), '[\\p{L}\\p{N}]+') AS t FROM segments UNION ALL SELECT id, 'text', regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') FROM segments))"""


def _phrase_sql(words: list[str], prefix: bool) -> str:
    """(doc) once per occurrence of a phrase, by joins of postings at adjacent places."""
    joins = "".join(f" JOIN post p{n} ON p{n}.doc = p0.doc AND p{n}.field = p0.field AND p{n}.pos = p0.pos + {n} AND p{n}.term = '{w}'" for n, w in enumerate(words) if n)
    return f"SELECT p0.doc FROM post p0{joins} WHERE " + (f"starts_with(p0.term, '{words[0]}')" if prefix else f"p0.term = '{words[0]}'")


def _bm25_sql(questions: dict[str, str]) -> str:
    tf = " UNION ALL ".join(f"SELECT '{q}' AS question, {n} AS phrase, doc, count(*) AS tf FROM ({_phrase_sql(w, p)}) GROUP BY doc" for q, text in questions.items() for n, (_, w, p) in enumerate(R.parse(text)))
    return f""", post AS ({_POSTINGS}), sizes AS (SELECT doc, count(*) AS size FROM post GROUP BY doc), whole AS (SELECT count(*) AS docs, avg(size) AS mean_size FROM sizes), tf AS ({tf}),
idf AS (SELECT question, phrase, CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf, mean_size FROM (SELECT question, phrase, count(*) AS n FROM tf GROUP BY ALL), whole),
bm AS (SELECT question, doc, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean_size))) AS score FROM tf JOIN idf USING (question, phrase) JOIN sizes USING (doc) GROUP BY question, doc)"""


def _bm25(spark, d):
    return R.bm25(load(spark, d, "segments"), "id", ["section_label", "text"], R.parse(QUESTION))


def _sql(rest: str) -> str:
    return WITH.rstrip() + _bm25_sql({"": QUESTION}) + rest


@query("m19_bm25")
def m19(spark, d):
    return _bm25(spark, d)


ORACLE["m19_bm25"] = _sql(" SELECT doc, score FROM bm")


@query("m19_questions")
def m19_questions(spark, d):
    """Several questions at once: phrases, prefixes, cited articles, one without a hit."""
    return R.bm25_each(load(spark, d, "segments"), "id", ["section_label", "text"], {q: R.parse(t) for q, t in QUESTIONS.items()})


ORACLE["m19_questions"] = WITH.rstrip() + _bm25_sql(QUESTIONS) + " SELECT question, doc, score FROM bm"


@query("t1_search_top")
def t1(spark, d):
    """The twenty best with their documents, restricted to two kinds of document, the cited article first."""
    s = load(spark, d, "segments").select(F.col("id").alias("doc"), "document_id", "section_label")
    l = load(spark, d, "library_documents").select(F.col("id").alias("document_id"), "name", "kind").filter(F.col("kind").isin("wk_table", "legal_text"))
    hits = _bm25(spark, d).withColumn("score", F.round("score", 9)).join(s, "doc").join(l, "document_id")
    return R.top(hits, 20, F.regexp_extract("section_label", r"(\d+.*)$", 1), R.cited_articles(QUESTION)).select("doc", "name", "section_label", "score", "named")


ORACLE["t1_search_top"] = _sql(" SELECT doc, name, section_label, score, CASE WHEN starts_with(regexp_extract(section_label, '(\\d+.*)$', 1), '9') THEN 0 ELSE 1 END AS named FROM (SELECT doc, name, section_label, round(score, 9) AS score FROM bm JOIN segments s ON s.id = doc JOIN library_documents l ON l.id = s.document_id WHERE l.kind IN ('wk_table', 'legal_text') ORDER BY round(score, 9) DESC, doc LIMIT 20)")


@query("a31_hits_by_party")
def a31(spark, d):
    s = load(spark, d, "segments").select(F.col("id").alias("doc"), F.coalesce("ms_code", F.lit("—")).alias("party"))
    return _bm25(spark, d).join(s, "doc").groupBy("party").agg(F.count(F.lit(1)).alias("n"))


ORACLE["a31_hits_by_party"] = _sql(" SELECT coalesce(ms_code, '—') AS party, count(*) AS n FROM bm JOIN segments s ON s.id = doc GROUP BY ALL")


@query("m20_snippets")
def m20(spark, d):
    s = load(spark, d, "segments").select(F.col("id").alias("doc"), "text")
    return R.top(_bm25(spark, d), 20).join(s, "doc").select("doc", R.snippet(F.col("text"), ["annual", "registre"]).alias("snippet"))


@query("j3_section_neighbours", "SELECT s.document_id, l.name, s.section_id, s.id FROM segments s JOIN library_documents l ON l.id = s.document_id WHERE s.section_id IN ('art_9', 'art_14')")
def j3(spark, d):
    l = load(spark, d, "library_documents").select(F.col("id").alias("document_id"), "name")
    return load(spark, d, "segments").filter(F.col("section_id").isin("art_9", "art_14")).join(l, "document_id").select("document_id", "name", "section_id", "id")


@query("f11_quote_matches")
def f11(spark, d):
    s = scored(spark, d).filter("evidence is not null and text is not null").repartition(F.col("id"))
    return s.select("id", C.quote_matches(F.col("evidence"), F.col("text")).alias("found"))


def _sides(spark, d):
    """Segments and their copy, the fragments of each article rejoined."""
    whole = lambda t: S.rejoin(load(spark, d, t).distinct(), "document_id", "section_id", "section_label", "text").select("document_id", "root_id", "text")
    return whole("segments"), whole("segments_copy")


_ROOTS = r"""SELECT document_id, root_id, string_agg(text, chr(10) ORDER BY rank, section_id, text) AS text FROM (SELECT document_id, section_id, coalesce(text, '') AS text, CASE WHEN regexp_matches(section_id, '^[a-z]+_\d+[a-z]?_\d+$') THEN regexp_extract(section_id, '^([a-z]+_\d+[a-z]?)_\d+$', 1) ELSE section_id END AS root_id, CASE WHEN regexp_matches(section_id, '^[a-z]+_\d+[a-z]?_\d+$') THEN CAST(regexp_extract(section_id, '_(\d+)$', 1) AS int) ELSE 0 END AS rank FROM (SELECT DISTINCT * FROM {0})) GROUP BY document_id, root_id"""
_STATUS = f"SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.root_id, b.root_id) AS root_id, CASE WHEN a.text IS NULL THEN 'ajout' WHEN b.text IS NULL THEN 'suppression' WHEN a.text <> b.text THEN 'reformulation' ELSE 'inchange' END AS status FROM ({_ROOTS.format('segments')}) a FULL JOIN ({_ROOTS.format('segments_copy')}) b ON a.document_id = b.document_id AND a.root_id = b.root_id"


@query("j5_status", _STATUS)
def j5(spark, d):
    """Articles of two copies, paired by document and root of the section, fragments rejoined."""
    return C.versions(*_sides(spark, d), ["document_id", "root_id"], "text", measured=False)


@query("x18_version_compare")
def x18(spark, d):
    return C.versions(*_sides(spark, d), ["document_id", "root_id"], "text")


@query("x19_article_history")
def x19(spark, d):
    """Each section against the version before it in its dossier; sections as they are stored, fragments apart."""
    s = load(spark, d, "segments").select("document_id", "section_id", F.coalesce("text", F.lit("")).alias("text"))
    l = load(spark, d, "library_documents").select(F.col("id").alias("document_id"), "dossier", "version_date").filter("version_date is not null")
    w = Window.partitionBy("dossier", "section_id").orderBy("version_date", "document_id")
    return C.history(s.join(l, "document_id").withColumn("before", F.lag("text").over(w)), "text", "before").select("document_id", "section_id", "similarity", "added", "removed")


@query("m11_inline_diff")
def m11(spark, d):
    a, b = _sides(spark, d)
    both = a.withColumnRenamed("text", "old").join(b.withColumnRenamed("text", "new"), ["document_id", "root_id"]).filter("old <> new")
    return both.select("document_id", "root_id", C.inline_diff("old", "new").alias("marked"))


_WORDS = r"len(list_filter(string_split_regex({0}.text, '[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}\x{{1680}}\x{{205f}}\x{{0085}}\x{{2028}}\x{{2029}}]+'), lambda x: x <> ''))"


@query("x18_word_balance", f"SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.root_id, b.root_id) AS root_id, coalesce({_WORDS.format('b')}, 0) - coalesce({_WORDS.format('a')}, 0) AS balance FROM ({_ROOTS.format('segments')}) a FULL JOIN ({_ROOTS.format('segments_copy')}) b ON a.document_id = b.document_id AND a.root_id = b.root_id")
def x18_balance(spark, d):
    """Words added less words removed, which is by how many words the later text is longer."""
    return x18(spark, d).select("document_id", "root_id", (F.col("added") - F.col("removed")).cast("bigint").alias("balance"))


@query("m11_round_trip", "SELECT CAST(NULL AS varchar) AS document_id, CAST(NULL AS varchar) AS root_id WHERE false")
def m11_round_trip(spark, d):
    """Marked differences from which either text can't be had back: none."""
    a, b = _sides(spark, d)
    both = a.withColumnRenamed("text", "old").join(b.withColumnRenamed("text", "new"), ["document_id", "root_id"])
    marked = both.withColumn("marked", C.inline_whole("old", "new"))
    words = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    without = lambda gone, kept: words(F.regexp_replace(F.regexp_replace("marked", gone, ""), kept, "$1"))
    removed, added = r"(?s)\[-(.*?)-\](?= |$)", r"(?s)\{\+(.*?)\+\}(?= |$)"
    return marked.filter((without(added, removed) != words("old")) | (without(removed, added) != words("new"))).select("document_id", "root_id")


@query("t10_most_changed")
def t10(spark, d):
    return x18(spark, d).withColumn("churn", F.col("added") + F.col("removed")).orderBy(F.desc("churn"), "document_id", "root_id").limit(40)


_REQUESTS = f"SELECT id, ms_code, document_id, {_KEY.format('section_label')} AS match_key, deletion FROM sc WHERE section_label IS NOT NULL"
_TARGETS = f"SELECT DISTINCT document_id, {_KEY.format('section_label')} AS match_key FROM segments"
_VERDICT = f"SELECT r.*, CASE WHEN coalesce(deletion, false) AND t.match_key IS NULL THEN 'retenue' WHEN coalesce(deletion, false) THEN 'ecartee' ELSE 'indetermine' END AS verdict FROM ({_REQUESTS}) r LEFT JOIN ({_TARGETS}) t ON t.match_key = r.match_key AND t.document_id = r.document_id"


def _tracked(spark, d):
    """Requests followed into the text of their document."""
    r = scored(spark, d).filter("section_label is not null").select("id", "ms_code", "document_id", L.match_key(F.col("section_label")).alias("match_key"), "deletion")
    t = load(spark, d, "segments").select("document_id", L.match_key(F.col("section_label")).alias("match_key"))
    return C.track(r, t, ["document_id", "match_key"], "deletion")


@query("l6_request_verdicts", f"SELECT id, match_key, verdict FROM ({_VERDICT})")
def l6(spark, d):
    return _tracked(spark, d).select("id", "match_key", "verdict")


@query("a15_uptake", f"SELECT ms_code AS party, count(*) AS n, count(*) FILTER (verdict = 'retenue') AS kept, count(*) FILTER (verdict = 'partielle') AS partly, count(*) FILTER (verdict = 'ecartee') AS dropped, (count(*) FILTER (verdict = 'retenue') + 0.5::DOUBLE * count(*) FILTER (verdict = 'partielle')) / nullif(count(*) FILTER (verdict IN ('retenue', 'partielle', 'ecartee')), 0) AS rate FROM ({_VERDICT}) GROUP BY ALL")
def a15(spark, d):
    return C.uptake(_tracked(spark, d), "ms_code", "verdict")


@query("a23_target_texts", f"SELECT document_id, {_KEY.format('section_label')} AS match_key, string_agg(text, chr(10) ORDER BY section_order, id) AS text FROM segments GROUP BY 1, 2 HAVING count(text) > 0")
def a23(spark, d):
    """The texts of every document by match key, in order."""
    s = load(spark, d, "segments").filter("text is not null")
    rows = F.array_sort(F.collect_list(F.struct("section_order", "id", "text")))  # one section of one document
    return s.groupBy("document_id", L.match_key(F.col("section_label")).alias("match_key")).agg(F.array_join(rows["text"], "\n").alias("text"))


@query("a42_status_counts", f"SELECT status, count(*) AS n FROM ({_STATUS}) GROUP BY 1")
def a42(spark, d):
    return j5(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
