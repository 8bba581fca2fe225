"""Acts by instruction, titles, table rows, scorers, backups, alerts, table functions: defined results for nulls, empties, repeats."""

import difflib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from concordat.functions import udtfs
from concordat.operators import alerts as AL, amend as A, coalition as K, positions as P, scoring, segment as G, sequence as S, store
from tests.conftest import DATA

ACT = """ONT ADOPTÉ LE PRÉSENT RÈGLEMENT:
Article premier
Modifications du règlement (UE) 2023/2854
Le règlement (UE) 2023/2854 est modifié comme suit:
1. L'article 5 est remplacé par le texte suivant:
«Article 5
Un texte neuf qui compte assez de signes.»;
2. L'article 20 est supprimé.
Article 3
Entrée en vigueur
Ce règlement entre en vigueur le lendemain de sa publication.
"""


def test_act_by_instruction(spark):
    got = {s[0]: s for s in A.split(ACT)}
    assert set(got) == {"mod_32023r2854_art_5_1", "mod_32023r2854_art_20_2", "art_3"}
    assert got["mod_32023r2854_art_20_2"][4] == "L'article 20 est supprimé." and got["mod_32023r2854_art_5_1"][2] == "modification"
    plain = "Article 1\nUn corps assez long pour compter.\nArticle 2\nEncore un corps assez long."
    assert A.split(plain) == G.legal_text(plain)
    df = spark.createDataFrame([("a", ACT, 1), ("b", None, 2), ("c", " ", 3), ("a", ACT, 1)], "document_id string, act string, section_id int")
    assert A.split_acts(df, "document_id", "act").groupBy("document_id").count().collect()[0]["count"] == 2 * len(got)
    assert A.split_acts(df.limit(0), "document_id", "act").count() == 0


def test_edits_keep_untouched_lines():
    text = "Article 7\n\n1. Un.\n   suite\n2. Deux:\n(a) un;\n(b) deux.\n2 bis. Bis.\n3. Trois.\n"
    assert str(A.Article(text)) == text
    x = lambda op, said, new="": {"operation": op, "instruction": said, "new_text": new}
    assert A.apply(text, [x("suppression", "le paragraphe 2 est supprimé")])[0] == "Article 7\n\n1. Un.\n   suite\n2 bis. Bis.\n3. Trois.\n"
    assert A.apply(text, [x("insertion", "est inséré", "2 ter. Ter.")])[0] == text.replace("3. Trois", "2 ter. Ter.\n3. Trois")
    assert A.apply("(a) x\n(a) y", [x("suppression", "le point a) est supprimé")])[1] == "non_appliquee"
    assert A.apply(text, [x("", "rien")])[1:] == ("non_appliquee", [False]) and A.apply(text, []) == (text, "inchange", [])
    assert A.apply("", [x("insertion", "est inséré", "Neuf.")]) == ("Neuf.", "exacte", [True])


def test_titles(spark):
    rows = [("d", 1, "Article 1", "TITRE I — OBJET ET CHAMP\nTexte"), ("d", 2, "Article 2", None), ("d", 3, "Article 3", "Chapitre 2\nx\nTITLE IV:\ny"), ("d", 4, "Article 1", "z"), ("d", 5, None, "z"), ("e", 1, "Article 9", "rien"), ("d", 3, "Article 3", "Chapitre 2\nx\nTITLE IV:\ny")]
    df = spark.createDataFrame(rows, "document_id string, section_order int, section_label string, text string").withColumn("title", F.lit("clash")).drop("title")
    got = {(r["document_id"], r["section_label"]): r["title"] for r in S.titles(df, "document_id", ["section_order"], "section_label", "text").collect()}
    assert got == {("d", "Article 1"): "Titre I, Objet et champ", ("d", "Article 2"): "Titre I, Objet et champ", ("d", "Article 3"): "Titre IV"}
    assert S.titles(df.limit(0), "document_id", ["section_order"], "section_label", "text").count() == 0


def test_table_rows(spark):
    df = spark.createDataFrame([(1, ["Article 1", "compromise", " x "]), (2, ["Commission Proposal", "Comments"]), (3, [None, " "]), (4, ["alone"]), (5, None), (6, [None, "goes on"])], "id int, cells array<string>")
    assert sorted((r["id"], r["left"], r["right"]) for r in G.table_rows(df, "cells").collect()) == [(1, "Article 1", "x"), (6, "", "goes on")]


def test_scorers(spark):
    df = spark.createDataFrame([(1, "We support this.", "comments"), (2, None, None)], "id int, text string, kind string").withColumn("stance", F.lit("old"))
    got = {r["id"]: (r["stance"], r["score"], r["method"]) for r in scoring.scored(df, "text", F.col("kind"), F.lit(True)).collect()}
    assert got == {1: ("aligne", 2, "heuristique"), 2: (None, None, "heuristique")}

    class Fixed:
        def score(self, df, text, kind, silent):
            return df.withColumns({c: F.lit(None).cast("string") for c in scoring.COLUMNS}).withColumn("method", F.lit("fixed"))

    class Poor:
        def score(self, df, text, kind, silent):
            return df

    assert {r["method"] for r in scoring.scored(df, "text", F.col("kind"), F.lit(True), Fixed()).collect()} == {"fixed"}
    with pytest.raises(ValueError, match="score"):
        scoring.scored(df, "text", F.col("kind"), F.lit(True), Poor())


def test_a_backup_is_whole_or_refused(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "id int, v string")
    store.backup({"one": one, "none": one.limit(0)}, f"{tmp_path}/b")
    back = store.restore(spark, f"{tmp_path}/b", {"one": one.schema, "none": one.schema})
    assert back["one"].count() == 3 and back["none"].count() == 0
    for wanted in ({"two": one.schema}, {"one": one.select(F.col("id").cast("string").alias("id")).schema}, {"one": one.withColumn("more", F.lit(1)).schema}):
        with pytest.raises(ValueError):
            store.restore(spark, f"{tmp_path}/b", wanted)


def test_rules_together_are_the_rules_apart(spark):
    df = spark.createDataFrame([(None, 1), (3, None), (5, 1), (5, 2)], "a int, b int")
    some = F.when(F.col("n") > 0, "attention")
    rules = [("one", F.col("a") > 4, None, some), ("two", F.col("b") == 1, F.col("a").isNotNull(), some), ("three", F.col("a") > 9, None, some)]
    want = sorted(tuple(r) for name, wrong, applies, s in rules for r in AL.counted(df, name, wrong, s, applies).collect())
    assert sorted(tuple(r) for r in AL.counted_together(df, rules).collect()) == want
    named = AL.counted(df, "x", F.col("a") > 4, some, None, F.col("b").cast("string")).first()
    assert named["members"] == ["1", "2"] and AL.counted_together(df.limit(0), rules).filter("n <> 0").count() == 0


def test_report_of_groups(spark):
    weights = spark.createDataFrame([("A", 0.5), ("B", 0.3), ("C", 0.2)], "party string, share double")
    members = spark.createDataFrame([("g", "A"), ("g", "X"), ("h", "X")], "name string, party string")
    got = {r["name"]: r for r in K.report(members, weights).collect()}
    assert (got["g"]["n_states"], got["g"]["population_share"], got["g"]["states_missing"], got["g"]["population_missing"]) == (2, 0.5, 13, 0.15)
    assert got["h"]["population_share"] == 0 and not got["h"]["qualified"] and not got["h"]["blocks"]


def test_weights_and_extracted_positions(spark):
    df = spark.createDataFrame([(1, "a", "n.docx", "reserve"), (2, "b", "n.docx", None), (3, "c", "n.docx", "soutien")], "id int, text string, source string, nature string")
    got = {r["id"]: (r["stance"], r["scrutiny"], r["text"]) for r in P.extracted(df, "nature", "source", "text").collect()}
    assert got == {1: ("oppose", True, "[n.docx] a"), 3: ("aligne", False, "[n.docx] c")}
    hits = spark.createDataFrame([(1, "q"), (1, "q"), (9, "z")], "id int, quotation string")
    assert sorted((r["id"], r["weight"]) for r in P.weighed(df.select("id"), hits, "id", 2.0).collect()) == [(1, 2.0), (2, 1.0), (3, 1.0)]


def test_table_functions_give_what_the_operators_do(spark):
    udtfs.register(spark)
    spark.createDataFrame([("a", ACT), ("b", None), ("c", "Un texte libre.\n\nDeux blocs.")], "k string, t string").createOrReplaceTempView("__t")
    got = {tuple(r) for r in spark.sql("SELECT s.* FROM __t, LATERAL legal_sections(t) s").collect()}
    assert got == {*G.legal_text(ACT), *G.legal_text("Un texte libre.\n\nDeux blocs.")}
    assert spark.sql("SELECT i.section_id FROM __t, LATERAL instructions(t) i ORDER BY i.numero").collect() == [("art_5",), ("art_20",)]


def test_versions_against_difflib(spark):
    """Similarity and churn of all articles against the standard library over the rows as DuckDB reads them."""
    sql = entry.oracle_sql()["j5_status"]
    con = duckdb.connect()
    for t in ("segments", "segments_copy", "contributions", "analyses", "populations"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    sides = con.execute(sql.replace("CASE WHEN a.text IS NULL THEN 'ajout' WHEN b.text IS NULL THEN 'suppression' WHEN a.text <> b.text THEN 'reformulation' ELSE 'inchange' END AS status", "a.text AS old, b.text AS new")).fetchall()
    want = {}
    for document, root, old, new in sides:
        a, b = (old or "").split(), (new or "").split()
        m = difflib.SequenceMatcher(None, a, b)
        changed = [(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in m.get_opcodes() if tag != "equal"]
        ratio = None if old is None or new is None else 1.0 if old == new else m.ratio()
        status = "ajout" if old is None else "suppression" if new is None else "inchange" if ratio >= 0.995 else "reformulation"
        want[document, root] = (status, ratio, sum(j for _, j in changed), sum(i for i, _ in changed))
    got = {(r["document_id"], r["root_id"]): (r["status"], r["similarity"], r["added"], r["removed"]) for r in entry.queries()["x18_version_compare"](spark, DATA).collect()}
    assert got == want and len({v[0] for v in want.values()}) >= 3


def test_structured_articles_of_repeated_ids_without_moving_segments(spark, tmp_path):
    """Segments are changed where they are read; rows of one id, or of none, are articles of their own."""
    spark.createDataFrame([(1, "a  b"), (1, "c"), (None, "d"), (2, None)], "id bigint, text string").write.parquet(f"{tmp_path}/segments.parquet")
    df = entry.queries()["x13_structured"](spark, str(tmp_path))
    c = duckdb.connect()
    for t in ("contributions", "analyses", "populations"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    c.execute(f"create view segments as select * from '{tmp_path}/segments.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, c.execute(entry.oracle_sql()["x13_structured"]).fetchall()))

    def nodes(node):
        yield node
        for k in range(node.children().size()):
            yield from nodes(node.children().apply(k))

    joins = [n.toString() for n in nodes(df._jdf.queryExecution().sparkPlan()) if n.nodeName() == "SortMergeJoin"]
    assert not any("FileScan parquet" in x for x in joins)
