"""The core's operators on small cases."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from concordat.functions import labels as L
from concordat.operators import amend as A, coalition as K, compare as C, positions as P, search as R, segment as G, sequence as S, store
from concordat.sources.tables import conform


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r[1] for r in df.select("n", f(F.col("v"))).orderBy("n").collect()]


def test_section_order(spark):
    ids = ["rec_12", "art_51", "art_50", "art_5_2", "art_5_1", "art_5", "preambule"]
    places = dict(zip(ids, column(spark, L.section_order, ids)))
    assert sorted(ids, key=places.get) == ["preambule", "art_5", "art_5_1", "art_5_2", "art_50", "art_51", "rec_12"]
    assert column(spark, L.section_order, ["art_94a", "annexes_2", None]) == [94010, 90000002, 19900000]


def test_provisions_and_labels(spark):
    texts = ["Art. 5(2): the scope", "Art. 5(2)(a): x", "Recital 12 is fine", "Paragraph 3 says", "x" * 230 + "Art. 5(2)", "", None]
    assert column(spark, L.provision, texts) == ["§ 2", "§ 2 (a)", "considérant 12", "§ 3", "", "", ""]
    assert column(spark, lambda c: L.fragment_label(F.lit("Article 24 (2/12)"), c), ["Art. 24(3) a", "We would like to say more than seven words now ok", ""]) == ["Article 24, à partir du § 3", "Article 24 · extrait 2/12 : « say more than seven words now ok »", "Article 24 · extrait 2/12"]
    assert column(spark, L.match_key, ["Considérant 79", "Article 79", "Art. 79 (2/3)", "Annexe", None]) == ["rec_79", "art_79", "art_79", "annexe", ""]
    assert column(spark, L.subject, ["Article 5\nInterdictions réseaux\nLe texte.", "Article 5\nThe Commission shall act", None]) == ["Interdictions réseaux", "", ""]


def test_version_marks(spark):
    assert column(spark, L.version_kind, ["Presidency compromise text", "COM(2025) 123 final", "other", None]) == ["compromis", "com", "autre", "autre"]
    assert column(spark, L.version_date, ["24 July 2026", "15.3.2025", "45.3.2025", None]) == ["2026-07-24", "2025-03-15", None, None]


def test_lexical_stance(spark):
    cases = [
        ("We believe this Article should be deleted.", "comments", True, "oppose"),
        ("We maintain a scrutiny reservation on this provision.", "comments", True, "oppose"),
        ("Replace 'shall' by 'may' for consistency.", "drafting", True, "partiel"),
        ("We welcome this Article as drafted.", "comments", True, "aligne"),
        ("What is the intended timeline?", "comments", True, "neutre"),
        ("We do not support this.", "comments", False, "oppose"),
        ("We support it, however the scope is wide.", "comments", False, "partiel"),
        ("We maintain a scrutiny reservation.", "comments", False, "neutre"),
        (None, None, True, None),
    ]
    df = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], "n int, text string, kind string, silent boolean, want string")
    got = P.lexical_stance(df, "text", F.col("kind"), F.col("silent"))
    assert all(r["lex_stance"] == r["want"] for r in got.collect())


def test_matrix_ranking_and_weights(spark):
    df = spark.createDataFrame([(1, "DE", "1", 2), (2, "DE", "2", 0), (3, "NL", "1", 2), (4, "NL", "2", 0), (5, "NL", "2", None), (6, None, "1", 1), (1, "DE", "1", 2)], "id int, p string, item string, score int")
    m = P.matrix(df, ["item"], "p", "score")
    assert m.count() == 4
    w = df.withColumn("w", F.when(F.col("id") == 2, 3.0).otherwise(1.0)).dropDuplicates()
    got = {r["party"]: r for r in P.weighted_ranking(w, "p", "score", "w").collect()}
    assert (got["DE"]["raw_mean"], got["DE"]["weighted_mean"], got["NL"]["difference"]) == (1.0, 0.5, 0.0)
    one = P.contentious(m.filter("party = 'DE'"), ["item"]).collect()
    assert all(r["dispersion"] is None for r in one)


def test_agreement_is_over_shared_items_only(spark):
    m = spark.createDataFrame([("1", "A", 2), ("2", "A", 0), ("1", "B", 2), ("2", "B", 1), ("3", "B", 1), ("1", "C", 0)], "item string, party string, score int")
    got = {(r["a"], r["b"]): (r["shared"], r["rate"]) for r in P.agreement(m, ["item"]).collect()}
    assert got == {("A", "B"): (2, 0.5)}


def test_components_and_blocs(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefgh"], "node string")
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("c", "d"), ("g", "h")], "a string, b string")
    got = {r["node"]: r["component"] for r in K.components(nodes, edges).collect()}
    assert got == {**dict.fromkeys("abcd", "a"), "e": "e", "f": "f", "g": "g", "h": "g"}
    chain = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r["component"] for r in K.components(spark.range(201).withColumnRenamed("id", "node"), chain).collect()} == {0}


def test_round_robin_covers_items(spark):
    df = spark.createDataFrame([(i, f"s{i // 5:02}", f"p{i % 5}") for i in range(100)], "id int, item string, party string")
    assert P.round_robin(df, "item", ["party"], 10).select("item").distinct().count() == 10


def test_kappa(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), (None, "a")], "x string, y string")
    assert P.kappa(df, "x", "y").collect()[0]["kappa"] == pytest.approx(0.5)
    assert P.kappa(df.filter("x = 'a' and y = 'a'"), "x", "y").collect()[0]["kappa"] is None


def test_store_operations(spark):
    old = spark.createDataFrame([("1", "f.pdf", 1), ("2", "g.pdf", 1)], "id string, fichier string, n int")
    new = spark.createDataFrame([("2", "", 2), ("3", "h", 2)], "id string, fichier string, n int")
    got = sorted(tuple(r) for r in store.upsert(old, new, ["id"], ["fichier"]).collect())
    assert got == [("1", "f.pdf", 1), ("2", "g.pdf", 2), ("3", "h", 2)]
    part = spark.createDataFrame([("d", i) for i in range(5)], "d string, i int")
    assert store.replace_part(store.replace_part(part, part, "d"), part, "d").count() == 5
    assert conform(old.drop("n"), old.schema).columns == ["id", "fichier", "n"]


def test_sequence_operators(spark):
    df = spark.createDataFrame([("d", 1, "a"), ("d", 2, None), ("d", 3, None), ("d", 4, "b")], "d string, o int, v string")
    assert [r["c"] for r in S.carry_forward(df, ["d"], ["o"], F.col("v"), "c").orderBy("o").collect()] == ["a", "a", "a", "b"]
    assert [r["island"] for r in S.islands(df, ["d"], ["o"], ["v"]).orderBy("o").collect()] == [0, 1, 1, 2]
    seg = spark.createDataFrame([("d", "art_5_2", "Article 5 (2/2)", "b"), ("d", "art_5_1", "Article 5 (1/2)", "a"), ("d", "art_6", "Article 6", None)], "d string, s string, l string, t string")
    assert sorted(tuple(r)[1:] for r in S.rejoin(seg, "d", "s", "l", "t").collect()) == [("art_5", "Article 5", "a\nb", 2), ("art_6", "Article 6", "", 1)]
    packs = column(spark, lambda c: S.pack(c, 10), [["abc", "def", "ghijklmnopqrstu", "x"], []], "array<string>")
    assert packs == [["abc\n\ndef", "ghijklmnopqrstu", "x"], []]
    assert column(spark, S.running_floor, [[-1, 1, 1, -1], []], "array<int>") == [1, 0]


def test_bm25(spark):
    assert len(R.ACCENTED) == len(R.PLAIN)
    assert R.parse('qui parle de "cyber posture" ?') == [("phrase", ["cyber", "posture"], False)]
    assert ("term", ["commente"], True) in R.parse("quels sont les États qui ont commenté")
    df = spark.createDataFrame([(i, "Article", f"Contribution {i} concerning cyber posture") for i in range(5)] + [(9, None, "posture of cyber things"), (10, "x", None)], "id int, label string, text string")
    ask = lambda q: {r["doc"] for r in R.bm25(df, "id", ["label", "text"], R.parse(q)).collect()}
    assert ask('"cyber posture"') == set(range(5)) and ask("cyber") == {0, 1, 2, 3, 4, 9} and ask('"x x"') == set() == ask("")
    assert R.bm25(df.limit(0), "id", ["label", "text"], R.parse("cyber")).count() == 0
    plan = R.bm25_each(df, "id", ["label", "text"], {q: R.parse(q) for q in ("cyber posture", "things", "x of it")})
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2


def test_diff_is_the_standard_ratio():
    random.seed(1)
    for _ in range(20):
        a = [random.choice("abcdefg") for _ in range(random.randint(0, 300))]
        b = [random.choice("abcdefg") for _ in range(random.randint(0, 300))]
        assert C.word_diff(" ".join(a), " ".join(b))[0] == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())
    assert C.word_diff("x y", "x y") == (1.0, 0, 0)
    assert "[-b-] {+c+}" in C.inline("a b", "a c")


def test_versions(spark):
    old = spark.createDataFrame([("1", "a b c"), ("2", "gone"), ("3", None)], "id string, text string")
    new = spark.createDataFrame([("1", "a b d"), ("3", None), ("4", "new one")], "id string, text string")
    got = {r["id"]: (r["status"], r["added"], r["removed"]) for r in C.versions(old, new, "id", "text").collect()}
    assert got == {"1": ("reformulation", 1, 1), "2": ("suppression", 0, 1), "3": ("inchange", 0, 0), "4": ("ajout", 2, 0)}


def test_quotations():
    source = "The proposed concept of a Cyber Posture is under scrutiny reservation. In particular, we would like to wait and see what results the workshop brings."
    assert C.quoted_in("Cyber Posture is under scrutiny reservation", source)
    assert C.quoted_in("cyber posture is under - scrutiny reservation.", source)
    assert not C.quoted_in("Germany fully supports the Commission proposal without reservation", source)
    assert not C.quoted_in("the", source)


ACT = """Considérant (60) Le règlement (UE) 2023/2854 est modifié comme suit par ailleurs.
ONT ADOPTÉ LE PRÉSENT RÈGLEMENT:
Article premier
Modifications du règlement (UE) 2023/2854
Le règlement (UE) 2023/2854 est modifié comme suit:
1. L'article 5 est remplacé par le texte suivant:
«Article 5
Un texte neuf.»;
2. À l'article 12, le paragraphe 2 est remplacé par le texte suivant:
«2. Le deuxième paragraphe.
3. Une ligne citée.»;
3. L'article 20 est supprimé.
4. À l'article 18 bis, le point b) est supprimé.
Article 2
Modifications du règlement (UE) 2016/679
Le règlement (UE) 2016/679 est modifié comme suit:
1. À l'article 4, les points suivants sont ajoutés:
«32) un terme.»;
Article 3
Entrée en vigueur
Ce règlement entre en vigueur.
"""


def test_reading_an_act():
    got = A.read(ACT)
    assert [(x["celex"], x["numero"], x["section_id"], x["operation"]) for x in got] == [
        ("32023R2854", "1.", "art_5", "remplacement"),
        ("32023R2854", "2.", "art_12", "remplacement"),
        ("32023R2854", "3.", "art_20", "suppression"),
        ("32023R2854", "4.", "art_18bis", "suppression"),
        ("32016R0679", "1.", "art_4", "ajout"),
    ]
    assert A.read("Article 5. Rien.") == [] and A.read("") == [] and A.read(None) == []
    assert A.act_id("directive 2002/58/CE") == "32002L0058" and A.act_id("règlement (UE) nº 910/2014") == "32014R0910"


def test_applying_instructions():
    by = {x["section_id"]: x for x in A.read(ACT)}
    assert A.apply("Article 12.\n1. Un.\n2. Deux.\n3. Trois.", [by["art_12"]])[0].startswith("Article 12.\n1. Un.\n2. Le deuxième")
    assert A.apply("x", [by["art_20"]]) == ("", "exacte", [True])
    assert A.apply("a) un\nb) deux\nc) trois", [by["art_18bis"]])[0] == "a) un\nc) trois"
    assert A.apply("sans point", [by["art_18bis"]]) == ("sans point", "non_appliquee", [False])
    new = {"operation": "insertion", "instruction": "est inséré", "new_text": "2 bis. Neuf."}
    assert A.apply("1. Un.\n2. Deux.\n3. Trois.", [new])[:2] == ("1. Un.\n2. Deux.\n2 bis. Neuf.\n3. Trois.", "exacte")
    assert A.apply("Un.", [{**new, "new_text": "Sans numéro."}])[:2] == ("Un.\nSans numéro.", "approchee")
    assert A.status({"suppression"}, False) == "Modifié" and A.status(set(), False) == "Inchangé"


def test_legal_split():
    text = "Un préambule assez long pour compter comme tel dans le texte de la loi.\n" + "\n".join(f"Article {n}\n{'Le corps de cet article. ' * 3}" for n in ("premier", "2", "5 bis")) + "\nFait à Bruxelles\n" + "Annexe. " * 150
    got = G.legal_text(text)
    assert [x[0] for x in got] == ["preambule", "art_1", "art_2", "art_5_bis", "annexes"]
    assert G.legal_text("sans article")[0][2] == "paragraphe" and G.free_text("") == []
    assert all(len(b) <= 2500 for *_, b in G.subdivided(("art_1", "Article 1", "article", 1, "Une phrase ici. " * 400)))


def test_comment_table(spark):
    rows = spark.createDataFrame([
        ("d", 1, 1, "Article 5", "DE\n(Comments):\nfirst"), ("d", 1, 2, "", "goes on"), ("d", 2, 1, None, "head\nFR (Drafting suggestions): second\nIT\n(comments)\n—"),
        ("d", 2, 2, "Recital 7", "lost text"), ("d", 2, 3, None, "NL\n(Comments): third"),
    ], "document_id string, page_no int, row_no int, left string, right string")
    got = sorted((r["section_id"], r["ms_code"], r["kind"], r["text"], r["page_start"], r["page_end"]) for r in G.comment_table(rows, ["DE", "FR", "IT", "NL"]).collect())
    assert got == [("art_5", "DE", "comments", "first\ngoes on\nhead", 1, 2), ("art_5", "FR", "drafting", "second", 2, 2), ("rec_7", "NL", "comments", "third", 2, 2)]


def test_html():
    assert G.html_text("<html><script>a('</p>')</script><p>One&amp;two<br>three <b>four</b></p><!-- no --></html>") == "One&two\nthree four"


def test_streams_go_on_with_new_files(spark, tmp_path):
    """Stopped and started again with the same folders: nothing of the first run is lost, nothing is counted twice."""
    from concordat.streaming import streams

    source, where = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "contribution_id bigint, section_id string, party string, score int, ts timestamp, value double"
    parts = [
        [(1, "a", "X", 2, "2024-01-01 10:00:00", 1.0), (2, "a", "Y", 2, "2024-01-01 10:30:00", 2.0), (3, "b", "X", 1, "2024-01-01 23:00:00", 3.0)],
        [(1, "a", "X", 0, "2024-01-02 10:00:00", 4.0), (4, "b", "Y", 1, "2024-01-09 10:00:00", 5.0)],
        [(4, "b", "Y", 0, "2024-01-08 10:00:00", 6.0), (5, "a", "Z", 0, "2024-01-01 00:10:00", 7.0)],
    ]
    frame = lambda rows: spark.createDataFrame(rows, "contribution_id bigint, section_id string, party string, score int, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    runs = []
    for part in [*parts, None]:  # the last run finds nothing new
        if part:
            frame(part).coalesce(1).write.mode("append").parquet(source)
        latest = streams.merged(read(), f"{where}/latest", ["contribution_id"], "ts", ["score"])
        matrix = streams.least_scores(streams.updates(streams.running_matrix(read().withColumnRenamed("party", "ms_code")), f"{where}/matrix", "update"), ["section_id", "party"])
        days = streams.newest(streams.updates(streams.activity(read(), "ts", "section_id", "1 day"), f"{where}/days", "update"), ["start", "section_id"])
        sessions = streams.append(streams.sessions(read(), "ts", "party", "1 hour"), f"{where}/sessions")
        agree = streams.agreements(read(), f"{where}/agree", ["section_id"], "party", 1)
        runs.append([{tuple(r) for r in df.collect()} for df in (latest.select("contribution_id", "score"), matrix, days.select(F.dayofmonth("start"), "section_id", "n"), sessions.select(F.hour("start"), F.dayofmonth("start"), "party", "n"), agree.select("a", "b", "shared", "rate"))])
    assert runs[0][0] == {(1, 2), (2, 2), (3, 1)} and runs[1][0] == {(1, 0), (2, 2), (3, 1), (4, 1)} and runs[2][0] == runs[3][0] == {(1, 0), (2, 2), (3, 1), (4, 1), (5, 0)}
    assert runs[2][1] == {("a", "X", 0), ("a", "Y", 2), ("a", "Z", 0), ("b", "X", 1), ("b", "Y", 0)}
    assert runs[0][2] == {(1, "a", 2), (1, "b", 1)} and runs[1][2] == {(1, "a", 2), (1, "b", 1), (2, "a", 1), (9, "b", 1)}
    assert runs[2][2] == runs[1][2] | {(8, "b", 1)}, "the row of 1 January comes after the watermark has passed its day"
    assert {(10, 1, "X", 1), (10, 1, "Y", 1), (23, 1, "X", 1), (10, 2, "X", 1)} == runs[2][3]
    assert runs[0][4] == {("X", "Y", 1, 1.0)} and runs[2][4] == runs[3][4] == {("X", "Y", 2, 0.0), ("X", "Z", 1, 1.0), ("Y", "Z", 1, 0.0)}
