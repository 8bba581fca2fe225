"""The operators on training text over small tables: brute force, nulls, empties, repeats, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from concordat.llm import leaks, mixture, neardup, normalize, queries, sentences, split, truncation


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def jaccard(a, b, k):
    s = lambda t: {tuple(t.lower().split()[i : i + k]) for i in range(len(t.split()) - k + 1)}
    return len(s(a) & s(b)) / len(s(a) | s(b))


def texts(n, seed):
    """Texts of a small vocabulary with edited, reordered and exact copies."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words = [f"w{r.randrange(400)}" for _ in range(r.randrange(25, 120))]
        out.append(" ".join(words))
        for _ in range(r.randrange(3)):
            w = words[:]
            for _ in range(r.randrange(0, 12)):
                w[r.randrange(len(w))] = f"x{r.randrange(999)}"
            cut = r.randrange(len(w))
            out.append(" ".join(w[cut:] + w[:cut] if r.random() < 0.3 else w))
    return out


def test_near_duplicates_against_brute_force(spark):
    t = texts(120, 5)
    df = spark.createDataFrame([(i, x, i, "k") for i, x in enumerate(t)] + [(5000, None, 0, ""), (5001, "", 0, ""), (5002, "too short", 0, ""), (0, t[0], 0, "k"), (None, t[1], 0, "")], "id bigint, text string, anchor int, key string")
    found = neardup.NearDuplicates(df, "id", "text", 3, 0.55, 20)
    got = {tuple(r) for r in found.pairs().collect()}
    want = {(i, j) for i in range(len(t)) for j in range(i + 1, len(t)) if jaccard(t[i], t[j], 3) >= 0.55}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 30
    members = {r["key"]: r["group_id"] for r in found.groups().collect()}
    assert all(members[a] == members[b] for a, b in got)


def test_code_words_cover_and_are_met_within_the_threshold(spark):
    r = random.Random(8)
    word = lambda symbols: sum(x << 16 * n for n, x in enumerate(symbols))
    signed = lambda w: w - 2**64 if w >= 2**63 else w
    pairs = []
    for n in range(200):
        a = [r.randrange(2**16) for _ in range(4)]
        b = a[:]
        b[n % 4] = r.randrange(2**16)
        pairs.append((signed(word(a)), signed(word(b))))
    pairs.append((signed(word([1, 2, 3, 2**16 - 6])), signed(word([65535] * 4))))
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = df.select("a", "b", F.array(*neardup.code_words(F.col("a"))).alias("x"), F.array(*neardup.code_words(F.col("b"))).alias("y")).collect()
    for row in got:
        for w, code in ((row["a"], row["x"]), (row["b"], row["y"])):
            for n, c in enumerate(code):
                parts = [[(v % 2**64 >> 16 * k) & 0xFFFF for k in range(4)] for v in (w, c)]
                assert sum(parts[1]) % 2**16 == 0 and all(parts[0][k] == parts[1][k] for k in range(4) if k != n)
    assert all(set(row["x"]) & set(row["y"]) for row in got[:-1])
    assert set(got[-1]["x"]) == {got[-1]["a"]}


def test_hot_anchors_in_fragments_meet_alike(spark, monkeypatch):
    t = texts(150, 9)
    df = spark.createDataFrame([(i, f"{x} one clause that every text of the table has in common with all the others of it word by word and sign by sign") for i, x in enumerate(t)], "id bigint, text string")
    whole = rows(neardup.NearDuplicates(df, "id", "text", 3, 0.55).pairs())
    monkeypatch.setattr(neardup, "HOT", 3)
    monkeypatch.setattr(neardup, "WEIGHED", 1)
    assert rows(neardup.NearDuplicates(df, "id", "text", 3, 0.55).pairs()) == whole and len(whole) > 30


@pytest.mark.parametrize("threshold, k", [(0.55, 3), (0.8, 5)])
def test_recall_near_the_threshold(spark, threshold, k):
    """Pairs just above the threshold, where fingerprints meet most seldom."""
    r = random.Random(6)
    data, want = [], set()
    for n in range(400):
        base = [f"w{r.randrange(10**6)}" for _ in range(150)]
        edited = base[:]
        while jaccard(" ".join(base), " ".join(edited), k) > threshold + 0.03:
            edited[r.randrange(150)] = f"x{r.randrange(10**6)}"
        if jaccard(" ".join(base), " ".join(edited), k) >= threshold:
            want.add((2 * n, 2 * n + 1))
        data += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(edited))]
    got = {tuple(x) for x in neardup.NearDuplicates(spark.createDataFrame(data, "id bigint, text string"), "id", "text", k, threshold).pairs().collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 300


def test_near_duplicates_of_nothing_and_of_copies(spark):
    df = spark.createDataFrame([(i, "the same text of more than five words " * 3) for i in range(300)], "id bigint, text string")
    found = neardup.NearDuplicates(df, "id", "text")
    assert found.links.count() == 0 and found.groups().select("group_id").distinct().count() == 1 and found.groups().count() == 300
    assert neardup.NearDuplicates(df.limit(0), "id", "text").pairs().count() == 0


def test_groups_of_the_query_have_its_own_setting(spark, tmp_path):
    long = [f"w{n}" for n in range(40)]
    near = long[:20] + ["other"] + long[21:30] + ["words"] + long[31:]
    data = [(1, "Reservation on the whole article."), (2, "Reservation on the whole article."), (3, " ".join(long)), (4, " ".join(near)), (5, "Something else that stands alone here."), (6, "n/a"), (7, "n/a")]
    assert 0.55 <= jaccard(data[2][1], data[3][1], 3) < 0.8
    for t in ("segments", "contributions"):
        spark.createDataFrame(data, "id bigint, text string").write.parquet(f"{tmp_path}/{t}.parquet")
    got = {}
    for r in queries.p1_groups(spark, str(tmp_path)).collect():
        got.setdefault((r["tbl"], r["group_id"]), set()).add(r["key"])
    assert sorted((t, sorted(ids)) for (t, _), ids in got.items()) == [(t, ids) for t in ("contributions", "segments") for ids in ([1, 2], [3, 4])]


def test_split_table(spark):
    df = spark.createDataFrame([(1, "a. " * 2000, 0), (1, "a. " * 2000, 0), (2, "short", 0), (3, None, 0), (4, "x" * 2501, 0), (None, "b " * 3000, 0)], "id bigint, text string, piece int")
    got = split.split_oversized(df, "id", "text")
    assert {r["rec_id"] for r in got.collect()} == {1, 4, None}
    assert got.filter("length(piece) > 2500").count() == 0 and got.groupBy("rec_id", "piece_no").count().filter("count > 1").count() == 0
    assert split.split_oversized(df.limit(0), "id", "text").count() == 0


def test_normalize_table(spark):
    df = spark.createDataFrame([(1, "A  b c", "x"), (2, None, "x"), (3, "", "x"), (4, "Plain  Text", "x"), (5, "é", "x"), (1, "A  b c", "x")], "id int, text string, canonical string")
    got = {r["id"]: (r["canonical"], r["irregular"], r["changed"]) for r in normalize.normalize(df, "text").collect()}
    assert got == {1: ("a b c", True, True), 2: (None, False, False), 3: ("", False, False), 4: ("plain text", False, False), 5: ("é", False, False)}
    assert normalize.normalize(df, "text").count() == 6
    assert [r["canonical"] for r in normalize.normalize(df.select(F.lit("Ａ").alias("canonical")).limit(1), "canonical").collect()] == ["a"]


def test_changed_without_being_irregular(spark):
    altered, same = ["Wait…", "½ of it", "5 m²", "ﬁne print"], ["Straße", "ΟΔΟΣ", "ΛΌΓΟΣ  ένας", " Été \n", "“Quoted”"]
    df = spark.createDataFrame([(v,) for v in altered + same], "v string")
    got = {r["v"]: (r["changed"], r["irregular"]) for r in normalize.normalize(df, "v").collect()}
    assert got == {**{v: (True, False) for v in altered}, **{v: (False, False) for v in same}}


def test_truncation_table(spark):
    full = "The board shall adopt the annual report before the next meeting."
    data = [
        (1, full), (2, full[:40]), (3, "The board shall adopt…"), (4, "Under scrutiny"), (5, "Under scrutiny"), (6, ""), (7, None), (8, "Another thing that never was stored whole and"),
        (9, "Does it end?"), (10, "« Il agit ! »"), (2, full[:40]), (11, "A quotation that goes on"), (12, "Agreed in part"),
    ]
    df = spark.createDataFrame(data, "id bigint, v string").withColumn("value", F.lit(1))
    source = spark.createDataFrame([(11, "Before. A quotation that goes on here."), (12, "Agreed in part"), (1, None)], "id bigint, text string")
    got = {r["id"]: r["proof"] for r in truncation.find(df, "id", "v", source).collect()}
    assert got == {2: "prefix", 3: "prefix", 8: "ending", 11: "source"}
    assert truncation.find(df.limit(0), "id", "v").count() == 0
    shares = truncation.shares(df.withColumn("m", F.lit("x")), "id", ["v"], "m", {"v": source}).collect()[0]
    assert (shares["n_values"], shares["n_truncated"]) == (12, 5)


def test_prefixes_against_brute_force(spark):
    r = random.Random(2)
    pool = ["".join(r.choice("ab") for _ in range(r.randrange(1, 12))) for _ in range(300)]
    values = spark.createDataFrame([(x,) for x in pool], "v string")
    got = {x["v"] for x in truncation.extended(values, values).collect()}
    assert got == {x for x in pool if any(y != x and y.startswith(x) for y in pool)}


def test_no_value_extends_itself(spark):
    data = [(1, "Stored once, then lost …"), (2, "A blank behind it "), (3, "Cut by […]"), (4, "Held twice, cut here…"), (5, "held twice, cut here..."), (6, "Lacks its stop"), (7, "Lacks its stop."), (8, "Weiß auf schw"), (9, "weiß auf schwarz."), (10, "The ca…"), (11, "The café."), (12, "-"), (13, "Dots ...... 5 and")]
    df = spark.createDataFrame(data, "id bigint, v string")
    got = {r["id"]: r["proof"] for r in truncation.find(df, "id", "v").collect()}
    assert {k for k, proof in got.items() if proof == "prefix"} == {8, 10}
    assert {1, 2, 3, 4, 5} <= set(got)


def test_forms_of_plain_values_are_those_of_the_others(spark):
    values = ["Foo  Bar ...", " a\n b &am", "[", "x [...]", "(See)  [ ", "Ends.\"\n", "..", "…", "é [", "1. A", "\n\nA\n", "a" + "." * 200 + " b", "A.....]"]
    got = {r["value"]: (r["form"], r["stem"], r["key"]) for r in truncation.shaped(spark.createDataFrame([(v,) for v in values], "value string")).collect()}
    assert got == {v: truncation.shape(v) for v in values}


def test_short_cuts_that_coincide(spark):
    hot, whole = "The board shall adopt the", "The board shall adopt the annual report before the next meeting."
    values = [hot] * 30 + [whole] * 30 + ["Under scrutiny"] * 9 + ["Under scrutiny by the Council.", "Under scrutiny until the next meeting."] + ["Held twice and cut wi"] * 2 + ["Not twice"] + [f"Comment number {n} ends here." for n in range(5000)]
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, v string")
    got = {(r["value"], r["proof"]) for r in truncation.find(df, "id", "v").collect()}
    assert got == {(hot, "prefix"), ("Held twice and cut wi", "ending"), ("Not twice", "ending")}
    assert truncation.find(df, "id", "v").count() == 33


def test_branches_against_brute_force(spark):
    r = random.Random(4)
    for alphabet, most in (("ab", 9), ("a", 40)):
        pool = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, most))) for _ in range(250)]
        asked = pool[:120] + ["a"]
        got = {x["v"]: x["branched"] for x in truncation.extended(*(spark.createDataFrame([(x,) for x in p], "v string") for p in (asked, pool))).collect()}
        longer = {x: [y for y in {*pool, *asked} if y != x and y.startswith(x)] for x in asked}
        assert got == {x: any(not b.startswith(a) and not a.startswith(b) for a in ys for b in ys) for x, ys in longer.items() if ys}


def test_leaks_table(spark):
    p = " ".join(f"word{n}" for n in range(30))
    docs = spark.createDataFrame([(1, "x " + p, 0), (1, "x " + p, 0), (2, None, 0), (3, "", 0), (4, " ".join(p.split()[5:22]), 0)], "doc_id bigint, text string, key int")
    items = spark.createDataFrame([(1, p, None), (2, None, "a"), (3, "few words", "b"), (1, p, None)], "item_id bigint, passage string, answer string")
    got = leaks.find(docs, "doc_id", "text", items, "item_id", "passage")
    assert rows(got.select("doc_id", "item_id", "n_words").distinct()) == [(1, 1, 30), (4, 1, 17)]
    assert leaks.find(docs, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK", 2)
    passages = [" ".join(f"p{k}w{n}" for n in range(20)) for k in range(5)]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id bigint, passage string")
    docs = spark.createDataFrame([(9, " and ".join(passages))], "doc_id bigint, text string")
    assert leaks.find(docs, "doc_id", "text", items, "item_id", "passage").count() == 5


def test_mixture(spark):
    docs = [(i, f"text number {i} " * (1 + i % 9), "big") for i in range(900)] + [(1000 + i, "small text", "small") for i in range(5)] + [(2000, None, "big"), (2001, " ", "big"), (2002, "x", None), (2003, "x", "unlisted"), (0, "text number 0 ", "big")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("uses", F.lit(1))
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    drawn, report = mixture.draw(df, "doc_id", "text", "source", targets)
    assert drawn.groupBy("doc_id").count().filter("count > 3").count() == 0
    assert drawn.filter("source = 'big'").groupBy("doc_id").count().filter("count > 1").count() == 0
    r = {x["source"]: x for x in report.collect()}
    assert r["big"]["reachable"] and abs(r["big"]["drawn_tokens"] / r["big"]["wanted_tokens"] - 1) < 0.02
    assert not r["small"]["reachable"] and r["small"]["n_uses"] == 15 and not r["none"]["reachable"] and r["none"]["n_uses"] == 0
    again, _ = mixture.draw(df.repartition(7), "doc_id", "text", "source", targets)
    assert rows(again) == rows(drawn)
    assert mixture.draw(df.limit(0), "doc_id", "text", "source", targets)[0].count() == 0
    two = spark.createDataFrame([(1, "one text", "big"), (1, "two text", "big"), (1, "one text", "big")], "doc_id bigint, text string, source string").withColumn("content", F.lit(0))
    assert mixture.draw(two, "doc_id", "text", "source", spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int"))[0].count() == 2


def test_sentences_table(spark):
    df = spark.createDataFrame([(1, "One. Two!", "k"), (2, None, "k"), (3, "  ", "k"), (4, "A sentence goes on. " * 5000, "k"), (1, "One. Two!", "k")], "doc_id bigint, text string, key string")
    got = sentences.sentences(df, "doc_id", "text")
    assert rows(got.filter("doc_id = 1").distinct()) == [(1, 0, 4), (1, 5, 9)] and got.filter("doc_id = 4").count() == 5000
    assert sentences.sentences(df.limit(0), "doc_id", "text").count() == 0
