"""Skewed keys, orphan references, differences between copies: defined results for nulls, empties, ties, repeats, clashing names."""

import pytest

from concordat.operators import balance, orphans, reconcile


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_pack_splits_a_heavy_key_and_balances():
    packed = balance.pack([("a", 90), ("b", 10), ("c", 10)], 120, 4)
    shards = {k: n for k, n, _ in packed}
    assert shards["a"] == 3 and shards["b"] == 1
    load = [0.0] * 4
    for k, n, tasks in packed:
        for t in tasks:
            load[t] += {"a": 90, "b": 10, "c": 10}[k] / n
    assert max(load) <= 30 + 1e-9
    assert balance.pack([], 0, 4) == []


def test_per_key_with_nulls_repeats_and_clashing_names(spark):
    data = [(1, "a", "xx", 0), (1, "a", "xx", 0), (2, "a", None, 0), (None, "a", "", 0), (3, None, "abc", 0), (4, "b", "y" * 100_000, 0)]
    df = spark.createDataFrame(data, "id bigint, k string, text string, n int")
    got = {r["k"]: tuple(r)[1:] for r in balance.per_key(df, "k", "id", "text").collect()}
    assert got["a"] == (4, 2, 4 / 3) and got[None] == (1, 1, 3.0) and got["b"] == (1, 1, 100_000.0)
    assert balance.per_key(df.limit(0), "k", "id", "text").count() == 0


def test_per_key_is_the_same_however_skewed(spark):
    df = spark.range(20_000).selectExpr("id", "case when id % 3 < 2 then 'hot' else cast(id % 50 as string) end as k", "repeat('x', cast(id % 7 as int)) as text")
    got = rows(balance.per_key(df, "k", "id", "text", tasks=6).select("k", "n_rows", "n_ids"))
    want = rows(df.groupBy("k").agg({"*": "count"}).selectExpr("k", "`count(1)` as a", "`count(1)` as b"))
    assert got == want
    packing = balance.plan(df, "k", 6).collect()
    hot = next(r for r in packing if r["__key"] == "hot")
    assert hot["__shards"] == 5 and len(set(hot["__tasks"])) == 5  # two thirds of the rows over six tasks


def test_heavy_values(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "b"), (4, "c")], "id bigint, k string").withColumn("text", __import__("pyspark").sql.functions.lit("t"))
    assert rows(balance.heavy_values(df, ["k"], "id", "text", 0.4)) == [("k", "a")]


def test_replicate_join(spark):
    left = spark.createDataFrame([(i, "a") for i in range(50)] + [(90, "b"), (91, None), (92, "z")], "id bigint, k string")
    right = spark.createDataFrame([("a", 1, 7), ("b", 2, 8), (None, 3, 9)], "k string, id bigint, v int")
    got = balance.replicate_join(left, right, "k", ["id"], tasks=4)
    assert got.columns == ["id", "k", "id_right", "v"] and got.count() == 53
    assert got.filter("v is null").count() == 2 and got.filter("k = 'a' and v = 7").count() == 50
    assert balance.replicate_join(left, right.limit(0), "k", ["id"], how="inner").count() == 0


def test_orphans(spark):
    child = spark.createDataFrame([(1, "x"), (1, "x"), (2, ""), (3, None), (4, "X"), (5, "y ")], "id bigint, ref string")
    parent = spark.createDataFrame([("x",), ("y",), (None,)], "id string")
    assert rows(orphans.find(child, parent, [("ref", "id")])) == [(4, "X"), (5, "y ")]
    assert orphans.find(child, parent.limit(0), [("ref", "id")]).count() == 4
    assert orphans.find(child.limit(0), parent, [("ref", "id")]).count() == 0


def test_orphans_of_composite_keys_at_a_saturated_filter(spark, monkeypatch):
    monkeypatch.setattr("concordat.functions.bloom.MAX_ITEMS", 1)
    parent = spark.range(20_000).selectExpr("cast(id as string) as a", "id % 5 as b")
    child = spark.range(19_990, 20_010).selectExpr("cast(id as string) as a", "id % 5 as b", "'t' as k")
    assert orphans.find(child, parent, [("a", "a"), ("b", "b")]).count() == 10


def test_orphans_without_the_filter_in_the_plan(spark):
    parent = spark.range(100_000).selectExpr("cast(id as string) as id")
    got = orphans.find(spark.range(99_990, 100_010).selectExpr("cast(id as string) as ref"), parent, [("ref", "id")])
    assert got.count() == 10
    assert len(got._jdf.queryExecution().toString()) < 50_000  # the filter has 120 kB, spelled out at each of its uses


def test_differences(spark):
    a = spark.createDataFrame([(1, "x", {"k": "v"}), (2, None, None), (3, "same", None), (5, "q", None), (None, "n", None)], "id bigint, text string, m map<string,string>")
    b = spark.createDataFrame([(1, "X", {"k": "v"}), (2, "", None), (3, "same", None), (3, "same", None), (4, "new", None), (5, "q", {"z": "1"})], "id bigint, text string, m map<string,string>")
    got = reconcile.differences(a, b, "id", "only_a", "only_b")
    assert rows(got.select("id", "diff_kind")) == sorted([(1, "text"), (2, "text"), (4, "only_b"), (5, "m"), (None, "only_a")], key=str)
    assert got.filter("id = 1").select("left_value", "right_value").collect()[0][:] == ("x", "X")
    assert reconcile.differences(a, a, "id", "l", "r").filter("id is not null").count() == 0
    assert reconcile.differences(a, b.limit(0), "id", "only_a", "only_b").count() == 5


def test_differences_far_apart_keys(spark):
    a = spark.range(0, 3000).selectExpr("id * 1000003 - 5000000000 as id", "cast(id as string) as text")
    b = a.selectExpr("id", "case when text = '77' then '78' else text end as text").filter("text <> '2999'")
    assert rows(reconcile.differences(a, b, "id", "l", "r").select("diff_kind")) == [("l",), ("text",)]


def test_differences_against_brute_force(spark):
    import random

    r = random.Random(3)
    for span, share in ((40, 0.5), (3_000_000, 0.02)):
        keys = r.sample(range(-span, span), 40)
        a = [(k, f"t{k}", None if k % 5 else k) for k in keys for _ in range(1 + (r.random() < 0.1))]
        b = [(k, t + "x" if r.random() < share else t, n if r.random() > share else 7) for k, t, n in a if r.random() > share]
        b += [(k + 1, "new", 1) for k in keys[:2] if k + 1 not in keys]
        got = rows(reconcile.differences(spark.createDataFrame(a, "id bigint, text string, n int"), spark.createDataFrame(b, "id bigint, text string, n int"), "id", "l", "r").select("id", "diff_kind"))
        want = set()
        for k in {x[0] for x in a + b}:
            one, two = {x for x in a if x[0] == k}, {x for x in b if x[0] == k}
            if not one or not two:
                want.add((k, "l" if one else "r"))
            else:
                want |= {(k, f) for f, n in (("text", 1), ("n", 2)) if {x[n] for x in one} != {x[n] for x in two}}
        assert got == sorted(want, key=str)


def test_unequal_ranges_tell_repeated_rows_from_each_other(spark):
    """Rows that are stored twice on one side each do not cancel out."""
    a = spark.createDataFrame([(0, "r"), (0, "r"), (1, "s")], "id bigint, text string")
    b = spark.createDataFrame([(1, "s"), (2, "t"), (2, "t")], "id bigint, text string")
    assert rows(reconcile.differences(a, b, "id", "l", "r").select("id", "diff_kind")) == [(0, "l"), (2, "r")]


def test_levels_of_the_descent():
    assert reconcile.levels(5, 5) == [0]
    for low, high in ((0, 7999), (-(2**62), 2**62), (1, 10**11)):
        steps = reconcile.levels(low, high)
        assert steps[-1] == 0 and all(0 < a - b <= 6 for a, b in zip(steps, steps[1:])) and ((high >> steps[0]) - (low >> steps[0])) < reconcile.ROOTS


def test_replicated_rows_are_joined_in_the_tasks_of_the_packing(spark):
    left = spark.createDataFrame([("hot" if n % 3 else f"k{n}", n) for n in range(3000)], "key string, id bigint")
    right = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k0", "c"), ("none", "d")], "key string, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = balance.replicate_join(left, right, "key", ["id"], tasks=6)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("shufflepartitionidpassthrough") == 2 and "Exchange hashpartitioning" not in plan
        assert got.count() == 2 * 2000 + 1000 and got.filter("v is not null").count() == 4001
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from concordat.functions import lineage

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(RuntimeError):
        lineage.shared_folder(unset)
