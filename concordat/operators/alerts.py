"""Reliability alerts: rules over the results, each a small aggregate, all in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


#: Members that an alert names, at most, the first in order.
NAMED = 50


def counted(df: DataFrame, rule: str, wrong: Column, severity: Column, applies: Column | None = None, members: Column | None = None) -> DataFrame:
    """(rule, severity, n, of): rows that break a rule, of those it applies to. severity: an expression over n and of, null where there is no alert.

    members: whom a row concerns, of a bounded set such as parties; given as the sorted array `members`.
    """
    base = df if applies is None else df.filter(applies)
    named = [] if members is None else [F.slice(F.array_sort(F.collect_set(F.when(wrong, members))), 1, NAMED).alias("members")]
    g = base.agg(F.count_if(wrong).alias("n"), F.count(F.lit(1)).alias("of"), *named)
    return g.select(F.lit(rule).alias("rule"), severity.alias("severity"), "n", "of", *(["members"] if named else []))


def counted_together(df: DataFrame, rules: list[tuple[str, Column, Column | None, Column]]) -> DataFrame:
    """As `counted`, several rules (name, wrong, applies, severity) over one reading of the rows."""
    yes = lambda c: F.lit(True) if c is None else F.coalesce(c, F.lit(False))
    row = df.agg(*[x for k, (_, wrong, applies, _) in enumerate(rules) for x in (F.count_if(yes(applies) & F.coalesce(wrong, F.lit(False))).alias(f"n{k}"), F.count_if(yes(applies)).alias(f"of{k}"))])
    each = row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"n{k}").alias("n"), F.col(f"of{k}").alias("of")) for k, (name, *_) in enumerate(rules)])).alias("r")).select("r.*")
    severity = F.lit(None).cast("string")
    for name, _, _, s in rules:
        severity = F.when(F.col("rule") == name, s).otherwise(severity)
    return each.select("rule", severity.alias("severity"), "n", "of")


def alerts(parts: list[DataFrame]) -> DataFrame:
    """The alerts that were raised, most severe first in rank."""
    rank = F.when(F.col("severity") == "bloquant", 0).when(F.col("severity") == "attention", 1).otherwise(2)
    return reduce(DataFrame.unionByName, parts).filter(F.col("severity").isNotNull()).withColumn("rank", rank)


def coverage(party: str, reference: str, stance: str) -> tuple[str, Column, Column, Column]:
    """The rule on rows of other parties without an analysis: attention below 95 % covered, blocking at 50 % or less."""
    share = 1 - F.col("n") / F.nullif(F.col("of"), F.lit(0))
    return "coverage", F.col(stance).isNull(), F.coalesce(F.col(party), F.lit("")) != reference, F.when(share <= 0.5, "bloquant").when(share < 0.95, "attention")


def few(df: DataFrame, rule: str, by: list[str], below: int, distinct: str) -> DataFrame:
    """Groups with fewer than `below` different values of `distinct`."""
    g = df.groupBy(*by).agg(F.countDistinct(distinct).alias("d"))
    return counted(g, rule, F.col("d") < below, F.when(F.col("n") > 0, "attention"))
