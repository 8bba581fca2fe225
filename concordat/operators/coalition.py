"""Coalitions over parties with a weight: blocs of the agreement graph, majorities, blocking groups, pivots.

Parties are few (a table the size of a membership list); what grows with the data has been reduced to (party, party) before it comes here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from concordat.functions.lineage import cut

# Shares of states and of population for a majority, states for a blocking group, members.
STATES_SHARE, POPULATION_SHARE, BLOCKING_STATES, MEMBERS = 0.55, 0.65, 4, 27


def shares(populations: DataFrame, party: str, weight: str) -> DataFrame:
    """(party, weight, share of the total)."""
    return populations.select(F.col(party).alias("party"), F.col(weight).alias("weight"), (F.col(weight) / populations.agg(F.sum(weight)).scalar()).alias("share"))


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component): connected components by least label, with the label's own label taken along, checkpointed each round until nothing moves.

    nodes: (node); edges: (a, b) in either direction. A node without edges is its own component. Raises if most_rounds don't settle it.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(nodes.select(F.col("node"), F.col("node").alias("component")).distinct())
    for _ in range(most_rounds):
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "node")
        step = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        jump = step.join(step.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left")
        jump = cut(jump.select("node", F.least("component", F.coalesce("next", "component")).alias("component"), "was"))
        label = jump.select("node", "component")
        if not jump.filter("component <> was").limit(1).count():
            return label
    raise RuntimeError("components did not settle; raise most_rounds")


def blocs(parties: DataFrame, rates: DataFrame, weights: DataFrame, threshold: float, least_shared: int = 2) -> DataFrame:
    """(bloc, members, n, cohesion, share, blocking): groups of parties linked by rates, rounded to 3, of at least `threshold`.

    Cohesion is the mean rate of the links that exist, 0 without any. A party without a known weight counts as a member and weighs nothing.
    """
    edges = cut(rates.withColumn("rate", F.round("rate", 3)).filter((F.col("rate") >= threshold) & (F.col("shared") >= least_shared)))
    label = components(parties.select(F.col("party").alias("node")), edges)
    inner = edges.join(label, edges["a"] == label["node"]).groupBy("component").agg(F.avg("rate").alias("cohesion"))
    grown = label.join(weights, label["node"] == weights["party"], "left").groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("members"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("share"))
    blocking = (F.col("n") >= BLOCKING_STATES) & (F.col("share") > 1 - POPULATION_SHARE)
    return grown.join(inner, "component", "left").select(F.col("component").alias("bloc"), "members", "n", F.coalesce("cohesion", F.lit(0.0)).alias("cohesion"), "share", blocking.alias("blocking"))


def majority(sides: DataFrame, weights: DataFrame) -> DataFrame:
    """Per item the supporters and opposers: states, shares, whether the majority is reached or blocked. sides: (item, party, score)."""
    held = sides.join(weights, "party")
    yes, no = F.col("score") == 2, F.col("score") == 0
    g = held.groupBy("item").agg(F.count_if(yes).alias("n_support"), F.count_if(no).alias("n_oppose"), F.coalesce(F.sum(F.when(yes, F.col("share"))), F.lit(0.0)).alias("support_share"), F.coalesce(F.sum(F.when(no, F.col("share"))), F.lit(0.0)).alias("oppose_share"))
    states = F.col("n_support") / MEMBERS
    reached = (states >= STATES_SHARE) & (F.col("support_share") >= POPULATION_SHARE)
    blocked = (F.col("n_oppose") >= BLOCKING_STATES) & (F.col("oppose_share") > 1 - POPULATION_SHARE)
    return g.select("item", "n_support", "n_oppose", "support_share", "oppose_share", states.alias("states_share"), F.greatest(F.lit(0.0), POPULATION_SHARE - F.col("support_share")).alias("missing_share"), F.when(blocked, "blocked").when(reached, "reached").otherwise("not reached").alias("verdict"))


def additions(base: DataFrame, candidates: DataFrame, weights: DataFrame) -> DataFrame:
    """Each candidate outside the base with the group's states and share if it joined, and what the group would then be."""
    held = base.join(weights, "party", "left")
    out = candidates.join(base, "party", "left_anti").join(weights, "party", "left")
    out = out.withColumns({"n0": held.agg(F.count(F.lit(1))).scalar(), "share0": held.agg(F.coalesce(F.sum("share"), F.lit(0.0))).scalar()})
    n, s = F.col("n0") + 1, F.col("share0") + F.coalesce("share", F.lit(0.0))
    return out.select("party", F.coalesce("share", F.lit(0.0)).alias("share"), n.alias("n_with"), s.alias("share_with"), ((n >= BLOCKING_STATES) & (s > 1 - POPULATION_SHARE)).alias("blocks"), ((n / MEMBERS >= STATES_SHARE) & (s >= POPULATION_SHARE)).alias("reaches"))


def report(members: DataFrame, weights: DataFrame) -> DataFrame:
    """What each named group of states weighs, whether it decides or blocks, and what it lacks. members: (name, party); a party without a weight counts as a state of weight 0."""
    g = members.join(weights, "party", "left").groupBy("name").agg(F.count(F.lit(1)).alias("n_states"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("s"))
    states = F.col("n_states") / MEMBERS
    return g.select(
        "name", "n_states", F.round("s", 4).alias("population_share"), F.round(states, 4).alias("states_share"),
        ((states >= STATES_SHARE) & (F.col("s") >= POPULATION_SHARE)).alias("qualified"), ((F.col("n_states") >= BLOCKING_STATES) & (F.col("s") > 1 - POPULATION_SHARE)).alias("blocks"),
        F.greatest(F.lit(0), F.lit(round(STATES_SHARE * MEMBERS)) - F.col("n_states")).alias("states_missing"), F.round(F.greatest(F.lit(0.0), POPULATION_SHARE - F.col("s")), 4).alias("population_missing"),
    )
