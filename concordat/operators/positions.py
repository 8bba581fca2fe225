"""From contributions to positions: lexical stance, score matrix, rankings, weights, agreement, targets.

Tables are long: (item, party, score), score 2, 1, 0 or null. Null is no position: it never enters a mean or a rate. Where a party speaks
several times on an item the least score holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from concordat.functions.lineage import cut

# Marker patterns of the lexical stance.
OPPOSE = [r"\bwe (?:do not|don't) support\b", r"\boppose[sd]?\b", r"\bcannot support\b", r"\bdisagree\b", r"\bwe object\b", r"\bstrongly against\b", r"\bnot in a position\b", r"\bshould be deleted\b", r"\bwe are against\b", r"\bno added value\b"]
ALIGNE = [r"\bwe support\b", r"\bfully support\b", r"\bwelcome[sd]?\b", r"\bagree\b", r"\bwe are in favour\b", r"\bstrongly support\b", r"\bappreciate\b", r"\bcan support\b", r"\bendorse\b"]
PARTIEL = [r"\bhowever\b", r"\bnevertheless\b", r"\bprovided that\b", r"\bsubject to\b", r"\bwould prefer\b", r"\bclarif", r"\bsuggest", r"\bwe propose\b"]
SCRUTINY = [r"scrutiny reservation", r"reserve d'examen", r"réserve d'examen", r"\bparliamentary reservation\b", r"\bexamination reservation\b"]
DELETION = [r"\bdelet(?:e|ed|es|ing|ion)\b", r"\bshould be removed\b", r"\bbe deleted\b", r"\bsuppress", r"\bsupprim"]
# Scores of the stances; others have none.
SCORES = {"aligne": 2, "partiel": 1, "oppose": 0}


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether the lower-cased text matches one of the patterns; one alternation, one pass.

    Patterns that begin a word are tried only where one of their first letters stands and a word begins.
    """
    words = [p[2:] for p in patterns if p.startswith(r"\b")]
    heads = "".join(sorted({w[0] for w in words}))
    begun = [rf"(?=[{heads}])\b(?:{'|'.join(words)})"] if words else []
    return F.lower(text).rlike("(?U)" + "|".join([*begun, *(p for p in patterns if not p.startswith(r"\b"))]))


def stance_score(stance: Column) -> Column:
    """Score of a stance, null for those without one."""
    score = F.lit(None).cast("int")
    for name, value in SCORES.items():
        score = F.when(stance == name, F.lit(value)).otherwise(score)
    return score


def stance_of(oppose: bool, aligned: bool, partial: bool, scrutiny: bool, deletion: bool, silent: bool, drafting: bool) -> tuple[str, float]:
    """(stance, confidence) of the markers found. silent: the reference said nothing, so any request departs from the text."""
    if oppose or deletion or (silent and scrutiny):
        return "oppose", 0.45
    if silent:
        return ("partiel", 0.35) if drafting or partial else ("aligne", 0.40) if aligned else ("neutre", 0.25)
    if aligned:
        return ("partiel", 0.40) if partial else ("partiel", 0.35) if scrutiny else ("aligne", 0.45)
    return ("partiel", 0.35) if partial else ("neutre", 0.25)


#: The stance of each combination of markers, by the bits of its place.
STANCES = [stance_of(*(bool(n >> bit & 1) for bit in range(7))) for n in range(128)]


def lexical_stance(df: DataFrame, text: str, kind: Column, silent: Column) -> DataFrame:
    """df with stance, score, confidence, scrutiny, deletion and evidence by the markers in `text`.

    silent: whether the reference party said nothing on the item, so that any request departs from the text. kind: the contribution's kind.
    Null texts have no stance and no score; blank ones are neutral. Evidence is the first line, at most 600 characters. The markers found make one
    number, by which the rest is looked up. A filter on the result repeats the patterns below; `matrix` therefore drops null scores after its aggregation.
    """
    t = F.col(text)
    bits = [any_of(t, p) for p in (OPPOSE, ALIGNE, PARTIEL, SCRUTINY, DELETION)] + [F.coalesce(silent, F.lit(False)), F.coalesce(kind, F.lit("")) == "drafting"]
    code = F.lit(0)
    for n, bit in enumerate(bits):
        code = code + F.when(bit, F.lit(1 << n)).otherwise(F.lit(0))
    df = df.withColumn("__code", F.when(t.isNotNull(), code))
    look = lambda values: F.try_element_at(F.array(*[F.lit(v) for v in values]), F.col("__code") + 1)
    return df.withColumns({
        "lex_stance": look([s for s, _ in STANCES]), "lex_confidence": look([c for _, c in STANCES]), "lex_score": look([SCORES.get(s) for s, _ in STANCES]),
        "lex_scrutiny": F.col("__code").bitwiseAND(8) > 0, "lex_deletion": F.col("__code").bitwiseAND(16) > 0,
        "lex_evidence": F.substring(F.substring_index(F.trim(t), "\n", 1), 1, 600),
    }).drop("__code")


def quote_ratio(quote: Column, source: Column) -> Column:
    """Share of the quote's words of more than three letters that the source holds; 1 if it holds the whole quote, null for a blank one."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    q, s = norm(quote), norm(source)
    words = F.filter(F.split(q, " "), lambda w: F.length(w) > 3)
    hits = F.filter(words, lambda w: F.contains(s, w))
    return F.when(q == "", None).when(F.contains(s, q), F.lit(1.0)).otherwise(F.size(hits) / F.nullif(F.size(words), F.lit(0)))


def matrix(df: DataFrame, item: list[str], party: str, score: str, without: str | None = None) -> DataFrame:
    """(item columns, party, score): the least score of each party on each item; null scores and null parties count for nothing."""
    held = df.filter(F.col(party).isNotNull())
    if without is not None:
        held = held.filter(F.col(party) != without)
    return held.groupBy(*item, F.col(party).alias("party")).agg(F.min(score).alias("score")).filter(F.col("score").isNotNull())


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("score") == v).alias(f"n_{v}") for v in (2, 1, 0)]]


def ranking(m: DataFrame) -> DataFrame:
    """Parties by mean score."""
    return m.groupBy("party").agg(F.avg("score").alias("mean_score"), *_counts())


def contentious(m: DataFrame, item: list[str]) -> DataFrame:
    """Items by mean and sample deviation (null for a single party)."""
    return m.groupBy(*item).agg(F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("dispersion"), *_counts())


def agreement(m: DataFrame, item: list[str], least: int = 2) -> DataFrame:
    """(a, b, shared, rate), a < b: share of equal scores over the items on which both spoke; pairs sharing fewer than `least` are left out.

    One join of the small pre-aggregated matrix with itself on the item gives both figures; the shuffle is linear in the matrix.
    """
    x, y = m.alias("x"), m.alias("y")
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in item]
    pairs = x.join(y, [*on, F.col("x.party") < F.col("y.party")])
    out = pairs.groupBy(F.col("x.party").alias("a"), F.col("y.party").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.avg((F.col("x.score") == F.col("y.score")).cast("double")).alias("rate"))
    return out.filter(F.col("shared") >= least)


def weighted(df: DataFrame, item: list[str], party: str, score: str, weight: str) -> DataFrame:
    """Cells as weighted means of all scores of a party on an item."""
    return df.filter(F.col(score).isNotNull() & F.col(party).isNotNull()).groupBy(*item, F.col(party).alias("party")).agg((F.sum(F.col(score) * F.col(weight)) / F.sum(weight)).alias("score"))


def weighted_ranking(df: DataFrame, party: str, score: str, weight: str) -> DataFrame:
    """Per party the raw and the weighted mean, their difference, rows and rows of weight above 1."""
    raw, heavy = F.avg(score), F.sum(F.col(score) * F.col(weight)) / F.sum(weight)
    return df.filter(F.col(score).isNotNull() & F.col(party).isNotNull()).groupBy(F.col(party).alias("party")).agg(raw.alias("raw_mean"), heavy.alias("weighted_mean"), (heavy - raw).alias("difference"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(weight) > 1).alias("n_weighted"))


def targets(m: DataFrame, parties: DataFrame, share: str) -> DataFrame:
    """Every party of `parties` with its counts and whether it is silent, opposed, ally or to be persuaded."""
    held = m.groupBy("party").agg(F.avg("score").alias("mean_score"), *_counts())
    out = parties.join(held, "party", "left").na.fill(0, ["n", "n_2", "n_1", "n_0"])
    status = F.when(F.col("n") == 0, "silent").when(F.col("n_0") > F.col("n_2"), "opposed").when(F.col("n_2") >= F.greatest(F.lit(1.0), F.col("n") / 2), "ally").otherwise("persuade")
    return out.withColumn("status", status).select("party", share, "mean_score", "n", "n_2", "n_1", "n_0", "status")


def dominant(df: DataFrame, by: list[str], stance: str, order: list[str]) -> DataFrame:
    """The first stance of `order` that occurs in each group; others rank behind."""
    rank = F.lit(len(order))
    for n, name in reversed(list(enumerate(order))):
        rank = F.when(F.col(stance) == name, F.lit(n)).otherwise(rank)
    return df.groupBy(*by).agg(F.min(rank).alias("__r"), F.count(F.lit(1)).alias("n")).withColumn("dominant", F.element_at(F.array(*[F.lit(o) for o in order], F.lit(None).cast("string")), F.col("__r") + 1)).drop("__r")


def round_robin(df: DataFrame, item: str, order: list[str], k: int) -> DataFrame:
    """A sample of k rows that takes the first row of every item, then the second, and so on."""
    turn = F.row_number().over(Window.partitionBy(item).orderBy(*order)) - 1
    return df.withColumn("turn", turn).orderBy("turn", item, *order).limit(k)


def kappa(df: DataFrame, one: str, two: str) -> DataFrame:
    """Cohen's kappa of two codings over the rows that have both; null where chance agreement is 1 or there are none."""
    # one small table from which all the rest is made; a filter before it would repeat the codings
    cells = cut(df.groupBy(F.col(one).alias("x"), F.col(two).alias("y")).agg(F.count(F.lit(1)).alias("n"))).filter("x is not null and y is not null")
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    rows, cols = cells.groupBy("x").agg(F.sum("n").alias("nx")), cells.groupBy("y").agg(F.sum("n").alias("ny"))
    chance = rows.join(cols, rows["x"] == cols["y"]).agg(F.coalesce(F.sum(F.col("nx") * F.col("ny")), F.lit(0)))
    return total.withColumn("chance", chance.scalar()).select("total", (F.col("same") / F.col("total")).alias("observed"), F.when(F.col("chance") != F.col("total") * F.col("total"), (F.col("same") / F.col("total") - F.col("chance") / F.col("total") / F.col("total")) / (1 - F.col("chance") / F.col("total") / F.col("total"))).alias("kappa"))


# The stance that a kind of request stands for.
NATURES = {"suppression": "oppose", "modification": "partiel", "soutien": "aligne", "reserve": "oppose", "question": "neutre"}


def extracted(df: DataFrame, nature: str, source: str, text: str) -> DataFrame:
    """Extracted positions as contributions with their analysis: stance by nature, confidence 0.7, the source before the text. Rows of no known nature are dropped."""
    n = F.col(nature)
    stance = F.lit(None).cast("string")
    for name, value in NATURES.items():
        stance = F.when(n == name, value).otherwise(stance)
    out = df.withColumns({"stance": stance, "confidence": F.lit(0.7), "scrutiny": n == "reserve", "deletion": n == "suppression", "kind": F.lit("non-paper"), text: F.concat(F.lit("["), F.col(source), F.lit("] "), F.col(text))})
    return out.filter(F.col("stance").isNotNull())


def weighed(df: DataFrame, matches: DataFrame, key: str, factor: float) -> DataFrame:
    """df with `weight`, the factor for keys that met a criterion and 1 for others, and the `quotation` that shows it. matches: (key, quotation)."""
    return df.join(matches.dropDuplicates([key]), key, "left").withColumn("weight", F.when(F.col("quotation").isNotNull(), F.lit(factor)).otherwise(1.0))
