"""Comparison of two versions of a text: full outer pairing, word-level similarity and churn, uptake of requests.

The ratio is that of Ratcliff and Obershelp as the standard library gives it, autojunk included, on whole texts; pairs arrive in Arrow batches, so the
work is spread by pair and equal pairs are done once per batch.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

_DIFF = T.StructType([T.StructField("similarity", T.DoubleType()), T.StructField("added", T.IntegerType()), T.StructField("removed", T.IntegerType())])


def word_diff(old: str, new: str, autojunk: bool = True) -> tuple[float, int, int]:
    """(similarity, words added, words removed)."""
    a, b = old.split(), new.split()
    if a == b:
        return 1.0, 0, 0
    m = difflib.SequenceMatcher(None, a, b, autojunk)
    added = removed = 0
    for tag, i1, i2, j1, j2 in m.get_opcodes():
        if tag != "equal":
            added += j2 - j1
            removed += i2 - i1
    return m.ratio(), added, removed


@F.pandas_udf(_DIFF)
def _diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    done: dict = {}
    out = []
    for a, b in zip(old, new):
        key = (a, b)
        if key not in done:
            done[key] = (None, None, None) if a is None and b is None else word_diff(a or "", b or "")
        out.append(done[key])
    return pd.DataFrame(out, columns=["similarity", "added", "removed"])


def inline(old: str, new: str, most: int = 4000, context: int | None = None) -> str:
    """The difference word by word as marked text: [-removed-] {+added+}; runs of equal words longer than 2 * context + 12 are shortened; beyond `most` words of either side a note says what is not shown."""
    a, b = old.split(), new.split()
    note = f" [… {max(len(a), len(b)) - most} words not shown]" if max(len(a), len(b)) > most else ""
    a, b = a[:most], b[:most]
    out = []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if tag == "equal":
            run = a[i1:i2]
            if context is not None and len(run) > 2 * context + 12:
                run = [*run[:context], f"[… {len(run) - 2 * context} words …]", *run[-context:]] if context else [f"[… {len(run)} words …]"]
            out += run
        else:
            out += ["[-" + " ".join(a[i1:i2]) + "-]"] * (i2 > i1) + ["{+" + " ".join(b[j1:j2]) + "+}"] * (j2 > j1)
    return " ".join(out) + note


@F.pandas_udf(T.StringType())
def inline_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([inline(a or "", b or "", context=8) for a, b in zip(old, new)])


@F.pandas_udf(T.StringType())
def inline_whole(old: pd.Series, new: pd.Series) -> pd.Series:
    """Marked differences of whole texts, nothing shortened."""
    return pd.Series([inline(a or "", b or "", most=10**9) for a, b in zip(old, new)])


def versions(old: DataFrame, new: DataFrame, keys: str | list[str], text: str, threshold: float = 0.995, measured: bool = True) -> DataFrame:
    """(keys, status, similarity, added, removed): every key of either side; ajout, suppression, inchange, reformulation.

    Similarity is null where a side lacks the key. Equal texts never reach Python. With measured=False only equality decides, all in the JVM.
    """
    keys = [keys] if isinstance(keys, str) else keys
    a = old.select(*keys, F.coalesce(text, F.lit("")).alias("old_text"), F.lit(True).alias("__o"))
    b = new.select(*keys, F.coalesce(text, F.lit("")).alias("new_text"), F.lit(True).alias("__n"))
    both = a.join(b, keys, "full_outer")
    pair = F.col("__o").isNotNull() & F.col("__n").isNotNull()
    differs = F.col("old_text") != F.col("new_text")
    if not measured:
        status = F.when(F.col("__o").isNull(), "ajout").when(F.col("__n").isNull(), "suppression").when(differs, "reformulation").otherwise("inchange")
        return both.select(*keys, status.alias("status"))
    asked = ~pair | differs
    both = both.withColumn("__d", _diff(F.when(asked, F.col("old_text")), F.when(asked, F.col("new_text"))))
    similarity = F.when(pair, F.when(differs, F.col("__d.similarity")).otherwise(1.0))
    status = F.when(F.col("__o").isNull(), "ajout").when(F.col("__n").isNull(), "suppression").when(similarity >= threshold, "inchange").otherwise("reformulation")
    return both.select(*keys, status.alias("status"), similarity.alias("similarity"), F.coalesce("__d.added", F.lit(0)).alias("added"), F.coalesce("__d.removed", F.lit(0)).alias("removed"))


def history(df: DataFrame, text: str, before: str) -> DataFrame:
    """df with the difference of each text to the one before; null for a first version and where both are empty."""
    known = F.col(before).isNotNull() & ((F.col(text) != "") | (F.col(before) != ""))
    out = df.withColumn("__d", _diff(F.when(known, F.col(before)), F.when(known, F.col(text))))
    return out.withColumns({"similarity": F.col("__d.similarity"), "added": F.col("__d.added"), "removed": F.col("__d.removed")}).drop("__d")


def quoted_in(quote: str, source: str, least: float = 0.75, words: int = 4) -> bool:
    """Whether a quotation of at least `words` words stands in the source, or most of its words do in their order."""
    norm = lambda s: re.sub(r"[^\w\s]", " ", re.sub(r"\s+", " ", s.lower())).strip()
    q, s = norm(quote), norm(source)
    asked = q.split()
    if len(asked) < words:
        return False
    if q in s:
        return True
    places: dict[str, list[int]] = {}
    for n, w in enumerate(s.split()):
        places.setdefault(w, []).append(n)
    from bisect import bisect_left

    at = hits = 0
    for w in asked:
        here = places.get(w)
        k = bisect_left(here, at) if here else 0
        if here and k < len(here):
            at, hits = here[k] + 1, hits + 1
    return hits / len(asked) >= least


@F.pandas_udf(T.BooleanType())
def _quoted(quote: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([None if q is None or s is None else quoted_in(q, s) for q, s in zip(quote, source)], dtype=object)


def quote_matches(quote: Column, source: Column) -> Column:
    """F11 for a column: literal hits of four words and more are settled in the JVM, the rest in order, word by word, in batches."""
    norm = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s+", " "), r"(?U)[^\w\s]", " "))
    sure = (F.size(F.split(norm(quote), r"\s+")) >= 4) & F.contains(norm(source), norm(quote))
    return F.when(sure, True).otherwise(_quoted(F.when(~sure, quote), F.when(~sure, source)))


def uptake(requests: DataFrame, party: str, verdict: str) -> DataFrame:
    """Per party how many requests were kept, in part, dropped, undecided, and the rate (kept + half of partly) / decided; null if none is decided."""
    n = lambda v: F.count_if(F.col(verdict) == v)
    g = requests.groupBy(F.col(party).alias("party")).agg(F.count(F.lit(1)).alias("n"), n("retenue").alias("kept"), n("partielle").alias("partly"), n("ecartee").alias("dropped"))
    decided = F.col("kept") + F.col("partly") + F.col("dropped")
    return g.withColumn("rate", (F.col("kept") + F.col("partly") * 0.5) / F.nullif(decided, F.lit(0)))


def track(requests: DataFrame, target: DataFrame, keys: list[str], deletion: str) -> DataFrame:
    """requests with the verdict that structure alone gives: a deletion is retenue where the section is gone, ecartee where it stands; all else indetermine."""
    there = target.select(*keys).distinct().withColumn("__there", F.lit(True))
    asked = F.coalesce(F.col(deletion), F.lit(False))
    verdict = F.when(asked & F.col("__there").isNull(), "retenue").when(asked, "ecartee").otherwise("indetermine")
    return requests.join(there, keys, "left").withColumn("verdict", verdict).drop("__there")
