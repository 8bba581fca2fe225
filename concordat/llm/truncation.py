"""Values that lost their tail.

Three proofs, strongest first:
- `prefix`: the value is a strict prefix of another, longer value. Both are compared by their keys (consistent form without the marks of a cut and without
  closing punctuation), so that no value extends itself or another one by a mark alone. All distinct keys are range-sorted, where a key's extensions follow
  it directly, so one pass over sorted partitions compares neighbours; no pair of values is joined and no prefix group meets in one task.
- `source`: the value is a quotation and its source goes on within the sentence where the value stops.
- `ending`: no longer copy is stored anywhere, but the value stops without the end of a sentence and is no stock answer (short, without a mark, given by at least two records and one in stock_one_in; both bounds are parameters).
A stock answer that longer values extend is none if they are all one text, stored in several lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from concordat.functions import bloom, lineage
from concordat.llm.normalize import PLAIN, canonical, plain_form

#: Words of a short answer at most; a longer value that recurs is not taken for complete because of that.
SHORT_WORDS = 8
#: A short value is a stock answer where at least one record in so many gives it (measured on sf0.1: stock answers 1 in 300 or more, coinciding cuts none).
STOCK_ONE_IN = 2_000
_MARK = r"(?:\s|…|\.{2,}+|�|&#?\w*;?|\[\s*$|\[?(?:\.{3}|…)\]?)+$"
_ENDED = r"[.!?。！？؟।\u037e](?:\s*['\"”’»)\]])*\s*$"
# Abbreviations that a sentence does not end with.
_SHORTENED = r"(?i)(?:^|[\s(«“])(?:art|al|ann|cf|fig|p|pp|vol|no|nr|núm|pág|n|abs|anh|abb|s|sec|cap|dr|mr|mrs|ms|mme|m|st|i\.e|e\.g|z\.b|d\.h|p\. ex|bzw|approx|ca|vgl)\.\s*$"
_TAIL = regex.compile(_MARK)
_SIGNS = regex.compile(r"[^\p{L}\p{M}\p{N}]+$")
_END = regex.compile(_ENDED)


def _unclosed(value: Column) -> Column:
    count = lambda c: F.length(value) - F.length(F.replace(value, F.lit(c), F.lit("")))
    return (count("«") > count("»")) | (count("“") > count("”"))


def suspects(df: DataFrame, key: str, column: str) -> DataFrame:
    """(id, value) of the distinct non-blank values that do not plainly end a sentence, by built-in functions."""
    v = F.col(f"`{column}`")
    ended = v.rlike(_ENDED) & ~v.rlike(r"(?:…|\.{2,})\s*$") & ~v.rlike(_SHORTENED) & ~_unclosed(v)
    return df.select(F.col(f"`{key}`").alias("id"), v.alias("value")).filter(F.col("value").isNotNull() & (F.trim("value") != "") & F.col("id").isNotNull() & ~ended).distinct()


_FORMS = T.StructType([T.StructField(name, T.StringType()) for name in ("form", "stem", "key")])


def shape(value: str) -> tuple[str, str, str]:
    """The consistent form of a value, that without the marks of a cut (stem), and the stem without punctuation at its end (key)."""
    stem = canonical(_TAIL.sub("", value))
    return canonical(value), stem, _SIGNS.sub("", stem)


@F.pandas_udf(_FORMS)
def _shapes(values: pd.Series) -> pd.DataFrame:
    done = {v: shape(v) for v in values.dropna().unique()}
    return pd.DataFrame([done.get(v, (None, None, None)) for v in values], columns=_FORMS.names)


def shaped(df: DataFrame) -> DataFrame:
    """df with `form`, `stem` and `key` of its column `value`; plain ASCII values by built-in functions."""
    value = F.col("value")
    plain = value.rlike(PLAIN)
    bare = plain_form(F.regexp_replace(value, _MARK, ""))
    built = (plain_form(value), bare, F.regexp_replace(bare, "[^a-z0-9]+$", ""))
    out = df.withColumn("__n", _shapes(F.when(~plain, value)))  # plain values reach Python as nulls
    return out.withColumns({name: F.when(plain, b).otherwise(F.col(f"__n.{name}")) for name, b in zip(_FORMS.names, built)}).drop("__n")


_SEEN = "v string, kind string, asked boolean, hit boolean, branched boolean"


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over a sorted partition of (v, asked, hit, branched): `hit` for each asked value that later ones extend, branched where these are not all prefixes of one another.

    As `end` come the values that decide what goes on across partitions: the first, the last, the first two of which the second does not extend the first,
    and the asked ones that the last value extends or is, with what is known of them.
    """
    before, parted = None, False
    held: list[list] = []  # asked prefixes of the value before, each one a prefix of the next
    for frame in batches:
        out = []
        for value, asked, hit, branched in zip(frame["v"], frame["asked"], frame["hit"], frame["branched"]):
            onward = before is None or value.startswith(before)
            if before is None:
                out.append((value, "end", False, False, False))
            elif not onward and not parted:
                out.extend((v, "end", False, False, False) for v in (before, value))
                parted = True
            while held and not value.startswith(held[-1][0]):
                v, h, b = held.pop()
                if h:
                    out.append((v, "hit", True, True, b))
            for h in reversed(held):
                if h[1] and (onward or h[2]):
                    break
                h[1], h[2] = True, h[2] or not onward
            if asked:
                held.append([value, bool(hit), bool(branched)])
            before = value
        yield pd.DataFrame(out, columns=["v", "kind", "asked", "hit", "branched"])
    if before is not None:
        yield pd.DataFrame([(before, "end", False, False, False), *((v, "end", True, h, b) for v, h, b in held)], columns=["v", "kind", "asked", "hit", "branched"])


def extended(stems: DataFrame, values: DataFrame) -> DataFrame:
    """(v, branched) of the distinct stems that are a strict prefix of some longer value of either table (column `v` each); branched: of several that go on differently."""
    every = stems.select("v", F.lit(True).alias("asked")).unionByName(values.select("v", F.lit(False).alias("asked"))).groupBy("v").agg(F.max("asked").alias("asked"))
    every = every.withColumns({"hit": F.lit(False), "branched": F.lit(False)})
    parts = max(1, int(stems.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    seen = every.repartitionByRange(parts, "v").sortWithinPartitions("v").mapInPandas(_neighbours, _SEEN)
    ends = seen.filter(F.col("kind") == "end").groupBy("v").agg(*(F.max(c).alias(c) for c in ("asked", "hit", "branched")))  # a few values a partition
    across = ends.repartition(1).sortWithinPartitions("v").mapInPandas(_neighbours, _SEEN).filter("hit")
    return seen.filter(F.col("kind") == "hit").select("v", "branched").unionByName(across.select("v", "branched")).distinct()


@F.pandas_udf(T.StringType())
def _in_source(stem: pd.Series, form: pd.Series, source: pd.Series) -> pd.Series:
    """`cut` where the source goes on within the sentence, `whole` where it does not, null where the value isn't found in it."""
    done: dict[str, str] = {}
    out = []
    for s, f, text in zip(stem, form, source):
        if text is None or not s:
            out.append(None)
            continue
        t = done.get(text)
        if t is None:
            if len(done) > 256:
                done.clear()
            t = done[text] = canonical(text)
        at, verdict = t.find(s), None
        whole_at = t.find(f)
        if whole_at >= 0 and _closes(t, whole_at + len(f), f):
            verdict = "whole"
        while at >= 0 and verdict != "whole":
            verdict = "whole" if _closes(t, at + len(s), s) else "cut"
            at = t.find(s, at + 1)
        out.append(verdict)
    return pd.Series(out, dtype=object)


def _closes(text: str, end: int, value: str) -> bool:
    """Whether a sentence or line of the text ends at `end`."""
    rest = text[end : end + 3]
    if not rest.strip() or rest[0] == "\n":
        return True
    ended = bool(_END.search(value)) or value.endswith("…")
    return ended and rest[0].isspace() and not (regex.search(_SHORTENED, value) and not text[end:].lstrip()[:1].isupper())


def find(df: DataFrame, key: str, column: str, source: DataFrame | None = None, short_words: int = SHORT_WORDS, stock_one_in: int = STOCK_ONE_IN) -> DataFrame:
    """(id, field_name, value, proof) of the truncated distinct values of `column`.

    source: (id, text), the text that the value of this id quotes. Null, empty and blank values and rows with a null key are no case. A value that is a
    whole text or whole sentence of its source is complete. So is a stock answer: of at most short_words words, without a mark of a cut, and given by at least
    two keys and one in stock_one_in, unless longer values extend it that are all one text. What the text alone cannot tell: a cut as frequent as that of which
    no longer value is stored, or of which several that go on differently are, passes for a stock answer, and a rarer short answer for a cut.
    Rows repeated whole count once. Values of any length are compared whole.
    """
    held = lineage.cut(shaped(suspects(df, key, column)).filter(F.col("stem") != ""))
    words = F.size(F.split("form", r"\s+"))
    often = held.filter((words <= short_words) & (F.col("form") == F.col("stem"))).groupBy("form").agg(F.count_distinct("id").alias("n")).filter("n > 1")
    total = df.filter(F.trim(F.col(f"`{column}`")) != "").agg(F.count_distinct(F.col(f"`{key}`")).alias("total"))
    answers = often.filter(F.col("n") * stock_one_in >= total.scalar()).select("form", F.lit(True).alias("stock"))
    values = shaped(df.select(F.col(f"`{column}`").alias("value")).filter(F.col("value").isNotNull()).distinct()).select(F.col("key").alias("v")).distinct()
    goes_on = extended(held.select(F.col("key").alias("v")).filter(F.col("v") != "").distinct(), values).select(F.col("v").alias("key"), F.lit(True).alias("longer"), "branched")
    got = held.join(answers, "form", "left").join(goes_on, "key", "left")
    if source is not None:
        ids = held.select("id").distinct()
        near = bloom.build(ids, "id", items=min(ids.count(), bloom.MAX_ITEMS // 4))  # no larger than needed: every plan's description spells the filter out
        text = source.select(F.col(source.columns[0]).alias("id"), F.col(source.columns[1]).alias("source")).filter(bloom.might_contain(source, near, bloom.key_hash(F.col("id")))).distinct()
        got = got.join(text, "id", "left").withColumn("verdict", _in_source("stem", "form", "source"))
    else:
        got = got.withColumn("verdict", F.lit(None).cast("string"))
    longer = F.coalesce("longer", F.lit(False))
    stock = F.coalesce("stock", F.lit(False)) & (~longer | F.col("branched"))
    proof = (
        F.when(F.col("verdict") == "whole", None)
        .when(F.col("verdict") == "cut", F.when(longer, "prefix").otherwise("source"))
        .when(stock, None)
        .when(longer, "prefix")
        .otherwise("ending")
    )
    return got.select("id", F.lit(column).alias("field_name"), "value", proof.alias("proof")).filter(F.col("proof").isNotNull()).distinct()


def shares(df: DataFrame, key: str, columns: list[str], by: str, source: dict[str, DataFrame]) -> DataFrame:
    """(by, field_name, n_values, n_truncated, share): how often each source of values truncates; rows without a value do not count."""
    out = None
    for c in columns:
        cut = find(df, key, c, source.get(c)).select(F.col("id").alias("__id"), F.col("value").alias("__v")).distinct()
        rows = df.select(F.col(f"`{by}`").alias(by), F.col(f"`{key}`").alias("__id"), F.col(f"`{c}`").alias("__v")).filter(F.col("__v").isNotNull())
        one = rows.join(cut.withColumn("__cut", F.lit(1)), ["__id", "__v"], "left").groupBy(by).agg(F.count(F.lit(1)).alias("n_values"), F.count("__cut").alias("n_truncated"))
        one = one.select(by, F.lit(c).alias("field_name"), "n_values", "n_truncated", (F.col("n_truncated") / F.col("n_values")).alias("share"))
        out = one if out is None else out.unionByName(one)
    return out
