"""Full-text retrieval by BM25 over postings, with prefix terms, phrases and facets; all in relational operators.

Texts are folded to their terms once, and the occurrences of every phrase of every question are counted there by one expression each, so nothing is exploded or
shuffled but the row of corpus figures. Postings (doc, field, pos, term) are what the index keeps per document.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from concordat.functions.lineage import cut

K1, B = 1.2, 0.75
#: Letters that are a Latin letter with accents, and that letter, place by place.
_BASES = {c: unicodedata.normalize("NFD", c) for c in map(chr, [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]) if c.islower()}
ACCENTED = "".join(c for c, d in _BASES.items() if len(d) > 1 and d[0].isascii() and all(map(unicodedata.combining, d[1:])))
PLAIN = "".join(_BASES[c][0] for c in ACCENTED)
# Words that a question is not searched for.
STOP = frozenset("les des une que qui quoi quel quelle quels quelles dans pour par sur avec sans sous est sont ont ete etre aux ces cette cet leur leurs nous vous ils elles mais donc car comme plus the and for with from that this these those what which who are was were has have been not but into over under their its about ont parle parlent dit disent".split())


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def postings(df: DataFrame, doc: str, fields: list[str]) -> DataFrame:
    """(doc, field, pos, term): the runs of letters and digits of each field, folded; null fields hold none."""
    parts = [df.select(F.col(doc).alias("doc"), F.lit(f).alias("field"), F.posexplode(F.regexp_extract_all(fold(F.col(f)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("pos", "term")) for f in fields]
    return reduce(DataFrame.unionByName, parts)


def parse(question: str) -> list[tuple[str, list[str], bool]]:
    """(kind, words, prefix) of a question: quoted phrases as they are; numbers exactly; other words of three letters and more, not stop words, as prefixes."""
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
    out = [("phrase", re.findall(r"[^\W_]+", plain(p)), False) for p in re.findall(r'"([^"]+)"', question)]
    for raw in re.findall(r"[\w'-]+", re.sub(r'"[^"]+"', " ", question)):
        word = plain(raw.strip("'-"))
        words = re.findall(r"[^\W_]+", word)
        if word.isdigit():
            out.append(("term", [word], False))
        elif len(word) >= 3 and word not in STOP and words:
            out.append(("phrase", words, False) if len(words) > 1 else ("term", words, True))
    seen: dict = {}
    for kind, words, prefix in out:
        if words:
            seen.setdefault((tuple(words), prefix), (kind, words, prefix))
    return list(seen.values())


def cited_articles(question: str) -> list[str]:
    """Numbers of the articles that a question names."""
    return [re.sub(r"\s+", " ", m).strip().lower() for m in re.findall(r"\bart(?:icle)?s?\.?\s*(\d+(?:\s*(?:bis|ter|quater))?)", question, re.I)]


def _pattern(words: list[str], prefix: bool) -> str:
    """A regular expression that matches once per occurrence of a phrase in `_flat`, overlapping ones too."""
    return f" {words[0]}" + ("" if prefix else "(?= " + "".join(f"{w} " for w in words[1:]) + ")")


def _flat(fields: list[str]) -> Column:
    """The terms of the fields with one blank around each, and a bar between fields that no phrase crosses."""
    terms = [F.nullif(F.trim(F.regexp_replace(fold(F.col(f"`{f}`")), r"[^\p{L}\p{N}]+", " ")), F.lit("")) for f in fields]
    return F.concat(F.lit(" "), F.concat_ws(" | ", *terms), F.lit(" "))


def _size(flat: Column) -> Column:
    """How many terms `_flat` holds: blanks less one, less the bars; 0 for two blanks alone."""
    without = lambda sign: F.length(flat) - F.length(F.replace(flat, F.lit(sign), F.lit("")))
    return F.when(flat == "  ", 0).otherwise(without(" ") - 1 - without("|"))


def bm25_each(df: DataFrame, doc: str, fields: list[str], questions: dict[str, list[tuple[str, list[str], bool]]]) -> DataFrame:
    """(question, doc, score) of the documents that hold any phrase of a question; any number of questions in one reading of the texts.

    Corpus figures (documents with terms, mean length, documents with a phrase) are one row. Documents without terms count nowhere; a question without phrases has no row.
    """
    phrases = list(dict.fromkeys((tuple(words), prefix) for query in questions.values() for _, words, prefix in query))
    if not phrases:
        return df.select(F.lit("").alias("question"), F.col(doc).alias("doc"), F.lit(0.0).alias("score")).limit(0)
    flat = df.select(F.col(doc).alias("doc"), _flat(fields).alias("__t"))
    # kept as counts, of which the corpus figures and the scores are made; a filter on them would otherwise be pushed below and repeat the folding
    held = cut(flat.select("doc", _size(F.col("__t")).alias("size"), F.array(*[F.regexp_count("__t", F.lit(_pattern(list(w), p))) for w, p in phrases]).alias("tf"))).filter("size > 0")
    figures = held.agg(F.struct(F.count(F.lit(1)).alias("docs"), F.avg("size").alias("mean"), F.array(*[F.count_if(F.col("tf")[n] > 0) for n in range(len(phrases))]).alias("df")).alias("c")).scalar()
    some = held.filter(F.exists("tf", lambda n: n > 0)).withColumn("c", figures)

    def score(query: list[tuple[str, list[str], bool]]) -> Column:
        total = F.lit(0.0)
        for _, words, prefix in query:
            n = phrases.index((tuple(words), prefix))
            idf = F.log((F.col("c.docs") - F.col("c.df")[n] + 0.5) / (F.col("c.df")[n] + 0.5))
            tf = F.col("tf")[n]
            total += F.when(tf > 0, F.when(idf > 0, idf).otherwise(1e-6) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.col("c.mean")))).otherwise(0.0)
        return total

    scores = F.array(*[F.struct(F.lit(name).alias("question"), score(query).alias("score")) for name, query in questions.items()])
    return some.select("doc", F.explode(scores).alias("s")).select("s.question", "doc", "s.score").filter("score > 0")


def bm25(df: DataFrame, doc: str, fields: list[str], query: list[tuple[str, list[str], bool]]) -> DataFrame:
    """(doc, score) for one question, as `bm25_each`."""
    return bm25_each(df, doc, fields, {"": query}).select("doc", "score")


def top(scores: DataFrame, k: int, section: Column | None = None, cited: list[str] = (), boost_before_limit: bool = False) -> DataFrame:
    """The k best by score, ties by doc; then those of a cited article first (or before the limit, if asked)."""
    named = F.lit(0) if section is None or not cited else F.when(reduce(lambda a, b: a | b, [section.startswith(c) for c in cited]), 0).otherwise(1)
    order = [F.desc("score"), "doc"]
    if boost_before_limit:
        return scores.withColumn("named", named).orderBy("named", *order).limit(k)
    return scores.withColumn("named", named).orderBy(*order).limit(k).orderBy("named", *order)


def snippet(text: Column, words: list[str], around: int = 12) -> Column:
    """Twice `around` words about the first hit, hits marked; from the beginning where none is found."""
    tokens = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    match = lambda t: reduce(lambda a, b: a | b, [fold(t).contains(w) for w in words])
    at = F.greatest(F.array_position(F.transform(tokens, lambda t: match(t)), True) - around, F.lit(1)).cast("int")
    marked = F.transform(F.slice(tokens, at, F.lit(2 * around)), lambda t: F.when(match(t), F.concat(F.lit("«"), t, F.lit("»"))).otherwise(t))
    return F.array_join(marked, " ")


def best_card(words: Column, cards: dict[str, list[str]]) -> Column:
    """The card that has most different words in common with `words`, the first of several; null where none has any."""
    scored = F.array(*[F.struct(F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in own]))).alias("n"), F.lit(-n).alias("place"), F.lit(name).alias("name")) for n, (name, own) in enumerate(cards.items())])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["name"])
