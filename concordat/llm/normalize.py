"""Visually identical text with different characters, brought to one consistent form.

The form is: compatibility normalisation, composed (NFKC), full case folding, every kind of blank as one plain space (line breaks stay),
default-ignorable characters removed, and look-alike letters inside a word of several scripts mapped to the one script that can write the word, Latin, Greek
or Cyrillic alike. A word that two scripts can write goes to that with most of its letters, then to the text's main script. Plain ASCII values are done by built-in functions alone; the others are normalised once per distinct value of an Arrow batch.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Letters that look alike in Latin, Greek and Cyrillic, one letter of each script in a row (blank: the script has none).
LOOK_ALIKE = [
    ("A", "Α", "А"), ("B", "Β", "В"), ("C", "", "С"), ("E", "Ε", "Е"), ("F", "Ϝ", ""), ("G", "", "Ԍ"), ("H", "Η", "Н"), ("I", "Ι", "І"), ("J", "Ϳ", "Ј"), ("K", "Κ", "К"),
    ("M", "Μ", "М"), ("N", "Ν", ""), ("O", "Ο", "О"), ("P", "Ρ", "Р"), ("Q", "", "Ԛ"), ("S", "", "Ѕ"), ("T", "Τ", "Т"), ("V", "", "Ѵ"), ("W", "", "Ԝ"), ("X", "Χ", "Х"), ("Y", "Υ", "У"), ("Z", "Ζ", ""),
    ("", "Γ", "Г"), ("", "Λ", "Л"), ("", "Π", "П"), ("", "Φ", "Ф"),
    ("a", "α", "а"), ("c", "", "с"), ("d", "", "ԁ"), ("e", "", "е"), ("h", "", "һ"), ("i", "ι", "і"), ("j", "ϳ", "ј"), ("k", "κ", "к"), ("l", "", "ӏ"), ("o", "ο", "о"), ("p", "ρ", "р"),
    ("q", "", "ԛ"), ("s", "", "ѕ"), ("u", "υ", ""), ("v", "ν", "ѵ"), ("w", "", "ԝ"), ("x", "χ", "х"), ("y", "γ", "у"), ("", "π", "п"), ("", "φ", "ф"), ("", "τ", "т"),
]
MAPPED = ("Latin", "Greek", "Cyrillic")
#: Per target script, its look-alike of each letter of the other two.
_TO = {target: {row[k]: row[n] for row in LOOK_ALIKE for k in range(3) if k != n and row[n] and row[k]} for n, target in enumerate(MAPPED)}

FULL_WIDTH = r"\uff01-\uff60\uffe0-\uffe6"
SPACES = r"\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
# Default-ignorable code points.
INVISIBLE = r"\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
_SIGNS = regex.compile(f"[{FULL_WIDTH}{SPACES}{INVISIBLE}]")
_INVISIBLE = regex.compile(f"[{INVISIBLE}]+")
_SPACE = regex.compile(r"[^\S\n]+")
_RUN = regex.compile(" +")
_BREAK = regex.compile(r"[ ]*\n[ ]*")
_CLUSTER = regex.compile(r"\p{L}\p{M}+")
_FOREIGN = regex.compile(r"[\p{L}--[\p{Latin}\p{Common}\p{Inherited}]]", regex.V1)
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_SCRIPTS = [(name, regex.compile(rf"\p{{Script={name}}}")) for name in ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Armenian", "Georgian", "Devanagari", "Bengali", "Thai", "Cherokee")]
_EAST = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Bopomofo}]")
_COMMON = regex.compile(r"[\p{Common}\p{Inherited}]")
#: Values without any other character need no Python.
PLAIN = r"^[\x20-\x7e\n]*$"


@lru_cache(maxsize=20_000)
def script(char: str) -> str:
    """The script of a letter, the East Asian ones as one; '' for letters common to several."""
    if _COMMON.match(char):
        return ""
    if _EAST.match(char):
        return "East"
    return next((name for name, pattern in _SCRIPTS if pattern.match(char)), "other")


def _scripts(word: str) -> dict[str, int]:
    count: dict[str, int] = {}
    for char in word:
        if char.isalpha() and (s := script(char)):
            count[s] = count.get(s, 0) + 1
    return count


def _mixed_words(text: str) -> bool:
    return any(len(_scripts(w)) > 1 for w in _WORD.findall(_INVISIBLE.sub("", text)) if not w.isascii())


def irregular(text: str) -> bool:
    """Whether the text holds a full-width sign, a letter and accent that one character could hold, an invisible character, a blank other than the plain space, or a word of two scripts."""
    if text.isascii():
        return "\t" in text or "\x0b" in text or "\x0c" in text
    if _SIGNS.search(text) or "\t" in text:
        return True
    if not unicodedata.is_normalized("NFC", text) and any(len(unicodedata.normalize("NFC", m)) < len(m) for m in _CLUSTER.findall(text)):
        return True
    return bool(_FOREIGN.search(text)) and _mixed_words(text)


def _unmixed(word: str, main: str) -> str:
    """A word of several scripts in one: that into which all its letters of others can be mapped, where there are several that with most of its letters, then `main`.

    Accents are set apart for this and put back. A word that fits no script whole goes as far as possible into the one with most letters.
    """
    base = unicodedata.normalize("NFD", word)
    count = _scripts(base)
    if len(count) < 2:
        return word
    rank = {s: (n, s == main, -MAPPED.index(s)) for s, n in count.items() if s in MAPPED}
    fit = [s for s in rank if all(c in _TO[s] or script(c) in ("", s) for c in base if c.isalpha())]
    if not rank:
        return word
    table = _TO[max(fit or rank, key=rank.__getitem__)]
    return unicodedata.normalize("NFC", "".join(table.get(c, c) for c in base))


def _one_script(text: str) -> str:
    """text with the words of several scripts brought to one script each."""
    if not _FOREIGN.search(text):
        return text
    main = max(count, key=count.__getitem__) if (count := _scripts(text)) else ""
    return _WORD.sub(lambda m: m.group() if m.group().isascii() else _unmixed(m.group(), main), text)


def _composed(text: str) -> str:
    """The consistent form but for case and blanks."""
    return text if text.isascii() else _one_script(_INVISIBLE.sub("", unicodedata.normalize("NFKC", text)))


def canonical(text: str, fold: bool = True) -> str:
    """The one consistent form of a text; with fold=False letters keep their case. Idempotent."""
    text = _composed(text)
    if fold:
        text = text.casefold() if text.isascii() else _one_script(unicodedata.normalize("NFKC", text.casefold()))
    return _BREAK.sub("\n", _SPACE.sub(" ", text)).strip()


def changed(text: str) -> bool:
    """Whether the consistent form differs from the text by more than case and runs of plain spaces."""
    return canonical(text, fold=False) != _BREAK.sub("\n", _RUN.sub(" ", text)).strip(" \n")


@F.pandas_udf(T.StructType([T.StructField("canonical", T.StringType()), T.StructField("irregular", T.BooleanType()), T.StructField("changed", T.BooleanType())]))
def _normalized(values: pd.Series) -> pd.DataFrame:
    done = {v: (canonical(v), irregular(v), changed(v)) for v in values.dropna().unique()}
    none = (None, None, None)
    return pd.DataFrame([done.get(v, none) for v in values], columns=["canonical", "irregular", "changed"])


def _plain_form(text: Column) -> Column:
    """`canonical` of a plain ASCII value by built-in functions."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), " +", " "), " ?\n ?", "\n"))


def plain_form(text: Column) -> Column:
    """The same without line breaks at either end."""
    return F.regexp_replace(_plain_form(text), r"^\n+|\n+$", "")


def normalize(df: DataFrame, text: str) -> DataFrame:
    """df with `canonical` (the consistent form of column `text`), `irregular` and `changed` (the form differs from the value by more than case and runs of plain spaces).

    The one does not depend on the other: fractions, ellipses, ligatures and superscripts are changed without being irregular.

    Null values have a null form and are neither irregular nor changed; empty and blank texts become empty; very long texts are done whole.
    All rows stay, repeated ones too. If df has columns of these names already they are replaced.
    """
    kept = df.withColumn("__value", F.col(f"`{text}`")).drop("canonical", "irregular", "changed")
    value = F.col("__value")
    plain = value.rlike(PLAIN)
    out = kept.withColumn("__n", _normalized(F.when(~plain, value)))  # plain values reach Python as nulls
    form = F.when(plain, plain_form(value)).otherwise(F.col("__n.canonical"))
    flags = {name: F.when(plain, F.lit(False)).otherwise(F.coalesce(F.col(f"__n.{name}"), F.lit(False))) for name in ("irregular", "changed")}
    return out.withColumns({"__form": form, **{f"__{name}": F.coalesce(flag, F.lit(False)) for name, flag in flags.items()}}).drop("__n", "__value").withColumnsRenamed({"__form": "canonical", "__irregular": "irregular", "__changed": "changed"})
