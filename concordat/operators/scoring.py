"""What scores a contribution: the lexical rules built in, or anything with the same method, a model behind a service say."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from concordat.operators import positions

#: What every scorer adds.
COLUMNS = ("stance", "score", "confidence", "scrutiny", "deletion", "evidence", "method")


class Scorer(Protocol):
    def score(self, df: DataFrame, text: str, kind: Column, silent: Column) -> DataFrame:
        """df with COLUMNS; rows are neither added nor lost. silent: whether the reference party said nothing on the item."""


class Lexical:
    """The rules on markers, without a model; all in the JVM."""

    method = "heuristique"

    def score(self, df: DataFrame, text: str, kind: Column, silent: Column) -> DataFrame:
        out = positions.lexical_stance(df.drop(*COLUMNS), text, kind, silent)
        return out.withColumnsRenamed({f"lex_{c}": c for c in COLUMNS if c != "method"}).withColumn("method", F.lit(self.method))


def scored(df: DataFrame, text: str, kind: Column, silent: Column, scorer: Scorer | None = None) -> DataFrame:
    """df scored by `scorer`, by the lexical rules without one. Raises ValueError where a scorer leaves a column out."""
    out = (scorer or Lexical()).score(df, text, kind, silent)
    if missing := [c for c in COLUMNS if c not in out.columns]:
        raise ValueError(f"the scorer gives no {', '.join(missing)}")
    return out
