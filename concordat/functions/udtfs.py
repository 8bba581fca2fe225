"""Table functions in SQL: a text's sections, blocks and instructions as rows, by LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession, functions as F

from concordat.operators import amend, segment

SECTION = "section_id: string, section_label: string, section_kind: string, section_order: int, text: string"


@F.udtf(returnType=SECTION)
class LegalSections:
    """The sections of a legal text; null and blank texts have none."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from segment.legal_text(text) if text and text.strip() else ()


@F.udtf(returnType=SECTION)
class TextBlocks:
    """The blocks of any text."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from segment.free_text(text) if text and text.strip() else ()


@F.udtf(returnType="celex: string, article: string, section_id: string, operation: string, numero: string, instruction: string, new_text: string")
class Instructions:
    """The instructions of an amending act; other texts have none."""

    def eval(self, text: str) -> Iterator[tuple]:
        for x in amend.read(text):
            yield tuple(x[c] for c in ("celex", "article", "section_id", "operation", "numero", "instruction", "new_text"))


def register(spark: SparkSession) -> None:
    """legal_sections(text), text_blocks(text) and instructions(text) for this session's SQL."""
    for name, function in (("legal_sections", LegalSections), ("text_blocks", TextBlocks), ("instructions", Instructions)):
        spark.udtf.register(name, function)
