"""Order-dependent operators that windows can express: carry-forward, islands, rejoined fragments, range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

FRAGMENT_ID = r"^([a-z]+_\d+[a-z]?)_(\d+)$"


def carry_forward(df: DataFrame, part: list[str], order: list[str], value: Column, out: str, initial: Column | None = None) -> DataFrame:
    """`out`: the last non-null value at or before each row of its part."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(value, ignorenulls=True).over(w)
    return df.withColumn(out, last if initial is None else F.coalesce(last, initial))


def islands(df: DataFrame, part: list[str], order: list[str], same: list[str], out: str = "island") -> DataFrame:
    """`out`: the number of the run of adjacent rows of a part with equal `same` values, from 0; nulls equal nulls."""
    w = Window.partitionBy(*part).orderBy(*order)
    begins = F.lit(False)
    for c in same:
        begins = begins | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    begins = F.when(F.row_number().over(w) == 1, 0).otherwise(begins.cast("int"))
    return df.withColumn("__b", begins).withColumn(out, F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def rejoin(df: DataFrame, document: str, section: str, label: str, text: str) -> DataFrame:
    """(document, root_id, label, text, n_parts): fragments `art_5_1`, `art_5_2` … of one article joined in order by line breaks."""
    rank = F.nullif(F.regexp_extract(section, FRAGMENT_ID, 2), F.lit("")).cast("int")
    root = F.when(rank.isNotNull(), F.regexp_extract(section, FRAGMENT_ID, 1)).otherwise(F.col(section))
    parts = df.select(F.col(document).alias("document_id"), root.alias("root_id"), F.struct(F.coalesce(rank, F.lit(0)).alias("rank"), F.col(section).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).alias("label")).alias("p"))
    # an article's fragments are the pieces of one text, which bounds the list
    return parts.groupBy("document_id", "root_id").agg(F.array_sort(F.collect_list("p")).alias("ps")).select("document_id", "root_id", F.regexp_replace(F.col("ps")[0]["label"], r"\s*\(\d+\s*/\s*\d+\)\s*$", "").alias("label"), F.array_join(F.col("ps.text"), "\n").alias("text"), F.size("ps").alias("n_parts"))


def within_bounds(items: DataFrame, number: Column, bounds: DataFrame) -> DataFrame:
    """items with the title whose bounds hold the number, the first declared one where several do. bounds: (title, low, high, declared), a hand-made table."""
    rows = items.withColumn("__n", number).withColumn("__row", F.monotonically_increasing_id())
    met = rows.join(F.broadcast(bounds), (F.col("__n") >= F.col("low")) & (F.col("__n") <= F.col("high")))  # a handful of declared titles
    first = met.groupBy(*items.columns, "__row").agg(F.min_by("title", "declared").alias("title"))
    return first.drop("__row")


# Headings of titles and chapters, which stand at the head of the article that follows.
TITLE = r"(?im)^[^\S\n]*(?:TITRE|TITLE|CHAPITRE|CHAPTER)[^\S\n]+(?:[IVXLC]+|\d+|premier|first)\b[^\S\n]*[—\-–:.]?[^\S\n]*[^\n]{0,90}$"
TITLE_WITHIN = 600


def titles(df: DataFrame, document: str, order: list[str], label: str, text: str) -> DataFrame:
    """(document_id, label, title): the title or chapter under which each label of a document first stands. A heading holds until the next; sections before any have none.

    Of several headings in one section the last holds. One document is sorted in one task; null and empty labels have no title.
    """
    heads = F.regexp_extract_all(F.substring(text, 1, TITLE_WITHIN), F.lit(TITLE), F.lit(0))
    head = F.try_element_at(heads, F.lit(-1))
    rest = F.regexp_replace(F.regexp_replace(head, r"^\s*\w+\s+\w+\s*[—\-–:.]?\s*", ""), r"^[ —\-–:.]+|[ —\-–:.]+$", "")
    said = F.when(F.length(rest) > 3, F.concat(F.lit(", "), F.upper(F.substring(rest, 1, 1)), F.lower(F.expr("substring(__rest, 2)")))).otherwise("")
    title = F.when(head.isNotNull(), F.concat(F.when(F.lower(F.trim(head)).startswith("tit"), "Titre ").otherwise("Chapitre "), F.upper(F.regexp_extract(head, r"^\s*\w+\s+(\w+)", 1)), said))
    held = carry_forward(df.withColumn("__rest", rest), [document], order, title, "title").filter(F.col("title").isNotNull() & (F.col(label) != ""))
    return held.groupBy(F.col(document).alias("document_id"), F.col(label).alias(label)).agg(F.min_by("title", F.struct(*order)).alias("title"))


def running_floor(deltas: Column) -> Column:
    """The running sum of an array of deltas that never falls below 0, as the last value (quotation depth)."""
    return F.aggregate(deltas, F.lit(0), lambda acc, x: F.greatest(acc + x, F.lit(0)))


def pack(parts: Column, limit: int, join: int = 2) -> Column:
    """An array of texts packed in order into as few as fit: a part is added while the pack stays within `limit` with `join` characters between; none is split."""
    empty = F.array().cast("array<string>")

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = last.isNotNull() & (F.char_length(last) + join + F.char_length(x) <= limit)
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit("\n" * join), x)))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(parts, empty, add)
