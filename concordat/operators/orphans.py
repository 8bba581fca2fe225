"""References to records that do not exist.

A Bloom filter of the parents' keys, of bounded size, is sent to the scan of the referring table: what it denies is certainly an
orphan. Only the distinct keys that it lets pass are checked by an exact anti join, so one hot key costs one row there; the few keys
the filter let pass wrongly are then looked up among the references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from concordat.functions import bloom


def find(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """The rows of `child` whose key (child column, parent column pairs) is in no row of `parent`.

    A reference with a null or empty part refers to nothing and is no orphan. Keys are compared exactly (case, blanks and accents count).
    Repeated child rows come out as often as they are stored; with an empty parent table every reference is an orphan. Columns of child
    are kept as they are.
    """
    names = [c for c, _ in on]
    refers = None
    for c in names:
        part = F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`").cast("string") != "")
        refers = part if refers is None else refers & part
    refs = child.filter(refers)
    keys = parent.select(*[F.col(f"`{p}`").cast(child.schema[c].dataType).alias(f"__{k}") for k, (c, p) in enumerate(on)]).na.drop()
    cols = [f"__{k}" for k in range(len(on))]
    held = bloom.aside(child.sparkSession, bloom.build(keys, *cols))
    maybe = bloom.might_contain(child, held, bloom.key_hash(*[F.col(f"`{c}`") for c in names]))
    certain = refs.filter(~maybe)
    passed = refs.filter(maybe).select(*[F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(names)]).distinct()
    wrong = passed.join(keys, cols, "left_anti").select(*[F.col(c).alias(f"{c}w") for c in cols])
    match = None
    for k, c in enumerate(names):
        same = F.col(f"`{c}`") == F.col(f"__{k}w")
        match = same if match is None else match & same
    return certain.unionByName(refs.filter(maybe).join(wrong, match, "left_semi"))


def labelled(orphans: DataFrame, table: str, rec_key, stamp: str) -> DataFrame:
    """(tbl, ref_month, rec_key) of orphan rows; ref_month is yyyy-MM of `stamp`, or `none`."""
    month = F.coalesce(F.date_format(F.col(f"`{stamp}`"), "yyyy-MM"), F.lit("none"))
    return orphans.select(F.lit(table).alias("tbl"), month.alias("ref_month"), rec_key.cast("string").alias("rec_key"))
