"""Differences between two copies of a table, by hierarchical checksums over key ranges.

One scan of each side reduces its rows to (key, two 64-bit row hashes, side), 25 bytes a row, kept in the checkpoint folder. A range of keys has as checksum the
sums of both hashes' halves and the number of rows, left minus right, so it is zero where both sides hold the same rows equally often. The descent begins with at most
ROOTS ranges, which every task sums up before anything is moved, and opens disagreeing ranges into FAN parts, level by level, down to single keys. Which ranges are open is
told to the next pass by a Bloom filter of bounded size: a range that it lets pass wrongly is summed once more and found equal. So what is moved follows
the number of ranges that disagree. Rows written twice on one side make their ranges disagree as well, and are told from true differences at the keys, where sets of rows
are compared. A second scan reads the full rows of disagreeing keys alone, which are compared field by field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from concordat.functions import bloom
from concordat.functions.lineage import cut

#: Ranges at the top, at most, and parts into which a disagreeing range is opened.
ROOTS, FAN = 1 << 12, 1 << 6


def _row_hash(columns: list[str], seed: int) -> Column:
    nulls = F.concat(F.lit(""), *[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in columns])
    return F.xxhash64(F.lit(seed), nulls, *[F.col(f"`{c}`") for c in columns])


def _digests(df: DataFrame, key: str, columns: list[str], side: int) -> DataFrame:
    k = F.col(f"`{key}`")
    return df.filter(k.isNotNull()).select(k.cast("bigint").alias("k"), _row_hash(columns, 1).alias("h1"), _row_hash(columns, 2).alias("h2"), F.lit(side).cast("byte").alias("side"))


def _plain(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with map columns as sorted entries in text, which have a hash and an order."""
    maps = {f.name: F.to_json(F.array_sort(F.map_entries(F.col(f"`{f.name}`")))) for f in df.schema if f.name in columns and f.dataType.typeName() == "map"}
    return df.withColumns(maps) if maps else df


def unequal_ranges(digests: DataFrame, bits: int) -> DataFrame:
    """(r) of the ranges of 2^bits keys whose rows are not the same on both sides, each as often as it is stored."""
    halves = {f"{h}_{n}": F.sum(F.col("side") * part) for h in ("h1", "h2") for n, part in enumerate((F.shiftrightunsigned(h, 32), F.col(h).bitwiseAND(0xFFFFFFFF)))}
    sums = digests.groupBy(F.shiftright("k", bits).alias("r")).agg(F.sum(F.col("side").cast("bigint")).alias("n"), *[half.alias(name) for name, half in halves.items()])
    return sums.filter(" or ".join(f"{name} <> 0" for name in ("n", *halves))).select("r")


def levels(low: int, high: int) -> list[int]:
    """The bits of a range at each level of the descent over keys from low to high, ending with 0, single keys."""
    span, fan = high - low + 1, FAN.bit_length() - 1
    bits = max(0, (span - 1).bit_length() - (ROOTS.bit_length() - 2))  # ranges begin at multiples of their size, so one more may be touched
    return [*range(bits, 0, -fan), 0]


def differing_keys(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(k) of the non-null keys whose set of distinct rows is not the same on both sides, by descent through the checksum tree."""
    open_ = cut(_digests(left, key, columns, 1).unionByName(_digests(right, key, columns, -1)))
    ends = open_.agg(F.min("k"), F.max("k")).first()
    for bits in levels(ends[0], ends[1])[:-1] if ends[0] is not None else ():
        ranges = cut(unequal_ranges(open_, bits))
        open_ = open_.filter(bloom.might_contain(ranges, bloom.build(ranges, "r"), bloom.key_hash(F.shiftright("k", bits))))
    rows = open_.groupBy("k", "h1", "h2").agg(F.bit_or(F.when(F.col("side") > 0, 1).otherwise(2)).alias("sides"))  # a row written twice is one
    return rows.filter("sides <> 3").select("k").distinct()


def differences(left: DataFrame, right: DataFrame, key: str, only_left: str, only_right: str) -> DataFrame:
    """(key, diff_kind, left_value, right_value): one row per key missing on a side or per differing field.

    diff_kind is `only_left`, `only_right` or the field's name. Columns are those both sides have. Values are compared exactly, null differs
    from every value. Rows written twice unchanged are one row. Where one side holds several versions of a key, a field differs if the two sets of
    values do, and the least of each side's own values is shown. Rows with a null key can match nothing and come out once per side as missing on the other.
    An empty side makes all keys of the other missing. The key must be an integer; other keys are hashed by the caller.
    """
    columns = [c for c in left.columns if c in right.columns and c != key]
    left, right = _plain(left, columns), _plain(right, columns)
    ids = cut(differing_keys(left, right, key, columns))
    held = bloom.build(ids, "k")

    def rows(df: DataFrame, side: int) -> DataFrame:
        k = F.col(f"`{key}`")
        near = df.filter(bloom.might_contain(df, held, bloom.key_hash(k.cast("bigint"))) | k.isNull()).select(k.cast("bigint").alias("k"), *[F.col(f"`{c}`") for c in columns])
        fields = [F.struct(F.lit(c).alias("f"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns]
        return near.select("k", F.explode(F.array(F.struct(F.lit(None).cast("string").alias("f"), F.lit(None).cast("string").alias("v")), *fields)).alias("e")).select("k", "e.f", "e.v", F.lit(side).alias("s"))

    # keys that the filter lets pass wrongly are equal on both sides and give no row
    cells = rows(left, 1).unionByName(rows(right, 2)).groupBy("k", "f", "v").agg(F.bit_or("s").alias("s"))
    fields = cells.groupBy("k", "f").agg(
        F.bit_or("s").alias("s"), F.max(F.col("s") != 3).alias("differs"), F.min(F.when(F.col("s") == 1, F.col("v"))).alias("left_value"), F.min(F.when(F.col("s") == 2, F.col("v"))).alias("right_value")
    )
    named = F.col("k").isNotNull()
    kinds = F.when(F.col("f").isNotNull(), F.when(named & (F.col("s") == 3) & F.col("differs"), F.array("f"))).otherwise(
        F.when(named, F.when(F.col("s") == 1, F.array(F.lit(only_left))).when(F.col("s") == 2, F.array(F.lit(only_right)))).otherwise(
            F.array_compact(F.array(F.when(F.col("s").bitwiseAND(1) > 0, only_left), F.when(F.col("s").bitwiseAND(2) > 0, only_right)))
        )
    )
    return fields.select(F.col("k").alias(key), F.explode(kinds).alias("diff_kind"), "left_value", "right_value")
