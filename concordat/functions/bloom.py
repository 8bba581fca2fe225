"""Bloom filters of bounded size as ordinary column predicates.

A filter is built by one distributed aggregation (partial filters are merged, no key reaches the driver) and holds at most
MAX_ITEMS keys at the asked rate, which keeps it under 8 MB. Beyond that it lets more keys pass, never fewer, so callers that
verify the positives stay exact at any size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Keys for which a filter is sized at most; at 1 % false positives that takes 4.8 MB.
MAX_ITEMS = 4_000_000


def key_hash(*cols: Column) -> Column:
    """64-bit hash of a key of one or more columns; callers handle null keys themselves."""
    return F.xxhash64(*cols)


def build(keys: DataFrame, *names: str, items: int | None = None, fpp: float = 0.01) -> bytes:
    """The serialised filter of the non-null keys in `names`; an empty table gives a filter that holds nothing."""
    hashed = keys.na.drop(subset=list(names)).select(key_hash(*[F.col(f"`{n}`") for n in names]).alias("h"))
    n = hashed.count() if items is None else items
    hashed = hashed.unionByName(keys.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("h")))  # the aggregate knows no empty filter
    java = hashed._jdf.stat().bloomFilter("h", max(1000, min(n, MAX_ITEMS)), fpp)
    out = keys.sparkSession._jvm.java.io.ByteArrayOutputStream()
    java.writeTo(out)
    return bytes(out.toByteArray())


def aside(spark: SparkSession, filter_: bytes) -> Column:
    """The filter as a subquery of one local row: descriptions of a plan, of which the driver holds many, name it, where they spell a literal out in hex."""
    return spark.createDataFrame(pa.table({"filter": pa.array([filter_], pa.binary())})).scalar()


def might_contain(keys: DataFrame, filter_: bytes | Column, hashed: Column) -> Column:
    """Whether the filter, also one put `aside`, may hold the key with this `key_hash`; false means that it certainly does not. JVM-side, inside codegen."""
    from pyspark.sql.classic.column import Column as ClassicColumn

    jvm = keys.sparkSession._jvm
    to_expr, to_column = jvm.org.apache.spark.sql.classic.ExpressionUtils.expression, jvm.org.apache.spark.sql.classic.ExpressionUtils.column
    held = filter_ if isinstance(filter_, Column) else F.lit(bytearray(filter_))
    test = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(to_expr(held._jc), to_expr(hashed._jc))
    return ClassicColumn(to_column(test))
