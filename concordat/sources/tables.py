"""Reading the Parquet tables of a data folder, and the schema helpers of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`; Parquet, so filters and column selection reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def open_store(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a store by name; raises where one is missing."""
    return {name: load(spark, folder, name) for name in names}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the columns of schema: missing ones null, others dropped, types cast.

    Rows are kept as they are, an empty table stays empty, extra columns go.
    """
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
