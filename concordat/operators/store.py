"""The store's reads and writes as DataFrame operations: ordered reads, upserts, replacement, cascade, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T


def latest(df: DataFrame, keys: list[str], stamp: str, ties: list[str]) -> DataFrame:
    """Last write wins: one row per key, the one of the greatest stamp (null last), ties by the least `ties` (nulls last).

    Rows with a null in a key are kept as a key of their own. Repeated rows give one row. A pre-aggregation by `max_by`-like structs isn't
    needed: the window shuffles on the key alone, and keys are near unique here.
    """
    order = [F.col(stamp).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_when_blank: list[str] = ()) -> DataFrame:
    """old with the rows of new put in by key; a null or empty new value of `keep_when_blank` leaves the old one."""
    kept = old.join(new.select(*keys), keys, "left_anti")
    if not keep_when_blank:
        return kept.unionByName(new)
    before = old.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in keep_when_blank])
    merged = new.join(before, keys, "left").withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__old_{c}")) for c in keep_when_blank})
    return kept.unionByName(merged.select(*old.columns))


def replace_part(old: DataFrame, new: DataFrame, part: str) -> DataFrame:
    """old without the rows of the parts that new holds, and new: importing the same part again changes nothing."""
    return old.join(new.select(part).distinct(), part, "left_anti").unionByName(new)


def write_part(new: DataFrame, path: str, part: str) -> None:
    """The same on files: each part of new replaces that part's folder, other parts are not touched."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def cascade(parent_ids: DataFrame, id_col: str, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Every table without the rows that refer to the deleted ids (table, its reference column)."""
    return {name: df.join(parent_ids.select(F.col(id_col).alias(ref)).distinct(), ref, "left_anti") for name, (df, ref) in tables.items()}


def fill_blank(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, F.when(F.coalesce(F.col(column), F.lit("")) == "", value).otherwise(F.col(column)))


def integrity(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """(check_name, n_rows) of the rows that break each invariant."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("check_name")).groupBy("check_name").agg(F.count(F.lit(1)).alias("n_rows")) for name, df in checks])


def facet(df: DataFrame, column: str, chosen: list[str] | None) -> DataFrame:
    """Multi-select: an empty choice means all."""
    return df.filter(F.col(column).isin(chosen)) if chosen else df


def backup(tables: dict[str, DataFrame], folder: str) -> None:
    """A copy of each table; the names come last, so a folder without them is no whole backup."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(n,) for n in tables], "name string").coalesce(1).write.mode("overwrite").json(f"{folder}/tables")


def restore(spark: SparkSession, folder: str, wanted: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """The tables of a backup. Raises ValueError where one is missing or lacks a column or has another type, before anything is given."""
    there = {r["name"] for r in spark.read.schema("name string").json(f"{folder}/tables").collect()}  # a handful of names
    if missing := sorted(set(wanted) - there):
        raise ValueError(f"the backup lacks {', '.join(missing)}")
    tables = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in wanted}
    for name, schema in wanted.items():
        types = dict(tables[name].dtypes)
        if wrong := [f.name for f in schema if types.get(f.name) != f.dataType.simpleString()]:
            raise ValueError(f"{name} differs in {', '.join(wrong)}")
    return tables
