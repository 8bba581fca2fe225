"""The same pipelines on streams: stateless classification, running matrix, latest analysis, windows of activity.

Results go to files in the shared checkpoint folder: final rows by the file sink in append mode, running aggregates in update mode as parts by batch. A query
started again with the same folder goes on where it stopped, with all that earlier runs wrote. Watermarks drop the state of windows and sessions that are past.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from concordat.functions.lineage import shared_folder
from concordat.operators import positions as P, store


def folder(spark: SparkSession) -> str:
    """A new folder under the session's shared folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A table's files as a stream, `files` at a time; times without zone are read as UTC instants, which watermarks need."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        df = reader.parquet(path)
    else:  # a stream reads folders; the name picks the one file
        df = reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    zoned = {f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns(zoned) if zoned else df


def append(df: DataFrame, where: str) -> DataFrame:
    """Runs a stream over all that is there now and gives the rows it appended."""
    spark = df.sparkSession
    df.writeStream.format("parquet").outputMode("append").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{where}/out")


def updates(df: DataFrame, where: str, mode: str | None = None, then: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over all that is there now; every batch adds its rows as a part of its own, which a batch that is run again overwrites.

    Gives the rows of all parts with the number of the batch, of earlier runs with this folder too: what holds is settled by the reader, so no batch rewrites
    the rows of others. then: called after each batch with the rows of all parts and the batch's number.
    """
    spark = df.sparkSession

    def table() -> DataFrame:
        return spark.read.schema(T.StructType([*df.schema, T.StructField("batch", T.LongType())])).parquet(f"{where}/out")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/batch={n}")
        if then:
            then(table(), n)

    writer = df.writeStream.option("checkpointLocation", f"{where}/state").foreachBatch(write).trigger(availableNow=True)
    (writer.outputMode(mode) if mode else writer).start().awaitTermination()
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/out")
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):  # no batch ever came
        return spark.createDataFrame([], df.schema).withColumn("batch", F.lit(0).cast("bigint"))
    return table()


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of `updates`, the last batch's of each key."""
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")


def merged(df: DataFrame, where: str, keys: list[str], stamp: str, ties: list[str]) -> DataFrame:
    """The latest row of each key, whatever order the batches bring; each batch stores the latest of its own rows."""
    rows = updates(df, where, then=None)
    return store.latest(rows.drop("batch"), keys, stamp, ties)


def agreements(scored: DataFrame, where: str, item: list[str], party: str, least: int = 2) -> DataFrame:
    """Agreement of parties as a stream of scored contributions goes on: after every batch the matrix so far is compared anew and kept as that batch's table. Gives the last."""
    spark = scored.sparkSession

    def compare(rows: DataFrame, n: int) -> None:
        P.agreement(least_scores(rows, [*item, "party"]), item, least).write.mode("overwrite").parquet(f"{where}/agreement/batch={n}")

    matrix = scored.withColumnRenamed(party, "party").filter("party is not null").groupBy(*item, "party").agg(F.min("score").alias("score")).filter("score is not null")
    rows = updates(matrix, where, "update", compare)
    last = rows.agg(F.max("batch")).first()[0]
    if last is None:
        return P.agreement(rows.drop("batch"), item, least)
    return spark.read.parquet(f"{where}/agreement/batch={last}")


def least_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The running matrix from its updates: a least score can only fall."""
    return rows.groupBy(*keys).agg(F.min("score").alias("score"))


def classified(contributions: DataFrame) -> DataFrame:
    """Lexical stance of arriving contributions; stateless, so rows go out as they come."""
    return P.lexical_stance(contributions, "text", F.col("kind"), F.lit(True)).select("id", "section_id", "ms_code", F.col("lex_stance").alias("stance"), F.col("lex_score").alias("score"))


def running_matrix(scored: DataFrame) -> DataFrame:
    """The least score of each party on each item so far; a minimum never has to be taken back when rows arrive late."""
    return scored.filter("ms_code is not null").groupBy("section_id", F.col("ms_code").alias("party")).agg(F.min("score").alias("score")).filter("score is not null")


def activity(events: DataFrame, stamp: str, by: str, length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts by window and `by`, with a watermark. For update mode: a window comes out whenever it grows."""
    w = F.window(stamp, length, slide) if slide else F.window(stamp, length)
    return events.withWatermark(stamp, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, stamp: str, by: str, gap: str, late: str = "1 day") -> DataFrame:
    """Sessions of activity: runs of events of one `by` no more than `gap` apart. For append mode: a session comes out once the watermark has passed its end."""
    return events.withWatermark(stamp, late).groupBy(F.session_window(stamp, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")
