"""Cutting a plan's lineage on storage that every executor shares."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="concordat-")


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`. Only in local mode, as in tests, is one made where none is set; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder(spark.sparkContext.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that later jobs neither repeat its work nor lose it with an executor."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
