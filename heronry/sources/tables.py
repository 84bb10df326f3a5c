"""Tables that are used again, written to the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, as a URI. Where none is set, as in tests on one machine, a temporary one is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.gettempdir()}/heronry-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", at)
    return qualified(spark, at)


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme and authority of the cluster's file system, as Spark's own readers and writers understand it."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(at).toString()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and not again when an executor is lost."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
