"""What the operators share about the cluster: its shared folder, and tables in buckets there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import folder, written

__all__ = ["bucketed", "folder", "frugal", "partitions", "unused", "written"]

#: Bytes of an Arrow batch that goes to a Python worker.
ARROW_BYTES = 8 << 20


def frugal(spark: SparkSession) -> None:
    """Arrow batches of texts of at most ARROW_BYTES, unless the session says otherwise: they are held several times by an executor's tasks."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).lower().rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(ARROW_BYTES))


def unused(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df as a table in the shared folder, in as many buckets of its keys as shuffles have partitions: what is joined to it on all
    keys is shuffled to the buckets, and the table itself is not shuffled again."""
    spark, table = df.sparkSession, f"heronry_{name}_{uuid.uuid4().hex}"
    n = partitions(spark)
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", f"{folder(spark)}/{table}").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay, and out knows them
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
