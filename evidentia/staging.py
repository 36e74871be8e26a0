"""Intermediate tables in the shared folder of the cluster.

Long plans are cut by writing a table and reading it again, so a lost executor costs the
tasks of one step and never the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode a new one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, n: int, dealt: bool = False) -> DataFrame:
    """df, written to the shared folder in n buckets of a key and read again: joins and windows on the key do not shuffle it. If dealt, df was repartitioned so already."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(n, key)).write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{table}").option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a staged table that no later step reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
