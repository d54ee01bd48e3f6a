"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); unset, one of our own in local mode and an error elsewhere."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if spark.sparkContext.master.startswith("local"):
        return f"{tempfile.gettempdir()}/checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


class Workspace:
    """Intermediate tables of one job, written to the shared folder and read back.

    A written table cuts lineage: a lost executor costs a re-read, never a recomputation of the
    whole job. ``drop`` frees a table as soon as nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{table}")

    def drop(self, *tables: str) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n: the folds of the labelled operators."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
