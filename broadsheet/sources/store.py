"""Derived tables written as parquet in the shared folder, bucketed where joins need it.

A table bucketed by ``ord`` is read back with that partitioning known to Spark, so joins and
aggregations on ``ord`` between such tables need no shuffle. Tables survive the loss of executors
because they live in shared storage.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.session import shared_dir


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket that Spark writes a row to."""
    return F.pmod(F.hash(key), F.lit(buckets))


def bucket_of_file() -> Column:
    """The bucket of a scanned row by its file's name; as a filter it keeps other files unopened."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"_(\d{5,})\.c", 1).cast("int")


def scratch_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: an intermediate result that outlives executors."""
    path = f"{shared_dir(spark)}/broadsheet-{spark.sparkContext.applicationId}/scratch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Store:
    """Named parquet tables under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.prefix = "bs_" + hashlib.md5(self.path.encode()).hexdigest()[:12]

    @classmethod
    def for_input(cls, spark: SparkSession, input_path: str) -> "Store":
        """The store of this application for one input folder."""
        app = spark.sparkContext.applicationId
        digest = hashlib.md5(input_path.rstrip("/").encode()).hexdigest()[:12]
        return cls(spark, f"{shared_dir(spark)}/broadsheet-{app}/{digest}")

    def location(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table_name(self, name: str) -> str:
        return f"{self.prefix}_{name}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.location(name))
        return self.spark.read.schema(df.schema).parquet(self.location(name))

    def write_bucketed(
        self,
        name: str,
        df: DataFrame,
        buckets: int,
        key: str = "ord",
        sort: tuple[str, ...] = ("ord",),
        partition_by: tuple[str, ...] = (),
    ) -> DataFrame:
        """Write one file per bucket. ``df`` should already be spread by ``key`` over ``buckets``
        parts; then the write adds no shuffle."""
        writer = (
            df.write.format("parquet")
            .mode("overwrite")
            .option("path", self.location(name))
            .bucketBy(buckets, key)
            .sortBy(*sort)
        )
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.saveAsTable(self.table_name(name))
        return self.spark.table(self.table_name(name))

    def attach_bucketed(
        self,
        name: str,
        schema_ddl: str,
        buckets: int,
        key: str = "ord",
        sort: tuple[str, ...] = ("ord",),
        partition_by: tuple[str, ...] = (),
    ) -> DataFrame:
        """Register a bucketed table that an earlier application wrote to this folder."""
        table = self.table_name(name)
        parts = f"PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({schema_ddl}) USING parquet {parts} "
            f"CLUSTERED BY ({key}) SORTED BY ({', '.join(sort)}) INTO {buckets} BUCKETS "
            f"LOCATION '{self.location(name)}'"
        )
        if partition_by:
            self.spark.catalog.recoverPartitions(table)
        return self.spark.table(table)
