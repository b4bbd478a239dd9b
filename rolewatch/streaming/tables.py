"""Batch-versioned parquet folders under one shared root.

Every micro-batch writes new folders and, last of all, a small commit table that names the folders that
are current.  A batch that runs again overwrites its own folders only, so it can be repeated at any
point, and readers see whole batches.

    <root>/<table>/batch=<n>                      appended tables
    <root>/last_scans/batch=<n>                   a whole table, read as the last batch that had any scan left it
    <root>/snapshot/batch=<n>/bucket=<b>          state, one folder per bucket of companies
    <root>/commits/batch=<n>                      (bucket, batch): current folder per bucket, and, as LAST_SCANS, of last_scans
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
#: Stands for the table last_scans among the buckets of a commit.
LAST_SCANS = -1


def bucket_of(company_id: Column) -> Column:
    return F.pmod(F.xxhash64(company_id), F.lit(BUCKETS)).cast("int")


def append(df: DataFrame, root: str, table: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{table}/batch={batch}")


def read_version(spark: SparkSession, root: str, table: str, schema: str, batch: int | None) -> DataFrame:
    """A table that batches write as a whole, as ``batch`` left it; empty if no batch did."""
    if batch is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{table}/batch={batch}")


def current_folders(spark: SparkSession, root: str, before: int) -> dict[int, int]:
    """Bucket to the batch that wrote it last; at most one entry per bucket."""
    if before == 0:
        return {}
    rows = spark.read.parquet(f"{root}/commits/batch={before - 1}").collect()
    return {r.bucket: r.batch_no for r in rows}


def read_buckets(spark: SparkSession, root: str, schema: str, folders: dict[int, int]) -> DataFrame:
    paths = [f"{root}/snapshot/batch={n}/bucket={b}" for b, n in sorted(folders.items()) if b != LAST_SCANS]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write_buckets(df: DataFrame, root: str, batch: int) -> None:
    """Rebalanced by bucket: small buckets share a task, a hot company's bucket is split over many."""
    bucketed = df.withColumn("bucket", bucket_of(F.col("company_id"))).hint("rebalance", "bucket")
    bucketed.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/snapshot/batch={batch}")


def commit(spark: SparkSession, root: str, batch: int, folders: dict[int, int]) -> None:
    rows = spark.createDataFrame(sorted(folders.items()), "bucket INT, batch_no INT")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/batch={batch}")


def carry(spark: SparkSession, root: str, batch: int) -> None:
    """Commit a batch that changes nothing."""
    commit(spark, root, batch, current_folders(spark, root, batch))


def committed(spark: SparkSession, root: str) -> int:
    """How many batches are committed; only the names of folders are read."""
    last = spark.read.parquet(f"{root}/commits").agg(F.max("batch")).first()[0]
    return 0 if last is None else int(last) + 1
