"""Tables that grow by what changed, merged when they are read.

* Counts: every batch appends signed differences; a count is their sum.
* The change log: one folder per day and a row per day and batch with how many changes it holds, so a page of the newest changes reads the newest days only.
* Marks and outcomes: changed rows are appended under a version; a reader takes the last version of each id.  Compaction writes
  the merged rows as a new base.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shaping import winners

COUNT = "metric STRING, delta LONG"
DAY_COUNT = "day DATE, n LONG"


# ---- counts ----------------------------------------------------------------------------------


def differences(before: DataFrame, after: DataFrame, changes: DataFrame, runs: DataFrame) -> DataFrame:
    """``metric, delta`` of one batch, from the snapshot rows it replaced and wrote, its changes and its runs."""
    one = F.count("*").cast("long")
    parts = [
        before.where("active").agg(F.lit("active_postings").alias("metric"), (-one).alias("delta")),
        after.where("active").agg(F.lit("active_postings").alias("metric"), one.alias("delta")),
        before.agg(F.lit("postings").alias("metric"), (-one).alias("delta")),
        after.agg(F.lit("postings").alias("metric"), one.alias("delta")),
        changes.groupBy(F.concat(F.lower("kind"), F.lit("_changes")).alias("metric")).agg(one.alias("delta")),
        changes.where("read_at is null").agg(F.lit("unread").alias("metric"), one.alias("delta")),
        runs.agg(F.lit("scan_runs").alias("metric"), one.alias("delta")),
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy("metric").agg(F.sum("delta").alias("delta"))


def counts(spark: SparkSession, root: str, batches: int) -> dict[str, int]:
    """All counts after the first ``batches`` batches; one row per metric comes to the driver."""
    rows = spark.read.schema(COUNT + ", batch INT").parquet(f"{root}/counts").where(F.col("batch") < batches)
    return {r.metric: r.n for r in rows.groupBy("metric").agg(F.sum("delta").alias("n")).collect()}


# ---- change log ------------------------------------------------------------------------------


def append_log(changes: DataFrame, root: str, batch: int) -> None:
    """Add the changes of a batch to their days.  A batch that runs again replaces what it wrote."""
    dated = changes.withColumn("day", F.to_date("created_at"))
    dated.write.mode("overwrite").partitionBy("day").parquet(f"{root}/log/batch={batch}")
    dated.groupBy("day").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{root}/log_days/batch={batch}")


def first_day(days: DataFrame, limit: int, before: Column | None = None) -> date | None:
    """The latest day such that it and the later ones, up to ``before``, hold ``limit`` rows; None if all days hold fewer."""
    totals = days.groupBy("day").agg(F.sum("n").alias("n"))
    totals = totals if before is None else totals.where(F.col("day") < F.to_date(before))
    # A row per day: bounded by the age of the log.
    upto = totals.withColumn("_upto", F.sum("n").over(Window.orderBy(F.col("day").desc())))
    return upto.where(F.col("_upto") >= limit).agg(F.max("day")).first()[0]


def newest(spark: SparkSession, root: str, schema: str, limit: int, before: tuple | None = None) -> DataFrame:
    """The ``limit`` newest changes, or those that follow the row ``before`` (created_at, id) in that order.

    Only days that may hold them are read.
    """
    rows = spark.read.schema(schema + ", day DATE").parquet(f"{root}/log")
    at, last = (F.lit(before[0]).cast("timestamp"), F.lit(before[1])) if before else (None, None)
    cut = first_day(spark.read.schema(DAY_COUNT).parquet(f"{root}/log_days"), limit, at)
    if cut is not None:
        rows = rows.where(F.col("day") >= F.lit(cut))
    if before:
        rows = rows.where(F.col("day") <= F.to_date(at)).where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") > last)))
    return rows.drop("day", "batch").orderBy(F.col("created_at").desc(), "id").limit(limit)


# ---- marks and outcomes ----------------------------------------------------------------------


def append_changed(rows: DataFrame, root: str, table: str, version: int) -> None:
    """Rows that a version inserts or replaces, whole."""
    rows.write.mode("overwrite").parquet(f"{root}/{table}/version={version}")


def merged(spark: SparkSession, root: str, table: str, schema: str, key: str = "id") -> DataFrame:
    """Every id's row of the last version."""
    base = spark.read.schema("base LONG").parquet(f"{root}/{table}_bases").agg(F.max("base")).first()[0] if _exists(spark, f"{root}/{table}_bases") else None
    rows = spark.read.schema(schema + ", version LONG").parquet(f"{root}/{table}")
    if base is not None:
        older = spark.read.schema(schema).parquet(f"{root}/{table}_base/version={base}").withColumn("version", F.lit(base).cast("long"))
        rows = rows.where(F.col("version") > base).unionByName(older)
    return winners(rows, [key], [F.col("version")]).drop("version")


def compact(spark: SparkSession, root: str, table: str, schema: str, version: int, key: str = "id") -> None:
    """Write what is merged up to ``version`` as a base; it counts from the moment its entry is written, last of all."""
    merged(spark, root, table, schema, key).write.mode("overwrite").parquet(f"{root}/{table}_base/version={version}")
    spark.createDataFrame([(version,)], "base LONG").coalesce(1).write.mode("overwrite").parquet(f"{root}/{table}_bases/entry={version}")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
