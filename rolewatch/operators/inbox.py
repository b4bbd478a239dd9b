"""The change log as an inbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shaping import join_dimension, join_skewed


def change_log(changes: DataFrame, unread_only: bool = False) -> DataFrame:
    rows = changes.where(F.col("read_at").isNull()) if unread_only else changes
    return rows.orderBy(F.col("created_at").desc(), "id")


def with_posting(changes: DataFrame, targets: DataFrame, postings: DataFrame, *columns: str) -> DataFrame:
    """Changes with the company's name and columns of the posting; changes without either drop out."""
    named = join_dimension(
        changes, targets.select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), ["company_id"], "inner"
    )
    slim = postings.select(
        F.col("id").alias("job_id"), F.col("title").alias("job_title"), "application_url", *columns
    )
    return join_skewed(named, slim, ["job_id"], keyed=changes.select("job_id"))


def inbox(changes: DataFrame, targets: DataFrame, postings: DataFrame, unread_only: bool = False) -> DataFrame:
    """Notifications, newest first."""
    rows = changes.where(F.col("read_at").isNull()) if unread_only else changes
    return with_posting(rows, targets, postings).orderBy(F.col("created_at").desc(), "id")


def mark_read(changes: DataFrame, marks: DataFrame) -> DataFrame:
    """Apply read marks (id, read_at).  The first read of a change stands."""
    first = marks.groupBy("id").agg(F.min("read_at").alias("_mark"))
    marked = changes.join(first, "id", "left").withColumn("read_at", F.coalesce("read_at", "_mark"))
    return marked.select(*changes.columns)


def mark_all_read(changes: DataFrame, at: Column) -> DataFrame:
    return changes.withColumn("read_at", F.coalesce(F.col("read_at"), at))


def mark_counts(changes: DataFrame, marks: DataFrame) -> DataFrame:
    """One row: ``marked``, the unread changes that the marks read, and ``unread``, those that stay."""
    unread = changes.where(F.col("read_at").isNull()).select("id")
    hit = unread.join(marks.where(F.col("read_at").isNotNull()).select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    return hit.agg(F.count("_hit").alias("marked"), F.count_if(F.col("_hit").isNull()).alias("unread"))


def dismissed_count(changes: DataFrame, dismissed: DataFrame) -> DataFrame:
    """One row: how many stored changes a dismissal removes."""
    return changes.join(dismissed.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("dismissed"))


def dismiss(changes: DataFrame, dismissed: DataFrame) -> DataFrame:
    return changes.join(dismissed.select("id").distinct(), "id", "left_anti")
