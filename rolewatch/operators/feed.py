"""Postings and events as readers see them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.payloads import confidence_label, event_place_label, locations_label, words
from .shaping import join_dimension, winners

UNKNOWN = "Unknown company"


def _with_company(rows: DataFrame, targets: DataFrame) -> DataFrame:
    names = targets.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    joined = join_dimension(rows, names, ["company_id"])
    return joined.withColumn("company_name", F.coalesce("company_name", F.lit(UNKNOWN)))


def opportunity_feed(postings: DataFrame, targets: DataFrame) -> DataFrame:
    return _with_company(postings, targets).select(
        "id",
        "company_name",
        words(F.col("employment_type")).alias("employment_type"),
        "title",
        locations_label(F.col("locations")).alias("locations"),
        confidence_label(F.col("extraction_confidence")).alias("confidence"),
        "application_url",
    )


def event_feed(events: DataFrame, targets: DataFrame) -> DataFrame:
    return _with_company(events, targets).select(
        "id",
        "company_name",
        words(F.col("event_type")).alias("event_type"),
        "title",
        event_place_label(F.col("location"), F.col("format")).alias("place"),
        words(F.col("status")).alias("status"),
        "registration_url",
    )


def merge_feed(found: DataFrame, cached: DataFrame) -> DataFrame:
    """Freshly found rows joined to cached ones; a cached row of the same posting stays."""
    ranked = found.withColumn("_rank", F.lit(0)).unionByName(cached.withColumn("_rank", F.lit(1)))
    return winners(ranked, ["company_id", "canonical_url"], [F.col("_rank")]).drop("_rank")


def opportunities(postings: DataFrame, events: DataFrame) -> DataFrame:
    """Both tables as one, told apart by ``kind``."""
    return postings.withColumn("kind", F.lit("JOB")).unionByName(
        events.withColumn("kind", F.lit("EVENT")), allowMissingColumns=True
    )
