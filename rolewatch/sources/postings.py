"""The last steps shared by all extractors: identity, evidence columns and the company's own filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import employment_type, is_eligible_title, keyword_rules, satisfies_rules
from ..functions.ids import posting_id
from ..functions.text import reused
from ..operators.shaping import join_dimension

# Columns every extractor needs next to the raw content.
CONTEXT = ["company_id", "source_id", "source_url", "observed_at"]


def context_of(rows: DataFrame) -> list[str]:
    """The context columns, and scan_id where the rows are of scans that must be told apart."""
    return [c for c in ("scan_id",) if c in rows.columns] + CONTEXT


@reused
def _eligible_title():
    return is_eligible_title(F.col("title"))


@reused
def _employment_type():
    return employment_type(F.col("title"), F.col("raw_type"))


@reused
def _own_rules():
    return keyword_rules(F.col("role_keywords"))


@reused
def _fits():
    return satisfies_rules(F.col("title"), F.col("description"), F.col("_rules"))


def finish_postings(records: DataFrame, *keep: str) -> DataFrame:
    """Turn records into postings.

    ``records`` holds the context columns and per record title, url, application_url, description,
    locations, raw_type, content_fingerprint and extraction_confidence.  ``keep`` names columns to
    carry along.
    """
    return records.select(
        posting_id(F.col("company_id"), F.col("url")).alias("id"),
        "company_id",
        "source_id",
        "source_url",
        F.col("url").alias("canonical_url"),
        "application_url",
        "title",
        "description",
        "locations",
        _employment_type().alias("employment_type"),
        F.col("observed_at").alias("first_seen_at"),
        F.col("observed_at").alias("last_seen_at"),
        "content_fingerprint",
        "extraction_confidence",
        *keep,
    )


def eligible(records: DataFrame) -> DataFrame:
    """Records worth further work.  Most fall here, before URLs and descriptions are looked at."""
    return records.where(_eligible_title())


def target_rules(targets: DataFrame) -> DataFrame:
    return targets.select(F.col("id").alias("company_id"), _own_rules().alias("_rules"))


def wanted_postings(postings: DataFrame, targets: DataFrame) -> DataFrame:
    """Postings that satisfy their company's keywords.

    The join meets extracted postings only: pages and payloads are never shuffled to reach the watchlist.
    """
    ruled = join_dimension(postings, target_rules(targets), ["company_id"], "inner")
    return ruled.where(_fits()).drop("_rules")
