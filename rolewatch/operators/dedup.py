"""De-duplication of extracted postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.board_payloads import RECORD_KEY
from .shaping import winners


def _preference(keep: str, *tie_break: str) -> list:
    confidence = F.col("extraction_confidence")
    return [-confidence if keep == "lowest" else confidence, *[F.col(c) for c in tie_break]]


def dedup_page_postings(postings: DataFrame, keep: str = "lowest", run: tuple[str, ...] = ()) -> DataFrame:
    """One posting per page and URL.

    The observed rule keeps the layer with the lowest confidence, and among equals the latest one on
    the page; ``keep="highest"`` turns the first part round.
    """
    key = [*run, "source_id", "canonical_url"]
    return winners(postings, key, _preference(keep, "ordinal")).drop("ordinal")


def dedup_board_postings(postings: DataFrame, run: tuple[str, ...] = ()) -> DataFrame:
    """One posting per source and URL across the queries and pages of a board; the last record wins."""
    order = [F.col(c) for c in RECORD_KEY]
    return winners(postings, [*run, "source_id", "canonical_url"], order).drop(*RECORD_KEY)


def dedup_company_postings(postings: DataFrame, keep: str = "lowest", run: tuple[str, ...] = ()) -> DataFrame:
    """One posting per company and URL across its sources; ties go to the greater source id."""
    return winners(postings, [*run, "company_id", "canonical_url"], _preference(keep, "source_id"))
