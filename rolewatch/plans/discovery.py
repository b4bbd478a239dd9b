"""From landed rows to postings, results and changes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import dedup_board_postings, dedup_company_postings, dedup_page_postings
from ..operators.scans import source_results, us_postings
from ..session import ensure_checkpoint_dir
from ..sources.board_payloads import PAGE_KEY, asked_pages, failed_pages, page_facts, payload_postings
from ..sources.boards import GENERIC
from ..sources.pages import admitted_pages, page_postings
from ..sources.postings import wanted_postings
from ..sources.strategies import Strategy, with_discovered, with_failures

TASK = ["scan_id", "company_id", "source_id", "source_url", "provider"]
RUN = ("scan_id", "source_id")


@dataclass(frozen=True)
class ScanOutcome:
    """``postings``: one row per company and URL of each scan.  ``results``: one row per source of each scan."""

    postings: DataFrame
    results: DataFrame


def pages_of(landed: DataFrame) -> DataFrame:
    return landed.where(F.col("provider") == GENERIC).withColumnRenamed("body", "html")


def scan_times(landed: DataFrame) -> DataFrame:
    """One time per scan, when its first page was observed."""
    return landed.groupBy("scan_id").agg(F.min("observed_at").alias("scanned_at"))


def extract(landed: DataFrame, targets: DataFrame, asked: DataFrame | None = None, strategies: Sequence[Strategy] = ()) -> DataFrame:
    """Postings of every source that satisfy the company's keywords, one per source, scan and URL.

    Scans are told apart by scan_id, and all postings of a scan carry its one time.  Bodies and pages
    are read in narrow stages; only facts and extracted postings meet in a shuffle.  ``asked`` has the board pages a scan would have read.
    ``strategies`` are boards beyond the built-in ones.
    """
    asked = asked_pages(page_facts(landed)) if asked is None else asked
    pages = admitted_pages(pages_of(landed)).where(F.col("rejection").isNull())
    on_pages = dedup_page_postings(wanted_postings(page_postings(pages), targets), run=("scan_id",))
    found = payload_postings(landed).join(asked.select(*RUN, *PAGE_KEY), [*RUN, *PAGE_KEY], "left_semi")
    found = with_discovered(found, landed, strategies)
    on_boards = dedup_board_postings(wanted_postings(found, targets), run=("scan_id",))
    both = on_pages.unionByName(on_boards).join(scan_times(landed), "scan_id")
    return both.withColumns({"first_seen_at": F.col("scanned_at"), "last_seen_at": F.col("scanned_at")}).drop("scanned_at")


def failures(landed: DataFrame, asked: DataFrame, strategies: Sequence[Strategy] = ()) -> DataFrame:
    """Sources that cannot be used, with the reason."""
    rejected = admitted_pages(pages_of(landed)).where(F.col("rejection").isNotNull())
    pages = rejected.select(*RUN, F.col("rejection").alias("message"))
    both = pages.unionByName(failed_pages(asked).select(*RUN, "message"))
    return with_failures(both, landed, strategies)


def results_of(landed: DataFrame, found: DataFrame, asked: DataFrame | None = None, strategies: Sequence[Strategy] = ()) -> DataFrame:
    """One row per source of each scan; ``found`` is the output of ``extract``."""
    asked = asked_pages(page_facts(landed)) if asked is None else asked
    tasks = landed.select(*TASK).distinct().join(scan_times(landed), "scan_id")
    return source_results(tasks, found, failures(landed, asked, strategies))


def winners_of(found: DataFrame, results: DataFrame) -> DataFrame:
    """Postings in the United States of the sources that succeeded, one per company and URL of each scan."""
    bad = results.where(F.col("status") == "FAILED").select(*RUN)
    usable = found.join(bad, [*RUN], "left_anti")
    return dedup_company_postings(us_postings(usable), run=("scan_id",))


def scan(landed: DataFrame, targets: DataFrame, strategies: Sequence[Strategy] = ()) -> ScanOutcome:
    """Extract one or more scans.

    The facts of board pages and the extracted postings have several readers.  Both are checkpointed, so that
    bodies are parsed once for each; a checkpoint on shared storage also survives lost executors.
    """
    ensure_checkpoint_dir(landed.sparkSession)
    asked = asked_pages(page_facts(landed)).checkpoint()
    found = extract(landed, targets, asked, strategies).checkpoint()
    results = results_of(landed, found, asked, strategies)
    return ScanOutcome(winners_of(found, results), results)
