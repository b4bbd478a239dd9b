"""Results, history and health of scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.places import is_us_location
from ..functions.payloads import scan_message
from ..functions.text import reused
from ..sources.boards import GENERIC

# Fixed value: the message about a page without a posting.
EMPTY_PAGE = "Source loaded but no job records were extractable; provider adapter may be required."


@reused
def _in_us():
    return is_us_location(F.col("locations"))


def source_results(tasks: DataFrame, postings: DataFrame, failures: DataFrame) -> DataFrame:
    """One row per scanned source: counts before cross-source de-duplication, status and message.

    ``tasks`` has scan_id, source_id, provider and whatever else describes the source of a scan; ``postings`` have scan_id.
    A generic page without a posting is a failure, an empty board answer is a success.
    """
    counts = postings.groupBy("scan_id", "source_id").agg(
        F.count("*").alias("_found"), F.count_if(_in_us()).alias("_us")
    )
    messages = failures.groupBy("scan_id", "source_id").agg(F.min("message").alias("_message"))
    both = tasks.join(counts, ["scan_id", "source_id"], "left").join(messages, ["scan_id", "source_id"], "left")
    found = F.coalesce("_found", F.lit(0))
    message = F.coalesce(
        F.col("_message"), F.when((F.col("provider") == GENERIC) & (found == 0), F.lit(EMPTY_PAGE))
    )
    good = F.col("message").isNull()
    return both.withColumn("message", message).select(
        *tasks.columns,
        F.when(good, found).alias("discovered_count"),
        F.when(good, F.coalesce("_us", F.lit(0))).alias("united_states_count"),
        F.when(good, "SUCCESS").otherwise("FAILED").alias("status"),
        "message",
    )


def us_postings(postings: DataFrame) -> DataFrame:
    return postings.where(_in_us())


def summarize_runs(results: DataFrame, jobs_per_run: DataFrame) -> DataFrame:
    """One row per scan_id with counts.  The details of a run are the rows of ``results``.

    Companies are reduced per run before they are counted, so a run of very many sources does not meet in one task.
    """
    failed = F.col("status") == "FAILED"
    runs = results.groupBy("scan_id").agg(
        F.min("scanned_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
        F.count_distinct("company_id").alias("target_count"),
        F.count_if(failed).alias("failure_count"),
    )
    return runs.join(jobs_per_run, "scan_id", "left").withColumn(
        "job_count", F.coalesce("job_count", F.lit(0).cast("bigint"))
    )


def with_details(runs: DataFrame, results: DataFrame, key: str = "scan_id") -> DataFrame:
    """Add ``failures`` and ``source_results``, nested, to the runs that a reader asked for.

    The lists of a run are as long as its sources are many: pass few runs, or use ``results`` itself.
    """
    failed = F.col("status") == "FAILED"
    failure = F.struct("company_id", "source_id", "source_url", "provider", "message")
    success = F.struct(
        "company_id", "source_id", "source_url", "provider", "discovered_count", "united_states_count", "status"
    )
    asked = results.withColumnRenamed("scan_id", key).join(runs.select(key), key, "left_semi")
    nested = asked.groupBy(key).agg(
        F.array_sort(F.array_compact(F.collect_list(F.when(failed, failure)))).alias("failures"),
        F.array_sort(F.array_compact(F.collect_list(F.when(~failed, success)))).alias("source_results"),
    )
    return runs.join(nested, key, "left")


def health(runs: DataFrame) -> DataFrame:
    """The latest run, or one NO_SCANS row when there is none."""
    latest = runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(1)
    # A global aggregate over at most one row always yields a row.
    row = latest.agg(F.max(F.struct("started_at", *[c for c in runs.columns if c != "started_at"])).alias("r"))
    return row.select(F.when(F.col("r").isNull(), "NO_SCANS").otherwise("SCANNED").alias("status"), "r.*")


def scan_messages(runs: DataFrame) -> DataFrame:
    """The line shown after a scan, from job, new, updated and failure counts per run."""
    return runs.withColumn(
        "message",
        scan_message(F.col("job_count"), F.col("new_count"), F.col("updated_count"), F.col("failure_count")),
    )


def change_counts(changes: DataFrame, by: list[str]) -> DataFrame:
    return changes.groupBy(*by).agg(
        F.count_if(F.col("kind") == "NEW").alias("new_count"),
        F.count_if(F.col("kind") == "UPDATED").alias("updated_count"),
    )


def dashboard_metrics(targets: DataFrame, sources: DataFrame, postings: DataFrame, events: DataFrame, changes: DataFrame) -> DataFrame:
    """Sizes of the tables, side by side.  Each is one aggregated row, and the rows are summed up."""
    names = ["target_count", "source_count", "posting_count", "event_count", "unread_count"]
    tables = [
        targets,
        sources,
        postings.where("active"),
        events.where("active"),
        changes.where(F.col("read_at").isNull()),
    ]
    total: DataFrame | None = None
    for index, table in enumerate(tables):
        row = table.agg(
            *[(F.count("*") if i == index else F.lit(0).cast("bigint")).alias(n) for i, n in enumerate(names)]
        )
        total = row if total is None else total.unionByName(row)
    return total.agg(*[F.sum(n).alias(n) for n in names])


def scanned_sources(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == "SUCCESS").select("source_id")


def runs_union(history: DataFrame, run: DataFrame) -> DataFrame:
    """Append a run to the history; a rerun of the same scan replaces its row."""
    return history.join(run.select("id"), "id", "left_anti").unionByName(run.select(*history.columns))
