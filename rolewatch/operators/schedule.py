"""Which sources to scan now."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cron import cron_matches
from .shaping import side_by_side

BATCH_SIZE = 25
INTERVAL_SECONDS = 300


def due_sources(sources: DataFrame, at: Column) -> DataFrame:
    """Enabled sources whose schedule fires at this minute; targets without one do not appear."""
    return sources.where(F.col("enabled") & cron_matches(F.col("scan_cron"), at))


def due_per_target(sources: DataFrame, at: Column) -> DataFrame:
    return due_sources(sources, at).groupBy("company_id").agg(F.count("*").alias("due_sources"))


def range_of(rows: DataFrame, name: str, tie: str, low: Column, size: int, prefixes: tuple[int, ...] = (2, 6, 20)) -> DataFrame:
    """The rows at positions ``low`` to ``low + size - 1`` in the order of ``name`` and ``tie``, with their ``position``.

    Nothing is sorted as a whole: rows are counted by beginnings of the name, longer ones at each step, and only rows of the
    beginnings that the range touches go on.  So what is put in order at the end is the range and what shares a long beginning with it.
    """
    near = rows.withColumn("_ahead", F.lit(0).cast("bigint"))
    start = F.coalesce(F.col(name), F.lit(""))
    for length in prefixes:
        near = near.withColumn("_start", F.substring(start, 1, length))
        bins = near.groupBy("_start").agg(F.count("*").alias("_n"), F.min("_ahead").alias("_ahead_of"))
        # One row per beginning; those before the range count from the start of the beginnings kept so far.
        upto = F.min("_ahead_of").over(Window.partitionBy(F.lit(0))) + F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_start"))
        touched = bins.withColumn("_upto", upto).where((F.col("_upto") > low) & (F.col("_upto") - F.col("_n") < low + size))
        near = near.drop("_ahead").join(touched.select("_start", (F.col("_upto") - F.col("_n")).alias("_ahead")), "_start").drop("_start")
    near = near.withColumn("_start", F.substring(start, 1, prefixes[-1]))
    order = Window.partitionBy("_start").orderBy(F.col(name).asc_nulls_first(), tie)
    placed = near.withColumn("position", F.col("_ahead") + F.row_number().over(order) - 1)
    return placed.where((F.col("position") >= low) & (F.col("position") < low + size)).drop("_start", "_ahead")


def scan_batch(targets: DataFrame, now: datetime, size: int = BATCH_SIZE, interval_seconds: int = INTERVAL_SECONDS) -> DataFrame:
    """The slice of the watchlist this time slot covers, with batch_index and batch_count.

    Slots rotate through ceil(n / size) slices of the list in name order.
    """
    moment = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    slot = int(moment.timestamp() // interval_seconds)
    listed = targets.select("id", F.lower("name").alias("_name"))
    total = F.coalesce(listed.agg(F.count("*")).scalar(), F.lit(0))
    batches = F.ceil(total / size).cast("int")
    index = F.when(total > size, F.pmod(F.lit(slot), batches)).otherwise(0).cast("int")
    chosen = range_of(listed, "_name", "id", index * size, size).select("id", "position")
    return targets.join(chosen, "id").withColumns({"batch_index": index, "batch_count": batches})


def scheduled_batch(
    targets: DataFrame, sources: DataFrame, now: datetime, size: int = BATCH_SIZE, interval_seconds: int = INTERVAL_SECONDS
) -> DataFrame:
    """The sources to scan in this slot: those that are due, of the slice of due targets that the rotation covers."""
    moment = (now if now.tzinfo else now.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).replace(tzinfo=None)
    due = due_sources(sources, F.lit(moment).cast("timestamp_ntz"))
    waiting = targets.join(due.select(F.col("company_id").alias("id")).distinct(), "id", "left_semi")
    batch = scan_batch(waiting, now, size, interval_seconds).select(F.col("id").alias("company_id"), "position", "batch_index", "batch_count")
    return due.join(batch, "company_id")


def tick(targets: DataFrame, sources: DataFrame, now: datetime, size: int = BATCH_SIZE, interval_seconds: int = INTERVAL_SECONDS) -> DataFrame:
    """One row about a scheduled tick: how many targets are due and how many of them this slot scans; SKIPPED when none is due."""
    batch = scheduled_batch(targets, sources, now, size, interval_seconds)
    moment = (now if now.tzinfo else now.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).replace(tzinfo=None)
    due = due_sources(sources, F.lit(moment).cast("timestamp_ntz")).join(targets.select(F.col("id").alias("company_id")), "company_id", "left_semi")
    total = due.agg(F.count_distinct("company_id").alias("due_targets"))
    scanned = batch.agg(F.count_distinct("company_id").alias("scanned_targets"), F.count("*").alias("scanned_sources"))
    return side_by_side(total, scanned).withColumn("status", F.when(F.col("due_targets") == 0, "SKIPPED").otherwise("SCANNED"))


def scan_tasks(targets: DataFrame, sources: DataFrame, target_limit: int | None = None, source_limit: int | None = None) -> DataFrame:
    """Sources to fetch: enabled, not an events page.

    A caller that fetches with few workers may ask for the first ``target_limit`` targets in name order
    and the first ``source_limit`` sources of each in kind order; without limits all are returned.
    """
    first = targets if target_limit is None else targets.orderBy(F.lower("name"), "id").limit(target_limit)
    usable = sources.where(F.col("enabled") & (F.col("kind") != "EVENTS"))
    chosen = usable.join(first.select(F.col("id").alias("company_id"), "name", "domain"), "company_id")
    if source_limit is None:
        return chosen
    by_kind = Window.partitionBy("company_id").orderBy("kind", "id")
    ranked = chosen.withColumn("_rank", F.row_number().over(by_kind))
    return ranked.where(F.col("_rank") <= source_limit).drop("_rank")
