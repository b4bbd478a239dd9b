"""Replay many scans in one pass: the same results as merging them one after the other.

A posting's fate depends on its own sightings and on the scan times of the source that saw it last,
so the sequence turns into aggregates and one ordered comparison per posting:

* NEW or UPDATED: a sighting whose fingerprint differs from the sighting before it;
* the final row: the latest sighting;
* strikes: the successful scans of the winning source after that sighting, at most two.

``sightings`` are postings with at most one row per posting and scan; ``last_seen_at`` is the time of
the scan.  ``scans`` lists source_id and scanned_at of the successful scans.  ``snapshot`` is the
stored state the history continues from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import change_id
from .shaping import join_dimension, with_previous
from .snapshot import KEY, STRIKES


def split_late(sightings: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sightings newer than the stored row of their posting, and those that came too late."""
    stored = snapshot.select(*KEY, F.col("last_seen_at").alias("_stored_at"))
    known = sightings.join(stored, KEY, "left")
    late = F.coalesce(F.col("last_seen_at") <= F.col("_stored_at"), F.lit(False))
    return known.where(~late).drop("_stored_at"), known.where(late).drop("_stored_at")


def replay_changes(sightings: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """The change log of a history.  Ids are hashes of the posting key, hence equal in all sightings."""

    def slim(rows: DataFrame, stored: bool) -> DataFrame:
        return rows.select(*KEY, "id", "last_seen_at", "content_fingerprint", F.lit(stored).alias("stored"))

    history = slim(sightings, False)
    if snapshot is not None:
        history = history.unionByName(slim(snapshot, True))
    ordered = with_previous(history, KEY, "last_seen_at", ["content_fingerprint"])
    changed = F.col("previous.content_fingerprint") != F.col("content_fingerprint")
    kind = F.when(F.col("previous").isNull(), "NEW").when(changed, "UPDATED")
    changes = ordered.where(~F.col("stored")).withColumn("kind", kind).where(F.col("kind").isNotNull())
    return changes.select(
        change_id(F.col("id"), F.col("kind"), F.col("last_seen_at")).alias("id"),
        F.col("id").alias("job_id"),
        "company_id",
        "canonical_url",
        "kind",
        F.col("last_seen_at").alias("created_at"),
        F.lit(None).cast(sightings.schema["last_seen_at"].dataType).alias("read_at"),
    )


def latest_scans(scans: DataFrame) -> DataFrame:
    """The last two successful scans per source; two strikes never need more."""
    recent = Window.partitionBy("source_id").orderBy(F.col("scanned_at").desc())
    ranked = scans.select("source_id", "scanned_at").distinct().withColumn("_rank", F.row_number().over(recent))
    # The rank filter is pushed below the shuffle as a group limit.
    return ranked.where(F.col("_rank") <= STRIKES).groupBy("source_id").agg(
        F.max("scanned_at").alias("_last"), F.min(F.when(F.col("_rank") == 2, F.col("scanned_at"))).alias("_before")
    )


def replay_snapshot(sightings: DataFrame, scans: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """The state after a history of scans."""
    seen = sightings.withColumns({"active": F.lit(True), "missed_scans": F.lit(0)})
    if snapshot is not None:
        seen = seen.unionByName(snapshot.select(*seen.columns))
    payload = F.struct(*[F.col(c) for c in seen.columns])
    # An aggregate: every task keeps one row per posting before anything is shuffled.
    final = seen.groupBy(*KEY).agg(
        F.max_by(payload, F.col("last_seen_at")).alias("_row"), F.min("first_seen_at").alias("_first")
    ).select("_row.*", "_first")
    dated = join_dimension(final, latest_scans(scans), ["source_id"])
    after = sum(
        (F.when(F.coalesce(F.col(c) > F.col("last_seen_at"), F.lit(False)), 1).otherwise(0) for c in ("_last", "_before")),
        F.lit(0),
    )
    strikes = F.when(F.col("active"), F.least(F.col("missed_scans") + after, F.lit(STRIKES))).otherwise(
        F.col("missed_scans")
    )
    columns = {
        "first_seen_at": F.col("_first"),
        "active": F.col("active") & (strikes < STRIKES),
        "missed_scans": strikes.cast("int"),
    }
    return dated.select(*[columns.get(c, F.col(c)).alias(c) for c in seen.columns])


def reactivations(sightings: DataFrame, scans: DataFrame) -> DataFrame:
    """Sightings that bring back a retired posting.

    A posting had retired when the source that saw it last scanned twice without it before it came back.
    """
    by_source = Window.partitionBy("source_id").orderBy("scanned_at")
    second = scans.select("source_id", "scanned_at").distinct().withColumn(
        "retired_at", F.lead("scanned_at", 2).over(by_source)
    )
    slim = sightings.select(*KEY, "source_id", "last_seen_at", "content_fingerprint")
    retiring = join_dimension(
        slim.withColumnRenamed("last_seen_at", "scanned_at"), second, ["source_id", "scanned_at"]
    ).withColumnRenamed("scanned_at", "last_seen_at")
    ordered = with_previous(retiring, KEY, "last_seen_at", ["retired_at", "content_fingerprint"])
    back = ordered.where(F.col("previous.retired_at") < F.col("last_seen_at"))
    return back.select(
        *KEY,
        "source_id",
        F.col("last_seen_at").alias("reopened_at"),
        (F.col("previous.content_fingerprint") != F.col("content_fingerprint")).alias("is_update"),
    )
