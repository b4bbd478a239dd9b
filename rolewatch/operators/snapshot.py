"""Merge one scan into the stored snapshot and report what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import change_id
from .shaping import join_dimension

KEY = ["company_id", "canonical_url"]
STRIKES = 2


def merge_scan(snapshot: DataFrame, scan: DataFrame, scanned_sources: DataFrame) -> DataFrame:
    """The next snapshot with ``change_kind`` (NEW, UPDATED or NULL) per row.

    ``scan`` holds one row per key.  ``scanned_sources`` lists the sources whose scan succeeded; an
    active posting of such a source that is not in the scan takes a strike and retires at the second.
    A posting seen again is active with no strikes and keeps its id and first sighting.
    """
    ticked = scanned_sources.select("source_id").distinct().withColumn("_scanned", F.lit(True))
    stored = join_dimension(snapshot, ticked, ["source_id"])
    fresh = scan.withColumn("_seen", F.lit(True))
    both = stored.alias("s").join(fresh.alias("n"), KEY, "full_outer")
    missed = F.col("n._seen").isNull() & F.col("s.active") & F.coalesce(F.col("s._scanned"), F.lit(False))
    return _next_state(both, missed, snapshot.columns)


def _next_state(both: DataFrame, missed: Column, columns: list[str]) -> DataFrame:
    """Stored rows ``s`` joined to those of a scan ``n`` become the next snapshot."""
    seen, known = F.col("n._seen").isNotNull(), F.col("s.id").isNotNull()
    strikes = F.when(seen, 0).otherwise(F.col("s.missed_scans") + F.when(missed, 1).otherwise(0))

    kept = {"id": F.coalesce(F.col("s.id"), F.col("n.id"))}
    kept |= {name: F.col(name) for name in KEY}
    kept["first_seen_at"] = F.coalesce(F.col("s.first_seen_at"), F.col("n.first_seen_at"))
    kept["active"] = seen | (F.col("s.active") & ~(missed & (strikes >= STRIKES)))
    kept["missed_scans"] = strikes.cast("int")
    chosen = [
        kept.get(name, F.when(seen, F.col(f"n.{name}")).otherwise(F.col(f"s.{name}"))).alias(name)
        for name in columns
    ]
    changed = F.col("s.content_fingerprint") != F.col("n.content_fingerprint")
    kind = F.when(seen & ~known, "NEW").when(seen & changed, "UPDATED")
    return both.select(*chosen, kind.alias("change_kind"))


def hold_bucketed(snapshot: DataFrame, name: str, folder: str, buckets: int) -> DataFrame:
    """Write the snapshot as a table bucketed and sorted by its key, below ``folder`` on shared storage, and read it.

    Joins by the key then read each bucket where it lies.  A bucket holds whole keys, and a company of any size is spread over all buckets.
    """
    rows = snapshot.repartition(buckets, *KEY).write.bucketBy(buckets, *KEY).sortBy(*KEY)
    rows.option("path", f"{folder}/{name}").mode("overwrite").saveAsTable(name)
    return snapshot.sparkSession.table(name)


def merge_in_place(snapshot: DataFrame, scan: DataFrame, scanned_sources: DataFrame) -> DataFrame:
    """``merge_scan`` for a snapshot held by ``hold_bucketed``: stored rows are neither shuffled nor sorted.

    Which active rows the scanned sources have missed is found on keys and sources alone; these keys then meet the stored rows together with the scan.
    """
    fresh = scan.withColumns({"_seen": F.lit(True), "_missed": F.lit(False)})
    ticked = scanned_sources.select("source_id").distinct()
    active = snapshot.where("active").select(*KEY, "source_id")
    unseen = active.join(scan.select(*KEY), KEY, "left_anti")
    missed = join_dimension(unseen, ticked, ["source_id"], "inner").select(*KEY)
    names = [f for f in fresh.schema.fields if f.name not in (*KEY, "_seen", "_missed")]
    nothing = missed.select(*KEY, *[F.lit(None).cast(f.dataType).alias(f.name) for f in names], F.lit(None).cast("boolean").alias("_seen"), F.lit(True).alias("_missed"))
    both = snapshot.alias("s").join(fresh.unionByName(nothing).alias("n"), KEY, "full_outer")
    return _next_state(both, F.coalesce(F.col("n._missed"), F.lit(False)), snapshot.columns)


def merge_events(stored: DataFrame, imported: DataFrame) -> DataFrame:
    """Events know no strikes: an import creates or refreshes, and the event stays active."""
    both = stored.alias("s").join(imported.withColumn("_seen", F.lit(True)).alias("n"), KEY, "full_outer")
    seen, known = F.col("n._seen").isNotNull(), F.col("s.id").isNotNull()
    columns = []
    for name in stored.columns:
        if name in KEY:
            column = F.col(name)
        elif name in ("id", "first_seen_at"):
            column = F.coalesce(F.col(f"s.{name}"), F.col(f"n.{name}"))
        elif name == "active":
            column = seen | F.col("s.active")
        else:
            column = F.when(seen, F.col(f"n.{name}")).otherwise(F.col(f"s.{name}"))
        columns.append(column.alias(name))
    changed = F.col("s.content_fingerprint") != F.col("n.content_fingerprint")
    kind = F.when(seen & ~known, "NEW").when(seen & changed, "UPDATED")
    return both.select(*columns, kind.alias("change_kind"))


def changes_of(merged: DataFrame) -> DataFrame:
    """Change-log rows of a merge.  The id hashes the natural key, so a rerun adds nothing new."""
    changed = merged.where(F.col("change_kind").isNotNull())
    return changed.select(
        change_id(F.col("id"), F.col("change_kind"), F.col("last_seen_at")).alias("id"),
        F.col("id").alias("job_id"),
        "company_id",
        F.col("change_kind").alias("kind"),
        F.col("last_seen_at").alias("created_at"),
        F.lit(None).cast(merged.schema["last_seen_at"].dataType).alias("read_at"),
    )


def active_postings(snapshot: DataFrame) -> DataFrame:
    return snapshot.where("active").orderBy(F.col("last_seen_at").desc(), "title", "id")


def active_events(events: DataFrame) -> DataFrame:
    return events.where("active").orderBy(
        F.col("starts_at").asc_nulls_last(), F.col("last_seen_at").desc(), "id"
    )
