"""Deliveries of changes: enqueue, claim, settle.

A job that writes the table is its only writer; that replaces row locks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import delivery_id
from ..functions.payloads import retry_at, utf16_prefix
from .inbox import with_posting
from .shaping import join_large, side_by_side

CHANNEL = "DISCORD"
CLAIM_SIZE = 10


def enqueue(deliveries: DataFrame, changes: DataFrame, now: Column, channel: str = CHANNEL) -> DataFrame:
    """New PENDING deliveries for changes that have none on this channel."""
    return enqueue_at(deliveries, changes.select("id", now.alias("created_at")), F.col("created_at"), channel)


def enqueue_at(deliveries: DataFrame, changes: DataFrame, at: Column, channel: str = CHANNEL) -> DataFrame:
    """As ``enqueue``, with a time that depends on the change."""
    present = deliveries.where(F.col("channel") == channel).select("change_id")
    queued = changes.groupBy(F.col("id").alias("change_id")).agg(F.min(at).alias("_at"))
    wanted = join_large(queued, present, "change_id", "left_anti")
    types = {f.name: f.dataType for f in deliveries.schema.fields}
    values = {
        "id": delivery_id(F.col("change_id"), F.lit(channel)),
        "change_id": F.col("change_id"),
        "channel": F.lit(channel),
        "status": F.lit("PENDING"),
        "attempts": F.lit(0),
        "next_attempt_at": F.col("_at"),
        "last_error": F.lit(None),
        "external_id": F.lit(None),
        "created_at": F.col("_at"),
        "updated_at": F.col("_at"),
    }
    return wanted.select(*[values[c].cast(types[c]).alias(c) for c in deliveries.columns])


def claimable(deliveries: DataFrame, changes: DataFrame, targets: DataFrame, postings: DataFrame, now: Column, channel: str = CHANNEL) -> DataFrame:
    """Deliveries that may go out: due, and about a posting the latest scan still saw."""
    due = deliveries.where(
        (F.col("channel") == channel)
        & F.col("status").isin("PENDING", "FAILED")
        & (F.col("next_attempt_at") <= now)
    ).select("id", "change_id", "attempts", F.col("created_at").alias("queued_at"))
    alive = postings.where(F.col("active") & (F.col("missed_scans") == 0))
    items = with_posting(changes, targets, alive).withColumnRenamed("id", "change_id")
    return join_large(due, items, "change_id")


def claim(deliveries: DataFrame, changes: DataFrame, targets: DataFrame, postings: DataFrame, now: Column, limit: int | None = CLAIM_SIZE, channel: str = CHANNEL) -> DataFrame:
    """The oldest claimable deliveries, or all without a ``limit``, with the attempt they are about to make."""
    ready = claimable(deliveries, changes, targets, postings, now, channel)
    first = ready if limit is None else ready.orderBy("queued_at", "id").limit(limit)
    return first.withColumn("attempts", F.col("attempts") + 1)


def apply_claims(deliveries: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """The table with the claimed rows SENDING.  ``claims`` may be of any size: Spark broadcasts it if it is small."""
    taken = claims.select("id", F.lit(True).alias("_taken"))
    updates = {"status": F.lit("SENDING"), "attempts": F.col("attempts") + 1, "updated_at": now}
    return _update(deliveries.join(taken, "id", "left"), F.col("_taken"), updates, deliveries)


def _update(joined: DataFrame, hit: Column, updates: dict[str, Column], like: DataFrame) -> DataFrame:
    taken = F.coalesce(hit, F.lit(False))
    columns = []
    for field in like.schema.fields:
        column = F.col(field.name)
        if field.name in updates:
            column = F.when(taken, updates[field.name].cast(field.dataType)).otherwise(column)
        columns.append(column.alias(field.name))
    return joined.select(*columns)


def settle(deliveries: DataFrame, outcomes: DataFrame, now: Column, error_length: int | None = None) -> DataFrame:
    """Apply outcomes (id, external_id, error): SENT without an error, else FAILED with a later retry.

    Errors are kept whole, or up to ``error_length`` UTF-16 units.
    """
    result = outcomes.select("id", F.col("external_id").alias("_external"), F.col("error").alias("_error"), F.lit(True).alias("_hit"))
    sent = F.col("_error").isNull()
    updates = {
        "status": F.when(sent, "SENT").otherwise("FAILED"),
        "external_id": F.when(sent, F.coalesce("_external", F.lit("accepted"))).otherwise(F.col("external_id")),
        "last_error": F.when(~sent, utf16_prefix(F.col("_error"), error_length)),
        "next_attempt_at": F.when(sent, F.col("next_attempt_at")).otherwise(retry_at(now, F.col("attempts"))),
        "updated_at": now,
    }
    return _update(join_large(deliveries, result, "id", "left"), F.col("_hit"), updates, deliveries)


def settled(deliveries: DataFrame, outcomes: DataFrame, now: Column, error_length: int | None = None) -> DataFrame:
    """Only the rows that ``settle`` would change: answered ones that are SENDING, so the same outcomes once more change nothing."""
    answered = join_large(deliveries.where(F.col("status") == "SENDING"), outcomes.select("id"), "id", "left_semi")
    return settle(answered, outcomes, now, error_length)


def deliver(
    deliveries: DataFrame,
    changes: DataFrame,
    targets: DataFrame,
    postings: DataFrame,
    outcomes: DataFrame,
    now: Column,
    limit: int | None = CLAIM_SIZE,
    channel: str = CHANNEL,
    error_length: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """One round: enqueue, claim, settle.  Gives the table after it, and one row with what was queued, claimed, sent and failed.

    ``outcomes`` (id, external_id, error) are the answers to the claimed deliveries; answers to others are not applied.
    """
    queued = enqueue(deliveries, changes, now, channel)
    waiting = deliveries.unionByName(queued)
    claimed = claim(waiting, changes, targets, postings, now, limit, channel)
    answered = outcomes.join(claimed.select("id"), "id", "left_semi")
    after = settle(apply_claims(waiting, claimed, now), answered, now, error_length)
    counts = side_by_side(queued.agg(F.count("*").alias("queued")), claimed.agg(F.count("*").alias("claimed")), outcome_counts(answered))
    return after, counts


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count_if(F.col("error").isNull()).alias("sent"), F.count_if(F.col("error").isNotNull()).alias("failed")
    )
