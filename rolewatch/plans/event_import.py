"""The import of submitted event pages, from their URLs to the next event table and its messages, as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payloads import event_message
from ..functions.urls import event_url_allowed
from ..operators.shaping import join_dimension, winners
from ..operators.snapshot import KEY, merge_events
from ..sources.pages import admitted_pages, read_event_pages

# Reasons for which a submission is turned down before its page is read.
INCOMPLETE = "Event URL and company are required."
NOT_ALLOWED = "The first release supports direct WithGoogle RSVP event URLs."


@dataclass(frozen=True)
class EventImport:
    """``events``: the next event table with ``change_kind``.  ``rejected``: company_id, url and reason.  ``messages``: id and payload of what changed."""

    events: DataFrame
    rejected: DataFrame
    messages: DataFrame


def import_events(
    pages: DataFrame,
    targets: DataFrame,
    sources: DataFrame,
    stored: DataFrame,
    allowed: Callable[[Column], Column] = event_url_allowed,
    max_units: int | None = None,
    description_length: int | None = None,
) -> EventImport:
    """Import ``pages`` (company_id, url, html, observed_at) on the ``stored`` events.

    A page is turned down for the first of: no URL or company, a URL that is not ``allowed`` or not admitted, an unknown company, no title, no match.
    Only the URL is looked at before the page is read, so the markup of pages turned down there is never parsed.  Of several pages of
    one event the one observed last counts, then that of the greatest fingerprint.
    """
    url = F.col("url")
    gate = F.when(url.isNull() | F.col("company_id").isNull(), INCOMPLETE).when(~allowed(url), NOT_ALLOWED)
    gated = pages.withColumns({"source_url": url, "_gate": gate})
    admitted = admitted_pages(gated, max_units).withColumn("rejection", F.coalesce("_gate", "rejection"))
    turned_down = admitted.where(F.col("rejection").isNotNull()).select("company_id", "url", F.col("rejection").alias("reason"))
    read = read_event_pages(admitted.where(F.col("rejection").isNull()).select("company_id", "url", "html", "observed_at"), targets, sources)
    refused = read.where(F.col("rejection").isNotNull()).select("company_id", F.col("canonical_url").alias("url"), F.col("rejection").alias("reason"))
    accepted = winners(read.where(F.col("rejection").isNull()).drop("rejection"), KEY, [F.col("last_seen_at"), F.col("content_fingerprint")])
    events = merge_events(stored, accepted)
    changed = events.where(F.col("change_kind").isNotNull())
    named = join_dimension(changed, targets.select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), ["company_id"], "inner")
    body = event_message({c: F.col(c) for c in stored.columns}, F.col("company_name"), F.col("change_kind"), description_length=description_length)
    return EventImport(events, turned_down.unionByName(refused), named.select("id", body.alias("payload")))
