"""Stable identities.  Every id is a hash of a natural key, so a rerun yields the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SEPARATOR = "\u001f"


def fingerprint(*parts: Column) -> Column:
    """sha256 over the parts.  NULL parts count as empty instead of vanishing."""
    filled = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *filled), 256)


def posting_id(company_id: Column, url: Column) -> Column:
    return F.substring(fingerprint(company_id, url), 1, 24)


def change_id(job_id: Column, kind: Column, created_at: Column) -> Column:
    return F.substring(fingerprint(job_id, kind, created_at), 1, 32)


def delivery_id(change: Column, channel: Column) -> Column:
    return F.substring(fingerprint(change, channel), 1, 32)
