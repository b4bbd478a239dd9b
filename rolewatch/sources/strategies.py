"""Boards beyond the built-in ones: a name, the companies it serves, and how its landed rows become postings.

A strategy is added by passing it to ``route`` and to the plans of ``plans.discovery``; no table of this package has to be changed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boards import route_targets


@dataclass(frozen=True)
class Strategy:
    """``supports`` tells, from the columns of a target, whether its rows are landed under this ``name``.

    ``discover`` turns landed rows of the provider into rows as ``postings.finish_postings`` gives them, with scan_id and the record's position
    (``board_payloads.RECORD_KEY``).  ``failures`` gives scan_id, source_id and message of the sources that cannot be used.
    """

    name: str
    supports: Callable[[DataFrame], Column]
    discover: Callable[[DataFrame], DataFrame]
    failures: Callable[[DataFrame], DataFrame] | None = None


def route(targets: DataFrame, strategies: Sequence[Strategy] = ()) -> DataFrame:
    """``boards.route_targets``, with the given strategies ahead of the built-in boards; the first that supports a target takes it."""
    names = [s.name for s in strategies]
    if len(set(names)) != len(names):
        raise ValueError("two strategies have one name")
    routed = route_targets(targets)
    chosen = F.coalesce(*[F.when(s.supports(targets), F.lit(s.name)) for s in strategies], F.lit(None).cast("string"))
    own = routed.withColumn("_own", chosen)
    return own.select(
        *targets.columns,
        F.coalesce("_own", "provider").alias("provider"),
        *[F.when(F.col("_own").isNull(), F.col(c)).alias(c) for c in ("api_origin", "site")],
    )


def with_discovered(found: DataFrame, landed: DataFrame, strategies: Sequence[Strategy]) -> DataFrame:
    """The postings found so far and those of all strategies; each reads its own provider's rows only."""
    fields = found.schema.fields
    for s in strategies:
        own = s.discover(landed.where(F.col("provider") == s.name))
        found = found.unionByName(own.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]))
    return found


def with_failures(found: DataFrame, landed: DataFrame, strategies: Sequence[Strategy]) -> DataFrame:
    """The failures found so far and those that strategies report."""
    for s in strategies:
        if s.failures is not None:
            found = found.unionByName(s.failures(landed.where(F.col("provider") == s.name)).select(*found.columns))
    return found
