"""URL filters by dated lists: each capture is judged by the entries that were active when it was fetched.

A list's history is a table of dated entries: from a date on, a name is listed or no longer listed.  Entries of a name in order
of their dates become validity intervals.  A capture is looked up under its host and every parent domain; of the names
that have an entry in force, the longest decides.

Intervals are cut at the edges of months, and captures meet them by name and month.  So a capture meets few entries, whatever the
length of a name's history, and a host with very many captures is spread by month and split by adaptive execution.

Results: a capture without a host (null, empty or no URL) or without a time is not blocked and has no entry; of several entries of a
name at one moment, the one of the highest order or else a listing one wins; rows with equal keys are judged alike and stay repeated; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name


def host_of(url: Column | str) -> Column:
    """Lower-case host without user, port and trailing dot; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.nullif(F.regexp_replace(F.lower(bare), r"\.+$", ""), F.lit(""))


def names_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more, longest first."""
    labels = F.split(host, r"\.")
    count = F.greatest(F.size(labels) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), count), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))


def intervals(entries: DataFrame, order: str | None = None) -> DataFrame:
    """``name, listed, since, until`` from ``name, since, listed``; the last one of a name has no end.

    Of several entries of a name at one moment the one of the highest ``order`` counts; without that column, or among equals, a listing one.
    """
    known = entries.where(F.col("name").isNotNull() & F.col("since").isNotNull())
    last = F.struct(*([F.col(f"`{order}`")] if order else []), "listed")
    moments = known.groupBy("name", "since").agg(F.max(last)["listed"].alias("listed"))
    follows = Window.partitionBy("name").orderBy("since")
    return moments.withColumn("until", F.lead("since").over(follows))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on", order: str | None = None) -> DataFrame:
    """Add ``host, blocked, entry, listed_since`` to each capture; ``fetched`` and ``since`` are dates or times.

    A date is the first moment of its day.  Months serve only to bring captures and intervals together.
    """
    new = ["host", "blocked", "entry", "listed_since"]
    kept = [c for c in captures.columns if c.lower() not in new]
    own = {c: free_name(c, [*kept, *new]) for c in ("_on", "_host", "_at", "_best")}
    on = F.col(own["_on"])
    given = captures.select(
        *[F.col(f"`{c}`") for c in kept], host_of(f"`{url}`").alias("host"), F.col(f"`{fetched}`").cast("timestamp").alias(own["_on"])
    )
    month = lambda day: F.year(day) * 12 + F.month(day)
    last = captures.agg(F.max(F.col(f"`{fetched}`").cast("timestamp")).cast("string")).first()[0]  # one moment
    last = F.lit(last).cast("timestamp")
    moment = lambda name: F.col(name).cast("timestamp")
    valid = intervals(entries, order).where(moment("since") <= last)
    upto = F.least(F.coalesce(moment("until"), last), last)
    by_month = valid.withColumn("_month", F.explode(F.sequence(month(moment("since")), month(upto))))
    # Equal captures ask once: a host has as many questions as moments, however many captures it has.
    asked = given.where(F.col("host").isNotNull() & on.isNotNull()).select("host", on.alias("_at")).distinct()
    asked = asked.select("host", "_at", F.explode(names_of(F.col("host"))).alias("name")).withColumn("_month", month(F.col("_at")))
    in_force = (moment("since") <= F.col("_at")) & (F.col("until").isNull() | (F.col("_at") < moment("until")))
    met = asked.join(by_month, ["name", "_month"]).where(in_force)
    best = met.groupBy("host", "_at").agg(F.max_by(F.struct("name", "listed", "since"), F.length("name")).alias("_best"))
    best = best.select(F.col("host").alias(own["_host"]), F.col("_at").alias(own["_at"]), F.col("_best").alias(own["_best"]))
    found = F.col(own["_best"])
    return given.join(best, (F.col("host") == F.col(own["_host"])) & (on == F.col(own["_at"])), "left").select(
        *[F.col(f"`{c}`") for c in kept],
        "host",
        F.coalesce(found["listed"], F.lit(False)).alias("blocked"),
        found["name"].alias("entry"),
        found["since"].alias("listed_since"),
    )
