"""Mixing sources to target weights by weighted fair queueing.

Each source gets a target in words: its share by weight of all words, at most ``most`` times its own
size; what a capped source leaves is shared anew among the others.  Within a source documents are
shuffled by a hash, and each gets a virtual finish time: the source's words up to and including it,
divided by the source's target.  Further passes over a source go on counting.  All documents in order of
finish time, cut where the words reach the budget, are the mix.

Nothing is ordered in one task: running sums go over hash ranges of a few thousand documents plus one sum per
range; the cut is looked up in a histogram of finish times and settled within the one bar that it falls into.

Results: a null text has size 0; a document of size 0 is never taken; a null source is a source of its
own, last in order; rows equal in id, source and size are taken together, so repeated rows and ties
give the same result on every run; an empty table gives an empty one.  A column with the name of a new one is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name

#: Documents of one source in a hash range, on average: a window group of this size.
RANGE_ROWS = 4096
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: its place, weight, size, target, and totals over all sources.

    Sources by code point, null last, take the weights in turn.  Sorted by how early they reach their
    cap, the capped ones come first, so running sums replace repeated sharing.  One row per source meets in one task.
    """
    sums = units.groupBy("_source").agg(F.sum("_words").alias("_source_size"), F.count("*").alias("_rows"))
    placed = sums.withColumn("_place", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    by_cap = everything.orderBy(F.col("_cap") / F.col("_weight"), "_place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    sharing = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    ranked = (
        placed.withColumns({"_weight": weight.cast("double"), "_cap": (F.col("_source_size") * most).cast("double")})
        .withColumns({"_budget": F.sum("_source_size").over(everything), "_all_rows": F.sum("_rows").over(everything)})
        .withColumns({"_left": left.cast("double"), "_sharing": sharing})
        .withColumn("_capped", F.col("_cap") * F.col("_sharing") < F.col("_weight") * F.col("_left"))
    )
    open_left = F.max(F.when(~F.col("_capped"), F.col("_left"))).over(everything)
    open_weight = F.max(F.when(~F.col("_capped"), F.col("_sharing"))).over(everything)
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_weight") * open_left / open_weight)
    return ranked.withColumn("_target", target).select(
        "_source", "_place", "_source_size", "_target", "_budget",
        F.greatest(F.lit(1), F.ceil(F.col("_rows") / RANGE_ROWS)).alias("_ranges"),
        F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("_all_rows")))).alias("_bars"),
    )


def mix_units(sized: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From rows ``_id, _source, _size``: one row per distinct one with ``_copies``, ``_finish``, ``_source_size``, ``_target``."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    units = cut(
        sized.groupBy("_id", "_source", "_size")
        .agg((F.count("*") * F.col("_size")).alias("_words"))
        .withColumn("_key", key)
    )
    targets = cut(source_targets(units, weights, most))
    share = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    placed = (
        units.join(targets.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of")))
        .drop("_of")
        .withColumn("_range", F.floor(share * F.col("_ranges")))
    )
    sums = placed.groupBy("_place", "_range").agg(F.sum("_words").alias("_sum"))
    earlier = Window.partitionBy("_place").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_place", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_place", "_range").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("_start") + F.sum("_words").over(inside)
    queued = cut(placed.join(starts, ["_place", "_range"]).withColumn("_at", at).drop("_key", "_range", "_ranges", "_start"))

    passes = F.transform(
        F.sequence(F.lit(0), F.lit(most - 1)),
        lambda n: F.struct(
            F.try_divide(n * F.col("_source_size") + F.col("_at"), F.col("_target")).alias("finish"),
            F.col("_place").alias("place"),
            (n * F.col("_source_size") + F.col("_at")).alias("at"),
        ),
    )
    turns = queued.where(F.col("_words") > 0).select("_words", "_bars", "_budget", F.explode(passes).alias("_turn"))
    # Beyond four times the budget's own time all turns share one bar.
    turns = turns.withColumn("_bar", F.floor(F.least(F.col("_turn.finish"), F.lit(4.0)) * F.col("_bars")))
    bars = turns.groupBy("_bar").agg(F.sum("_words").alias("_sum"), F.first("_budget").alias("_budget"))
    running = F.sum("_sum").over(Window.partitionBy(F.lit(0)).orderBy("_bar"))
    full = bars.withColumn("_upto", running).where(F.col("_upto") > F.col("_budget"))
    # One row: the first bar that the budget does not cover.
    edge = full.agg(F.min_by(F.struct("_bar", (F.col("_upto") - F.col("_sum")).alias("_ahead")), "_bar").alias("_edge"))
    edge = edge.select(F.col("_edge._bar").alias("_edge"), F.col("_edge._ahead").alias("_ahead"))
    within = Window.partitionBy("_edge").orderBy("_turn").rowsBetween(Window.unboundedPreceding, 0)
    crossing = turns.join(F.broadcast(edge), F.col("_bar") == F.col("_edge"))
    last = crossing.withColumn("_upto", F.col("_ahead") + F.sum("_words").over(within)).groupBy("_edge").agg(
        F.max(F.when(F.col("_upto") <= F.col("_budget"), F.col("_turn"))).alias("_last")
    )
    one = F.lit(1).alias("_one")
    ends = F.broadcast(last.select("_edge", "_last", one))
    bar = lambda turn: F.floor(F.least(turn["finish"], F.lit(4.0)) * F.col("_bars"))
    in_mix = lambda turn: (bar(turn) < F.col("_edge")) | ((bar(turn) == F.col("_edge")) & (turn <= F.col("_last")))
    copies = F.when(F.col("_words") > 0, F.size(F.filter("_passes", lambda turn: F.coalesce(in_mix(turn), F.lit(False))))).otherwise(0)
    return (
        queued.withColumns({"_passes": passes, "_one": F.lit(1)})
        .join(ends, "_one", "left")
        .select("_id", "_source", "_size", "_source_size", "_target", copies.alias("_copies"), F.col("_passes")[0]["finish"].alias("_finish"))
    )


NEW = ["size", "source_size", "target", "copies", "finish", "taken"]


def mix(rows: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **settings) -> DataFrame:
    """Add to every row ``size``, ``source_size``, ``target``, ``copies`` (how often the mix takes it), ``finish`` and ``taken``."""
    kept = [c for c in rows.columns if c.lower() not in NEW]
    sized = rows.select(*[F.col(f"`{c}`") for c in kept], word_count(f"`{text}`").alias("size"))
    facts = sized.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{source}`").alias("_source"), F.col("size").alias("_size"))
    units = mix_units(facts, **settings)
    own = {c: free_name(c, [*kept, *NEW]) for c in units.columns}  # a column of the rows may have such a name
    units = units.select(*[F.col(c).alias(name) for c, name in own.items()])
    same = (
        F.col(f"`{doc_id}`").eqNullSafe(F.col(own["_id"])) & F.col(f"`{source}`").eqNullSafe(F.col(own["_source"])) & (F.col("size") == F.col(own["_size"]))
    )
    return sized.join(units, same).select(
        *[F.col(f"`{c}`") for c in kept], "size",
        F.col(own["_source_size"]).alias("source_size"), F.col(own["_target"]).alias("target"), F.col(own["_copies"]).alias("copies"),
        F.col(own["_finish"]).alias("finish"), (F.col(own["_copies"]) * F.col("size")).cast("long").alias("taken"),
    )


def mixed(rows: DataFrame, **settings) -> DataFrame:
    """The mix itself, in global order: each taken document once per copy, range-sorted by finish time."""
    taken = mix(rows, **settings).where(F.col("copies") > 0)
    turns = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    finish = F.col("finish") + (F.col("copy") - 1) * F.col("source_size") / F.col("target")
    return turns.withColumn("finish", finish).sort("finish").select(*[F.col(f"`{c}`") for c in rows.columns], *[c for c in ("finish", "copy") if c not in rows.columns])


def repeated(rows: DataFrame, **settings) -> DataFrame:
    """The rows that the mix takes, each once per copy, in no order."""
    taken = mix(rows, **settings).where(F.col("copies") > 0)
    return taken.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"`{c}`") for c in rows.columns])
