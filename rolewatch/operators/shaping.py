"""Shapes shared by the operators: skew-safe joins, winners per key, positions in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SALTS = 16
BULKY = {"description", "html", "body"}
SALT_TYPES = {"string", "integer", "long", "timestamp", "timestamp_ntz", "date"}


def join_dimension(
    facts: DataFrame, dimension: DataFrame, on: list[str], how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Join many facts to one row per key when a single key may own a large share of the facts.

    The dimension is repeated ``salts`` times and each fact picks one copy, so the facts of a hot key
    spread over that many tasks.  Nothing is broadcast by hint: the dimension may grow, and Spark
    still broadcasts it by itself when its size is known to be small.  The copies come from a join with their
    numbers, as Spark counts that into the size it expects; it takes exploded rows for no larger than before.
    """
    numbers = facts.sparkSession.range(0, salts, 1, 1).select(F.col("id").cast("int").alias("_salt"))
    copies = dimension.crossJoin(F.broadcast(numbers))
    spread = facts.withColumn("_salt", F.pmod(F.xxhash64(*salt_by(facts)), F.lit(salts)).cast("int"))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def join_large(rows: DataFrame, others: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the data.

    Both are sorted: Spark would judge a side by the file that it comes from, in which rows may be far smaller than in memory, and broadcast it.
    """
    return rows.join(others.hint("merge"), on, how)


def salt_by(facts: DataFrame) -> list[Column]:
    """Columns whose hash picks the salt: deterministic, so a recomputed task sends rows the same way."""
    narrow = [f for f in facts.schema.fields if f.name not in BULKY]
    return [F.col(f.name) for f in narrow if f.dataType.typeName() in SALT_TYPES]


def join_skewed(
    facts: DataFrame,
    others: DataFrame,
    on: list[str],
    how: str = "inner",
    salts: int = SALTS,
    hot_keys: int = 4096,
    hot_rows: int = 100_000,
    keyed: DataFrame | None = None,
) -> DataFrame:
    """Join many facts to a large table with one row per key, salting only the heaviest keys.

    A key is hot with more than ``hot_rows`` rows and more than one in ``hot_keys`` of all rows.  So there are fewer than ``hot_keys`` hot keys, their
    list may be broadcast, and no key with a larger share is left out.  Counting keys is a map-side aggregate over ``keyed``, the narrow
    table the facts come from (by default the facts).  The rows of hot keys are salted, all others join as usual.  Every row takes part.
    Both sides are sorted: without hot keys Spark would judge the large table by its file, in which rows may be far smaller, and broadcast it.
    """
    counted = (facts if keyed is None else keyed).groupBy(*on).agg(F.count("*").alias("_rows"))
    share = counted.agg(F.coalesce(F.sum("_rows"), F.lit(0)) / hot_keys).scalar()
    hot = F.broadcast(counted.where((F.col("_rows") > hot_rows) & (F.col("_rows") > share)).select(*on, F.lit(True).alias("_hot")))
    is_hot = F.coalesce(F.col("_hot"), F.lit(False))
    salt = F.pmod(F.xxhash64(*salt_by(facts)), F.lit(salts)).cast("int")
    spread = facts.join(hot, on, "left").withColumn("_salt", F.when(is_hot, salt).otherwise(0)).drop("_hot")
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = others.join(hot, on, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return join_large(spread, copies, [*on, "_salt"], how).drop("_salt")


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    Filters written on a projected column are pushed below the projection and would evaluate an
    expensive expression a second time.  They cannot be pushed below a generator.
    """
    kept = [c for c in rows.columns if c not in columns]
    once = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    return rows.select(*kept, once).select(*kept, "_once.*")


def winners(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the greatest ``order`` per key.

    An aggregate instead of a ranking window: each task first reduces its own rows to one per key, so
    a key that owns a third of the rows never meets in one task.
    """
    payload = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.groupBy(*keys).agg(F.max_by(payload, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def positions(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add the zero-based position of every row in the global order, without gathering the rows.

    The sorted rows are checkpointed (range partitioning samples its input, so a recomputation could
    cut elsewhere); rows count from the start of their partition plus the sizes of those before it.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    marked = rows.sort(*order).withColumn("_mark", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftrightunsigned(F.col("_mark"), 33).alias("_part")
    within = F.col("_mark").bitwiseAND((1 << 33) - 1)
    # One row per partition: bounded by the shuffle width, not by the data.
    sizes = marked.groupBy(part).agg(F.count("*").alias("_size"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_start"))
    return (
        marked.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + within)
        .drop("_part", "_mark", "_start")
    )


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One row of whole numbers from several one-row tables with columns of their own, which are stacked and summed."""
    names = [c for row in rows for c in row.columns]
    total = None
    for row in rows:
        wide = row.select(*[F.col(n) if n in row.columns else F.lit(0).cast("bigint").alias(n) for n in names])
        total = wide if total is None else total.unionByName(wide)
    return total.agg(*[F.sum(n).alias(n) for n in names])


def with_previous(rows: DataFrame, keys: list[str], at: str, columns: list[str], days: int = 7) -> DataFrame:
    """Add ``previous``: the struct of ``columns`` of the row before it among the rows of its key.

    Two levels, so that a key with a third of all rows is not ordered in one task.  Inside a time
    segment rows are compared directly; across segments only the first and last row of each segment
    matter.  Both levels read the same shuffle.
    """
    segment = F.floor(F.unix_date(F.to_date(F.col(at))) / days).alias("_segment")
    value = F.struct(*columns)
    shared = rows.select("*", segment).repartition(*[F.col(k) for k in keys], F.col("_segment"))
    inside = Window.partitionBy(*keys, "_segment").orderBy(at)
    near = shared.withColumn("previous", F.lag(value).over(inside)).where(F.col("previous").isNotNull())

    whole = F.struct(at, *[c for c in rows.columns if c != at])
    edges = shared.groupBy(*keys, "_segment").agg(F.min_by(whole, at).alias("_first"), F.max_by(value, at).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_segment")
    far = edges.withColumn("previous", F.lag("_last").over(across))
    first = [F.col(f"_first.{c}").alias(c) for c in rows.columns]
    return near.select(*rows.columns, "previous").unionByName(far.select(*first, "previous"))
