"""Vectors in shards of bounded size, each searched by leaves of a kd-tree, for queries that stream past it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors of a shard, on average: what a task holds besides a batch of queries.
SHARD_ROWS = 4096
LEAF_ROWS = 128
#: Queries searched at once.
QUERY_ROWS = 512


def usable(vector: Column) -> Column:
    """Neither null nor empty, and no component null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def vectors(rows: DataFrame, vec_id: str, vector: str, keep: Callable[[Column], Column] = usable) -> DataFrame:
    """``_id, _v`` of the vectors that take part; of several rows with one id, the smallest vector."""
    given = rows.select(F.col(f"`{vec_id}`").cast("long").alias("_id"), F.col(f"`{vector}`").alias("_v"))
    return given.where(F.col("_id").isNotNull() & keep(F.col("_v"))).groupBy("_id").agg(F.min("_v").alias("_v"))


def kd_leaves(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points and where its leaves begin and end: median splits across the widest side."""
    open_, order, starts, done = [np.arange(len(points))], [], [0], 0
    while open_:
        here = open_.pop()
        if len(here) <= leaf_rows:
            order.append(here)
            done += len(here)
            starts.append(done)
            continue
        part = points[here]
        side = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        middle = len(here) // 2
        split = np.argpartition(part[:, side], middle)
        open_ += [here[split[middle:]], here[split[:middle]]]
    return np.concatenate(order) if order else np.empty(0, np.int64), np.array(starts)


class Shard:
    """Vectors in leaf order, with the bounding box of each leaf in the space the tree was split in."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, split_by: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order, self.starts = kd_leaves(split_by, leaf_rows)
        self.ids, self.points = ids[order], np.ascontiguousarray(points[order])
        placed = split_by[order]
        cuts = self.starts[:-1]
        self.low = np.minimum.reduceat(placed, cuts, axis=0)
        self.high = np.maximum.reduceat(placed, cuts, axis=0)


def best(scores: np.ndarray, ids: np.ndarray, k: int, exact: Callable[[int, np.ndarray], np.ndarray], slack: float) -> np.ndarray:
    """Per row, the places of the ``k`` highest scores, ties to smaller ids.

    Scores closer than ``slack`` may be in either order: where that decides, they are computed anew by ``exact(row, places)``.
    """
    picked = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(scores, picked, axis=1).min(axis=1)
    unsure = ((scores >= (least - slack)[:, None]).sum(axis=1) > k) & (least > -np.inf)
    for row in np.flatnonzero(unsure):
        near = np.flatnonzero(scores[row] >= least[row] - slack)
        picked[row] = near[np.lexsort((ids[row, near], -exact(row, near)))[:k]]
    return picked


def measure(shard: Shard, queries: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Inner products of each query with its places, summed in one order for every pair; minus infinity at place -1."""
    return np.where(places >= 0, (shard.points[places] * queries[:, None]).sum(axis=2), -np.inf)


def search(
    shard: Shard,
    queries: np.ndarray,
    own: np.ndarray,
    k: int,
    bounds: np.ndarray,
    done: Callable[[np.ndarray, np.ndarray], np.ndarray],
    floor: np.ndarray,
    slack: float = 0.0,
) -> np.ndarray:
    """The places in the shard of up to ``k`` candidates per query; -1 where one is missing.

    Leaves are visited best bound first.  ``done(bound of the next leaf, kth score so far)`` tells which queries
    need no more.  In each round the queries that want the same leaf are multiplied with it together.
    """
    order = np.argsort(bounds, axis=1, kind="stable")
    places, scores = np.full((len(queries), k), -1), np.full((len(queries), k), -np.inf)
    width = int(np.diff(shard.starts).max())
    active = np.arange(len(queries))
    for turn in range(bounds.shape[1]):
        kth = np.maximum(scores[active].min(axis=1), floor[active])
        active = active[~done(bounds[active, order[active, turn]], kth)]
        if not len(active):
            break
        leaf = order[active, turn]
        new, at = np.full((len(active), width), -np.inf), np.full((len(active), width), -1)
        by_leaf = np.argsort(leaf, kind="stable")
        for group in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
            a, b = shard.starts[leaf[group[0]]], shard.starts[leaf[group[0]] + 1]
            found = queries[active[group]] @ shard.points[a:b].T
            found[shard.ids[a:b] == own[active[group]][:, None]] = -np.inf
            new[group, : b - a], at[group, : b - a] = found, np.arange(a, b)
        better = (new >= (scores[active].min(axis=1) - slack)[:, None]).any(axis=1)
        if better.any():
            rows = active[better]
            both = np.concatenate([scores[rows], new[better]], axis=1)
            which = np.concatenate([places[rows], at[better]], axis=1)
            which[both == -np.inf] = -1

            def exact(row: int, columns: np.ndarray, rows=rows, which=which) -> np.ndarray:
                return measure(shard, queries[rows[row]][None], which[row, columns][None])[0]

            ids = np.where(which >= 0, shard.ids[which], np.iinfo(np.int64).max)
            picked = best(both, ids, k, exact, slack)
            scores[rows] = np.take_along_axis(both, picked, axis=1)
            places[rows] = np.take_along_axis(which, picked, axis=1)
    return places


def search_shards(
    candidates: DataFrame,
    queries: DataFrame,
    build: Callable[[np.ndarray, np.ndarray], object],
    find: Callable[[object, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
    shards: int,
    own_shard_only: bool = False,
    score: str = "double",
) -> DataFrame:
    """``query_id, vec_id, score``: what ``find`` returns for every query (``_id, _v, _floor``) in every shard of its length.

    ``find`` gives ids, scores (doubles, or longs if ``score`` says so) and which of them are real.

    Each query is sent to every shard, sorted behind the shard's vectors; a task holds one shard and one
    batch of queries.  With ``own_shard_only`` a query is sent only to the shard that its id would be in.
    """
    shard = F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int")
    where = F.array(shard) if own_shard_only else F.sequence(F.lit(0), F.lit(shards - 1))
    nothing = F.lit(None).cast("double").alias("_floor")
    held = candidates.select(F.size("_v").alias("_dim"), shard.alias("_shard"), F.lit(0).alias("_role"), "_id", "_v", nothing)
    asked = queries.select(F.size("_v").alias("_dim"), F.explode(where).alias("_shard"), F.lit(1).alias("_role"), "_id", "_v", "_floor")
    keys = ["_dim", "_shard"]
    dealt = held.unionByName(asked).repartition(shards, *keys).sortWithinPartitions(*keys, "_role", "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, points, index = None, [], [], None
        for batch in batches:
            dim, shard, role, row_id = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(4))
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            floor = np.nan_to_num(batch.column(5).to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
            offset = np.concatenate([[0], np.cumsum(dim)])
            cuts = np.flatnonzero((np.diff(dim) != 0) | (np.diff(shard) != 0) | (np.diff(role) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(dim)], strict=True):
                if a == b:
                    continue
                if now != (dim[a], shard[a]):
                    now, ids, points, index = (dim[a], shard[a]), [], [], None
                part = flat[offset[a] : offset[b]].reshape(b - a, dim[a])
                if not role[a]:
                    ids.append(row_id[a:b])
                    points.append(part)
                    continue
                if not ids:
                    continue
                index = index or build(np.concatenate(ids), np.concatenate(points))
                for s in range(a, b, QUERY_ROWS):
                    e = min(b, s + QUERY_ROWS)
                    found, measured, real = find(index, part[s - a : e - a], row_id[s:e], floor[s:e])
                    asked = np.broadcast_to(row_id[s:e][:, None], found.shape)[real]
                    yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(found[real]), pa.array(measured[real])], names=["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, f"query_id long, vec_id long, score {score}")


def prepared(rows: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """The vectors written out once, and the number of shards for them."""
    kept = cut(rows)
    return kept, max(1, -(-kept.count() // shard_rows))


def top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows per query, ranked from 1; tasks keep only that many per query before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
