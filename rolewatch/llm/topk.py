"""Exact top-k by integer inner product, with a kd-tree per shard.

Components become ``floor(scale * x)``.  Each shard is split at medians into leaves with tight bounding boxes.  The highest
inner product of a query with a box is known from its corners; leaves are visited by that bound, highest first,
until it is below the query's kth score.  A first pass searches each query's own shard only, and the kth score found there is propagated:
in every other shard it is the score to reach from the start.

All sums are exact: products are summed in double precision where no sum can reach 2**53, and in whole numbers of any size beyond.
Results: vectors that are null, empty, or hold a null or non-finite component take no part; of several rows with one
id the smallest vector counts; vectors of another length are no candidates; ties go to the smaller id.  A score beyond a long is an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shards

SCALE = 256
EXACT = float(1 << 53)


def exact_top(
    rows: DataFrame,
    queries: Column,
    k: int,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
    shard_rows: int = shards.SHARD_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows for each row whose ``_id`` satisfies ``queries``."""
    whole = shards.vectors(rows, vec_id, vector).select(
        "_id", F.transform("_v", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("_v")
    )
    candidates, count = shards.prepared(whole, shard_rows)

    def build(ids: np.ndarray, points: np.ndarray) -> shards.Shard:
        return shards.Shard(ids, points, points)

    def find(index: shards.Shard, given: np.ndarray, own: np.ndarray, floor: np.ndarray):
        most = np.abs(given).max(initial=0.0) * max(np.abs(index.low).max(), np.abs(index.high).max()) * given.shape[1]
        if most >= EXACT:
            return slow(index, given, own, k)
        bounds = -(np.maximum(given, 0) @ index.high.T + np.minimum(given, 0) @ index.low.T)
        places = shards.search(index, given, own, k, bounds, lambda bound, kth: -bound < kth, floor)
        scores = shards.measure(index, given, places)
        real = (places >= 0) & (scores >= floor[:, None])
        return index.ids[places], np.where(real, scores, 0).astype(np.int64), real

    asked = candidates.where(queries)
    first = shards.search_shards(candidates, asked.withColumn("_floor", F.lit(None).cast("double")), build, find, count, True, "long")
    # The kth score in the own shard; with fewer than k there, any score may do.
    reached = first.groupBy("query_id").agg(F.min("score").alias("_least"), F.count("*").alias("_n"))
    floors = reached.select(F.col("query_id").alias("_id"), F.when(F.col("_n") >= k, F.col("_least").cast("double")).alias("_floor"))
    found = shards.search_shards(candidates, asked.join(floors, "_id", "left"), build, find, count, score="long")
    return shards.top(found, k)


def slow(index: shards.Shard, given: np.ndarray, own: np.ndarray, k: int):
    """Whole numbers of any size, for vectors whose products pass what doubles hold exactly."""
    ids, scores, real = np.zeros((len(given), k), np.int64), np.zeros((len(given), k), np.int64), np.zeros((len(given), k), bool)
    points = [[int(x) for x in p] for p in index.points]
    for row, query in enumerate(given):
        q = [int(x) for x in query]
        ranked = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), int(i)) for p, i in zip(points, index.ids, strict=True) if i != own[row])
        for col, (score, i) in enumerate(ranked[:k]):
            ids[row, col], scores[row, col], real[row, col] = i, -score, True
    return ids, scores, real
