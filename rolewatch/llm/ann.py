"""Approximate nearest neighbours by stable projections.

Vectors are projected to a few dimensions by a matrix of independent normal numbers, so that the squared
projected distance over the squared distance follows a chi-square law.  Each shard holds a kd-tree of its projected
vectors.  A query takes leaves in order of their projected distance and verifies their vectors by the true
measure; it stops once, at the next leaf's projected distance, a vector nearer than the kth found would have been met with
probability ``certainty``.

The measure is the inner product: with one more component that brings every vector of a shard to the same
length, and queries scaled to that length, order by inner product is order by distance.

Every row is indexed and searched; nothing is fitted but the projection, which is drawn from a seed.  Results: vectors that
are null, empty, zero, or hold a null or non-finite component take no part; of several rows with one id the smallest
vector counts; vectors of another length than the query's are no candidates; ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shards

PROJECTED = 8
CERTAINTY = 0.95
SEED = 11


def chi_square(x: np.ndarray, degrees: int) -> np.ndarray:
    """The distribution function for an even number of degrees of freedom."""
    half = np.minimum(x / 2, 700.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for n in range(1, degrees // 2):
        term = term * half / n
        total = total + term
    return 1.0 - np.exp(-half) * total


class Projected:
    """A shard with its projection."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, dimensions: int, seed: int):
        norms = (points * points).sum(axis=1)
        self.length = float(np.sqrt(norms.max()))
        self.matrix = np.random.default_rng(seed).standard_normal((points.shape[1] + 1, dimensions))
        rest = np.sqrt(np.maximum(self.length**2 - norms, 0.0))
        self.shard = shards.Shard(ids, points, np.column_stack([points, rest]) @ self.matrix)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Squared projected distance from each scaled query to each leaf's box."""
        placed = queries @ self.matrix[:-1]
        gap = np.maximum(np.maximum(self.shard.low - placed[:, None], placed[:, None] - self.shard.high), 0.0)
        return (gap * gap).sum(axis=2)


def nearest(
    rows: DataFrame,
    queries: Column,
    k: int,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    dimensions: int = PROJECTED,
    certainty: float = CERTAINTY,
    shard_rows: int = shards.SHARD_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: up to ``k`` rows found for each row whose ``_id`` satisfies ``queries``."""

    def takes_part(v: Column) -> Column:
        return shards.usable(v) & F.exists(v, lambda x: x.cast("double") != 0)

    candidates, count = shards.prepared(shards.vectors(rows, vec_id, vector, takes_part), shard_rows)

    def build(ids: np.ndarray, points: np.ndarray) -> Projected:
        return Projected(ids, points, dimensions, seed)

    def find(index: Projected, given: np.ndarray, own: np.ndarray, floor: np.ndarray):
        scaled = given * (index.length / np.sqrt((given * given).sum(axis=1)))[:, None]

        def done(bound: np.ndarray, kth: np.ndarray) -> np.ndarray:
            return stop(bound, kth, index.length, dimensions, certainty)

        places = shards.search(index.shard, scaled, own, k, index.bounds(scaled), done, floor, slack=1e-9 * index.length**2)
        return index.shard.ids[places], shards.measure(index.shard, given, places), places >= 0

    asked = candidates.where(queries).withColumn("_floor", F.lit(None).cast("double"))
    return shards.top(shards.search_shards(candidates, asked, build, find, count), k)


def stop(bound: np.ndarray, kth: np.ndarray, length: float, dimensions: int, certainty: float) -> np.ndarray:
    """Whether a vector nearer than the kth would have been met below this squared projected distance."""
    distance = np.maximum(2 * length**2 - 2 * kth, 0.0)  # infinite while fewer than k are found
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(distance > 1e-12 * length**2, bound / distance, np.where(bound > 1e-9 * length**2, np.inf, 0.0))
    return chi_square(np.where(np.isfinite(distance), ratio, 0.0), dimensions) >= certainty
