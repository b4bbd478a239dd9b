"""Hard negatives by selection in disjoint slots.

An anchor's positives are its best rows of the same label.  Each positive asks for the best rows of other labels whose score lies in a window below
its own.  The windows of one anchor overlap; their upper limits, sorted, cut the scores into disjoint slots.  Every
task keeps the ``k`` best rows per anchor and slot, and so does the combination of tasks.  The ``k`` best rows below a limit are then the first of the
slots from that limit downwards, read one after another; the window's lower limit cuts what is left.  So one
pass over the scores answers all windows.

Vectors travel in blocks.  A cell compares a bounded group of anchors with a bounded group of rows, block by block, as matrix products: of the rows
with the anchor's label for positives, of all rows for negatives.  A label of any size is spread over cells.

Scores are inner products of ``floor(scale * x)``, exact: in double precision where no sum can reach 2**53, in whole numbers of any size beyond.

Results: rows with a null id, a null label, or a vector that is null, empty or holds a null or non-finite component take no part; labels are whole
numbers; of several rows with one id the smallest (vector, label) counts; vectors of another length are no candidates; ties go to the
smaller id; an anchor without a positive, and a window without a row, give no row; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, list_array, lists_of
from .shards import usable
from .topk import EXACT, SCALE

POSITIVES, NEGATIVES = 5, 10
#: Bounds of a negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Bytes of vectors in a block, in a cell's anchors and in a cell's rows.
BLOCK_BYTES = 2 << 20
ANCHOR_BYTES = 4 << 20
ROW_BYTES = 64 << 20
#: Anchors multiplied with a block at once.
ANCHORS = 256
NOTHING = -np.inf
#: Stands for a limit that an anchor does not have.
NO_LIMIT = -(1 << 63)


def floor_part(value: Column, hundredths: int) -> Column:
    """``floor(value * hundredths / 100)`` in whole numbers, without a product that could overflow."""
    rest = F.pmod(value, F.lit(100))
    return F.call_function("div", value - rest, F.lit(100)) * hundredths + F.call_function("div", rest * hundredths, F.lit(100))


def blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows ``_id, _label, _v, _limits`` packed by their keys into rows ``keys, first, ids, labels, flat, limits``, each of at most ``BLOCK_BYTES`` of vectors."""
    given = rows.select(*keys, "_id", "_label", "_v", "_limits").sortWithinPartitions(*keys, "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(n).to_numpy(zero_copy_only=False) for n in range(len(keys))]
            ids, labels = (batch.column(len(keys) + n).to_numpy(zero_copy_only=False) for n in range(2))
            vectors, limits = (list(lists_of(batch.column(len(keys) + n))) for n in (2, 3))
            change = np.zeros(len(ids), bool)
            for column in own:
                change[1:] |= column[1:] != column[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), len(ids)]
            cuts = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b:
                    step = max(1, BLOCK_BYTES // (8 * len(vectors[a])))
                    cuts += [(n, min(b, n + step)) for n in range(a, b, step)]
            parts = [list_array([x[a:b] for a, b in cuts], np.int64) for x in (ids.astype(np.int64), labels.astype(np.int64))]
            nested = [list_array([np.concatenate(x[a:b]).astype(kind) for a, b in cuts], kind) for x, kind in ((vectors, np.float64), (limits, np.int64))]
            heads = [pa.array(column[[a for a, _ in cuts]]) for column in own] + [pa.array(ids[[a for a, _ in cuts]].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*heads, *parts, *nested], names=[*keys, "first", "ids", "labels", "flat", "limits"])

    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return given.mapInArrow(run, f"{types}, first long, ids array<long>, labels array<long>, flat array<double>, limits array<long>")


def in_cells(anchors: DataFrame, rows: DataFrame, keys: list[str], kept: Callable, found: str) -> DataFrame:
    """What ``kept(ids, labels, points, limits)`` keeps of the rows met by each cell's anchors.

    ``kept`` gives ``meet(ids, labels, points)``, called per block of rows, and ``rows()``, the columns found.
    """
    spark = rows.sparkSession
    size = F.size("_v").cast("long") * 8
    sums = rows.groupBy(*keys).agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
    asked = anchors.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(F.sum(size).alias("asked"))
    own = [F.col(k) == F.col(f"of_{k}") for k in keys]
    across = F.ceil(F.col("asked") / ANCHOR_BYTES).cast("int")
    # Small tables are spread over the cores there are; the groups of large ones are full.
    wide = F.least(F.ceil(F.col("n") / 1024), F.ceil(F.lit(spark.sparkContext.defaultParallelism) / across))
    down = F.greatest(F.ceil(F.col("bytes") / ROW_BYTES), wide).cast("int")
    grid = cut(sums.join(asked, own).select(*keys, across.alias("across"), down.alias("down")))
    cells = grid.agg(F.sum(F.col("across").cast("long") * F.col("down"))).first()[0] or 1
    place = lambda n: F.pmod(F.xxhash64("first"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [*keys, "first", "ids", "labels", "flat", "limits"]
    asking = blocks(anchors, keys).join(grid, keys).select(*columns, F.lit(0).alias("role"), place("across").alias("at"), every("down").alias("of"))
    given = blocks(rows, keys).join(grid, keys).select(*columns, F.lit(1).alias("role"), place("down").alias("of"), every("across").alias("at"))
    cell = [*keys, "at", "of"]
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(cells), 10_000))
    dealt = asking.unionByName(given).repartition(wanted, *cell).sortWithinPartitions(*cell, "role", "first")
    dealt = dealt.select(F.xxhash64(*cell).alias("cell"), *cell, "role", "ids", "labels", "flat", "limits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, work = None, [], None
        for batch in batches:
            names = batch.schema.names
            keyed = list(zip(*[batch.column(n).to_pylist() for n in range(1, 1 + len(cell))], strict=True))
            role = batch.column(names.index("role")).to_pylist()
            for n, (ids, labels, flat, limits) in enumerate(zip(*[lists_of(batch.column(names.index(c))) for c in ("ids", "labels", "flat", "limits")], strict=True)):
                if keyed[n] != now:
                    if work is not None:
                        yield work.rows()
                    now, asked, work = keyed[n], [], None
                block = (ids, labels, flat.reshape(len(ids), -1), limits.reshape(len(ids), -1))
                if role[n] == 0:
                    asked.append(tuple(x.copy() for x in block))
                    continue
                if asked and work is None:
                    work = kept(*[np.concatenate(x) for x in zip(*asked, strict=True)])
                if work is not None:
                    work.meet(*block[:3])
        if work is not None:
            yield work.rows()

    return dealt.mapInArrow(run, found)


def products(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles, or whole numbers of any size where doubles would not do."""
    most = np.abs(points).max(initial=0.0) * np.abs(others).max(initial=0.0) * points.shape[1]
    if most < EXACT:
        return points @ others.T
    whole = [np.array([[int(x) for x in row] for row in p], object).reshape(p.shape) for p in (points, others)]
    return whole[0] @ whole[1].T


class Best:
    """The ``k`` best rows of each anchor in each of its slots: scores above ``over`` and up to ``upto``."""

    def __init__(self, ids: np.ndarray, k: int, slots: int):
        self.asked, self.k = ids, k
        self.found = [[np.full((len(ids), k), NOTHING), np.zeros((len(ids), k), np.int64)] for _ in range(slots)]

    def keep(self, slot: int, where: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge scores of some anchors with rows; minus infinity where a row is none."""
        held, names = self.found[slot][0][where], self.found[slot][1][where]
        if not (scores >= held.min(axis=1)[:, None]).any():
            return
        both = np.concatenate([held, scores], axis=1)
        which = np.concatenate([names, np.broadcast_to(ids, scores.shape)], axis=1)
        if both.dtype == object:
            picked = np.array([sorted(range(both.shape[1]), key=lambda c: (-both[r, c], which[r, c]))[: self.k] for r in range(len(both))])
        else:
            picked = np.argpartition(-both, self.k - 1, axis=1)[:, : self.k]
            least = np.take_along_axis(both, picked, axis=1).min(axis=1)
            tied = ((both >= least[:, None]).sum(axis=1) > self.k) & (least > NOTHING)
            for r in np.flatnonzero(tied):
                near = np.flatnonzero(both[r] >= least[r])
                picked[r] = near[np.lexsort((which[r, near], -both[r, near]))[: self.k]]
        if both.dtype == object and self.found[slot][0].dtype != object:
            self.found[slot][0] = self.found[slot][0].astype(object)
        self.found[slot][0][where] = np.take_along_axis(both, picked, axis=1)
        self.found[slot][1][where] = np.take_along_axis(which, picked, axis=1)

    def rows(self) -> pa.RecordBatch:
        parts = []
        for slot, (scores, ids) in enumerate(self.found):
            real = scores > NOTHING
            asked = np.broadcast_to(self.asked[:, None], real.shape)[real]
            parts.append((asked, np.full(len(asked), slot, np.int32), [int(s) for s in scores[real]], ids[real]))
        asked, slot, ids = (np.concatenate([p[n] for p in parts]) for n in (0, 1, 3))
        scores = [s for p in parts for s in p[2]]
        return pa.RecordBatch.from_arrays([pa.array(asked), pa.array(slot), pa.array(scores, pa.int64()), pa.array(ids)], names=["anchor_id", "slot", "score", "vec_id"])


class Positives(Best):
    """The best rows of a cell, but for the anchor itself."""

    def __init__(self, k: int, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, limits: np.ndarray):
        super().__init__(ids, k, 1)
        self.points = points

    def meet(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray) -> None:
        for n in range(0, len(self.asked), ANCHORS):
            here = slice(n, n + ANCHORS)
            scores = products(self.points[here], points)
            self.keep(0, here, np.where(self.asked[here][:, None] == ids, NOTHING, scores), ids)


class Negatives(Best):
    """The best rows of other labels in each slot; ``limits`` are an anchor's upper limits, highest first, and its least lower one."""

    def __init__(self, k: int, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, limits: np.ndarray):
        super().__init__(ids, k, limits.shape[1] - 1)
        self.labels, self.points, self.limits = labels, points, limits

    def meet(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray) -> None:
        slots = self.limits.shape[1] - 1
        for n in range(0, len(self.asked), ANCHORS):
            here = slice(n, n + ANCHORS)
            scores, limits = products(self.points[here], points), self.limits[here]
            other = (self.labels[here][:, None] != labels) & (scores >= limits[:, -1:])
            for slot in range(slots):
                inside = other & (scores <= limits[:, slot : slot + 1])
                if slot + 1 < slots:
                    inside &= scores > limits[:, slot + 1 : slot + 2]
                if inside.any():
                    self.keep(slot, here, np.where(inside, scores, NOTHING), ids)


FOUND = "anchor_id long, slot int, score long, vec_id long"


def facts(rows: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """``_id, _label, _v, _dim, _limits`` of the rows that take part."""
    given = rows.select(F.col(f"`{vec_id}`").cast("long").alias("_id"), F.col(f"`{label}`").cast("long").alias("_label"), F.col(f"`{vector}`").alias("_v"))
    fine = F.col("_id").isNotNull() & F.col("_label").isNotNull() & usable(F.col("_v"))
    one = given.where(fine).groupBy("_id").agg(F.min(F.struct("_v", "_label")).alias("_best"))
    whole = F.transform("_best._v", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return one.select("_id", F.col("_best._label").alias("_label"), whole.alias("_v"), F.size("_best._v").alias("_dim"), F.array().cast("array<long>").alias("_limits"))


def positives_of(held: DataFrame, anchors: Column, k: int) -> DataFrame:
    """``anchor_id, positive_id, positive_score``: the ``k`` best other rows of each anchor's label."""
    found = in_cells(held.where(anchors), held, ["_dim", "_label"], lambda *block: Positives(k, *block), FOUND)
    order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))


def mine(
    rows: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each row whose ``_id`` satisfies ``anchors``.

    A negative's score is at least ``low`` and at most ``high`` hundredths of the positive's.
    """
    held = cut(facts(rows, vec_id, vector, label, scale))
    near = positives_of(held, anchors, positives)
    near = cut(near.withColumns({"upto": floor_part(F.col("positive_score"), high), "from_": -floor_part(-F.col("positive_score"), low)}))
    limits = near.groupBy(F.col("anchor_id").alias("_of")).agg(
        F.sort_array(F.collect_set("upto"), asc=False).alias("_upto"), F.min("from_").alias("_least")
    )  # at most ``positives`` limits
    padded = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda n: F.coalesce(F.get("_upto", n), F.lit(NO_LIMIT)))
    asked = held.where(anchors).join(limits, F.col("_id") == F.col("_of")).withColumn("_limits", F.concat(padded, F.array("_least")))
    asked = asked.select("_id", "_label", "_v", "_dim", "_limits")
    found = in_cells(asked, held, ["_dim"], lambda *block: Negatives(negatives, *block), FOUND)
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id")
    kept = found.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= negatives)
    # Slots from the highest downwards, each from its best row on: at most ``positives * negatives`` rows of an anchor.
    row = F.struct("slot", (-F.col("score")).alias("down"), "vec_id")
    ranked = kept.groupBy(F.col("anchor_id").alias("_of")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    inside = F.filter("rows", lambda r: (-r["down"] <= F.col("upto")) & (-r["down"] >= F.col("from_")))
    answers = near.join(ranked, F.col("anchor_id") == F.col("_of")).select("anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(inside, 1, negatives)).alias("place", "row"))
    return answers.select(
        "anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("row.vec_id").alias("negative_id"), "positive_score", (-F.col("row.down")).alias("negative_score")
    )
