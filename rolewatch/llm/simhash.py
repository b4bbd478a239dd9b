"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint has one bit per position: whether over half of its shingle hashes have that bit set.
Two fingerprints link at ``max_distance`` or fewer differing bits.

The 64 bits are cut into bands; of ``d`` differing bits, one band has at most ``t = d // bands``.  In
each band the words of a covering code are the anchors: a Hamming code on the first ``2**r - 1`` bits, the
other bits free, so that every value has an anchor within radius 1.  A fingerprint is at home at that
anchor and is copied to every anchor within radius ``1 + t``; by the triangle inequality it meets there every
fingerprint at home within ``t``.  Pairs are compared per anchor over all 64 bits.

One code over all 64 bits would need copies to some hundred thousand anchors each; more, narrower bands
mean fewer copies but fuller anchors.  ``widths_for`` weighs both by the number of fingerprints: wider bands for larger tables.

Equal fingerprints count once.  An anchor with many visitors is split into a grid of cells, each with a
bounded number of rows, and each batch of cells gives a spanning forest of its links and not all pairs, so no link between
different fingerprints is lost and none is repeated within a group of copies.

Results: a null or empty text, or one of white space, has fingerprint zero and links like any other; repeated rows
are one group; null ids never name a component if there is another id; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, with_computed
from .components import connected, forest

SHINGLE = 4
MAX_DISTANCE = 4
SEED = 42
WIDTHS = (22, 21, 21)
#: Bands to choose from.
CHOICES = (WIDTHS, (32, 32))
#: What sending a copy costs, in comparisons.
COPY_COST = 200
#: Parity bits of the Hamming code: it covers 2**r - 1 bits.
CHECK_BITS = 4
#: Rows of an anchor that one cell compares with as many others.
CELL_ROWS = 8192
#: Pairs compared at once, which bounds a task's memory.
PAIRS = 2_000_000
#: Hashes whose bits are counted at once.
HASHES = 65_536
#: Up to so many anchors, the list of crowded ones is small by construction and is broadcast.
SMALL_CODE = 1 << 20


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = (digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True))
    count = len(words) - size + 1
    values = np.fromiter(hashes, np.uint64, count)
    ones = np.zeros(64, np.int64)
    for n in range(0, count, HASHES):
        part = values[n : n + HASHES]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > count, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(rows: DataFrame, text: str = "text", name: str = "fingerprint", size: int = SHINGLE) -> DataFrame:
    """Add the fingerprint of each whole text, as a long."""
    return with_computed(
        rows, text, {name: T.LongType()}, lambda: lambda texts: [[fingerprint(x, size) for x in texts.to_pylist()]]
    )


def as_hex(fingerprint: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def patterns(width: int, radius: int, check_bits: int = CHECK_BITS) -> list[list[int]]:
    """For each syndrome, the bit patterns of weight up to ``radius`` that lead from a value with it to an anchor."""
    covered = (1 << check_bits) - 1
    found: list[list[int]] = [[] for _ in range(covered + 1)]
    for weight in range(radius + 1):
        for places in combinations(range(width), weight):
            syndrome = 0
            for p in places:
                syndrome ^= p + 1 if p < covered else 0
            found[syndrome].append(sum(1 << p for p in places))
    return found


def widths_for(count: int, max_distance: int = MAX_DISTANCE, check_bits: int = CHECK_BITS) -> tuple[int, ...]:
    """The bands with the least work for ``count`` distinct fingerprints, if these are spread evenly: copies sent and pairs compared."""

    def work(widths: tuple[int, ...]) -> float:
        radius = 1 + max_distance // len(widths)
        copies = [sum(comb(w, n) for n in range(radius + 1)) / (1 << check_bits) for w in widths]
        return count * sum(COPY_COST * c + c * count / 2 ** (w - check_bits) for c, w in zip(copies, widths, strict=True))

    return min(CHOICES, key=work)


def copies_of(value: Column, syndrome: Column, table: Column, nearest: Column, band: int) -> Column:
    """The anchors of one band that a value is copied to, and which of them is its home."""

    def copy(pattern: Column) -> Column:
        anchor = value.bitwiseXOR(pattern.cast("long")) + F.lit(band << 40)
        return F.struct(anchor.alias("anchor"), (pattern == F.element_at(nearest, syndrome + 1)).alias("home"))

    return F.transform(F.element_at(table, syndrome + 1), copy)


def anchors(unique: DataFrame, max_distance: int, widths: tuple[int, ...], check_bits: int) -> DataFrame:
    """``anchor, fingerprint, home``: every copy of every fingerprint."""
    covered = (1 << check_bits) - 1
    low, parts = 0, []
    for band, width in enumerate(widths):
        value = F.shiftrightunsigned("fingerprint", low).bitwiseAND((1 << width) - 1)
        bits = [
            F.shiftleft(F.bit_count(value.bitwiseAND(sum(1 << (p - 1) for p in range(1, covered + 1) if p >> j & 1))) % 2, j)
            for j in range(check_bits)
        ]
        syndrome = sum(bits[1:], bits[0])
        table = F.array(*[F.array(*map(F.lit, p)) for p in patterns(width, 1 + max_distance // len(widths), check_bits)])
        nearest = F.array(F.lit(0), *[F.lit(1 << p) for p in range(covered)])
        parts.append(copies_of(value, syndrome, table, nearest, band))
        low += width
    return unique.select("fingerprint", F.explode(F.concat(*parts)).alias("_to")).select(
        "_to.anchor", "fingerprint", "_to.home"
    )


def cells(copies: DataFrame, few_anchors: bool, cell_rows: int) -> DataFrame:
    """``anchor, row, column, fingerprint, role``: a crowded anchor as a grid, any other as one cell.

    At home means a row of the grid (role 1), visiting a column (role 2); 3 is both.
    """
    crowded = copies.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
    crowded = crowded.select("anchor", F.ceil(F.col("n") / cell_rows).cast("int").alias("side"))
    split = copies.join(F.broadcast(crowded) if few_anchors else crowded, "anchor", "left")
    side, own = F.coalesce("side", F.lit(1)), F.pmod(F.xxhash64("fingerprint"), F.coalesce("side", F.lit(1))).cast("int")
    every = F.sequence(F.lit(0), side - 1)
    as_row = F.transform(every, lambda c: F.struct(own.alias("row"), c.alias("column"), F.when(c == own, 3).otherwise(1).alias("role")))
    as_column = F.transform(every, lambda r: F.struct(r.alias("row"), own.alias("column"), F.lit(2).alias("role")))
    others = F.filter(as_column, lambda x: x["row"] != own)
    placed = F.when(F.col("home"), F.concat(as_row, others)).otherwise(as_column)
    return split.select("anchor", "fingerprint", F.explode(placed).alias("_at")).select("anchor", "_at.row", "_at.column", "_at.role", "fingerprint")


def compare(keys: np.ndarray, role: np.ndarray, prints: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links of some whole cells; rows are sorted by cell."""
    new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.empty(0, bool)
    cell = np.cumsum(new) - 1
    visiting = np.flatnonzero(role & 2)
    first = np.searchsorted(cell[visiting], np.arange(cell[-1] + 2 if len(cell) else 1))
    home = np.flatnonzero(role & 1)
    count = np.diff(first)[cell[home]]
    upto = np.cumsum(count)
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    start = 0
    while start < len(home):
        done = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
        n = count[start:end]
        a = np.repeat(home[start:end], n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        b = visiting[np.repeat(first[cell[home[start:end]]], n) + within]
        apart = prints[a] ^ prints[b]
        near = (np.bitwise_count(apart.view(np.uint64)) <= max_distance) & (apart != 0)
        if near.any():
            x, y = forest(prints[a[near]], prints[b[near]])
            found_a.append(x)
            found_b.append(y)
        start = end
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def links(
    unique: DataFrame,
    max_distance: int = MAX_DISTANCE,
    widths: tuple[int, ...] | None = None,
    check_bits: int = CHECK_BITS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Links ``a, b`` that connect what all links within ``max_distance`` connect, from distinct ``fingerprint``."""
    widths = widths or widths_for(unique.count(), max_distance, check_bits)
    if sum(widths) != 64 or min(widths) < (1 << check_bits) - 1:
        raise ValueError("the bands must add up to 64 bits and each hold the code")
    few = sum(1 << (w - check_bits) for w in widths) <= SMALL_CODE
    grid = cells(anchors(unique, max_distance, widths, check_bits), few, cell_rows)
    keys = ["anchor", "row", "column"]
    dealt = grid.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def part(rows: list[np.ndarray]) -> pa.RecordBatch:
            a, b = compare(np.column_stack(rows[:3]), rows[3], rows[4], max_distance)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            if held:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
            # The last cell may go on in the next batch; a cell's rows are bounded.
            same = np.ones(len(rows[0]), bool)
            for key in rows[:3]:
                same &= key == key[-1]
            whole = len(same) - int(same.sum())
            yield part([r[:whole] for r in rows])
            held = [r[whole:] for r in rows]
        if held:
            yield part(held)

    return dealt.mapInArrow(run, "a long, b long")


def classes(prints: DataFrame, **settings) -> DataFrame:
    """From ``_id, fingerprint``: one row per fingerprint with its ``component_id``, the smallest id reachable."""
    unique = cut(prints.groupBy("fingerprint").agg(F.min("_id").alias("_least")))
    roots = connected(links(unique.select("fingerprint"), **settings))
    rooted = unique.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    return rooted.join(least, "root").select("fingerprint", "component_id")


def near_duplicates(rows: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, **settings) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row; the fingerprint as 16 hexadecimal digits."""
    given = rows.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    prints = cut(fingerprints(given, "_text", size=size).select("_id", "fingerprint"))
    found = prints.join(classes(prints, **settings), "fingerprint")
    return found.select(F.col("_id").alias(doc_id), as_hex("fingerprint").alias("fingerprint"), "component_id")


def keep_one(rows: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, **settings) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id; among rows of one id, that of the smallest row hash.

    Only ids, hashes and fingerprints are grouped; texts are read again for the final semi-join.
    """
    names = [F.col(f"`{c}`") for c in rows.columns]
    mark = free_name("_row_hash", rows.columns)
    marked = rows.withColumn(mark, F.xxhash64(*names))
    given = marked.select(F.col(f"`{doc_id}`").alias("_id"), F.col(mark).alias("_hash"), F.col(f"`{text}`").alias("_text"))
    prints = cut(fingerprints(given, "_text", size=size).select("_id", "_hash", "fingerprint"))
    unique = cut(
        prints.groupBy("fingerprint").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash")).alias("_best"))
    )
    roots = connected(links(unique.select("fingerprint"), **settings)).withColumnRenamed("node", "fingerprint")
    rooted = unique.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    best = rooted.groupBy("root").agg(F.min("_best").alias("_best")).select("_best._id", "_best._hash")
    times = prints.groupBy("_hash").agg(F.count("*").alias("_times"))
    own = {c: free_name(c, [*rows.columns, mark]) for c in ("_best_hash", "_best_id", "_times")}
    chosen = best.join(times, "_hash").select(F.col("_hash").alias(own["_best_hash"]), F.col("_id").alias(own["_best_id"]), F.col("_times").alias(own["_times"]))
    kept = marked.join(chosen, (F.col(mark) == F.col(own["_best_hash"])) & F.col(f"`{doc_id}`").eqNullSafe(F.col(own["_best_id"])))
    single = kept.where(F.col(own["_times"]) == 1).select(*names)
    # Rows equal in every column are in one group: one of them stays.
    repeated = kept.where(F.col(own["_times"]) > 1).dropDuplicates([mark]).select(*names)
    return single.unionByName(repeated)
