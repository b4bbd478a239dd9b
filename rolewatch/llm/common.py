"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ensure_checkpoint_dir

#: Words of a text: runs of anything but ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Bytes of a column that are turned into Python objects at once, unless one row alone has more.
SLICE_BYTES = 4 << 20
SLICE_ROWS = 2048
#: Bytes that a worker's store of recent values may hold, and what an entry takes besides its own bytes.
STORE_BYTES = 24 << 20
ENTRY_BYTES = 200
#: Places in which a store marks the keys it missed, a byte each; it starts anew when half are marked.
MISSED_PLACES = 1 << 21
#: A value by a longer key is computed each time and not stored.
STORED_LENGTH = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(rows: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()


def stored(rows: DataFrame) -> DataFrame:
    """The rows as written to a table in the shared checkpoint folder, for rows that are dear to compute and read more than once."""
    ensure_checkpoint_dir(rows.sparkSession)
    path = f"{rows.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, or ``wanted`` with underscores before it where a column has that name in any case."""
    used = {name.lower() for name in taken}
    while wanted.lower() in used:
        wanted = f"_{wanted}"
    return wanted


class Recent(dict):
    """Values by key, computed when missed; recent ones are held, up to ``limit`` bytes.

    With ``repeated``, a value is held only once its key was missed before, so that keys seen once push out none that come again.
    """

    def __init__(self, compute: Callable | None = None, limit: int = STORE_BYTES, repeated: bool = False):
        # The older half stays readable until the younger one is full.
        self.compute, self.limit, self.used, self.older = compute, limit // 2, 0, {}
        self.missed, self.marked = (bytearray(MISSED_PLACES) if repeated else None), 0

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
            if self.missed is not None and self.first_miss(key):
                return value
        self.hold(key, value)
        return value

    def first_miss(self, key: str) -> bool:
        """Whether the key was not missed of late; another key at its place counts as the key."""
        place = hash(key) % MISSED_PLACES
        if self.missed[place]:
            return False
        if self.marked >= MISSED_PLACES // 2:
            self.missed, self.marked = bytearray(MISSED_PLACES), 0
        self.missed[place] = 1
        self.marked += 1
        return True

    def hold(self, key: str, value) -> None:
        if len(key) > STORED_LENGTH:
            return
        self.make_room()
        self[key] = value
        self.used += ENTRY_BYTES + len(key) + (len(value) if isinstance(value, bytes) else 0)

    def make_room(self) -> None:
        if self.used >= self.limit:
            self.older = dict(self)
            self.clear()
            self.used = 0


_kept: dict[str, object] = {}


def kept_by_worker(owner: str, key, make: Callable):
    """What a worker process keeps from task to task: one thing of one operator.

    Workers serve all stages of a job, so what another operator left is dropped before the next one fills its own.
    """
    if _kept.get("owner") != owner or (_kept["key"] is not key and (not isinstance(key, bytes) or _kept["key"] != key)):
        _kept.clear()
        gc.collect()
        _kept.update(owner=owner, key=key, value=make())
    return _kept["value"]


def byte_sizes(column: pa.Array) -> np.ndarray:
    """About how many bytes each row of a column has."""
    if pa.types.is_struct(column.type):
        return sum((byte_sizes(column.field(n)) for n in range(column.type.num_fields)), np.zeros(len(column), np.int64))
    if pa.types.is_list(column.type):
        return 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.full(len(column), 8, np.int64)


def slices(column: pa.Array, most: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """Where to cut a column so that each part has at most ``most`` bytes, or is one row."""
    upto = np.cumsum(byte_sizes(column))
    start = 0
    while start < len(upto):
        done = upto[start - 1] if start else 0
        end = min(start + most_rows, max(start + 1, int(np.searchsorted(upto, done + most, "right"))))
        yield start, end
        start = end


def with_computed(
    rows: DataFrame, source: str, made: dict[str, T.DataType], work: Callable[[], Callable[[pa.Array], list]]
) -> DataFrame:
    """Add columns computed from one column, in Python workers, by parts of a batch of a few MB.

    ``work()`` runs once per task and gives a function from the Arrow column of a part to one list or
    Arrow array per new column.  A column of ``rows`` with the name of a new one is replaced; all others pass unchanged.
    """
    replaced = {name.lower() for name in made}
    kept = [f for f in rows.schema.fields if f.name.lower() not in replaced]
    taken = free_name("_computed_from", [*rows.columns, *made])
    given = rows.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{source}`").alias(taken))
    arrow = {name: to_arrow_type(kind) for name, kind in made.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = None
        for batch in batches:
            apply = apply or work()
            for start, end in slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(start, end - start)
                new = apply(part.column(part.num_columns - 1))
                columns = [v if isinstance(v, pa.Array) else pa.array(v, kind) for v, kind in zip(new, arrow.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*part.schema.names[:-1], *arrow])

    schema = T.StructType([*kept, *[T.StructField(name, kind) for name, kind in made.items()]])
    return given.mapInArrow(run, schema)


def list_array(parts: list[np.ndarray], kind: type = np.int32) -> pa.Array:
    """An Arrow column of lists from one array per row."""
    ends = np.cumsum([0, *[len(p) for p in parts]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, kind), *parts])))


def lists_of(column: pa.Array) -> Iterator[np.ndarray]:
    """One array per row of an Arrow column of lists; a null row is an empty one."""
    values, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()  # both as of the whole batch
    for start, end, known in zip(edges[:-1], edges[1:], column.is_valid().to_numpy(zero_copy_only=False), strict=True):
        yield values[start:end] if known else values[:0]


def held_out(doc_id: Column | str) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def fold(doc_id: Column | str) -> Column:
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(key.cast("string").cast("binary")) % 5
