"""Removal of repeated passages by super-k-mers of words.

A window is ``size`` consecutive words of one document.  Its minimiser is the least hash of the ``PART`` -word sequences in it.
Consecutive windows that share a minimiser travel as one packed string, a super-k-mer, to the bucket of that
minimiser; equal windows have equal minimisers and so meet there.  In a bucket the windows are sorted by hash, and those of one hash
compared word for word; every one but that of the smallest place (id, text, start) is a repeat.

A first pass counts the bytes that go to each slot of minimisers, which gives the number of buckets.  What a slot has
beyond a bucket's size, as for a passage that a third of all documents share, is dealt out by document over many
buckets.  This loses nothing: whatever part of the places of a window meets, all but the first of the part are repeats.
The first ones of a slot that is dealt out, and of a bucket that is worked off in several loads, go on as single windows, and are sorted by
their words.  So no task holds more than one load, whatever the sizes of slots and buckets.

Results: a null text has no words; ids are whole numbers, and a null id counts as the largest one.  Rows of one id are
ordered by a hash of their texts; rows equal in id and text are one document, repeated as often as given.  A text shorter than a window
loses nothing.  An empty table gives an empty one.  Other columns pass, but for ``n_words``, ``n_removed`` and ``kept``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, slices, with_computed

SIZE = 20
#: Words of the sequences whose least hash is a window's minimiser.
PART = 3
#: Leading bits of a minimiser that name its slot.
SLOT_BITS = 18
#: Bytes of packed text that a task works on at once.
LOAD_BYTES = 24 << 20
#: Bytes of text that a task packs at once.
PACKED_BYTES = 16 << 20
#: A slot with over this share of all bytes is dealt out, so at most this many slots are, and their list is small.
SLOT_SHARE = 1 << 14
#: Windows of one super-k-mer at most.
MOST_WINDOWS = 256
LAST_ID = (1 << 63) - 1
PLACE = "id long, mark long, start int, n int"


def mixed(values: np.ndarray) -> np.ndarray:
    """Hashes made even: shifts and a multiplication without carry beyond 64 bits."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def joint_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    count = len(hashes) - size + 1
    total = np.zeros(max(count, 0), np.uint64)
    if count > 0:
        for n in range(size):
            total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[n : n + count]
    return mixed(total)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def super_kmers(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each run of windows with one minimiser."""
    if len(words) < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    part = min(PART, size)
    least = sliding_least(joint_hashes(word_hashes(words), part), size - part + 1)
    edges = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
    counts = np.diff(edges)
    if counts.max() > MOST_WINDOWS:
        edges = np.concatenate([*[np.arange(a, b, MOST_WINDOWS) for a, b in zip(edges[:-1], edges[1:], strict=True)], [len(least)]])
        counts = np.diff(edges)
    return least[edges[:-1]], edges[:-1], counts


def edges_of(words: list[bytes]) -> np.ndarray:
    """Where each word begins in the words joined by blanks, and, last, one beyond the end."""
    return np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])


def slot_bytes(given: DataFrame, size: int) -> DataFrame:
    """``slot, bytes``: packed bytes of all super-k-mers, by slot; each task sends a slot at most once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            column = batch.column(2)
            for start, end in slices(column):
                for text in column.slice(start, end - start).to_pylist():
                    words = text.encode().split()
                    least, first, count = super_kmers(words, size)
                    edges = edges_of(words)
                    np.add.at(totals, (least >> np.uint64(64 - SLOT_BITS)).astype(np.int64), edges[first + count + size - 1] - edges[first])
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[used])], names=["slot", "bytes"])

    return given.mapInArrow(run, "slot int, bytes long").groupBy("slot").agg(F.sum("bytes").alias("bytes"))


def packed_rows(parts: list[tuple], buckets: int, shares: np.ndarray, size: int) -> Iterator[tuple[int, int, bytes]]:
    """Bucket, unpacked size and packed content of what some documents send to each bucket.

    A part is a document's ``id, mark, words``.  The content is two counts, then a row per document, a row per super-k-mer, and their text.
    """
    docs, least, first, count, texts = [], [], [], [], []
    for n, (_, _, words) in enumerate(parts):
        a, b, c = super_kmers(words, size)
        docs.append(np.full(len(a), n))
        least.append(a)
        first.append(b)
        count.append(c)
        edges, joined = edges_of(words), b" ".join(words)
        texts += [joined[x:y] for x, y in zip(edges[b].tolist(), (edges[b + c + size - 1] - 1).tolist(), strict=True)]
    if not texts:
        return
    docs, least, first, count = (np.concatenate(x) for x in (docs, least, first, count))
    ids, marks = (np.array([p[n] for p in parts], np.int64) for n in (0, 1))
    dealt = shares[(least >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    own = mixed((ids.astype(np.uint64) * np.uint64(3) + marks.astype(np.uint64))[docs] + first.astype(np.uint64) * np.uint64(7))
    salt = own % np.maximum(dealt, 1).astype(np.uint64)
    bucket = (mixed(least + salt * np.uint64(0xA24BAED4963EE407)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        mine, times = np.unique(docs[group], return_counts=True)
        table = np.concatenate([[len(mine), len(group)], ids[mine], marks[mine], times, first[group], count[group], dealt[group] > 0])
        content = table.astype(np.int64).tobytes() + b" ".join([texts[n] for n in group.tolist()])
        yield int(bucket[group[0]]), len(content), pa.compress(content, codec="zstd", asbytes=True)


def pack(given: DataFrame, buckets: int, dealt_out: dict[int, int], size: int) -> DataFrame:
    """``bucket, bytes, packed``: the super-k-mers of all documents, by bucket."""
    sent = given.sparkSession.sparkContext.broadcast(dealt_out)  # at most SLOT_SHARE slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = np.zeros(1 << SLOT_BITS, np.int64)
        shares[list(sent.value)] = list(sent.value.values())
        held: dict[tuple[int, int], list[bytes]] = {}
        used = 0

        def out() -> pa.RecordBatch:
            rows = list(packed_rows([(*k, w) for k, w in held.items()], buckets, shares, size))
            held.clear()
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            kinds = (pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "bytes", "packed"])

        for batch in batches:
            for start, end in slices(batch.column(2)):
                for i, mark, text in zip(*[c.to_pylist() for c in batch.slice(start, end - start).columns], strict=True):
                    held[i, mark] = text.encode().split()  # equal rows are one document
                    used += len(text)
                    if used >= PACKED_BYTES:
                        yield out()
                        used = 0
        yield out()

    return given.mapInArrow(run, "bucket int, bytes int, packed binary")


class Load:
    """Super-k-mers that one task compares at once."""

    def __init__(self, contents: list[bytes], size: int):
        ids, marks, first, count, dealt, texts = [], [], [], [], [], []
        for content in contents:
            n_docs, n = np.frombuffer(content, np.int64, 2).tolist()
            table = np.frombuffer(content, np.int64, 2 + 3 * n_docs + 3 * n)
            docs, rows = table[2 : 2 + 3 * n_docs].reshape(3, n_docs), table[2 + 3 * n_docs :].reshape(3, n)
            ids.append(np.repeat(docs[0], docs[2]))
            marks.append(np.repeat(docs[1], docs[2]))
            first.append(rows[0])
            count.append(rows[1])
            dealt.append(rows[2])
            texts.append(content[table.nbytes :])
        self.size, self.text = size, b" ".join(texts)
        ids, marks, first, count, dealt = (np.concatenate(x) for x in (ids, marks, first, count, dealt))
        words = self.text.split(b" ")
        self.edges = edges_of(words)
        hashes = joint_hashes(word_hashes(words), size)
        del words
        at = np.cumsum(count + size - 1) - (count + size - 1)
        # Windows in the order of their places: that of their super-k-mers, then along each of these.
        order = np.lexsort((first, marks, ids))
        count, self.row = count[order], np.repeat(order, count[order])
        along = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.word = at[self.row] + along
        self.hash = hashes[self.word]
        self.start = first[self.row] + along
        self.id, self.mark, self.dealt = ids[self.row], marks[self.row], dealt[self.row] > 0

    def window(self, n: int) -> bytes:
        word = self.word[n]
        return self.text[self.edges[word] : self.edges[word + self.size] - 1]

    def firsts(self) -> np.ndarray:
        """For each window, the first window with its words."""
        order = np.argsort(self.hash, kind="stable")
        ranked = self.hash[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        first = np.empty(len(order), np.int64)
        first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        # Sorted by hash, then compared word for word.
        text, word = self.text, self.word
        begin, end = self.edges[word], self.edges[word + self.size] - 1
        met = np.flatnonzero(first != np.arange(len(first)))
        other = first[met]
        lists = (x.tolist() for x in (begin[met], end[met], begin[other], end[other]))
        same = np.fromiter((text[a:b] == text[c:d] for a, b, c, d in zip(*lists, strict=True)), bool, len(met))
        if not same.all():
            for value in np.unique(self.hash[met[~same]]):
                known: dict[bytes, int] = {}
                for n in np.flatnonzero(self.hash == value).tolist():
                    first[n] = known.setdefault(self.window(n), n)
        return first

    def found(self, on: bool) -> list[np.ndarray]:
        """Repeats as runs of ``id, mark, start, n``, and the windows to go ``on``: all first ones, or those dealt out."""
        first = self.firsts()
        alone = first == np.arange(len(first))
        again = ~alone & ((self.id != self.id[first]) | (self.mark != self.mark[first]) | (self.start != self.start[first]))
        at = np.flatnonzero(again)
        next_ = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(self.row[at]) != 0)]) if len(at) else np.empty(0, bool)
        begin = np.flatnonzero(next_)
        runs, lengths = at[begin], np.diff(np.concatenate([begin, [len(at)]]))
        going = np.flatnonzero(alone & (self.dealt | on))
        return [runs, lengths, going]

    def rows(self, on: bool) -> pa.RecordBatch:
        runs, lengths, going = self.found(on)
        places = np.concatenate([runs, going])
        windows = [*[None] * len(runs), *map(self.window, going.tolist())]
        columns = [pa.array(self.id[places]), pa.array(self.mark[places]), pa.array(self.start[places].astype(np.int32)), pa.array(np.concatenate([lengths, np.ones(len(going), np.int64)]).astype(np.int32)), pa.array(windows, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "mark", "start", "n", "window"])


def compare_buckets(packed: DataFrame, buckets: int, size: int, load_bytes: int) -> DataFrame:
    """``id, mark, start, n, window``: runs of repeats, and, with their words, the windows that are compared once more."""
    dealt = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, used, several = None, [], 0, False
        for batch in batches:
            for bucket, count, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if held and (bucket != now or used + count > load_bytes):
                    several = several or bucket == now
                    yield Load(held, size).rows(several)
                    held, used = [], 0
                if bucket != now:
                    now, several = bucket, False
                held.append(pa.decompress(packed.as_buffer(), count, codec="zstd", asbytes=True))
                used += count
        if held:
            yield Load(held, size).rows(several)

    return dealt.mapInArrow(run, f"{PLACE}, window binary")


def compare_windows(windows: DataFrame) -> DataFrame:
    """Repeats among windows of which not all places have met yet: sorted by their words, each is compared with the one before."""
    keys = ["window", "id", "mark", "start"]
    dealt = windows.select(*keys).repartition(F.xxhash64("window")).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = None, None
        for batch in batches:
            rows = list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
            again = []
            for window, *at in rows:
                if window != known:
                    known, place = window, at
                elif at != place:
                    again.append((*at, 1))
            columns = zip(*again, strict=True) if again else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "mark", "start", "n"])

    return dealt.mapInArrow(run, PLACE)


def repeats(given: DataFrame, size: int = SIZE, load_bytes: int = LOAD_BYTES) -> DataFrame:
    """``id, mark, start, n``: runs of windows whose words also start at a smaller place, from ``id, mark, text``."""
    sums = cut(slot_bytes(given, size))
    total = sums.agg(F.sum("bytes")).first()[0] or 0
    most = max(total / SLOT_SHARE, load_bytes / 4)
    crowded = sums.where(F.col("bytes") > most).collect()  # at most SLOT_SHARE rows
    dealt_out = {r["slot"]: int(-(-r["bytes"] // max(1, load_bytes // 4))) for r in crowded}
    buckets = max(1, -(-2 * total // load_bytes))
    found = cut(compare_buckets(pack(given, buckets, dealt_out, size), buckets, size, load_bytes))
    places = ["id", "mark", "start", "n"]
    return found.where(F.col("window").isNull()).select(*places).unionByName(compare_windows(found.where(F.col("window").isNotNull())))


def kept_words(text: str | None, runs: list, size: int) -> tuple[int, int, str]:
    """Number of words, of those covered by a run of windows, and the text of the others."""
    words = (text or "").encode().split()
    if not runs:
        return len(words), 0, b" ".join(words).decode()
    turns = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        turns[run["start"]] += 1
        turns[run["start"] + run["n"] + size - 1] -= 1
    gone = np.cumsum(turns[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x]).decode()


NEW = ["n_words", "n_removed", "kept"]


def place_of(doc_id: Column, text: Column) -> list[Column]:
    """What orders documents: the id, null last, and a hash of the text."""
    return [F.coalesce(doc_id.cast("long"), F.lit(LAST_ID)), F.xxhash64(F.coalesce(text, F.lit("")))]


def remove_repeats(rows: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, load_bytes: int = LOAD_BYTES) -> DataFrame:
    """Add ``n_words``, ``n_removed`` and ``kept``: the words left, joined by one blank, of every whole text."""
    others = [c for c in rows.columns if c.lower() not in NEW]
    own = {c: free_name(c, [*others, *NEW]) for c in ("_id", "_mark", "_runs", "_of_id", "_of_mark", "_found")}
    body = F.col(f"`{text}`").cast("string")
    i, mark = place_of(F.col(f"`{doc_id}`"), body)
    given = rows.where(body.isNotNull()).select(i.alias("id"), mark.alias("mark"), body.alias("text"))
    runs = repeats(given, size, load_bytes).groupBy(F.col("id").alias(own["_of_id"]), F.col("mark").alias(own["_of_mark"]))
    runs = runs.agg(F.collect_list(F.struct("start", "n")).alias(own["_runs"]))  # no more than the windows of a document
    marked = rows.select(*[F.col(f"`{c}`") for c in others], i.alias(own["_id"]), mark.alias(own["_mark"]))
    same = (F.col(own["_id"]) == F.col(own["_of_id"])) & (F.col(own["_mark"]) == F.col(own["_of_mark"]))
    joined = marked.join(runs, same, "left")
    names = [F.col(f"`{c}`") for c in others]
    joined = joined.select(*names, F.struct(body.alias("text"), F.col(own["_runs"]).alias("runs")).alias(own["_found"]))
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def apply(column: pa.Array) -> list:
        found = [kept_words(t, r, size) for t, r in zip(column.field("text").to_pylist(), column.field("runs").to_pylist(), strict=True)]
        parts = zip(*found, strict=True) if found else ((), (), ())
        arrays = [pa.array(p, k) for p, k in zip(parts, (pa.int64(), pa.int64(), pa.string()), strict=True)]
        return [pa.StructArray.from_arrays(arrays, names=NEW)]

    done = with_computed(joined, own["_found"], {own["_found"]: kind}, lambda: apply)
    return done.select(*names, *[F.col(own["_found"])[c].alias(c) for c in NEW])
