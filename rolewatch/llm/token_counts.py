"""Token counts by section, from one encoding of the whole document.

A document is encoded once.  Each token has a span of characters: from the character that holds its first byte to
the one that holds its last.  The spans are joined to the document's sections as intervals, by binary search, as both are
in order.  A token that touches several sections goes, by ``rule``, to the one with most of its characters, the earlier of
equals ("most"), to the one with its first character ("first"), or to the one with its last ("last").

Counts of a section add up to what the document has as a whole, which encoding each section by itself does not give.  Nothing is
shuffled: spans and sections of a document are in one row.

Results: sections default to lines, each with its line feed; given ones are taken in order of their start, and one that
reaches into the next ends there; tokens outside all sections count for section -1, given only if there are any.  A null or empty text has
one empty section 0, with no token.  Repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Vocabulary, default_vocabulary, file_content, vocabulary_of
from .common import free_name, with_computed

RULES = ("most", "first", "last")
RESULT = T.ArrayType(
    T.StructType(
        [
            T.StructField("section", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_crossing", T.LongType()),
        ]
    )
)


def token_spans(coder: Vocabulary, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last, for each token of the text."""
    ids = coder.encode(text).astype(np.int64)
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(coder.offsets[ids + 1] - coder.offsets[ids])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return character[starts], character[ends - 1] + 1


def line_edges(text: str) -> np.ndarray:
    """Edges of the lines of a text, each line with its line feed."""
    lengths = [len(line) + 1 for line in text.split("\n")]
    edges = np.cumsum([0, *lengths])
    edges[-1] = len(text)
    return edges if len(edges) < 3 or edges[-1] > edges[-2] else edges[:-1]


def attribute(
    starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str = "most"
) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1: none), and whether it crosses an edge; sections in order, without overlap."""
    first = np.searchsorted(high, starts, "right")
    last = np.searchsorted(low, ends, "left") - 1
    section = np.where(last < first, -1, last if rule == "last" else first)
    crossing = last > first
    if rule == "most":
        for n in np.flatnonzero(crossing):
            a, b = first[n], last[n]
            shared = np.minimum(ends[n], high[a : b + 1]) - np.maximum(starts[n], low[a : b + 1])
            section[n] = a + int(np.argmax(shared))
    return section, crossing


def counts_of(coder: Vocabulary, text: str | None, given: list | None, rule: str) -> list[tuple[int, int, int, int, int]]:
    text = text or ""
    if given:
        order = sorted((max(0, s["start"]), min(len(text), s["end"]), n) for n, s in enumerate(given) if s and s["start"] is not None and s["end"] is not None)
        low = np.array([a for a, _, _ in order], np.int64)
        high = np.array([b for _, b, _ in order], np.int64)
        high = np.maximum(low, np.minimum(high, np.concatenate([low[1:], [len(text)]]) if len(low) else high))
        names = [n for _, _, n in order]
    else:
        edges = line_edges(text)
        low, high, names = edges[:-1], edges[1:], range(len(edges) - 1)
    if not text:
        return [(n, int(a), int(b), 0, 0) for n, a, b in zip(names, low, high, strict=True)]
    full = high > low  # an empty section holds no token
    section, crossing = attribute(*token_spans(coder, text), low[full], high[full], rule)
    places = np.flatnonzero(full)
    tokens, crossed = np.zeros(len(low) + 1, np.int64), np.zeros(len(low) + 1, np.int64)
    where = np.where(section >= 0, places[section] if len(places) else 0, len(low))
    np.add.at(tokens, where, 1)
    np.add.at(crossed, where, crossing.astype(np.int64))
    rows = [(n, int(a), int(b), int(t), int(c)) for n, a, b, t, c in zip(names, low, high, tokens, crossed, strict=False)]
    return rows + ([(-1, 0, len(text), int(tokens[-1]), 0)] if tokens[-1] else [])


def token_counts(
    rows: DataFrame, text: str = "text", sections: str | None = None, rule: str = "most", vocabulary: str | None = None
) -> DataFrame:
    """One row per section: the other columns of ``rows`` with ``section, start, end, n_tokens, n_crossing``.

    ``sections`` names a column of arrays of structs with ``start`` and ``end`` in characters; without it, lines are the sections.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    content = rows.sparkSession.sparkContext.broadcast(file_content(vocabulary or default_vocabulary()))
    names = [f.name for f in RESULT.elementType.fields]
    kept = [c for c in rows.columns if c.lower() not in (text.lower(), (sections or text).lower(), *names)]
    own = free_name("_sections", kept)
    column = F.col(f"`{sections}`") if sections else F.lit(None).cast("array<struct<start:int,end:int>>")
    given = rows.select(*[F.col(f"`{c}`") for c in kept], F.struct(F.col(f"`{text}`").cast("string").alias("text"), column.alias("given")).alias(own))

    def work():
        coder = vocabulary_of(content.value)

        def apply(column: pa.Array) -> list:
            found = [counts_of(coder, t, s, rule) for t, s in zip(column.field("text").to_pylist(), column.field("given").to_pylist(), strict=True)]
            flat = [row for rows in found for row in rows]
            parts = [pa.array(v, kind) for v, kind in zip(zip(*flat, strict=True) if flat else [()] * 5, [pa.int32()] * 3 + [pa.int64()] * 2, strict=True)]
            edges = np.cumsum([0, *map(len, found)])
            return [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(parts, names=names))]

        return apply

    counted = with_computed(given, own, {own: RESULT}, work)
    return counted.select(*[F.col(f"`{c}`") for c in kept], F.inline(own))
