"""Posting records of linked-data blocks, with VARIANT functions only.

A block is parsed once.  Its arrays and ``@graph`` members are opened level by level within the row: each level looks only at what the
level before it has opened, and there are no more levels than brackets in the block, so nesting of any depth is followed.
Records carry the path that leads to them, which puts them in document order at the end.

A block that is not one JSON value is ignored.  The parser takes up to 1,000 nested brackets; a block with more counts as invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ATTRS, RAW_ELEMENTS, joined, let, lit_true, null_if_blank, text_or_empty, trim_text

_ELEMENT = rf"(?is)<!--.*?-->|<({RAW_ELEMENTS})(?=[\s/>]){ATTRS}>.*?</\1\s*>"
_OPENING = rf"""(?is)^<script(?=[\s/>])(?=[^>]*\stype\s*=\s*["']?application/ld\+json["'\s>]){ATTRS}>"""
_CLOSING = r"(?is)</script\s*>\z"
#: Escapes of half a surrogate pair, which are legal JSON but no characters.
_LONE_HIGH = r"(?i)((?<!\\)(?:\\\\)*+)\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})"
_LONE_LOW = r"(?i)((?<!\\)(?:\\\\)*+)(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2}"
_RECORD = "struct<path:array<int>,title:string,url:string,description:string,raw_type:string,locations:array<string>>"
_OPEN = "array<struct<path:array<int>,node:variant>>"


def allow_repeated_names(spark: SparkSession) -> None:
    """A name given twice in an object is legal JSON, and its last value counts; by default the parser calls it an error."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def linked_data_blocks(html: Column) -> Column:
    """The text of every linked-data script of a page, in order; none from comments or from elements whose content is text."""
    elements = F.regexp_extract_all(html, F.lit(_ELEMENT), F.lit(0))
    scripts = F.filter(elements, lambda e: e.rlike(_OPENING))
    blocks = F.transform(scripts, lambda e: F.regexp_replace(F.regexp_replace(e, _OPENING, ""), _CLOSING, ""))
    return F.when(html.rlike(r"(?i)application/ld\+json"), blocks).otherwise(F.array().cast("array<string>"))


def _whole(block: Column) -> Column:
    """A block without halves of surrogate pairs."""
    mended = F.regexp_replace(F.regexp_replace(block, _LONE_HIGH, r"$1\\uFFFD"), _LONE_LOW, r"$1\\uFFFD")
    return F.when(block.rlike(r"(?i)\\ud[89a-f]"), mended).otherwise(block)


def _member(node: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(node, f'$["{name}"]', kind)


def _items(value: Column) -> Column:
    """The items of an array; anything else is the only item."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))


def _string(value: Column) -> Column:
    """A string as it is; NULL for values of other types."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _text(node: Column, name: str) -> Column:
    return let(_member(node, name), lambda v: text_or_empty(trim_text(_string(v))))


def _place(entry: Column) -> Column:
    parts = [_text(_member(entry, "address"), key) for key in ("addressLocality", "addressRegion", "addressCountry")]
    return joined(F.array(*parts), ", ")


def _is_posting(node: Column) -> Column:
    types = _items(_member(node, "@type"))
    return lit_true(F.exists(types, lambda t: lit_true(_string(t) == "JobPosting")))


def _record(entry: Column) -> Column:
    node = entry["node"]
    places = F.transform(_items(_member(node, "jobLocation")), _place)
    return F.struct(
        entry["path"].alias("path"),
        F.coalesce(null_if_blank(_text(node, "title")), _text(node, "name")).alias("title"),
        _text(node, "url").alias("url"),
        _text(node, "description").alias("description"),
        _text(node, "employmentType").alias("raw_type"),
        F.filter(places, lambda p: p != "").alias("locations"),
    )


def _opened(entry: Column) -> Column:
    """What lies one level below a value: the items of an array, or the graph of an object."""

    def below(items: Column) -> Column:
        return F.transform(items, lambda item, n: F.struct(F.concat(entry["path"], F.array(n)).alias("path"), item.alias("node")))

    graph = _member(entry["node"], "@graph")
    return F.coalesce(
        below(F.try_variant_get(entry["node"], "$", "array<variant>")),
        F.when(graph.isNotNull(), below(F.array(graph))),
        F.array().cast(_OPEN),
    )


def _records_of(block: Column) -> Column:
    # Inside an array, so that text after the value is an error.
    parsed = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"x":['), _whole(block), F.lit("]}"))), "$.x", "array<variant>")
    top = F.when(F.size(parsed) == 1, F.transform(parsed, lambda v: F.struct(F.array().cast("array<int>").alias("path"), v.alias("node"))))
    levels = F.sequence(F.lit(0), F.regexp_count(block, F.lit(r"[\[{]")))
    start = F.struct(F.coalesce(top, F.array().cast(_OPEN)).alias("open"), F.array().cast(f"array<{_RECORD}>").alias("found"))

    def step(state: Column, _: Column) -> Column:
        found = F.transform(F.filter(state["open"], lambda e: _is_posting(e["node"])), _record)
        return F.struct(F.flatten(F.transform(state["open"], _opened)).alias("open"), F.concat(state["found"], found).alias("found"))

    return F.array_sort(F.aggregate(levels, start, step)["found"])


def linked_data_records(blocks: Column) -> Column:
    """``title, url, description, raw_type, locations`` of every posting in the blocks, in document order."""
    return F.flatten(F.transform(blocks, _records_of))
