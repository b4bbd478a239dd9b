"""Text helpers with ECMAScript string semantics, written as Spark column expressions."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from html.entities import html5

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as ECMAScript defines it; Java's ``\s`` knows the ASCII part only.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

# ASCII word boundary.  Java 17's ``\b`` follows Unicode letters, ``\w`` does not.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

# The same boundary where the neighbour inside the pattern is known to be a word character.
START, END = r"(?<!\w)", r"(?!\w)"

# Any character but a line terminator.
ANY = r"[^\n\r\u2028\u2029]"

# The inside of an opening tag.  Possessive, so long attributes cannot overflow the matcher.
# A quote opens a value only directly after an equals sign; elsewhere it is a character like any other.
ATTRS = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""

RAW_ELEMENTS = "script|style|noscript|textarea|iframe|xmp|noembed|noframes"

# Character references.  Old names work without a semicolon, in attributes only at a word's end.
_OLD_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
_ENTITY = rf"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{_OLD_NAMES}))"
_GAP = "\uFDD0"  # a code point reserved for internal use
_ATTRIBUTE_ENTITY = _ENTITY[:-1] + r"(?![=A-Za-z0-9]))"


def reused(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the expression a function builds from column names and constants.

    Describing a large expression takes thousands of calls into the JVM, far longer than planning it.
    A column is an immutable description, so queries and micro-batches of one application can share it.
    """
    built: dict[tuple, Column] = {}

    @functools.wraps(build)
    def shared(*args):
        key = (SparkContext.getOrCreate().applicationId, *args)
        if key not in built:
            built[key] = build(*args)
        return built[key]

    return shared


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and name it inside ``body``.

    Columns are trees: a value used three times is copied three times, and nested helpers would
    multiply those copies.  Binding it to a lambda variable keeps the expression linear in size.
    """
    return F.transform(F.array(value), body).getItem(0)


def lit_true(condition: Column) -> Column:
    """A predicate that is never NULL."""
    return F.coalesce(condition, F.lit(False))


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def trim_text(value: Column) -> Column:
    return F.regexp_replace(value, rf"^{SPACE}+|{SPACE}+\z", "")


def collapse(value: Column) -> Column:
    """Runs of whitespace become one space, outer whitespace goes."""
    return F.trim(F.regexp_replace(value, f"{SPACE}+", " "))


def null_if_blank(value: Column) -> Column:
    return F.when(value != "", value)


def joined(parts: Column, separator: str) -> Column:
    """Array of strings as one string, blanks and NULLs left out."""
    return F.array_join(F.filter(parts, lambda p: lit_true(p != "")), separator)


def split_trim(value: Column, pattern: str) -> Column:
    """Split, trim every piece, drop empty pieces."""
    pieces = F.transform(F.split(text_or_empty(value), pattern), lambda p: trim_text(p))
    return F.filter(pieces, lambda p: p != "")


def unique_texts(values: Column, trim: bool = True) -> Column:
    """Non-blank strings of an array in first-seen order."""
    kept = F.filter(values, lambda v: lit_true(trim_text(v) != ""))
    if trim:
        kept = F.transform(kept, lambda v: trim_text(v))
    return F.array_distinct(kept)


def escape_pattern(value: Column) -> Column:
    """Escape a literal for use inside a regular expression."""
    return F.regexp_replace(value, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def unescape_json(value: Column) -> Column:
    """Decode one JSON string literal (quotes included); NULL when it is not valid JSON."""
    wrapped = F.concat(F.lit("["), value, F.lit("]"))
    return F.try_element_at(F.from_json(wrapped, "array<string>"), F.lit(1))


def _named_entities() -> Column:
    """Map literal of entity names; one JSON constant is cheaper to plan than hundreds of literals."""
    names = {name.removesuffix(";"): text for name, text in html5.items()}
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _c1_overrides() -> dict[int, str]:
    """Numeric references 128-159 mean windows-1252 characters in HTML."""
    table = {}
    for code in range(128, 160):
        try:
            table[code] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            continue
    return table


def _decode_entity(entity: Column) -> Column:
    overrides = F.create_map(*[F.lit(x) for pair in _c1_overrides().items() for x in pair])

    def character(number: Column) -> Column:
        is_character = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        encoded = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.coalesce(
            F.try_element_at(overrides, number.try_cast("int")),
            F.when(is_character, encoded),
            F.lit("\uFFFD"),
        )

    def decoded(name: Column) -> Column:
        digits = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(
            F.substr(name, F.lit(2))
        )
        return (
            F.when(name == "amp", F.lit("&"))
            .when(name == "lt", F.lit("<"))
            .when(name == "gt", F.lit(">"))
            .when(name == "quot", F.lit('"'))
            .when(name.startswith("#"), let(digits.try_cast("bigint"), character))
            .otherwise(F.coalesce(F.try_element_at(_named_entities(), name), entity))
        )

    return let(F.regexp_replace(entity, r"^&|;\z", ""), decoded)


def unescape_html(value: Column, entity: str = _ENTITY) -> Column:
    """Decode character references in a single left-to-right pass."""

    def decoded(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(entity), F.lit(0))
        # Splitting compiles its pattern per row unless it is a single plain character.
        gaps = F.split(F.regexp_replace(text, entity, _GAP), _GAP, -1)
        pieces = F.zip_with(
            gaps,
            F.transform(found, _decode_entity),
            lambda gap, character: F.concat(gap, text_or_empty(character)),
        )
        return F.when(text.rlike(entity), F.array_join(pieces, "")).otherwise(text)

    return let(F.replace(value, F.lit(_GAP), F.lit("\uFFFD")), decoded)


def drop_tags(markup: Column) -> Column:
    """Markup without comments and tags.  What a script or style holds is text, tags included."""
    raw = rf"<(?:script|style)(?=[\s/>]){ATTRS}>(.*?)</(?:script|style)\s*>"
    tag = rf"(?is){raw}|<!--.*?-->|</?[a-z]{ATTRS}>|</?[a-z][^>]*>|<[!?][^>]*>"
    return F.regexp_replace(markup, tag, "$1")


def markup_text(markup: Column) -> Column:
    """Text content of a markup fragment: tags removed, character references decoded."""
    return unescape_html(drop_tags(text_or_empty(markup)))


def strip_markup(markup: Column, passes: int = 1) -> Column:
    """Readable text of a fragment.  ``passes=2`` serves bodies that were escaped twice."""
    text = markup
    for _ in range(passes):
        text = markup_text(text)
    return collapse(text)


def element_markup(html: Column) -> Column:
    """A page without comments and without elements whose content is not markup."""
    hidden = rf"(?is)<!--.*?-->|<({RAW_ELEMENTS})(?=[\s/>]){ATTRS}>.*?</\1\s*>"
    return F.regexp_replace(html, hidden, "")


def attribute(tag: Column, name: str) -> Column:
    """Decoded attribute of an opening tag: NULL when absent, empty when empty."""
    pattern = (
        rf"""(?is)(?:[\s"'/]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))"""
    )

    def extracted(text: Column) -> Column:
        value = F.concat(*[F.regexp_extract(text, pattern, group) for group in (1, 2, 3)])
        return F.when(text.rlike(pattern), unescape_html(value, _ATTRIBUTE_ENTITY))

    return let(tag, extracted)


def count_utf16(value: Column, limit: int) -> Column:
    """True when the text has at most ``limit`` UTF-16 units; encodes only near the limit."""
    units = F.octet_length(F.encode(value, "UTF-16BE")) / 2
    return F.when(F.length(value) * 2 <= limit, F.lit(True)).otherwise(units <= limit)
