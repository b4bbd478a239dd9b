"""Career pages and event pages (HTML) to postings, links and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import (
    event_audience,
    event_format,
    event_type,
    is_early_career_event,
    location_in_title,
)
from ..functions.ids import fingerprint, posting_id
from ..functions.text import (
    ATTRS,
    attribute,
    count_utf16,
    element_markup,
    let,
    lit_true,
    null_if_blank,
    reused,
    strip_markup,
    text_or_empty,
    trim_text,
    unescape_html,
    unescape_json,
)
from ..functions.urls import canonical_url, is_job_detail_url, parsed_url, source_url_error
from ..operators.shaping import computed, join_dimension, join_large
from .linked_data import allow_repeated_names, linked_data_blocks, linked_data_records
from .postings import CONTEXT, context_of, eligible, finish_postings

LAYERS = ("jsonld", "pair", "tuple", "anchor")

# Confidence per extraction layer.
CONFIDENCE = {"jsonld": 0.95, "pair": 0.75, "tuple": 0.7, "anchor": 0.55}

# Serialised records inside application payloads.  Possessive, hence linear.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
PAIR = rf'\[0,"title"\],\[0,({_STRING})\],\[0,"href"\],\[0,({_STRING})\]'
TUPLE = rf'\[0,({_STRING})\],\[0,("https?:\\?/\\?/(?:[^"\\]++|\\.)*+")\]'

_ANCHOR = rf"(?is)<a(?=[\s/>]){ATTRS}>(?:.*?)(?:</a\s*>|(?=<a[\s/>])|\z)"
_OPENING = rf"(?is)^<a(?=[\s/>]){ATTRS}>"
_META = rf"(?is)<meta(?=[\s/>]){ATTRS}>"
_TITLE = rf"(?is)<title(?=[\s/>]|>){ATTRS}>(.*?)</title\s*>"


@reused
def _rejection(max_units: int | None) -> Column:
    forbidden = source_url_error(F.col("source_url"))
    if max_units is None:
        return forbidden
    # Fixed value: the message of the crawler's size limit.
    too_large = F.when(~count_utf16(F.col("html"), max_units), F.lit("Source response exceeded 5 MB."))
    return F.coalesce(forbidden, too_large)


def admitted_pages(pages: DataFrame, max_units: int | None = None) -> DataFrame:
    """Add ``rejection``: NULL for a page that may be used, else the reason it may not.

    A landed page of any size is used unless ``max_units``, in UTF-16 units, says otherwise.
    """
    return pages.withColumn("rejection", _rejection(max_units))


# ---- layers ----------------------------------------------------------------------------------


def _raw(layer: str, title: Column, href: Column, **rest: Column) -> Column:
    """A record as found, before any URL or text is cleaned."""
    return F.struct(
        F.lit(layer).alias("layer"),
        title.alias("title"),
        href.alias("href"),
        rest.get("description", F.lit("")).alias("description"),
        rest.get("locations", F.array().cast("array<string>")).alias("locations"),
        rest.get("raw_type", F.lit("")).alias("raw_type"),
    )


@reused
def _linked_data() -> Column:
    """Records of the linked-data blocks in column jsonld."""

    def one(r: Column) -> Column:
        link = F.coalesce(null_if_blank(r["url"]), F.col("source_url"))
        return _raw("jsonld", r["title"], link, description=r["description"], locations=r["locations"], raw_type=r["raw_type"])

    return F.transform(linked_data_records(F.col("jsonld")), one)


def _serialised(html: Column, layer: str) -> Column:
    pattern = PAIR if layer == "pair" else TUPLE

    def one(match: Column) -> Column:
        title = unescape_json(F.regexp_extract(match, pattern, 1))
        link = unescape_json(F.regexp_extract(match, pattern, 2))
        return _raw(layer, title, F.replace(link, F.lit("\\/"), F.lit("/")) if layer == "tuple" else link)

    return F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), one)


def _anchors(html: Column) -> Column:
    """Links of a page in document order; the title is still markup."""

    def one(match: Column) -> Column:
        href = attribute(F.regexp_extract(match, _OPENING, 0), "href")
        return _raw("anchor", F.regexp_replace(match, _OPENING, ""), href)

    matches = F.regexp_extract_all(element_markup(html), F.lit(_ANCHOR), F.lit(0))
    return F.filter(F.transform(matches, one), lambda a: a["href"].isNotNull())


@reused
def _layer(name: str) -> Column:
    """Records of one layer, from the columns html and source_url."""
    html = F.col("html")
    if name == "jsonld":
        return linked_data_blocks(html)
    return _anchors(html) if name == "anchor" else _serialised(html, name)


@reused
def _link_url() -> Column:
    return canonical_url(F.col("href"), F.col("source_url"))


@reused
def _is_detail(name: str) -> Column:
    return is_job_detail_url(F.col(name))


@reused
def _record_text() -> Column:
    """Anchors carry markup in the title, linked data in the description: one text per record to clean."""
    return strip_markup(F.when(F.col("layer") == "anchor", F.col("title")).otherwise(F.col("description")))


@reused
def _event_facts() -> Column:
    return F.struct(
        parsed_url(F.col("url")).alias("canonical_url"), event_page_facts(F.col("html")).alias("page")
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Every anchor of every page, unfiltered."""
    others = [c for c in pages.columns if c != "html"]
    links = pages.select(*others, F.posexplode(_layer("anchor")).alias("ordinal", "link"))
    cleaned = computed(
        links.select(*others, "ordinal", F.col("link.href").alias("href"), F.col("link.title").alias("text")),
        canonical_url=_link_url(),
        text=strip_markup(F.col("text")),
    )
    return cleaned.withColumn("is_job_detail", _is_detail("canonical_url"))


def page_postings(pages: DataFrame, *layers: str) -> DataFrame:
    """Eligible postings of every layer, in one scan, before de-duplication.

    ``pages`` has the context columns and html.  ``ordinal`` is the position among the page's records,
    structured layers first.
    """
    chosen = [name for name in LAYERS if name in (layers or LAYERS)]
    context = context_of(pages)
    extracted = pages.select(*context, *[_layer(name).alias(name) for name in chosen])
    if "jsonld" in chosen:
        allow_repeated_names(pages.sparkSession)
        extracted = extracted.withColumn("jsonld", _linked_data())
    records = extracted.select(
        *context, F.posexplode(F.concat(*[F.col(n) for n in chosen])).alias("ordinal", "r")
    ).select(*context, "ordinal", "r.*")

    layer = F.col("layer")
    texts = computed(records, text=_record_text())
    titled = texts.withColumns(
        {
            "title": F.when(layer == "anchor", F.col("text")).otherwise(F.col("title")),
            "description": F.when(layer == "jsonld", F.col("text")).otherwise(F.lit("")),
        }
    ).where(F.col("title") != "")
    resolved = computed(eligible(titled.where(F.col("href").isNotNull())), url=_link_url())
    usable = resolved.where(
        F.col("url").isNotNull() & (layer.isin("jsonld", "pair") | _is_detail("url"))
    )
    title, url = F.col("title"), F.col("url")
    marks = F.when(layer == "jsonld", fingerprint(title, F.col("description"), url)).otherwise(fingerprint(title, url))
    confidence = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    evidence = usable.withColumns(
        {"application_url": url, "content_fingerprint": marks, "extraction_confidence": F.element_at(confidence, layer)}
    )
    return finish_postings(evidence, "ordinal", *[c for c in context if c not in CONTEXT])


# ---- events ----------------------------------------------------------------------------------


def _metas(markup: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(markup, F.lit(_META), F.lit(0)),
        lambda tag: F.struct(
            attribute(tag, "name").alias("name"),
            attribute(tag, "property").alias("property"),
            trim_text(attribute(tag, "content")).alias("content"),
        ),
    )


def _meta(metas: Column, name: str) -> Column:
    """Content of the first meta element by name, then by property.  An empty content ends the search."""

    def first(key: str) -> Column:
        hits = F.filter(metas, lambda m: lit_true(m[key] == name))
        return F.try_element_at(hits, F.lit(1))["content"]

    return text_or_empty(F.coalesce(first("name"), first("property")))


def event_page_facts(html: Column) -> Column:
    """Title and description of an event page; empty strings where the page has none."""

    def facts(markup: Column) -> Column:
        return let(
            _metas(markup),
            lambda metas: F.struct(
                F.coalesce(
                    null_if_blank(trim_text(unescape_html(F.regexp_extract(markup, _TITLE, 1)))),
                    null_if_blank(_meta(metas, "og:title")),
                    _meta(metas, "twitter:title"),
                ).alias("title"),
                F.coalesce(null_if_blank(_meta(metas, "description")), _meta(metas, "og:description")).alias(
                    "description"
                ),
            ),
        )

    return let(element_markup(html), facts)


def read_event_pages(pages: DataFrame, targets: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per page with the event's columns and ``rejection`` (NULL for an accepted event).

    ``pages`` has company_id, url, html and observed_at; a page's markup never reaches a join.
    """
    read = pages.select("company_id", "observed_at", F.explode(F.array(_event_facts())).alias("f")).select(
        "company_id", "observed_at", "f.canonical_url", "f.page.*"
    )
    events_page = sources.where(F.col("kind") == "EVENTS").groupBy("company_id").agg(
        F.min(F.struct("id", "url")).alias("events_source")
    )
    companies = targets.select(F.col("id").alias("company_id"), "event_keywords", F.lit(True).alias("_known"))
    located = join_dimension(read, join_large(companies, events_page, "company_id", "left"), ["company_id"])
    title, description, url = F.col("title"), F.col("description"), F.col("canonical_url")
    haystack = F.lower(F.concat(title, F.lit(" "), description))
    rejection = (
        F.when(url.isNull(), F.lit("Invalid URL"))
        .when(F.col("_known").isNull(), F.lit("The selected company is not in the watchlist."))
        .when(title == "", F.lit("Event page did not provide a title."))
        .when(
            ~is_early_career_event(title, description, F.col("event_keywords")),
            F.lit("Event does not match the company event keywords."),
        )
    )
    place = location_in_title(title)
    never = F.lit(None).cast(pages.schema["observed_at"].dataType)
    return located.select(
        posting_id(F.col("company_id"), url).alias("id"),
        "company_id",
        F.coalesce(
            F.col("events_source.id"), F.concat("company_id", F.lit("-submitted-events"))
        ).alias("source_id"),
        F.coalesce(F.col("events_source.url"), url).alias("source_url"),
        url.alias("canonical_url"),
        url.alias("registration_url"),
        title,
        description,
        event_type(title).alias("event_type"),
        never.alias("starts_at"),
        never.alias("ends_at"),
        F.lit("America/Toronto").alias("timezone"),
        event_format(haystack).alias("format"),
        place.alias("location"),
        never.alias("registration_deadline"),
        event_audience(haystack).alias("audience"),
        F.lit("REGISTRATION_OPEN").alias("status"),
        F.col("observed_at").alias("first_seen_at"),
        F.col("observed_at").alias("last_seen_at"),
        fingerprint(title, description, url, place).alias("content_fingerprint"),
        F.lit(0.8).alias("extraction_confidence"),
        F.lit(True).alias("active"),
        rejection.alias("rejection"),
    )
