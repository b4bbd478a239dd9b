"""Job-board JSON payloads to postings.

Each board is described by the schema of its body and by the columns one record yields.  Parsing is
``from_json`` with that schema, so only the named fields are read from a body.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import fingerprint
from ..functions.text import (
    SPACE,
    collapse,
    joined,
    let,
    lit_true,
    markup_text,
    null_if_blank,
    reused,
    split_trim,
    text_or_empty,
    trim_text,
    unique_texts,
)
from ..functions.urls import resolve_url
from ..operators.shaping import computed
from .postings import CONTEXT, context_of, eligible, finish_postings


@dataclass(frozen=True)
class Board:
    """How to read one board's payloads."""

    schema: str
    records: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    fields: Callable[[Column, Column, Column], dict[str, Column]]
    confidence: float
    failure: str
    # Whether the next page is asked for, and the total it depends on; None means a one-page board.
    more: Callable[[Column, Column, Column], Column] | None = None
    total: Callable[[Column], Column] = lambda b: F.lit(None)
    # How far a page advances by its own account; None means by its records.
    step: Callable[[Column], Column] | None = None


def _clean(value: Column) -> Column:
    return trim_text(text_or_empty(value))


def _first_text(*values: Column) -> Column:
    """The first value that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[null_if_blank(v) for v in values], F.lit(""))




def _or_empty(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


# ---- record fields per board ---------------------------------------------------------------


def _greenhouse(r: Column, origin: Column, site: Column) -> dict[str, Column]:
    def office(o: Column) -> Column:
        # A location is a string or an object; objects arrive as their JSON text.
        place = F.when(o["location"].startswith("{"), F.get_json_object(o["location"], "$.name"))
        return F.array(F.coalesce(place, F.when(~o["location"].startswith("{"), o["location"])), o["name"])

    offices = _or_empty(F.flatten(F.transform(r["offices"], office)))
    departments = F.transform(r["departments"], lambda d: d["name"])
    return {
        "title": _clean(r["title"]),
        "link": _clean(r["absolute_url"]),
        "description": r["content"],
        "markup": F.lit(2),
        "locations": unique_texts(F.concat(F.array(r["location"]["name"]), offices)),
        "raw_type": joined(_or_empty(departments), ", "),
    }


def _jibe(r: Column, origin: Column, site: Column) -> dict[str, Column]:
    def place(p: Column) -> Column:
        parts = F.array(p["city"], p["state"], _first_text(p["country_code"], p["country"]))
        return _first_text(joined(parts, ", "), trim_text(p["location_name"]))

    data = r["data"]
    name = _first_text(data["slug"], data["req_id"])
    path = _first_text(data["canonical_url"], F.when(name != "", F.concat(F.lit("/jobs/"), name)))
    extra = _or_empty(F.transform(data["additional_locations"], place))
    return {
        "title": _clean(data["title"]),
        "link": path,
        "base": origin,
        "apply_link": data["apply_url"],
        "description": data["description"],
        "markup": F.lit(1),
        "locations": unique_texts(F.concat(F.array(place(data)), extra, F.array(data["full_location"]))),
    }


def _ashby(r: Column, origin: Column, site: Column) -> dict[str, Column]:
    others = _or_empty(F.transform(r["secondaryLocations"], lambda s: s["location"]))
    return {
        "title": _clean(r["title"]),
        "link": _clean(r["jobUrl"]),
        "apply_link": _clean(r["applyUrl"]),
        "description": _clean(r["descriptionPlain"]),
        "locations": unique_texts(F.concat(F.array(r["location"]), others)),
        "raw_type": F.concat(text_or_empty(r["employmentType"]), F.lit(" "), text_or_empty(r["department"])),
    }


def _lever(r: Column, origin: Column, site: Column) -> dict[str, Column]:
    return {
        "title": _clean(r["text"]),
        "link": _clean(r["hostedUrl"]),
        "apply_link": _clean(r["applyUrl"]),
        "description": trim_text(joined(F.array(r["descriptionPlain"], r["additionalPlain"]), " ")),
        "locations": split_trim(r["categories"]["location"], "[;|]"),
        "raw_type": r["categories"]["commitment"],
    }


def _eightfold(r: Column, origin: Column, site: Column) -> dict[str, Column]:
    standard = r["standardizedLocations"]
    return {
        "title": _clean(r["name"]),
        "link": r["positionUrl"],
        "base": origin,
        "description": _clean(r["department"]),
        "locations": F.when(lit_true(F.size(standard) > 0), standard).otherwise(_or_empty(r["locations"])),
        "raw_type": r["department"],
    }


def _workday(r: Column, origin: Column, site: Column) -> dict[str, Column]:
    bullets = F.transform(_or_empty(r["bulletFields"]), lambda b: text_or_empty(b))
    places = F.split(text_or_empty(r["locationsText"]), rf"{SPACE}*\|{SPACE}*|;{SPACE}*")
    return {
        "title": _clean(r["title"]),
        "link": r["externalPath"],
        "base": F.concat(origin, F.lit("/en-US/"), site),
        "description": trim_text(F.array_join(bullets, " ")),
        "locations": F.filter(places, lambda p: p != ""),
    }


def _phenom(r: Column, origin: Column, site: Column) -> dict[str, Column]:
    path = _first_text(
        r["jobUrl"], F.when(r["jobId"] != "", F.concat(F.lit("/global/en/job/"), r["jobId"]))
    )
    structured = joined(F.array(r["city"], r["state"], r["country"]), ", ")
    return {
        "title": _clean(r["title"]),
        "link": path,
        "base": origin,
        "apply_link": r["applyUrl"],
        "description": _clean(r["description"]),
        "locations": unique_texts(F.array(r["location"], structured), trim=False),
        "raw_type": r["category"],
    }


def _oracle_hcm(r: Column, origin: Column, site: Column) -> dict[str, Column]:
    # Form encoding differs from component encoding in these six characters.
    encoded = F.url_encode(r["Id"])
    for escaped, plain in {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}.items():
        encoded = F.replace(encoded, F.lit(escaped), F.lit(plain))
    return {
        "title": _clean(_first_text(r["ExternalTitle"], r["Title"])),
        "link": F.concat(origin, F.lit("/hcmUI/CandidateExperience/en/sites/"), site, F.lit("/job/"), encoded),
        "description": _clean(r["ShortDescriptionStr"]),
        "locations": unique_texts(F.array(r["PrimaryLocation"], r["Locations"]), trim=False),
        "raw_type": r["JobFunction"],
    }


# ---- paging: is the page after this one asked for? -------------------------------------------


def _by_offset(total: Column, step: Column, offset: Column) -> Column:
    return (step > 0) & (offset < F.coalesce(total, step))


def _by_flag(total: Column, step: Column, offset: Column) -> Column:
    return (total == 1) & (step > 0)


BOARDS: dict[str, Board] = {
    "GREENHOUSE": Board(
        """jobs ARRAY<STRUCT<title: STRING, absolute_url: STRING, content: STRING,
           location: STRUCT<name: STRING>, offices: ARRAY<STRUCT<name: STRING, location: STRING>>,
           departments: ARRAY<STRUCT<name: STRING>>>>""",
        lambda b: b["jobs"],
        lambda b: b["jobs"].isNotNull(),
        _greenhouse,
        0.99,
        "Greenhouse API returned an invalid response.",
    ),
    "JIBE": Board(
        """jobs ARRAY<STRUCT<data: STRUCT<slug: STRING, req_id: STRING, title: STRING, description: STRING,
           apply_url: STRING, canonical_url: STRING, full_location: STRING, city: STRING, state: STRING,
           country: STRING, country_code: STRING, location_name: STRING,
           additional_locations: ARRAY<STRUCT<city: STRING, state: STRING, country: STRING,
           country_code: STRING, location_name: STRING>>>>>, totalCount BIGINT, count BIGINT""",
        lambda b: b["jobs"],
        lambda b: b["jobs"].isNotNull(),
        _jibe,
        0.99,
        "Jibe API returned an invalid response.",
        _by_offset,
        lambda b: F.coalesce(b["totalCount"], b["count"]),
    ),
    "ASHBY": Board(
        """jobs ARRAY<STRUCT<title: STRING, location: STRING, secondaryLocations: ARRAY<STRUCT<location: STRING>>,
           descriptionPlain: STRING, jobUrl: STRING, applyUrl: STRING, department: STRING,
           employmentType: STRING>>""",
        lambda b: b["jobs"],
        lambda b: b["jobs"].isNotNull(),
        _ashby,
        0.99,
        "Ashby API returned an invalid response.",
    ),
    "LEVER": Board(
        """ARRAY<STRUCT<text: STRING, descriptionPlain: STRING, additionalPlain: STRING, hostedUrl: STRING,
           applyUrl: STRING, categories: STRUCT<location: STRING, department: STRING, commitment: STRING>>>""",
        lambda b: b,
        lambda b: b.isNotNull(),
        _lever,
        0.99,
        "Lever API returned an invalid response.",
    ),
    "EIGHTFOLD": Board(
        """status INT, data STRUCT<count: BIGINT, positions: ARRAY<STRUCT<name: STRING, locations: ARRAY<STRING>,
           standardizedLocations: ARRAY<STRING>, department: STRING, positionUrl: STRING>>>""",
        lambda b: b["data"]["positions"],
        lambda b: b["data"].isNotNull() & (b["status"] == 200),
        _eightfold,
        0.98,
        "Eightfold listing API returned an invalid response.",
        _by_offset,
        lambda b: b["data"]["count"],
    ),
    "WORKDAY": Board(
        """total BIGINT, jobPostings ARRAY<STRUCT<title: STRING, externalPath: STRING, locationsText: STRING,
           bulletFields: ARRAY<STRING>>>""",
        lambda b: b["jobPostings"],
        lambda b: b["jobPostings"].isNotNull(),
        _workday,
        0.97,
        "Workday API returned an invalid response.",
        _by_offset,
        lambda b: b["total"],
    ),
    "PHENOM": Board(
        """refineSearch STRUCT<data: STRUCT<totalHits: BIGINT, jobs: ARRAY<STRUCT<title: STRING, jobId: STRING,
           jobUrl: STRING, applyUrl: STRING, location: STRING, city: STRING, state: STRING, country: STRING,
           description: STRING, category: STRING>>>>""",
        lambda b: b["refineSearch"]["data"]["jobs"],
        lambda b: b["refineSearch"]["data"]["jobs"].isNotNull(),
        _phenom,
        0.96,
        "Phenom API returned an invalid response.",
        _by_offset,
        lambda b: b["refineSearch"]["data"]["totalHits"],
    ),
    "ORACLE_HCM": Board(
        """items ARRAY<STRUCT<Id: STRING, Title: STRING, ExternalTitle: STRING, PrimaryLocation: STRING,
           Locations: STRING, JobFunction: STRING, ShortDescriptionStr: STRING>>, hasMore BOOLEAN, count BIGINT""",
        lambda b: b["items"],
        lambda b: b["items"].isNotNull(),
        _oracle_hcm,
        0.96,
        "Oracle HCM API returned an invalid response.",
        _by_flag,
        lambda b: b["hasMore"].cast("int"),
        lambda b: b["count"],
    ),
}

RECORD_KEY = ["query_no", "page_no", "record_no"]


def _per_board(boards: list[str], branch: Callable[[Board], Column]) -> Column:
    """One column whose value is computed by the board the row belongs to."""
    chain = F.when(F.lit(False), F.lit(None))
    for name in boards:
        chain = chain.when(F.col("provider") == name, branch(BOARDS[name]))
    return chain


def _content(board: Board) -> Column:
    """The parsed body; NULL for a root of the wrong kind, which the parser would wrap or unwrap."""
    opening = r"^\s*\[" if board.schema.startswith("ARRAY") else r"^\s*\{"
    return F.when(F.col("body").rlike(opening), F.from_json("body", board.schema))


# What a board's record may leave out: links without a base are already absolute.
_TEXT_FIELDS = ["title", "link", "base", "apply_link", "description", "raw_type"]


@reused
def _records(board: Board) -> Column:
    def normalised(r: Column) -> Column:
        fields = board.fields(r, F.col("api_origin"), F.col("site"))
        texts = [text_or_empty(fields.get(name, F.lit(""))).alias(name) for name in _TEXT_FIELDS]
        markup = fields.get("markup", F.lit(0)).alias("markup")
        return F.struct(*texts, fields["locations"].alias("locations"), markup)

    def records(content: Column) -> Column:
        return F.when(board.valid(content), F.transform(board.records(content), normalised))

    return let(_content(board), records)


@reused
def _joined_to(link_name: str, base_name: str) -> Column:
    link, base = F.col(link_name), F.col(base_name)
    resolved = F.coalesce(resolve_url(link, base), F.lit(""))
    return F.when((link == "") | (base == ""), link).otherwise(resolved)


@reused
def _readable() -> Column:
    """Bodies hold plain text, markup, or markup that was escaped once more."""
    description, markup = F.col("description"), F.col("markup")
    once = F.when(markup > 0, markup_text(description)).otherwise(description)
    return let(
        once,
        lambda text: F.when(markup == 0, text).otherwise(
            collapse(F.when(markup == 2, markup_text(text)).otherwise(text))
        ),
    )


def payload_postings(payloads: DataFrame, *boards: str) -> DataFrame:
    """Postings of the given boards (all by default), one row per eligible record, in one scan.

    ``payloads`` has the context columns, provider, query_no, page_no, body, and the api_origin and
    site it was fetched from.  Each row keeps the record's position for de-duplication.
    """
    chosen = list(boards or BOARDS)
    context = context_of(payloads)
    records = (
        payloads.where(F.col("provider").isin(chosen))
        .select(
            *context,
            "query_no",
            "page_no",
            _per_board(chosen, lambda b: F.lit(b.confidence)).alias("extraction_confidence"),
            F.posexplode(_per_board(chosen, _records)).alias("record_no", "r"),
        )
        .select(*context, *RECORD_KEY, "extraction_confidence", "r.*")
    )
    resolved = computed(
        eligible(records.where(F.col("link") != "")),
        url=_joined_to("link", "base"),
        apply_url=_joined_to("apply_link", "base"),
        description=_readable(),
    ).where(F.col("url") != "")
    evidence = resolved.withColumns(
        {
            "application_url": _first_text(F.col("apply_url"), F.col("url")),
            "content_fingerprint": fingerprint(
                F.col("title"), F.col("description"), F.col("url"), F.array_join("locations", "|")
            ),
        }
    )
    return finish_postings(evidence, *RECORD_KEY, *[c for c in context if c not in CONTEXT])


@reused
def _page_facts(board: Board) -> Column:
    """Whether a page is valid, its number of records, how far it advances and the total it reports."""

    def read(content: Column) -> Column:
        count = F.size(F.coalesce(board.records(content), F.array())).cast("bigint")
        valid = lit_true(board.valid(content))
        step = count if board.step is None else F.coalesce(board.step(content).cast("bigint"), count)
        return F.struct(
            valid.alias("valid"),
            F.when(valid, count).otherwise(0).alias("records"),
            F.when(valid, step).otherwise(0).alias("step"),
            board.total(content).cast("bigint").alias("total"),
        )

    return let(_content(board), read)


PAGE_KEY = ["query_no", "page_no"]


def page_facts(payloads: DataFrame, *boards: str) -> DataFrame:
    """What paging and failures depend on, one slim row per landed page; bodies are read here and go no further."""
    chosen = list(boards or BOARDS)
    known = payloads.where(F.col("provider").isin(chosen))
    return known.select(
        "scan_id", "company_id", "source_id", "source_url", "provider", *PAGE_KEY,
        F.explode(F.array(_per_board(chosen, _page_facts))).alias("_facts"),
    ).select("*", "_facts.*").drop("_facts")


def asked_pages(
    facts: DataFrame, run: tuple[str, ...] = ("scan_id", "source_id"), max_offset: int | None = None, max_pages: int | None = None
) -> DataFrame:
    """The pages a scan would have asked for: in order, until the board has no more to give.

    All landed pages count; ``max_offset`` records or ``max_pages`` pages per query are limits that a caller may set.
    Only slim facts meet in the window of a query.  A one-page board is asked for its pages as landed.
    """
    paged = [name for name, board in BOARDS.items() if board.more is not None]
    pages = Window.partitionBy(*run, "query_no").orderBy("page_no")
    before = pages.rowsBetween(Window.unboundedPreceding, -1)
    numbered = facts.where(F.col("provider").isin(paged)).withColumn("_offset", F.sum("step").over(pages))
    more = _per_board(paged, lambda b: lit_true(b.more(F.col("total"), F.col("step"), F.col("_offset"))))
    if max_offset is not None:
        more &= F.col("_offset") < max_offset
    if max_pages is not None:
        more &= F.col("page_no") < max_pages
    kept = numbered.withColumn("_more", more).withColumn("_asked", F.coalesce(F.min("_more").over(before), F.lit(True)))
    return kept.where("_asked").select(*facts.columns).unionByName(facts.where(~F.col("provider").isin(paged)))


def stitch_pages(payloads: DataFrame, *boards: str, run: tuple[str, ...] = ("source_id",), **limits: int) -> DataFrame:
    """``asked_pages`` of the boards that are read page by page, with ``record_count``."""
    chosen = [name for name in (boards or BOARDS) if BOARDS[name].more is not None]
    return asked_pages(page_facts(payloads, *chosen), run, **limits).withColumnRenamed("records", "record_count")


def asked_payloads(payloads: DataFrame, asked: DataFrame, run: tuple[str, ...] = ("scan_id", "source_id")) -> DataFrame:
    """The landed rows, with their bodies, of the pages in ``asked``, which come from ``asked_pages`` or ``stitch_pages``."""
    keys = [*run, *PAGE_KEY]
    return payloads.join(asked.select(*keys), keys, "left_semi").select(*payloads.columns)


def failed_pages(asked: DataFrame) -> DataFrame:
    """One row per scan and source with at least one asked page that lacks the expected records."""
    message = _per_board(list(BOARDS), lambda b: F.lit(b.failure)).alias("message")
    return asked.where(~F.col("valid")).select("scan_id", "company_id", "source_id", "source_url", "provider", message).distinct()


def payload_failures(payloads: DataFrame) -> DataFrame:
    """One row per scan and source with at least one body that lacks the expected records."""
    return failed_pages(page_facts(payloads))
