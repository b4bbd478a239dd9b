"""URL resolution and cleaning after the WHATWG rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, lit_true, text_or_empty

# Query parameters dropped from canonical URLs (prefix match, any case).
TRACKING_PARAMETER = r"(?i)^(?:utm_|gh_src|lever-|source|ref)"

# What a link to a single job looks like, and what it never looks like.
MEDIA_PATH = r"(?i)\.(?:mp4|mov|pdf|jpg|png)\z"
LANDING_PATH = r"(?i)/(?:search|jobsearch|early-careers?|career-programs|university-recruiting)/?\z"
JOB_DETAIL_URL = (
    r"(?i)(?:job-boards\.greenhouse\.io/.+/jobs/\d+"
    r"|jobs\.ashbyhq\.com/.+/[0-9a-f-]{20,}"
    r"|jobs\.lever\.co/.+/[0-9a-f-]{20,}"
    r"|https?://jobs\.[^/]+/.+/[\w-]{4,}"
    r"|/job_details/\d+"
    r"|/details/\d+"
    r"|/jobs?/[\w-]{4,})"
)

# Addresses that are never public.
PRIVATE_IPV4 = r"^(?:127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(?:1[6-9]|2\d|3[01])\.)"

_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?\z"
_GOOD_HOST = r"""^[^\x00-\x20<>\[\]^|%"`{}\\:/]+(?::\d+)?\z"""
_PATH_UNSAFE = r"[^\x21\x24-\x3B\x3D\x40-\x5F\x61-\x7A\x7C\x7E]"
_QUERY_UNSAFE = r"[^\x21\x24-\x26\x28-\x3B\x3D\x3F-\x7E]"
_FRAGMENT_UNSAFE = r"[^\x21\x23-\x3B\x3D\x3F-\x5F\x61-\x7E]"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def scheme_of(url: Column) -> Column:
    return F.lower(_part(url, 1))


def path_of(url: Column) -> Column:
    return _part(url, 3)


def authority_of(url: Column) -> Column:
    return _part(url, 2)


def host_of(url: Column) -> Column:
    without_user = F.regexp_replace(authority_of(url), r"^.*@", "")
    return F.lower(F.regexp_replace(without_user, r":\d*\z", ""))


def _percent_encode(value: Column, unsafe: str) -> Column:
    def one(ch: Column) -> Column:
        escaped = F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")
        return F.when(ch.rlike(unsafe), escaped).otherwise(ch)

    def encoded(text: Column) -> Column:
        escaped = F.array_join(F.transform(F.split(text, ""), one), "")
        return F.when(text.rlike(unsafe), escaped).otherwise(text)

    return let(value, encoded)


def _fold_dots(value: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of a path that starts with a slash."""

    def plain(segment: Column) -> Column:
        return F.regexp_replace(segment, "(?i)%2e", ".")

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(plain(segment) == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(plain(segment) == ".", done)
            .otherwise(F.concat(done, F.array(segment)))
        )

    def folded(path: Column) -> Column:
        segments = F.split(F.substr(path, F.lit(2)), "/", -1)
        kept = F.aggregate(segments, F.array().cast("array<string>"), step)
        open_end = plain(F.element_at(segments, -1)).isin(".", "..")
        tail = F.when(open_end & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
        return F.when(
            path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|\z)"),
            F.concat(F.lit("/"), F.array_join(kept, "/"), tail),
        ).otherwise(path)

    return let(value, folded)


def _absolute(reference: Column, base: Column) -> Column:
    """Join a reference to its base without normalising the result yet."""
    trimmed = F.regexp_replace(text_or_empty(reference), r"^[\x00-\x20]+|[\x00-\x20]+\z|[\t\n\r]", "")
    base_path = F.when(_part(base, 3) == "", F.lit("/")).otherwise(_part(base, 3))

    def against(ref: Column, site: Column) -> Column:
        origin = F.concat(site["scheme"], F.lit("://"), site["authority"])
        return (
            F.when(ref.rlike(r"(?i)^https?:"), F.regexp_replace(ref, r"(?i)^(https?):[/\\]*", "$1://"))
            .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
            .when(base.isNull() | (site["authority"] == ""), F.lit(None).cast("string"))
            .when(
                ref.rlike(r"^[/\\]{2}"),
                F.concat(site["scheme"], F.lit("://"), F.regexp_replace(ref, r"^[/\\]+", "")),
            )
            .when(ref.rlike(r"^[/\\]"), F.concat(origin, ref))
            .when(ref.startswith("?"), F.concat(origin, site["path"], ref))
            .when(ref.rlike(r"^(?:#|\z)"), F.concat(origin, site["path"], site["query"], ref))
            .otherwise(F.concat(origin, F.regexp_replace(site["path"], r"[^/]*\z", ""), ref))
        )

    site = F.struct(
        _part(base, 1).alias("scheme"),
        _part(base, 2).alias("authority"),
        base_path.alias("path"),
        _part(base, 4).alias("query"),
    )
    return let(trimmed, lambda ref: let(site, lambda bound: against(ref, bound)))


def _without_tracking(value: Column) -> Column:
    """Drop tracking parameters; a query that lost one is re-serialised as form data."""

    def decoded(text: Column) -> Column:
        return F.try_url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))

    def name_of(pair: Column) -> Column:
        return decoded(F.regexp_extract(pair, r"(?s)^([^=]*)", 1))

    def serialised(pair: Column) -> Column:
        content = decoded(F.regexp_extract(pair, r"(?s)^[^=]*=(.*)", 1))
        return F.concat(F.url_encode(name_of(pair)), F.lit("="), F.url_encode(content))

    def cleaned(query: Column) -> Column:
        pairs = F.filter(F.split(F.substr(query, F.lit(2)), "&"), lambda p: p != "")
        kept = F.filter(pairs, lambda p: ~lit_true(name_of(p).rlike(TRACKING_PARAMETER)))
        form = F.concat(F.lit("?"), F.array_join(F.transform(kept, serialised), "&"))
        return F.when(F.size(kept) == F.size(pairs), query).otherwise(
            F.when(F.size(kept) == 0, F.lit("")).otherwise(form)
        )

    # Names may hide behind percent escapes, so those queries take the exact test too.
    suspect = r"(?i)[?&](?:utm_|gh_src|lever-|source|ref)|%[0-9a-f]{2}"
    return let(value, lambda q: F.when(q.rlike(suspect), cleaned(q)).otherwise(q))


def _normalise(absolute: Column, strip_tracking: bool, keep_fragment: bool) -> Column:
    def slashed(url: Column) -> Column:
        # Before the query, a backslash in a web URL counts as a slash.
        head = F.regexp_extract(url, r"(?s)^([^?#]*)", 1)
        tail = F.regexp_extract(url, r"(?s)^[^?#]*(.*)\z", 1)
        return F.when(
            url.rlike(r"(?i)^https?:[^?#]*\\"), F.concat(F.replace(head, F.lit("\\"), F.lit("/")), tail)
        ).otherwise(url)

    def web_url(url: Column) -> Column:
        scheme = scheme_of(url)
        user = F.regexp_extract(authority_of(url), r"^(.*@)", 1)
        host_port = F.regexp_replace(
            F.concat(scheme, F.lit("|"), F.lower(F.regexp_replace(authority_of(url), r"^.*@", ""))),
            r"^(?:(http)\|(.*?)(?::(?:80)?)?|(https)\|(.*?)(?::(?:443)?)?)\z",
            "$2$4",
        )
        path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
        path = _percent_encode(_fold_dots(path), _PATH_UNSAFE)
        query = _percent_encode(_part(url, 4), _QUERY_UNSAFE)
        if strip_tracking:
            query = _without_tracking(query)
        pieces = [path, query]
        if keep_fragment:
            pieces.append(_percent_encode(_part(url, 5), _FRAGMENT_UNSAFE))

        def assembled(host: Column) -> Column:
            valid = host.rlike(r"^\[[0-9a-f:.]+\](?::\d+)?\z") | host.rlike(_GOOD_HOST)
            return F.when(valid, F.concat(scheme, F.lit("://"), user, host, *pieces))

        return let(host_port, assembled)

    def either(url: Column) -> Column:
        other = url if keep_fragment else F.regexp_replace(url, r"(?s)#.*\z", "")
        return F.when(url.rlike(r"(?i)^https?:"), web_url(url)).when(url.rlike(_PARTS), other)

    return let(let(absolute, slashed), either)


def canonical_url(reference: Column, base: Column) -> Column:
    """Absolute URL without fragment and tracking parameters; NULL when it does not parse."""
    return _normalise(_absolute(reference, base), strip_tracking=True, keep_fragment=False)


def resolve_url(reference: Column, base: Column) -> Column:
    """Absolute URL as the platform would print it, nothing dropped."""
    return _normalise(_absolute(reference, base), strip_tracking=False, keep_fragment=True)


def parsed_url(value: Column) -> Column:
    """A URL that must already be absolute; NULL when it does not parse."""
    return resolve_url(value, F.lit(None).cast("string"))


def is_job_detail_url(url: Column) -> Column:
    def accepted(link: Column) -> Column:
        path = path_of(link)
        return lit_true(link.rlike(JOB_DETAIL_URL) & ~path.rlike(MEDIA_PATH) & ~path.rlike(LANDING_PATH))

    return let(url, accepted)


def source_url_error(url: Column) -> Column:
    """Why a page must not be fetched or used; NULL when the URL is public."""

    def private(host: Column) -> Column:
        numeric = host.rlike(r"(?:^|\.)(?:\d+|0x[0-9a-f]*)\.?\z")
        dotted = host.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}\z")
        return (
            (host == "localhost")
            | host.endswith(".local")
            | host.startswith("[")
            | (dotted & host.rlike(PRIVATE_IPV4))
            | (numeric & ~dotted)
        )

    # The messages about a page that must not be read.
    def reason(parsed: Column) -> Column:
        return (
            F.when(parsed.isNull(), F.lit("Invalid URL"))
            .when(~scheme_of(parsed).isin("http", "https"), F.lit("Only HTTP(S) sources can be scanned."))
            .when(authority_of(parsed).contains("@"), F.lit("Source URLs cannot contain credentials."))
            .when(let(host_of(parsed), private), F.lit("Private sources cannot be scanned."))
        )

    return let(parsed_url(url), reason)


def http_url_error(url: Column, field: str) -> Column:
    """Message for a configured URL that is not http(s); NULL when fine."""

    def reason(parsed: Column) -> Column:
        return F.when(parsed.isNull(), F.lit(f"{field} must be a valid URL.")).when(
            ~scheme_of(parsed).isin("http", "https"), F.lit(f"{field} must use http or https.")
        )

    return let(parsed_url(url), reason)


def event_url_allowed(url: Column, host: str = "rsvp.withgoogle.com", prefix: str = "/events/") -> Column:
    def allowed(parsed: Column) -> Column:
        return lit_true(
            (scheme_of(parsed) == "https") & (host_of(parsed) == host) & path_of(parsed).startswith(prefix)
        )

    return let(parsed_url(url), allowed)
