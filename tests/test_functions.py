"""Column functions against known vectors."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rolewatch.functions import classify, cron, ids, payloads, places, text, urls
from rolewatch.operators.watchlist import normalize_domain


def values(spark, rows, schema, expression):
    """Result of one expression per row, in row order."""
    numbered = [(i, *row) for i, row in enumerate(rows)]
    df = spark.createDataFrame(numbered, "_i int, " + schema).select("_i", expression.alias("v"))
    return [r.v for r in sorted(df.collect(), key=lambda r: r._i)]


US_LOCATIONS = [
    (["Salem, OR, US"], True),
    (["United States, Nevada, Reno"], True),
    (["Reno, Nevada"], True),
    (["Boise, ID"], True),
    (["Gary, IN"], True),
    (["Pune, MH, IN"], False),
    (["Galway, CO, IE"], False),
    (["Delft, ZH, NL"], False),
    (["Lod, Central District, IL"], False),
    (["Guelph, ON, CA"], False),
    (["ME", "Anywhere"], False),
    (["Anywhere"], False),
    ([], False),
    (["boise, id"], False),
    (["write to us"], True),
    (["Anywhere, U.S.A."], False),
    (["Salem, OR; Guelph, ON, CA"], True),
    (["Toronto, ON, CA | Paris"], False),
    (["Somewhere – Texas"], True),
    ([" Austin, TX "], True),
]


def test_us_location(spark):
    got = values(spark, [(l,) for l, _ in US_LOCATIONS], "l array<string>", places.is_us_location(F.col("l")))
    assert got == [expected for _, expected in US_LOCATIONS]


def test_us_location_null(spark):
    assert values(spark, [(None,)], "l array<string>", places.is_us_location(F.col("l"))) == [False]


TITLES = [
    ("Software Engineering Intern", True, "INTERNSHIP"),
    ("Undergraduate Software Engineering Intern", True, "INTERNSHIP"),
    ("Software Engineer, New Grad", True, "NEW_GRAD"),
    ("Graduate Software Engineer", True, "NEW_GRAD"),
    ("Masters Software Engineering Intern", False, "INTERNSHIP"),
    ("PhD Research Intern", False, "INTERNSHIP"),
    ("Ph.D. Intern", False, "INTERNSHIP"),
    ("MBA Product Intern", False, "INTERNSHIP"),
    ("Graduate Software Intern", False, "INTERNSHIP"),
    ("High School Engineering Intern", False, "INTERNSHIP"),
    ("Early Career Software Engineer", False, "EARLY_CAREER"),
    ("Director, US International Tax", False, "OTHER"),
    ("Technical Recruiter, Early Career", False, "EARLY_CAREER"),
    ("Explore internships", False, "OTHER"),
    ("Watch the film about becoming an intern", False, "INTERNSHIP"),
    ("University Recruiting Program Manager", False, "OTHER"),
    ("Solution Architect Manager - Intern Program", False, "INTERNSHIP"),
    ("Data Science Co-op", True, "INTERNSHIP"),
    ("Entry-Level Developer", True, "NEW_GRAD"),
    ("éintern", True, "INTERNSHIP"),
    (" Internships for students", False, "OTHER"),
]


def test_titles(spark):
    rows = [(t,) for t, *_ in TITLES]
    assert values(spark, rows, "t string", classify.is_eligible_title(F.col("t"))) == [e for _, e, _ in TITLES]
    assert values(spark, rows, "t string", classify.employment_type(F.col("t"))) == [k for *_, k in TITLES]


def test_raw_type_counts(spark):
    got = values(spark, [("Engineer", "Intern"), ("Engineer", None)], "t string, r string", classify.employment_type(F.col("t"), F.col("r")))
    assert got == ["INTERNSHIP", "OTHER"]


ROLE_MATCHES = [
    ("Software Intern", "", [], True),
    ("Software Intern", "", ["intern"], True),
    ("Software Intern", "", ["new grad"], False),
    ("Software Engineer, New Grad", "", ["graduate"], True),
    ("Software Engineer, New Grad", "", ["intern"], False),
    ("Software Intern", "", ["software"], True),
    ("Software Intern", "writes C++ code", ["c++"], True),
    ("Software Intern", "writes C++11 code", ["c++"], False),
    ("Software Intern", "softwares", ["hardware"], False),
    ("Software Intern", "", [" ", ""], True),
    ("Software Intern", "a.b", ["a.b"], True),
    ("Software Intern", "axb", ["a.b"], False),
    ("Senior Accountant", "", [], False),
]


def test_role_match(spark):
    rows = [r[:3] for r in ROLE_MATCHES]
    expression = classify.matches_keywords(F.col("t"), F.col("d"), F.col("k"))
    assert values(spark, rows, "t string, d string, k array<string>", expression) == [r[3] for r in ROLE_MATCHES]


def test_search_queries(spark):
    rows = [
        ([],), (["university"],), (["intern", "graduate"],), (["a", "b", "c", "d", "e", "intern"],), (["new grad"],), (None,),
    ]
    got = values(spark, rows, "k array<string>", classify.search_queries(F.col("k")))
    assert got == [["intern", "new grad"], ["intern"], ["intern", "new grad"], ["a", "b", "c", "d", "e"], ["new grad"], ["intern", "new grad"]]
    first = values(spark, rows, "k array<string>", classify.search_queries(F.col("k"), limit=4))
    assert first == [*got[:3], ["a", "b", "c", "d"], *got[4:]]


def test_keywords_and_domain(spark):
    assert values(spark, [(["Intern", "intern", " New Grad ", " "],)], "k array<string>", classify.clean_keywords(F.col("k"))) == [["intern", "new grad"]]
    rows = [("https://acme.test/",), (" ACME.test ",), ("acme.test//",)]
    assert values(spark, rows, "d string", normalize_domain(F.col("d"))) == ["acme.test", "acme.test", "acme.test/"]


CRONS = [
    ("* * * * *", True, True),
    ("*/15 9-17 * * 1-5", True, False),
    ("*/15 9-17 * * 0", True, True),
    ("0 * * * *", True, False),
    ("not a cron", False, False),
    ("* * * * 7", True, False),
    ("5/15 * * * *", True, False),
    ("30 14 1 * 0", True, False),
    ("30 14 16 8 0", True, True),
    ("60 * * * *", False, False),
    ("*/0 * * * *", False, False),
    ("*/ * * * *", True, True),
    (", * * * *", True, False),
    (",30 * * * *", True, True),
    ("30-10 * * * *", False, False),
    ("0-40/10/7 * * * *", True, True),
    ("  * *\t* * *  ", True, True),
    ("1.5 * * * *", False, False),
    ("* * * *", False, False),
    ("", False, False),
]


def test_cron(spark):
    at = datetime(2026, 8, 16, 14, 30)
    rows = [(e, at) for e, *_ in CRONS]
    schema = "e string, at timestamp_ntz"
    assert values(spark, rows, schema, cron.is_valid_cron(F.col("e"))) == [v for _, v, _ in CRONS]
    assert values(spark, rows, schema, cron.cron_matches(F.col("e"), F.col("at"))) == [d for *_, d in CRONS]


MARKUP = [
    ("<p>Build <b>collaborative</b>\n tools.</p>", "Build collaborative tools."),
    ("Tom &amp; Jerry&#8217;s &lt;b&gt; &#x1F600;", "Tom & Jerry’s <b> \U0001f600"),
    ("&amp;lt;", "&lt;"),
    ("a<b c>d", "ad"),
    ("1 < 2 &unknown; &amp end", "1 < 2 &unknown; & end"),
    ("<a title='x>y'>t</a><!-- > -->", "t"),
    ("&#150;&#0;&nbsp;x", "–� x"),
    (None, ""),
]


def test_strip_markup(spark):
    assert values(spark, [(m,) for m, _ in MARKUP], "m string", text.strip_markup(F.col("m"))) == [t for _, t in MARKUP]
    twice = text.strip_markup(F.col("m"), passes=2)
    assert values(spark, [("&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;",)], "m string", twice) == ["Hi & bye"]


CANONICAL = [
    ("/a/../b?utm_source=x&q=a b#f", "https://Ex.com:443/x/y", "https://ex.com/b?q=a+b"),
    ("foo/ó n.html", "https://ex.com/x/y", "https://ex.com/x/foo/%C3%B3%20n.html"),
    ("", "https://ex.com/x/y?q=1#z", "https://ex.com/x/y?q=1"),
    ("#top", "http://ex.com", "http://ex.com/"),
    ("?a=b%20c&ref=1&d", "https://ex.com/p", "https://ex.com/p?a=b+c&d="),
    ("?a=b%20c&d", "https://ex.com/p", "https://ex.com/p?a=b%20c&d"),
    ("?refresh=1&sourceId=2", "https://ex.com/p", "https://ex.com/p"),
    ("?%75tm_x=1&k=2", "https://ex.com/p", "https://ex.com/p?k=2"),
    ("//Cdn.Com/x", "http://ex.com", "http://cdn.com/x"),
    ("mailto:a@b.c", "http://ex.com", "mailto:a@b.c"),
    ("https://exa mple.com/", "http://ex.com", None),
    ("../..", "https://ex.com/a/b/c", "https://ex.com/"),
    ("./", "https://ex.com/a/b/c", "https://ex.com/a/b/"),
    ("../../../x/.", "https://ex.com/a/b", "https://ex.com/x/"),
    ("http://", "http://e.com", None),
    ("https://u:p@h.com:8080/?ref=2", "http://e.com", "https://u:p@h.com:8080/"),
]


def test_canonical_url(spark):
    expression = urls.canonical_url(F.col("u"), F.col("b"))
    assert values(spark, [c[:2] for c in CANONICAL], "u string, b string", expression) == [c[2] for c in CANONICAL]


def test_resolve_keeps_everything(spark):
    expression = urls.resolve_url(F.col("u"), F.lit("https://ex.com/en-US/Site"))
    got = values(spark, [("/job/R1?utm_source=a#b",), ("job/2",)], "u string", expression)
    assert got == ["https://ex.com/job/R1?utm_source=a#b", "https://ex.com/en-US/job/2"]


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://job-boards.greenhouse.io/acme/jobs/100001", True),
        ("https://jobs.ashbyhq.com/acme/12345678-1234-1234-1234-123456789abc", True),
        ("https://example.com/career-programs/university", False),
        ("https://example.com/jobs/early-careers", False),
        ("https://example.com/jobs/film.mp4", False),
        ("https://example.com/careers/senior-accountant", False),
        ("https://example.com/details/12", True),
        ("https://example.com/job/abcd", True),
        ("https://example.com/job/abc", False),
    ],
)
def test_job_detail_url(spark, url, expected):
    assert values(spark, [(url,)], "u string", urls.is_job_detail_url(F.col("u"))) == [expected]


def test_public_urls(spark):
    cases = {
        "http://127.0.0.1/": "Private sources cannot be scanned.",
        "http://10.1.1.1": "Private sources cannot be scanned.",
        "https://172.20.1.1/x": "Private sources cannot be scanned.",
        "https://172.32.1.1/x": None,
        "https://u@h.com": "Source URLs cannot contain credentials.",
        "ftp://x.y": "Only HTTP(S) sources can be scanned.",
        "nope": "Invalid URL",
        "http://LOCALHOST:80/": "Private sources cannot be scanned.",
        "http://a.local/x": "Private sources cannot be scanned.",
        "http://2130706433/": "Private sources cannot be scanned.",
        "http://[::1]/": "Private sources cannot be scanned.",
        "https://ok.com": None,
    }
    assert values(spark, [(u,) for u in cases], "u string", urls.source_url_error(F.col("u"))) == list(cases.values())


def test_event_functions(spark):
    rows = [
        ("Technical Resume Workshop at Google Toronto", "WORKSHOP", "Toronto"),
        ("Hackathon at  ", "HACKATHON", None),
        ("Information session", "INFO_SESSION", None),
        ("Recruiting night at Google", "CAMPUS_RECRUITING", "Google"),
        ("Networking at MIT at noon", "NETWORKING", "MIT at noon"),
        ("Tea", "OTHER", None),
    ]
    titles = [r[:1] for r in rows]
    assert values(spark, titles, "t string", classify.event_type(F.col("t"))) == [r[1] for r in rows]
    assert values(spark, titles, "t string", classify.location_in_title(F.col("t"))) == [r[2] for r in rows]
    gate = classify.is_early_career_event(F.col("t"), F.lit("x"), F.col("k"))
    cases = [("Tea party", ["TEA"], True), ("Tea", ["coffee"], False), ("Tea", [""], True), ("Student tea", [], True)]
    assert values(spark, [c[:2] for c in cases], "t string, k array<string>", gate) == [c[2] for c in cases]


def test_ids(spark):
    import hashlib

    whole = hashlib.sha256("a\u001f\u001fb".encode()).hexdigest()
    assert values(spark, [("a", None, "b")], "a string, n string, b string", ids.fingerprint(F.col("a"), F.col("n"), F.col("b"))) == [whole]
    short = hashlib.sha256("a\u001fb".encode()).hexdigest()[:24]
    assert values(spark, [("a", "b")], "a string, b string", ids.posting_id(F.col("a"), F.col("b"))) == [short]


def test_payload_helpers(spark):
    import json

    at = datetime(2026, 8, 18)
    body = values(
        spark,
        [("NEW", "Notion", "Software Engineering Intern", "https://example.com/jobs/1", at)],
        "k string, c string, t string, u string, at timestamp",
        payloads.job_message(F.col("k"), F.col("c"), F.col("t"), F.col("u"), F.col("at")),
    )[0]
    message = json.loads(body)
    assert "New opportunity" in message["content"]
    assert message["embeds"][0]["url"] == "https://example.com/jobs/1"
    assert message["embeds"][0]["timestamp"] == "2026-08-18T00:00:00.000Z"
    assert message["allowed_mentions"] == {"parse": []}
    cut = payloads.utf16_prefix(F.col("t"), 3)
    assert values(spark, [("abcd",), ("ab\U0001f600",), ("\U0001f600a",), ("ab",)], "t string", cut) == ["abc", "ab�", "\U0001f600a", "ab"]
    now = F.lit(datetime(2026, 1, 1))
    waits = values(spark, [(n,) for n in (0, 1, 2, 3, 4, 9)], "n int", payloads.retry_at(now, F.col("n")))
    assert [(w - datetime(2026, 1, 1)).total_seconds() for w in waits] == [60, 60, 300, 900, 3600, 3600]
