"""Extraction from board payloads and pages."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rolewatch.operators import dedup
from rolewatch.schemas import LANDED
from rolewatch.sources import board_payloads, boards, linked_data, pages, postings

AT = datetime(2026, 8, 20, 12)
ROUTES = {
    "GREENHOUSE": (None, None),
    "JIBE": ("https://careers.amd.com", None),
    "ASHBY": (None, None),
    "LEVER": (None, None),
    "EIGHTFOLD": ("https://jobs.nvidia.com", None),
    "WORKDAY": ("https://intel.wd1.myworkdayjobs.com", "External"),
    "PHENOM": ("https://careers.cisco.com", None),
    "ORACLE_HCM": ("https://enterpriseplatform.dell.com", "careers"),
}


def landed(spark, provider, *bodies, source="src", first_page=1):
    rows = [
        ("scan", "c1", source, "https://example.com/careers", provider, *ROUTES[provider], 0, first_page + i, AT,
         body if isinstance(body, str) else json.dumps(body))
        for i, body in enumerate(bodies)
    ]
    return spark.createDataFrame(rows, LANDED)


def targets(spark, *keywords):
    return spark.createDataFrame([("c1", list(keywords))], "id string, role_keywords array<string>")


def extract(spark, provider, *bodies, keywords=("intern", "new grad")):
    found = board_payloads.payload_postings(landed(spark, provider, *bodies), provider)
    rows = dedup.dedup_board_postings(postings.wanted_postings(found, targets(spark, *keywords)))
    return sorted(rows.collect(), key=lambda r: r.canonical_url)


def test_greenhouse(spark):
    body = {"jobs": [
        {"id": 1, "title": " Software Engineering Intern (2027 Start) - Winter ", "absolute_url": "https://x.com/job/1",
         "content": "&lt;p&gt;Build distributed &amp;amp; data systems.&lt;/p&gt;", "location": {"name": "Mountain View, California"},
         "offices": [{"name": "Bellevue, Washington", "location": "Bellevue, Washington"},
                     {"name": "HQ", "location": {"name": "Austin, TX"}}],
         "departments": [{"name": "Eng"}, {"name": ""}, {"name": "University"}]},
        {"title": "Software Intern", "absolute_url": " "},
        {"title": "Senior Accountant", "absolute_url": "https://x.com/job/2"},
    ]}
    (job,) = extract(spark, "GREENHOUSE", body)
    assert job.title == "Software Engineering Intern (2027 Start) - Winter"
    assert job.description == "Build distributed & data systems."
    assert job.locations == ["Mountain View, California", "Bellevue, Washington", "Austin, TX", "HQ"]
    assert (job.employment_type, job.extraction_confidence) == ("INTERNSHIP", 0.99)
    assert job.application_url == job.canonical_url == "https://x.com/job/1"


def test_jibe(spark):
    body = {"jobs": [
        {"data": {"slug": "k-31", "title": "Compiler Intern", "description": "<p>Write a linker.</p>", "apply_url": "https://apply.example/k-31",
                  "city": "Salem", "state": "Oregon", "country": "Elsewhere", "country_code": "US",
                  "additional_locations": [{"city": "Reno", "state": "Nevada", "country": "USA"}]}},
        {"data": {"req_id": "7", "slug": "", "title": "Data Intern", "location_name": " Anywhere ", "full_location": "Anywhere"}},
        {"data": None}, {},
    ]}
    second, first = extract(spark, "JIBE", body)
    assert first.canonical_url == "https://careers.amd.com/jobs/k-31"
    assert first.locations == ["Salem, Oregon, US", "Reno, Nevada, USA"]
    assert first.application_url == "https://apply.example/k-31"
    assert (second.canonical_url, second.locations) == ("https://careers.amd.com/jobs/7", ["Anywhere"])
    assert second.application_url == second.canonical_url


def test_ashby(spark):
    body = {"jobs": [{"title": "Software Engineer Intern", "location": "San Francisco, CA",
                      "secondaryLocations": [{"location": "New York, NY"}, {"location": " San Francisco, CA"}],
                      "descriptionPlain": "Build products", "jobUrl": "https://jobs.ashbyhq.com/ramp/id"}]}
    (job,) = extract(spark, "ASHBY", body)
    assert job.locations == ["San Francisco, CA", "New York, NY"]
    assert job.application_url == "https://jobs.ashbyhq.com/ramp/id"


def test_lever(spark):
    body = [{"text": "Software Engineering Intern", "hostedUrl": "https://jobs.lever.co/s/id", "applyUrl": "https://jobs.lever.co/s/id/apply",
             "descriptionPlain": "Audio", "additionalPlain": "systems ", "categories": {"location": "New York, NY; Boston, MA|", "commitment": "Intern"}}]
    (job,) = extract(spark, "LEVER", body)
    assert job.locations == ["New York, NY", "Boston, MA"]
    assert job.description == "Audio systems"
    assert job.application_url.endswith("/apply")


def test_eightfold(spark):
    body = {"status": 200, "data": {"positions": [
        {"id": 1, "name": "Optics Intern", "standardizedLocations": ["Salem, OR, US"], "locations": ["x"], "department": "Lab", "positionUrl": "/careers/job/1"},
        {"id": 2, "name": "Campus Recruiting Coordinator", "positionUrl": "/careers/job/2"},
        {"id": 3, "name": "Product Manager - Intern Program", "positionUrl": "/careers/job/3"},
        {"id": 4, "name": "Vision Intern", "standardizedLocations": [], "locations": ["Lod"], "positionUrl": "/careers/job/4"},
    ]}}
    first, second = extract(spark, "EIGHTFOLD", body)
    assert (first.canonical_url, first.extraction_confidence) == ("https://jobs.nvidia.com/careers/job/1", 0.98)
    assert first.locations == ["Salem, OR, US"] and second.locations == ["Lod"]


def test_workday(spark):
    body = {"total": 1, "jobPostings": [{"title": "Foundry Intern", "externalPath": "/job/F-8",
            "locationsText": "US, Nevada, Reno | US, Oregon, Salem", "bulletFields": ["Ten weeks", "F-8"]}]}
    (job,) = extract(spark, "WORKDAY", body)
    assert job.canonical_url == "https://intel.wd1.myworkdayjobs.com/job/F-8"
    assert job.locations == ["US, Nevada, Reno", "US, Oregon, Salem"]
    assert job.description == "Ten weeks F-8"


def test_phenom(spark):
    body = {"refineSearch": {"data": {"totalHits": 2, "jobs": [
        {"title": "Switching Intern", "jobId": "s1", "jobUrl": "/global/en/job/s1", "city": "Reno", "state": "Nevada", "country": "USA"},
        {"title": "Data Intern", "jobId": "s2", "location": "Anywhere", "applyUrl": "/apply/s2"},
    ]}}}
    first, second = extract(spark, "PHENOM", body)
    assert first.locations == ["Reno, Nevada, USA"]
    assert second.canonical_url == "https://careers.cisco.com/global/en/job/s2"
    assert second.application_url == "https://careers.cisco.com/apply/s2"


def test_oracle_hcm(spark):
    body = {"items": [
        {"Id": 42, "ExternalTitle": "Software Engineering Intern", "PrimaryLocation": "Austin, Texas, United States", "Locations": " "},
        {"Id": "a b/c!", "Title": "Data Intern"},
        {"Id": 0, "Title": "Zero Intern"},
        {"Title": "No Id Intern"},
    ]}
    urls = [job.canonical_url.rsplit("/", 1)[1] for job in extract(spark, "ORACLE_HCM", body)]
    assert urls == ["0", "42", "a%20b%2Fc!"]


@pytest.mark.parametrize("provider", list(ROUTES))
def test_invalid_payload_is_a_failure(spark, provider):
    bad = '{"jobs": 3, "items": {}, "status": 500, "data": {}}'
    rows = board_payloads.payload_failures(landed(spark, provider, bad, "not json")).collect()
    assert len(rows) == 1 and rows[0].message.endswith("returned an invalid response.")
    wrapped = '{"text": "Intern", "hostedUrl": "https://x.example"}' if provider == "LEVER" else '[{"jobs": [], "items": []}]'
    assert board_payloads.payload_failures(landed(spark, provider, wrapped)).count() == 1
    assert extract(spark, provider, bad) == []


def test_single_scan_over_all_boards(spark):
    mixed = landed(spark, "ASHBY", {"jobs": [{"title": "Intern A", "jobUrl": "https://a.example/1"}]}).unionByName(
        landed(spark, "LEVER", [{"text": "Intern B", "hostedUrl": "https://b.example/1"}], source="other")
    )
    found = board_payloads.payload_postings(mixed)
    assert sorted(r.title for r in found.collect()) == ["Intern A", "Intern B"]
    # One read of the landed rows, whatever the number of boards.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 2


def test_routing(spark):
    rows = [("a", "Databricks", "x.com"), ("b", " STRIPE ", "x.com"), ("c", "Anything", "NVIDIA.com"), ("d", "Stripe", "nvidia.com"),
            ("e", "Intel", "intel.com"), ("f", "Acme", "acme.com"), ("g", "Dell", "dell.com"), ("h", "AMD", "amd.com")]
    routed = boards.route_targets(spark.createDataFrame(rows, "id string, name string, domain string"))
    got = {r.id: (r.provider, r.api_origin, r.site) for r in routed.collect()}
    assert got["a"] == ("GREENHOUSE", None, "databricks") and got["b"][0] == "GREENHOUSE"
    assert got["c"] == got["d"] == ("EIGHTFOLD", "https://jobs.nvidia.com", None)
    assert got["e"] == ("WORKDAY", "https://intel.wd1.myworkdayjobs.com", "External")
    assert got["f"] == ("GENERIC_HTML", None, None)
    assert got["g"][0] == "ORACLE_HCM" and got["h"][1] == "https://careers.amd.com"


def page_numbers(rows):
    return sorted(r.page_no for r in rows.collect())


def test_stitching_by_offset(spark):
    def body(total, n, start=0):
        return {"status": 200, "data": {"count": total, "positions": [{"name": f"Engineering Intern {start + i}", "positionUrl": f"/j/{start + i}"} for i in range(n)]}}

    assert page_numbers(board_payloads.stitch_pages(landed(spark, "EIGHTFOLD", body(2, 1), body(2, 1, 1), body(2, 1, 2)))) == [1, 2]
    assert page_numbers(board_payloads.stitch_pages(landed(spark, "EIGHTFOLD", body(9, 1), body(9, 0), body(9, 1)))) == [1, 2]
    assert page_numbers(board_payloads.stitch_pages(landed(spark, "EIGHTFOLD", *[body(9999, 200)] * 5))) == [1, 2, 3, 4, 5]
    both = landed(spark, "EIGHTFOLD", body(3, 2), body(3, 2, 1), body(3, 1, 9))
    kept = board_payloads.asked_payloads(both, board_payloads.stitch_pages(both), run=("source_id",))
    assert kept.columns == both.columns and kept.count() == 2
    found = dedup.dedup_board_postings(board_payloads.payload_postings(kept))
    assert found.count() == 3


def test_stitching_by_page_and_flag(spark):
    def numbered(total, n):
        return {"totalCount": total, "jobs": [{"data": {"slug": str(i), "title": f"Software Intern {i}"}} for i in range(n)]}

    assert page_numbers(board_payloads.stitch_pages(landed(spark, "JIBE", numbered(11, 10), numbered(11, 1), numbered(11, 1)))) == [1, 2]
    assert page_numbers(board_payloads.stitch_pages(landed(spark, "JIBE", *[numbered(9999, 10)] * 53))) == list(range(1, 54))

    def flagged(more, n):
        return {"hasMore": more, "count": n, "items": [{"Id": i, "Title": "Intern"} for i in range(n)]}

    assert page_numbers(board_payloads.stitch_pages(landed(spark, "ORACLE_HCM", flagged(True, 25), flagged(False, 25), flagged(True, 1)))) == [1, 2]


# ---- pages -----------------------------------------------------------------------------------

MIXED_PAGE = """<html><head>
  <script type="application/ld+json">{"@type":"JobPosting","title":"Tidal Energy Intern","description":"<p>Tune <b>turbines</b>.</p>","url":"https://jobs.example/harbour/tides?utm_medium=page","jobLocation":{"address":{"addressLocality":"Salem","addressRegion":"OR","addressCountry":"US"}}}</script>
  </head><body><p><a href="/team/senior-bookkeeper">Senior Bookkeeper</a></p>
  <a href="https://jobs.example/harbour/new-grad">New Grad Shipwright</a>
  <script>push("[0,"title"],[0,"Sonar Intern"],[0,"href"],[0,"https://jobs.example/harbour/sonar"]")</script>
</body></html>"""


def page_frame(spark, *htmls, base="https://notion.so/careers"):
    rows = [("c1", f"src{i}", base, AT, h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "company_id string, source_id string, source_url string, observed_at timestamp, html string")


def jobs_on(spark, html, *layers, keywords=("intern", "new grad"), keep="lowest"):
    found = postings.wanted_postings(pages.page_postings(page_frame(spark, html), *layers), targets(spark, *keywords))
    return sorted(dedup.dedup_page_postings(found, keep).collect(), key=lambda r: r.canonical_url)


def test_mixed_page(spark):
    jobs = {j.canonical_url: j for j in jobs_on(spark, MIXED_PAGE)}
    assert set(jobs) == {f"https://jobs.example/harbour/{x}" for x in ("tides", "new-grad", "sonar")}
    structured = jobs["https://jobs.example/harbour/tides"]
    assert structured.title == "Tidal Energy Intern"
    assert structured.locations == ["Salem, OR, US"]
    assert structured.description == "Tune turbines."


def links(*pairs):
    return "<!doctype html><html><body>" + "".join(f'<a href="{u}">{t}</a>' for u, t in pairs) + "</body></html>"


def test_education_levels(spark):
    titles = ["Robotics Intern", "Undergraduate Chemistry Intern", "Backend Developer, New Grad", "Graduate Hardware Engineer",
              "Masters Thesis Intern", "PhD Statistics Intern", "MBA Strategy Intern", "Graduate Marketing Intern",
              "High School Robotics Intern", "Early Career Test Engineer"]
    html = links(*[(f"https://job-boards.greenhouse.io/harbour/jobs/{200 + i}", t) for i, t in enumerate(titles)])
    assert [j.title for j in jobs_on(spark, html)] == titles[:4]


def test_noise(spark):
    html = links(
        ("https://job-boards.greenhouse.io/harbour/jobs/11", "International Sales Lead"),
        ("https://job-boards.greenhouse.io/harbour/jobs/12", "Head of Internal Audit"),
        ("https://jobs.ashbyhq.com/harbour/0a0b0c0d-1111-2222-3333-444455556666", "Recruiter, Early Career Hiring"),
        ("https://example.com/programs/campus", "Explore internships"),
        ("https://example.com/day.mp4", "Watch a day with an intern"),
        ("https://job-boards.greenhouse.io/harbour/jobs/13", "Tidal Energy Intern"),
    )
    assert [j.title for j in jobs_on(spark, html)] == ["Tidal Energy Intern"]


def test_app_shell_has_nothing(spark):
    assert jobs_on(spark, "<!doctype html><div id='app'></div>") == []


def test_linked_data_shapes(spark):
    def record(n, **more):
        return {"@type": "JobPosting", "title": f"Intern {n}", "url": f"/jobs/{n}000", **more}

    nested = record(5)
    for _ in range(40):
        nested = {"@type": "Thing", "@graph": [nested]}
    blocks = [
        [record(1), {"@graph": record(2, **{"@type": ["Thing", "JobPosting"]})}],
        {"@graph": [{"@type": "Organization", "title": "Intern X", "url": "/jobs/x"}, record(3, title=" ", name="Named Intern")]},
        nested,
        record(4, jobLocation=[{"address": {"addressLocality": "Austin", "addressRegion": 7}}, {"address": "x"}, "y", {"address": {}}]),
        {**record(6), "url": None},
    ]
    html = "".join(f"<script TYPE='application/ld+json'>{json.dumps(b)}</script>" for b in blocks)
    html += '<script type="application/ld+json">{"@type": "JobPosting", broken</script>'
    found = {j.canonical_url.removeprefix("https://notion.so"): j for j in jobs_on(spark, html, "jsonld", keywords=())}
    assert set(found) == {"/jobs/1000", "/jobs/2000", "/jobs/3000", "/jobs/4000", "/jobs/5000", "/careers"}
    assert found["/jobs/3000"].title == "Named Intern"
    assert found["/jobs/4000"].locations == ["Austin"]


def linked(spark, *blocks):
    """Titles of the records in blocks of linked data."""
    linked_data.allow_repeated_names(spark)
    row = spark.createDataFrame([(list(blocks),)], "b array<string>").select(linked_data.linked_data_records(F.col("b")).alias("r")).first()
    return [r.title for r in row.r]


def test_linked_data_is_read_without_python_in_document_order(spark):
    def record(title, **more):
        return {"@type": "JobPosting", "title": title, **more}

    graph = {"@graph": [record("b"), [record("c", **{"@graph": record("d")})]], "@type": ["Thing", "JobPosting"], "name": "a"}
    assert linked(spark, json.dumps([graph, None, 5, record("e")]), json.dumps(record("f"))) == ["a", "b", "c", "d", "e", "f"]
    deep = record("deep")
    for _ in range(300):
        deep = [{"@graph": deep}]
    assert linked(spark, json.dumps(deep)) == ["deep"]
    html = f'<script type="application/ld+json">{json.dumps(graph)}</script>'
    given = [F.lit(v).alias(n) for n, v in (("company_id", "c"), ("source_id", "s"), ("source_url", "https://a.example"), ("observed_at", AT), ("html", html))]
    plan = pages.page_postings(spark.range(1).select(*given), "jsonld")._jdf.queryExecution().executedPlan().toString()
    assert not any(name in plan for name in ("Python", "ArrowEval", "Pandas"))


def test_odd_linked_data(spark):
    posting = '{"@type":"JobPosting","title":%s}'
    assert linked(spark, posting % '"x"' + " 1", posting % '"y', "", "NaN", "null", '"JobPosting"', "[01]") == []
    assert linked(spark, '{"@type":"JobPosting","title":"first","title":"last"}') == ["last"]
    assert linked(spark, posting % r'"\ud83d!"', posting % r'"\\ud83d 😀 \ude00"') == ["�!", "\\ud83d \U0001F600 �"]
    assert linked(spark, posting % '5,"name":"Name"', posting % "null", '{"\\u0040type":"JobPosting","title":"escaped"}') == ["Name", "", "escaped"]


def test_linked_data_in_comments_and_texts_is_none(spark):
    def block(title, tag="script"):
        return f'<{tag} type="application/ld+json">{{"@type":"JobPosting","title":"{title}","url":"/jobs/{title[0]}"}}</{tag}>'

    html = f"<!-- {block('Ghost Intern')} --><textarea>{block('Text Intern')}</textarea><script>var x = '<!--';</script>{block('Real Intern', 'SCRIPT')}"
    assert [j.title for j in jobs_on(spark, html)] == ["Real Intern"]


def test_serialised_tuples(spark):
    html = r'[0,"Data \"ML\" Intern"],[0,"https:\/\/jobs.example\/acme\/12345?ref=x"] [0,"Web Intern"],[0,"https://acme.example/about"]'
    (job,) = jobs_on(spark, html, "tuple")
    assert (job.title, job.canonical_url, job.extraction_confidence) == ('Data "ML" Intern', "https://jobs.example/acme/12345", 0.7)


def test_keep_rule(spark):
    url = "https://jobs.example/acme/12345"
    html = links((url, "Anchor Intern"), (url + "#x", "Later Intern")) + f'[0,"Tuple Intern"],[0,"{url}"]'
    assert [j.title for j in jobs_on(spark, html)] == ["Later Intern"]
    assert [j.title for j in jobs_on(spark, html, keep="highest")] == ["Tuple Intern"]


def test_anchor_markup(spark):
    html = """<!-- <a href="/jobs/comment">x</a> --><script>var a='<a href="/jobs/script">x</a>';</script>
    <a class=x href='/jobs/one?a=1&amp;b=2'><b>One</b>
      &amp; more</a><a name="no-href">skip</a><a data-href="/no" href=/jobs/two>Two<a href="/jobs/three">Three</a>"""
    rows = pages.page_links(page_frame(spark, html)).orderBy("ordinal").collect()
    assert [(r.href, r.text) for r in rows] == [("/jobs/one?a=1&b=2", "One & more"), ("/jobs/two", "Two"), ("/jobs/three", "Three")]
    assert [r.is_job_detail for r in rows] == [False, False, True]
    assert rows[0].canonical_url == "https://notion.so/jobs/one?a=1&b=2"


def test_admission(spark):
    small, exact, large = "x", "x" * 5_000_000, "x" * 5_000_001
    frame = page_frame(spark, small, exact, large, "\U0001f600" * 2_500_001)
    got = {r.source_id: r.rejection for r in pages.admitted_pages(frame, 5_000_000).collect()}
    assert not pages.admitted_pages(frame).where("rejection is not null").count()
    assert got == {"src0": None, "src1": None, "src2": "Source response exceeded 5 MB.", "src3": "Source response exceeded 5 MB."}


def events_on(spark, *rows):
    """Each row is (url, html, event keywords, events source) of a company of its own."""
    named = [(f"g{i}", *row) for i, row in enumerate(rows)]
    frame = spark.createDataFrame([(c, u, h, AT) for c, u, h, *_ in named], "company_id string, url string, html string, observed_at timestamp")
    watched = spark.createDataFrame([(c, k) for c, _, _, k, _ in named if k is not None], "id string, event_keywords array<string>")
    kinds = "company_id string, id string, kind string, url string"
    sources = spark.createDataFrame([(c, s[0], "EVENTS", s[1]) for c, *_, s in named if s] + [("g0", "other", "CAREERS", "x")], kinds)
    return pages.read_event_pages(frame, watched, sources).collect()


def test_event_page(spark):
    html = '<title>Technical Resume Workshop at Google Toronto</title><meta name="description" content="Applying for internships this semester? Join our workshop.">'
    url = "https://rsvp.withgoogle.com/events/technical-resume-workshop-at-google-toronto"
    (event,) = events_on(spark, (url, html, ["student"], None))
    assert event.rejection is None
    assert (event.title, event.event_type, event.location) == ("Technical Resume Workshop at Google Toronto", "WORKSHOP", "Toronto")
    assert (event.starts_at, event.status, event.format) == (None, "REGISTRATION_OPEN", "IN_PERSON")
    assert event.audience == ["Internship candidates"]
    assert (event.source_id, event.source_url) == ("g0-submitted-events", url)


def test_event_page_fallbacks(spark):
    og = '<meta property="og:title" content=" Online tea "><meta name="description" content=""><meta property="og:description" content="for Students">'
    rows = events_on(
        spark,
        ("https://e.example/1", og, [], ("s9", "https://e.example/")),
        ("https://e.example/2", "<p>no title</p>", ["x"], None),
        ("https://e.example/3", "<title>Tea</title>", ["coffee"], None),
        ("bad url", "<title>Student tea</title>", [], None),
        ("https://e.example/5", "<title>Student tea</title>", None, None),
    )
    got = {r.canonical_url: r for r in rows}
    first = got["https://e.example/1"]
    assert (first.title, first.description, first.format, first.source_id, first.rejection) == ("Online tea", "for Students", "VIRTUAL", "s9", None)
    assert got["https://e.example/2"].rejection == "Event page did not provide a title."
    assert got["https://e.example/3"].rejection == "Event does not match the company event keywords."
    assert got[None].rejection == "Invalid URL"
    assert got["https://e.example/5"].rejection == "The selected company is not in the watchlist."


# ---- strategies ------------------------------------------------------------------------------


def test_a_ninth_board_is_added_without_changing_a_table(spark, tmp_path):
    from rolewatch.plans import discovery
    from rolewatch.sources import landed as landed_files
    from rolewatch.sources import strategies

    def discover(rows):
        read = rows.select("*", F.posexplode_outer(F.from_json("body", "roles array<struct<name:string,link:string>>")["roles"]).alias("record_no", "r"))
        records = postings.eligible(read.select("*", F.col("r.name").alias("title")).where("r is not null")).withColumns({
            "url": F.col("r.link"), "application_url": F.col("r.link"), "description": F.lit(""), "locations": F.array(F.lit("Reno, NV")),
            "raw_type": F.lit(""), "content_fingerprint": F.sha2("title", 256), "extraction_confidence": F.lit(0.9),
        })
        return postings.finish_postings(records, *board_payloads.RECORD_KEY, "scan_id")

    def broken(rows):
        bad = rows.where(F.from_json("body", "roles array<struct<name:string,link:string>>")["roles"].isNull())
        return bad.select("scan_id", "source_id", F.lit("No roles.").alias("message"))

    board = strategies.Strategy("HARBOUR", lambda t: F.lower(t["domain"]).endswith(".harbour"), discover, broken)
    companies = spark.createDataFrame([("c1", "Pier", "pier.harbour"), ("c2", "Stripe", "stripe.com"), ("c3", "Nobody", "no.example")], "id string, name string, domain string")
    routed = {r.id: r.provider for r in strategies.route(companies, [board]).collect()}
    assert routed == {"c1": "HARBOUR", "c2": {r.id: r.provider for r in boards.route_targets(companies).collect()}["c2"], "c3": "GENERIC_HTML"}
    with pytest.raises(ValueError):
        strategies.route(companies, [board, board])

    good = json.dumps({"roles": [{"name": "Crane Intern", "link": "https://pier.harbour/1"}, {"name": "Senior Pilot", "link": "https://pier.harbour/2"}]})
    rows = [
        ("s", "c1", "h1", "https://pier.harbour", "HARBOUR", None, None, 0, 1, AT, good),
        ("s", "c1", "h2", "https://pier.harbour/x", "HARBOUR", None, None, 0, 1, AT, "{}"),
        ("s", "c1", "a1", "https://pier.example", "ASHBY", None, None, 0, 1, AT, json.dumps({"jobs": [{"title": "Rope Intern", "jobUrl": "https://jobs.ashbyhq.com/p/1", "location": "Reno, NV"}]})),
    ]
    folder = str(tmp_path / "landed")
    landed_files.write_landed(spark.createDataFrame(rows, LANDED), folder)
    watched = spark.createDataFrame([("c1", [])], "id string, role_keywords array<string>")
    outcome = discovery.scan(landed_files.read_landed(spark, folder), watched, [board])
    assert sorted(r.title for r in outcome.postings.collect()) == ["Crane Intern", "Rope Intern"]
    assert {r.source_id: (r.status, r.message) for r in outcome.results.collect()} == {"h1": ("SUCCESS", None), "h2": ("FAILED", "No roles."), "a1": ("SUCCESS", None)}
    one = landed_files.read_landed(spark, folder, ["ASHBY"])
    assert one.count() == 1
    (scan,) = [line for line in one._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line]
    assert "ASHBY" in scan.partition("PartitionFilters:")[2].partition("]")[0]


def test_event_import_turns_pages_down_before_reading_them(spark):
    from rolewatch.plans import event_import
    from rolewatch.schemas import EVENT

    def page(company, url, title, at=AT):
        return (company, url, f"<title>{title}</title><meta name=description content='for students'>", at)

    ok = "https://rsvp.withgoogle.com/events/"
    rows = [
        page("c1", ok + "a", "Student Hackathon"), page("c1", ok + "a", "Student Hackathon, second", datetime(2026, 8, 21)), page("c1", ok + "b", ""),
        page("nobody", ok + "c", "Student Hackathon"), page("c1", "https://rsvp.withgoogle.com/other/d", "Student Hackathon"),
        page("c1", "http://rsvp.withgoogle.com/events/e", "Student Hackathon"), page("c1", "no url", "Student Hackathon"),
        page(None, ok + "f", "Student Hackathon"), page("c1", None, "Student Hackathon"), ("c1", ok + "g", "<title>Sales Dinner</title>", AT),
    ]
    given = spark.createDataFrame(rows, "company_id string, url string, html string, observed_at timestamp")
    companies = spark.createDataFrame([("c1", "Pier", ["hackathon"])], "id string, name string, event_keywords array<string>")
    sources = spark.createDataFrame([], "id string, company_id string, kind string, url string")
    stored = spark.createDataFrame([], EVENT)
    done = event_import.import_events(given, companies, sources, stored)
    (event,) = done.events.collect()
    assert (event.title, event.change_kind, event.canonical_url) == ("Student Hackathon, second", "NEW", ok + "a")
    reasons = {(r.company_id, r.url): r.reason for r in done.rejected.collect()}
    assert reasons == {
        ("c1", ok + "b"): "Event page did not provide a title.", ("nobody", ok + "c"): "The selected company is not in the watchlist.",
        **{("c1", u): event_import.NOT_ALLOWED for u in ("https://rsvp.withgoogle.com/other/d", "http://rsvp.withgoogle.com/events/e", "no url")},
        (None, ok + "f"): event_import.INCOMPLETE, ("c1", None): event_import.INCOMPLETE,
        ("c1", ok + "g"): "Event does not match the company event keywords.",
    }
    assert done.messages.count() == 1
    again = event_import.import_events(given, companies, sources, done.events.drop("change_kind"))
    assert again.messages.count() == 0 and again.events.count() == 1
    small = event_import.import_events(given, companies, sources, stored, max_units=5)
    assert small.events.count() == 0 and small.rejected.where("reason like '%5 MB%'").count() == 5
