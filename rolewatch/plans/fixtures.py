"""Views over the given tables that have the shapes the operators expect.

A view is a base table and a list of (name, expression).  The expressions are SQL both Spark and the
checking database understand; the few spellings that differ come from a ``Dialect``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One title or place per rule of the classifiers and its near misses.
TITLES = [
    "Robotics Intern", "Undergraduate Chemistry Intern", "Backend Developer, New Grad",
    "Graduate Hardware Engineer", "Masters Thesis Intern", "PhD Statistics Intern",
    "MBA Strategy Intern", "Graduate Marketing Intern", "High School Robotics Intern",
    "Early Career Test Engineer", "Head of Internal Audit", "International Sales Lead",
    "Recruiter, Early Career Hiring", "Explore internships", "Watch a day with an intern",
    "Campus Recruiting Coordinator", "Product Manager - Intern Program",
    "Firmware Co-op", "Entry-Level C++ Programmer", "Senior Bookkeeper", "Apprentice Welder",
    "Graduate Program Actuary", "Internships for Students", "Compiler Design Internship",
]
EVENT_TITLES = [
    "Portfolio Workshop at Google Lisbon", "Autumn Hackathon", "Office Hours for Apprentices",
    "Information Session at Delft", "Rust Conference", "Networking Night at Google Vienna",
    "University Recruiting Week", "Board Game Party", "Info session by phone", "Virtual Alumni Meetup at Oslo",
]
LOCATIONS = [
    ["Salem, OR, US"], ["United States, Nevada, Reno"], ["Reno, Nevada"],
    ["Boise, ID"], ["Gary, IN"], ["Pune, MH, IN"], ["Galway, CO, IE"], ["Delft, ZH, NL"],
    ["Lod, Central District, IL"], ["Guelph, ON, CA"], ["ME", "Anywhere"], ["Anywhere"], [],
    ["Anywhere, U.S.A."], ["boise, id"], ["write to us"], ["Salem, OR; Guelph, ON, CA", "Anywhere"],
]
ROLE_KEYWORDS = [
    [], ["Intern "], ["intern", "new grad"], ["software", "intern"], ["university", "Data", "data"],
    ["c++", "embedded"], ["graduate"], ["", " "],
]
EVENT_KEYWORDS = [[], ["campus"], ["student", "Tea"], ["hack"]]
CRONS = [
    "* * * * *", "*/15 9-17 * * 1-5", "0 * * * *", "30 14 1 * 0", "5/15 * * * *", "* * * * 7", "not a cron",
    "0,30 */6 * * *", "10-20/5 12 * 1-6 *", "60 * * * *", "* * 31 12 *", "*/0 * * * *",
]
NAMES = ["Stripe", " AMD ", "Ramp", "spotify", "Intel", "Cisco", "Dell", "Nvidia Corp", "Google", "Notion"]
DOMAINS = ["stripe.com", "amd.com", "ramp.com", "spotify.com", "intel.com", "cisco.com", "dell.com", "NVIDIA.com", "google.com", "notion.com"]


@dataclass(frozen=True)
class Dialect:
    """Spellings that differ between the two SQL engines."""

    array: Callable[[str], str]
    empty: str
    get: Callable[[str, str], str]
    hours: Callable[[str], str]
    div: Callable[[str, int], str]
    stamp: str

    def texts(self, values: list[str]) -> str:
        if not values:
            return self.empty
        return self.array(", ".join("'" + v.replace("'", "''") + "'" for v in values))

    def pick(self, values: list, index: str) -> str:
        """The element of a constant list at ``index`` modulo its length."""
        if values and isinstance(values[0], list):
            items = self.array(", ".join(self.texts(v) for v in values))
        else:
            items = self.texts(values)
        return self.get(items, f"({index}) % {len(values)} + 1")


SPARK = Dialect(
    array=lambda items: f"array({items})",
    empty="cast(array() as array<string>)",
    get=lambda items, i: f"element_at({items}, cast({i} as int))",
    hours=lambda n: f"make_dt_interval(0, cast({n} as int), 0, 0)",
    div=lambda x, n: f"(({x}) div {n})",
    stamp="timestamp_ntz",
)
DUCK = Dialect(
    array=lambda items: f"[{items}]",
    empty="CAST([] AS VARCHAR[])",
    get=lambda items, i: f"list_extract({items}, {i})",
    hours=lambda n: f"to_hours(CAST({n} AS BIGINT))",
    div=lambda x, n: f"(({x}) // {n})",
    stamp="timestamp",
)

Columns = list[tuple[str, str]]


def _targets(d: Dialect) -> Columns:
    k = "c_custkey % 20"
    return [
        ("id", "concat('t', c_custkey)"),
        ("name", f"case when {k} < 10 then {d.pick(NAMES, k)} else c_name end"),
        ("domain", f"case when {k} < 10 then {d.pick(DOMAINS, k)} else concat('c', c_custkey, '.example') end"),
        ("priority", d.pick(["HIGH", "MEDIUM", "LOW"], "c_custkey")),
        ("role_keywords", d.pick(ROLE_KEYWORDS, "c_custkey")),
        ("event_keywords", d.pick(EVENT_KEYWORDS, "c_custkey")),
        ("created_at", f"{d.stamp} '2026-01-01 00:00:00' + {d.hours('c_custkey % 100')}"),
        ("n", "c_custkey"),
    ]


def _sources(d: Dialect) -> Columns:
    return [
        ("id", "concat('s', c_custkey, '-', kind_no)"),
        ("company_id", "concat('t', c_custkey)"),
        ("kind", d.pick(["CAREERS", "EARLY_CAREERS", "EVENTS"], "kind_no")),
        ("url", "concat('https://c', c_custkey, '.example/', kind_no)"),
        ("enabled", "c_custkey % 7 <> 3"),
        ("scan_cron", d.pick(CRONS, "c_custkey + kind_no")),
    ]


def _postings(d: Dialect) -> Columns:
    return [
        ("id", "concat('p', c_custkey)"),
        ("company_id", f"concat('t', {d.div('c_custkey', 3)})"),
        ("source_id", f"concat('s', {d.div('c_custkey', 3)}, '-0')"),
        ("source_url", f"concat('https://c', {d.div('c_custkey', 3)}, '.example/0')"),
        ("canonical_url", "concat('https://jobs.example/', c_custkey)"),
        ("application_url", "concat('https://jobs.example/', c_custkey, '/apply')"),
        ("title", d.pick(TITLES, "c_custkey")),
        ("description", "concat('Segment ', c_mktsegment)"),
        ("locations", d.pick(LOCATIONS, "c_custkey")),
        ("employment_type", d.pick(["INTERNSHIP", "NEW_GRAD", "EARLY_CAREER", "OTHER"], "c_custkey")),
        ("first_seen_at", f"{d.stamp} '2026-02-01 00:00:00'"),
        ("last_seen_at", f"{d.stamp} '2026-02-01 00:00:00' + {d.hours('c_custkey % 240')}"),
        ("content_fingerprint", "concat('f', c_custkey % 9)"),
        ("extraction_confidence", "(50 + c_custkey % 50) / 100.0"),
        ("active", "c_custkey % 5 <> 0"),
        ("missed_scans", "case when c_custkey % 5 = 0 then 2 when c_custkey % 7 = 0 then 1 else 0 end"),
    ]


def _events(d: Dialect) -> Columns:
    return [
        ("id", "concat('e', s_suppkey)"),
        ("company_id", "concat('t', s_suppkey)"),
        ("source_id", "concat('t', s_suppkey, '-submitted-events')"),
        ("source_url", "concat('https://e.example/', s_suppkey)"),
        ("canonical_url", "concat('https://e.example/', s_suppkey)"),
        ("registration_url", "concat('https://e.example/', s_suppkey)"),
        ("title", d.pick(EVENT_TITLES, "s_suppkey")),
        ("description", "concat('Hosted by ', s_name)"),
        ("event_type", d.pick(["WORKSHOP", "HACKATHON", "OFFICE_HOURS", "CAMPUS_RECRUITING"], "s_suppkey")),
        ("starts_at", f"case when s_suppkey % 3 = 0 then {d.stamp} '2026-03-01 17:05:00' + {d.hours('s_suppkey % 500')} end"),
        ("ends_at", f"cast(null as {d.stamp})"),
        ("timezone", "'America/Toronto'"),
        ("format", d.pick(["IN_PERSON", "VIRTUAL"], "s_suppkey")),
        ("location", "case when s_suppkey % 4 = 0 then s_name end"),
        ("registration_deadline", f"cast(null as {d.stamp})"),
        ("audience", d.texts(["Early-career candidates"])),
        ("status", d.pick(["REGISTRATION_OPEN", "ANNOUNCED", "FULL"], "s_suppkey")),
        ("first_seen_at", f"{d.stamp} '2026-02-01 00:00:00'"),
        ("last_seen_at", f"{d.stamp} '2026-02-01 00:00:00' + {d.hours('s_suppkey % 50')}"),
        ("content_fingerprint", "concat('f', s_suppkey % 4)"),
        ("extraction_confidence", "0.8"),
        ("active", "s_suppkey % 9 <> 0"),
    ]


def _changes(d: Dialect) -> Columns:
    return [
        ("id", "concat('c', o_orderkey)"),
        ("job_id", "concat('p', o_custkey)"),
        ("company_id", f"concat('t', {d.div('o_custkey', 3)})"),
        ("kind", "case when o_orderkey % 3 = 0 then 'UPDATED' else 'NEW' end"),
        ("created_at", f"o_orderdate + {d.hours('o_orderkey % 24')}"),
        ("read_at", f"case when o_orderstatus = 'F' then o_orderdate + {d.hours('48')} end"),
    ]


def _deliveries(d: Dialect) -> Columns:
    return [
        ("id", "concat('d', o_orderkey)"),
        ("change_id", "concat('c', o_orderkey)"),
        ("channel", "case when o_orderkey % 11 = 0 then 'EMAIL' else 'DISCORD' end"),
        ("status", "case o_orderstatus when 'F' then 'SENT' when 'O' then 'PENDING' else 'FAILED' end"),
        ("attempts", "cast(o_orderkey % 6 as int)"),
        ("next_attempt_at", f"o_orderdate + {d.hours('24 * (o_orderkey % 6)')}"),
        ("last_error", "case when o_orderstatus not in ('F', 'O') then o_orderpriority end"),
        ("external_id", "case when o_orderstatus = 'F' then concat('x', o_orderkey) end"),
        ("created_at", f"o_orderdate + {d.hours('o_orderkey % 24')}"),
        ("updated_at", "o_orderdate"),
    ]


# One row per (user, event type, day) of ``events``: the latest event stands for the sighting.  A user
# is a company with two sources, and the source that wins alternates from day to day.
OBSERVATION_DAY = "cast(date_trunc('day', ts) as {stamp})"


def _observations(d: Dialect) -> Columns:
    return [
        ("company_id", "concat('u', user_id)"),
        ("canonical_url", "concat('https://jobs.example/', event_type)"),
        ("source_id", "concat('s', (user_id % 10) * 2 + event_id % 2)"),
        ("seen_at", OBSERVATION_DAY.format(stamp=d.stamp)),
        ("event_id", "event_id"),
        ("mark", "cast(event_id % 3 as int)"),
        ("day_no", "cast(day(ts) as int)"),
    ]


# Scans of these (source number, day) pairs failed, so their sightings never arrived.
def failed_scan(source: str, day: str) -> str:
    return f"(cast(substr({source}, 2) as int) + {day}) % 7 = 0"


VIEWS: dict[str, tuple[str, Callable[[Dialect], Columns]]] = {
    "v_targets": ("customer", _targets),
    "v_postings": ("customer", _postings),
    "v_events": ("supplier", _events),
    "v_changes": ("orders", _changes),
    "v_deliveries": ("orders", _deliveries),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Use all cores when the input has fewer splits than there are: parsing is CPU-bound."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def dealt(rows: DataFrame, tasks: int = 4) -> DataFrame:
    """Narrow rows dealt out over ``tasks`` tasks per core: a file has no more useful splits than row groups, however many the reader plans."""
    return rows.repartition(tasks * rows.sparkSession.sparkContext.defaultParallelism)


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    base, columns = VIEWS[name]
    return table(spark, folder, base).selectExpr(*[f"{e} as {n}" for n, e in columns(SPARK)])


def sources(spark: SparkSession, folder: str) -> DataFrame:
    kinds = table(spark, folder, "customer").selectExpr(
        "c_custkey", "explode(sequence(0, cast(c_custkey % 3 as int))) as kind_no"
    )
    return kinds.selectExpr(*[f"{e} as {n}" for n, e in _sources(SPARK)])


def observations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").selectExpr(*[f"{e} as {n}" for n, e in _observations(SPARK)])
    latest = rows.groupBy("company_id", "canonical_url", "seen_at").agg(
        F.max(F.struct("event_id", "source_id", "mark", "day_no")).alias("r")
    )
    return latest.select("company_id", "canonical_url", "seen_at", "r.*")


def scans(spark: SparkSession, folder: str) -> DataFrame:
    """Successful scans, one per source and day."""
    rows = observations(spark, folder).where(f"not ({failed_scan('source_id', 'day_no')})")
    return rows.select("source_id", F.col("seen_at").alias("scanned_at")).distinct()


def sightings(spark: SparkSession, folder: str) -> DataFrame:
    """Observations of successful scans as postings."""
    rows = observations(spark, folder).where(f"not ({failed_scan('source_id', 'day_no')})")
    return rows.selectExpr(
        "substring(sha2(concat(company_id, chr(31), canonical_url), 256), 1, 24) as id",
        "company_id",
        "source_id",
        "concat('https://', source_id, '.example') as source_url",
        "canonical_url",
        "canonical_url as application_url",
        "concat('Intern ', mark) as title",
        "'' as description",
        "cast(array() as array<string>) as locations",
        "'INTERNSHIP' as employment_type",
        "seen_at as first_seen_at",
        "seen_at as last_seen_at",
        "concat('f', mark) as content_fingerprint",
        "0.9 as extraction_confidence",
    )


# ---- payloads --------------------------------------------------------------------------------

PAGE_SIZE = 10

# JSON text of one record per board, from a row of ``part`` and its title ``t``.
_N = "p_partkey"
RECORDS: dict[str, str] = {
    "GREENHOUSE": f"""concat('{{"title":" ', t, ' ","absolute_url":"https://g.example/', {_N}, '","content":"&lt;p&gt;', p_name, ' &amp;amp; more&lt;/p&gt;","location":{{"name":"', p_brand, '"}},"offices":[{{"name":"HQ","location":{{"name":"', p_type, '"}}}},{{"name":"HQ","location":"Austin, TX"}}],"departments":[{{"name":"Eng"}},{{"name":"', p_type, '"}}]}}')""",
    "JIBE": f"""concat('{{"data":{{"slug":"', {_N}, '","title":"', t, '","description":"<p>', p_name, '</p>","city":"', p_brand, '","state":"","country":"United States","country_code":"US","additional_locations":[{{"location_name":" Remote "}}],"full_location":"', p_type, '"}}}}')""",
    "ASHBY": f"""concat('{{"title":"', t, '","location":"', p_brand, '","secondaryLocations":[{{"location":"Remote"}},{{"location":"', p_brand, ' "}}],"descriptionPlain":"', p_name, '","jobUrl":"https://a.example/', {_N}, '","applyUrl":"https://a.example/', {_N}, '/apply","department":"', p_type, '","employmentType":"FullTime"}}')""",
    "LEVER": f"""concat('{{"text":"', t, '","descriptionPlain":"', p_name, '","additionalPlain":"extra","hostedUrl":"https://l.example/', {_N}, '","categories":{{"location":"', p_brand, '; Boston, MA| ","commitment":"', p_type, '"}}}}')""",
    "EIGHTFOLD": f"""concat('{{"id":', {_N}, ',"name":"', t, '","locations":["', p_brand, '"],"standardizedLocations":', case when {_N} % 2 = 0 then '[]' else '["Austin, TX, US"]' end, ',"department":"', p_name, '","positionUrl":"/careers/job/', {_N}, '"}}')""",
    "WORKDAY": f"""concat('{{"title":"', t, '","externalPath":"/job/R', {_N}, '","locationsText":"', p_brand, ' | US, Oregon; Remote","bulletFields":["', p_name, '","R', {_N}, '"]}}')""",
    "PHENOM": f"""concat('{{"title":"', t, '","jobId":"', {_N}, '","city":"', p_brand, '","state":"California","country":"United States","location":"', p_type, '","description":" ', p_name, ' ","category":"', p_type, '"}}')""",
    "ORACLE_HCM": f"""concat('{{"Id":', {_N}, ',"Title":"x","ExternalTitle":"', t, '","PrimaryLocation":"', p_brand, '","Locations":"', p_type, '","JobFunction":"', p_type, '","ShortDescriptionStr":"', p_name, '"}}')""",
}
ENVELOPES: dict[str, tuple[str, str]] = {
    "GREENHOUSE": ('{"jobs":[', "]}"),
    "JIBE": ('{"totalCount":25,"jobs":[', "]}"),
    "ASHBY": ('{"jobs":[', "]}"),
    "LEVER": ("[", "]"),
    "EIGHTFOLD": ('{"status":200,"data":{"count":25,"positions":[', "]}}"),
    "WORKDAY": ('{"total":25,"jobPostings":[', "]}"),
    "PHENOM": ('{"refineSearch":{"data":{"totalHits":25,"jobs":[', "]}}}"),
    "ORACLE_HCM": ('{"hasMore":true,"count":10,"items":[', "]}"),
}
ORIGINS = {"JIBE": "https://careers.amd.com", "EIGHTFOLD": "https://jobs.nvidia.com", "WORKDAY": "https://intel.wd1.myworkdayjobs.com", "PHENOM": "https://careers.cisco.com", "ORACLE_HCM": "https://enterpriseplatform.dell.com"}
SITES = {"WORKDAY": "External", "ORACLE_HCM": "careers"}
OBSERVED_AT = "2026-08-20 12:00:00"


def payloads(spark: SparkSession, folder: str, provider: str) -> DataFrame:
    """Landed bodies of one board: ten parts per page, five pages per source."""
    head, tail = ENVELOPES[provider]
    records = (
        table(spark, folder, "part")
        .selectExpr("*", f"{SPARK.pick(TITLES, 'p_partkey')} as t", "p_partkey div 10 as page")
        .selectExpr("page", "p_partkey", f"{RECORDS[provider]} as record")
    )
    # Ten records per page by construction, so the collected group is bounded.
    pages = records.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "record"))).alias("r"))
    body = F.concat(F.lit(head), F.array_join("r.record", ","), F.lit(tail))
    return pages.select(
        F.lit("scan").alias("scan_id"),
        F.expr("concat('t', page div 5)").alias("company_id"),
        F.expr("concat('b', page div 5)").alias("source_id"),
        F.lit("https://b.example").alias("source_url"),
        F.lit(provider).alias("provider"),
        F.lit(ORIGINS.get(provider)).cast("string").alias("api_origin"),
        F.lit(SITES.get(provider)).cast("string").alias("site"),
        F.lit(0).alias("query_no"),
        F.expr("cast(page % 5 + 1 as int)").alias("page_no"),
        F.expr(f"timestamp_ntz '{OBSERVED_AT}'").alias("observed_at"),
        # Every 13th page came back broken.
        F.when(F.expr("page % 13 = 12"), F.lit('{"error":"busy"}')).otherwise(body).alias("body"),
    )


# ---- pages -----------------------------------------------------------------------------------


def rich_head(d: Dialect) -> str:
    """Markup put before the end of a page's head: linked data, meta elements, serialised records."""
    t = d.pick(TITLES, "page_id")
    event = d.pick(EVENT_TITLES, "page_id")
    return f"""concat(
        '<script type="application/ld+json">{{"@context":"https://schema.org","@graph":[{{"@type":["JobPosting","Thing"],"title":" ', {t},
        ' ","description":"<p>Build &amp; ship #', page_id, '</p>","employmentType":"INTERN","url":"/jobs/ld-', page_id,
        '?utm_source=x&k=1","jobLocation":{{"address":{{"addressLocality":"Austin","addressRegion":" ","addressCountry":"US"}}}}}},{{"@type":"Organization","name":"Acme"}}]}}</script>',
        '<meta property="og:title" content="', {event}, '"><meta name="description" content="',
        case when page_id % 4 = 0 then '' else concat('For students, no. ', page_id) end, '"><meta property="og:description" content="online">',
        '<script>push([1,"[0,"title"],[0,"', {t}, '"],[0,"href"],[0,"/careers/pair-', page_id, '"]"])</script>',
        '<script>x=[0,"', {t}, '"],[0,"https:', chr(92), '/', chr(92), '/jobs.example.com', chr(92), '/acme', chr(92), '/tuple-', page_id, '"]</script>')"""


def rich_body(d: Dialect) -> str:
    t = d.pick(TITLES, "page_id")
    return f"""concat('<a class="job" href="https://job-boards.greenhouse.io/acme/jobs/', 100000 + page_id, '?ref=x"><b>', {t},
        '</b></a><a href="/careers/pair-', page_id, '#top">not a detail link</a>',
        '<a href="https://jobs.example.com/acme/tuple-', page_id, '">', {t}, '  </a>')"""


def rich_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``pages`` with recruiting markup added; page n belongs to company t(n mod 97)."""
    html = f"replace(replace(html, '</head>', concat({rich_head(SPARK)}, '</head>')), '</footer>', concat({rich_body(SPARK)}, '</footer>'))"
    return spread(table(spark, folder, "pages")).selectExpr(
        "page_id",
        "concat('t', page_id % 97) as company_id",
        "concat('w', page_id) as source_id",
        "url as source_url",
        f"timestamp_ntz '{OBSERVED_AT}' as observed_at",
        f"{html} as html",
    )
