"""Named queries over the given tables, one or more per operator.

Results are flat: arrays are joined to strings and timestamps printed, so that any SQL engine can be
asked for the same table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, cron, ids, payloads, places, text, urls
from ..operators import dedup, feed, inbox, outbox, replay, schedule, scans, snapshot, watchlist
from ..operators.shaping import winners
from ..session import ensure_checkpoint_dir
from ..sources import board_payloads, boards, pages, postings, presets
from . import discovery, event_import
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = "1998-06-15 12:00:00"
STAMP = "yyyy-MM-dd HH:mm:ss"
SNAPSHOT_DAY = 24


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def flat(df: DataFrame) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        kind, column = field.dataType.simpleString(), F.col(field.name)
        if kind == "array<string>":
            column = F.array_join(column, "|")
        elif kind.startswith("timestamp"):
            column = F.date_format(column, STAMP)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def stamp(value: str) -> Column:
    return F.expr(f"timestamp_ntz '{value}'")


def sources_text(column: str = "sources") -> Column:
    parts = F.transform(column, lambda s: F.concat_ws(",", s["id"], s["kind"], s["url"], s["enabled"].cast("string"), s["scan_cron"]))
    return F.array_join(parts, "|")


def pick(values: list, index: str) -> Column:
    return F.expr(fx.SPARK.pick(values, index))


# ---- watchlist and routing -------------------------------------------------------------------


@query
def watchlist_nested(spark: SparkSession, d: str) -> DataFrame:
    listed = watchlist.watchlist(fx.view(spark, d, "v_targets").drop("n"), fx.sources(spark, d))
    return flat(listed.withColumn("sources", sources_text()))


@query
def provider_route(spark: SparkSession, d: str) -> DataFrame:
    return boards.route_targets(fx.view(spark, d, "v_targets").select("id", "name", "domain"))


@query
def discovery_queries(spark: SparkSession, d: str) -> DataFrame:
    return watchlist.queries_per_target(fx.view(spark, d, "v_targets"))


@query
def watchlist_preview(spark: SparkSession, d: str) -> DataFrame:
    return flat(watchlist.preview(fx.view(spark, d, "v_targets"), fx.sources(spark, d)))


@query
def watchlist_conflicts(spark: SparkSession, d: str) -> DataFrame:
    targets = fx.view(spark, d, "v_targets")
    # Candidates are suppliers: some reuse a watched name, some a watched domain, some an own id.
    candidates = fx.table(spark, d, "supplier").selectExpr(
        "case when s_suppkey % 5 = 0 then concat('t', s_suppkey) else concat('n', s_suppkey) end as id",
        "case when s_suppkey % 4 = 1 then upper(concat('customer#', lpad(s_suppkey, 9, '0'))) else s_name end as name",
        "case when s_suppkey % 5 in (0, 2) then concat('c', s_suppkey, '.example') when s_suppkey % 7 = 3 then 'stripe.com' else concat('n', s_suppkey, '.example') end as domain",
    )
    return watchlist.conflicts(candidates, targets)


@query
def watchlist_save(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers saved as targets: once without a conflict, and once with conflicts, which leaves the watchlist as it is."""
    stored = fx.view(spark, d, "v_targets").drop("n")
    rows = fx.table(spark, d, "supplier").selectExpr(
        "concat('t', case when s_suppkey % 2 = 0 then s_suppkey else s_suppkey + 100000000 end) as id", "s_name as name",
        "concat('s', s_suppkey, '.example') as domain", "'LOW' as priority", "array('robotics') as role_keywords",
        "cast(array() as array<string>) as event_keywords", "timestamp_ntz '2026-05-05 00:00:00' as created_at",
    )
    repeated = rows.unionByName(rows)
    cases = []
    for name, candidates in (("clean", rows), ("repeated", repeated)):
        saved, found = watchlist.save_targets(stored, candidates)
        kept = saved.select(F.lit(name).alias("case"), "id", "name", "domain", F.lit(None).cast("string").alias("conflict_id"))
        bad = found.select(F.concat(F.lit(name), F.lit(" conflict")).alias("case"), "id", "name", "domain", "conflict_id").distinct()
        cases += [kept, bad]
    return cases[0].unionByName(cases[1]).unionByName(cases[2]).unionByName(cases[3])


@query
def watchlist_merge(spark: SparkSession, d: str) -> DataFrame:
    stored, sources = fx.view(spark, d, "v_targets").drop("n"), fx.sources(spark, d)
    # Suppliers save targets: half replace a stored one, half are new.
    incoming = fx.table(spark, d, "supplier").selectExpr(
        "concat('t', case when s_suppkey % 2 = 0 then s_suppkey else s_suppkey + 100000000 end) as id",
        "s_name as name",
        "concat('s', s_suppkey, '.example') as domain",
        "'LOW' as priority",
        "array('robotics') as role_keywords",
        "cast(array() as array<string>) as event_keywords",
        "timestamp_ntz '2026-05-05 00:00:00' as created_at",
    )
    new_sources = incoming.selectExpr(
        "concat('new-', id) as id", "id as company_id", "'CAREERS' as kind", "concat('https://', domain) as url",
        "true as enabled", "'0 * * * *' as scan_cron",
    )
    merged = watchlist.merge_targets(stored, incoming)
    kept = watchlist.merge_sources(sources, new_sources, incoming)
    listed = watchlist.watchlist(merged, kept)
    return flat(listed.withColumn("sources", sources_text()))


def target_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Import rows from ``customer``, with every kind of mistake."""
    k = "c_custkey"
    return fx.dealt(fx.table(spark, d, "customer").select(k, "c_name")).select(
        F.col(k).alias("n"),
        F.expr(f"case when {k} % 10 = 3 then '  ' else concat(' ', c_name, ' ') end").alias("name"),
        F.expr(
            f"case {k} % 9 when 0 then concat('https://Acme', {k}, '.test/') when 1 then 'a.test//' when 2 then '' "
            f"else concat('acme', {k}, '.test') end"
        ).alias("domain"),
        F.expr(
            f"case {k} % 8 when 0 then 'file:///careers' when 1 then '' when 2 then 'nope' "
            f"else concat(' HTTPS://Acme', {k}, '.test/jobs ') end"
        ).alias("career_url"),
        F.lit(None).cast("string").alias("early_careers_url"),
        F.expr(f"case {k} % 3 when 0 then concat('https://acme', {k}, '.test/events') when 1 then 'ftp://x' end").alias("events_url"),
        F.expr(f"case when {k} % 2 = 0 then 'HIGH' end").alias("priority"),
        pick(fx.ROLE_KEYWORDS, k).alias("role_keywords"),
        pick(fx.EVENT_KEYWORDS, k).alias("event_keywords"),
        F.expr(f"case when {k} % 4 = 1 then null else {fx.SPARK.pick(fx.CRONS, k)} end").alias("scan_cron"),
    )


@query
def import_targets(spark: SparkSession, d: str) -> DataFrame:
    checked = watchlist.validate_targets(target_inputs(spark, d))
    return flat(checked.withColumn("sources", sources_text()))


@query
def target_requests(spark: SparkSession, d: str) -> DataFrame:
    nested = watchlist.nest_sources(fx.sources(spark, d)).withColumnRenamed("company_id", "id")
    targets = fx.view(spark, d, "v_targets").join(nested, "id")
    # Every second hundred comes as one request, which is too large; some targets lack a domain.
    requests = targets.selectExpr(
        "concat('r', case when (n div 100) % 2 = 0 then n div 100 else 1000000 + n div 20 end) as request_id",
        "* except (domain)",
        "case when n % 171 <> 170 then domain end as domain",
    )
    return watchlist.admit_requests(requests, limit=50).select("request_id", "id", "admitted")


@query
def watchlist_edit(spark: SparkSession, d: str) -> DataFrame:
    edits = watchlist.validate_targets(target_inputs(spark, d)).where(F.size("errors") == 0)
    edits = edits.withColumn("target_id", F.concat(F.lit("t"), "n"))
    edited = watchlist.edit_targets(fx.view(spark, d, "v_targets"), fx.sources(spark, d), edits)
    return flat(edited.withColumn("sources", sources_text()))


@query
def preset_additions(spark: SparkSession, d: str) -> DataFrame:
    targets = fx.view(spark, d, "v_targets")
    return watchlist.absent(presets.presets(spark), targets).select("preset_id", "name", "domain", "career_url")


@query
def preset_missing(spark: SparkSession, d: str) -> DataFrame:
    return watchlist.missing_per_preset(presets.presets(spark), fx.view(spark, d, "v_targets"))


def company_list(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "supplier").selectExpr(
        "s_name as name",
        "case when s_suppkey % 3 = 0 then concat('c', s_suppkey, '.example') else concat('s', s_suppkey, '.example') end as domain",
        "concat('https://s', s_suppkey, '.example/careers') as career_url",
    )


@query
def watchlist_sync(spark: SparkSession, d: str) -> DataFrame:
    added = watchlist.sync_targets(
        company_list(spark, d), fx.view(spark, d, "v_targets"), presets.ROLE_KEYWORDS, presets.SYNC_EVENT_KEYWORDS
    )
    return flat(added.withColumn("sources", sources_text()))


@query
def watchlist_sync_report(spark: SparkSession, d: str) -> DataFrame:
    targets = fx.view(spark, d, "v_targets")
    added = watchlist.sync_targets(company_list(spark, d), targets, presets.ROLE_KEYWORDS, presets.SYNC_EVENT_KEYWORDS)
    return watchlist.sync_report(targets, added)


@query
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    tables = {
        "targets": fx.view(spark, d, "v_targets"),
        "sources": fx.sources(spark, d),
        "postings": fx.view(spark, d, "v_postings"),
        "events": fx.view(spark, d, "v_events"),
        "changes": fx.view(spark, d, "v_changes"),
        "deliveries": fx.view(spark, d, "v_deliveries"),
    }
    kept = watchlist.delete_targets(tables, tables["targets"].where("n % 6 = 1").select("id"))
    rows = None
    for name, df in kept.items():
        part = df.select(F.lit(name).alias("table_name"), "id")
        rows = part if rows is None else rows.unionByName(part)
    return rows


# ---- schedule --------------------------------------------------------------------------------


def cron_cases(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "orders").select(
        "o_orderkey",
        pick(fx.CRONS, "o_orderkey").alias("expr"),
        F.expr("o_orderdate + make_dt_interval(0, 0, cast(o_orderkey * 7 % 1440 as int), 0)").alias("tick"),
    )


@query
def cron_valid(spark: SparkSession, d: str) -> DataFrame:
    return cron_cases(spark, d).select("o_orderkey", "expr", cron.is_valid_cron(F.col("expr")).alias("valid"))


@query
def cron_due(spark: SparkSession, d: str) -> DataFrame:
    due = cron.cron_matches(F.col("expr"), F.col("tick"))
    return flat(cron_cases(spark, d).select("o_orderkey", "expr", "tick", due.alias("due")))


@query
def due_sources(spark: SparkSession, d: str) -> DataFrame:
    return schedule.due_per_target(fx.sources(spark, d), stamp("2026-08-16 14:30:00"))


@query
def scan_batch(spark: SparkSession, d: str) -> DataFrame:
    batch = schedule.scan_batch(fx.view(spark, d, "v_targets"), datetime(2026, 8, 16, 14, 30))
    return batch.select("id", "name", "position", F.col("batch_index").cast("bigint"), F.col("batch_count").cast("bigint"))


@query
def scheduled_batch(spark: SparkSession, d: str) -> DataFrame:
    batch = schedule.scheduled_batch(fx.view(spark, d, "v_targets"), fx.sources(spark, d), datetime(2026, 8, 16, 14, 30))
    return batch.select("company_id", "id", "kind", *[F.col(c).cast("bigint").alias(c) for c in ("position", "batch_index", "batch_count")])


@query
def scan_tasks(spark: SparkSession, d: str) -> DataFrame:
    tasks = schedule.scan_tasks(fx.view(spark, d, "v_targets"), fx.sources(spark, d))
    return tasks.select("company_id", "id", "kind", "url")


@query
def scan_tasks_first(spark: SparkSession, d: str) -> DataFrame:
    """The limits of the original: 25 targets, 5 sources of each."""
    tasks = schedule.scan_tasks(fx.view(spark, d, "v_targets"), fx.sources(spark, d), target_limit=25, source_limit=5)
    return tasks.select("company_id", "id", "kind", "url")


@query
def scheduled_tick(spark: SparkSession, d: str) -> DataFrame:
    return schedule.tick(fx.view(spark, d, "v_targets"), fx.sources(spark, d), datetime(2026, 8, 16, 14, 30))


@query
def scheduled_tick_idle(spark: SparkSession, d: str) -> DataFrame:
    """A minute at which only the schedules that fire always, or at this minute, are due."""
    asleep = fx.sources(spark, d).withColumn("scan_cron", F.when(F.col("scan_cron") == "* * * * *", "0 0 1 1 *").otherwise(F.col("scan_cron")))
    return schedule.tick(fx.view(spark, d, "v_targets"), asleep, datetime(2026, 8, 16, 14, 29))


# ---- scalar functions ------------------------------------------------------------------------


@query
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return fx.table(spark, d, "pages").select("page_id", url, urls.canonical_url(url, url).alias("canonical_url"))


@query
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.col("text"), F.col("lang"), F.expr("case when doc_id % 3 = 0 then null else source end")]
    return fx.table(spark, d, "documents").select("doc_id", ids.fingerprint(*parts).alias("content_fingerprint"))


@query
def posting_id(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://jobs.example/"), "o_orderkey")
    return fx.table(spark, d, "orders").select(
        "o_orderkey", ids.posting_id(F.concat(F.lit("t"), "o_custkey"), url).alias("posting_id")
    )


def titled_documents(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat(pick(fx.TITLES, "doc_id"), F.expr("case doc_id % 5 when 0 then concat(' - ', source) else '' end"))
    return fx.table(spark, d, "documents").select(
        "doc_id",
        title.alias("title"),
        F.expr("case when doc_id % 4 = 0 then 'Intern' when doc_id % 4 = 1 then lang else 'Entry level' end").alias("raw_type"),
        "text",
        pick(fx.ROLE_KEYWORDS, "doc_id").alias("role_keywords"),
        pick(fx.EVENT_KEYWORDS, "doc_id").alias("event_keywords"),
    )


@query
def employment_type(spark: SparkSession, d: str) -> DataFrame:
    kind = classify.employment_type(F.col("title"), F.col("raw_type"))
    return titled_documents(spark, d).select("doc_id", "title", kind.alias("employment_type"))


@query
def eligible_title(spark: SparkSession, d: str) -> DataFrame:
    return titled_documents(spark, d).select("doc_id", "title", classify.is_eligible_title(F.col("title")).alias("eligible"))


@query
def role_match(spark: SparkSession, d: str) -> DataFrame:
    match = classify.matches_keywords(F.col("title"), F.col("text"), F.col("role_keywords"))
    return titled_documents(spark, d).select("doc_id", match.alias("matches"))


@query
def event_match(spark: SparkSession, d: str) -> DataFrame:
    match = classify.is_early_career_event(F.lit("Gathering"), F.col("text"), F.col("event_keywords"))
    return titled_documents(spark, d).select("doc_id", match.alias("matches"))


@query
def us_location(spark: SparkSession, d: str) -> DataFrame:
    return fx.view(spark, d, "v_postings").select("id", places.is_us_location(F.col("locations")).alias("is_us"))


URL_SHAPES = [
    "https://job-boards.greenhouse.io/acme/jobs/", "https://jobs.lever.co/acme/0123456789abcdef0123-", "https://acme.example/career-programs/university/",
    "https://acme.example/jobs/search?x=", "https://jobs.acme.example/teams/eng-", "https://acme.example/job_details/", "https://acme.example/about/",
    "https://acme.example/job/abc", "https://acme.example/details/",
]


@query
def job_detail_url(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(pick(URL_SHAPES, "c_custkey"), F.expr("case when c_custkey % 10 = 4 then 'film.mp4' else cast(c_custkey as string) end"))
    rows = fx.table(spark, d, "customer").select("c_custkey", url.alias("url"))
    return rows.select("c_custkey", "url", urls.is_job_detail_url(F.col("url")).alias("is_detail"))


@query
def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    return fx.spread(fx.table(spark, d, "pages")).select("page_id", text.strip_markup(F.col("html")).alias("text"))


@query
def clean_keywords(spark: SparkSession, d: str) -> DataFrame:
    words = F.concat("role_keywords", F.expr("array(' X', 'x ', '', priority)"), "event_keywords")
    cleaned = classify.clean_keywords(words)
    return flat(fx.view(spark, d, "v_targets").select("id", cleaned.alias("keywords")))


@query
def normalize_domain(spark: SparkSession, d: str) -> DataFrame:
    domain = watchlist.normalize_domain(F.col("domain"))
    return target_inputs(spark, d).select("n", domain.alias("domain"), ((domain != "") & ~domain.contains("/")).alias("valid"))


@query
def event_type(spark: SparkSession, d: str) -> DataFrame:
    title = pick(fx.EVENT_TITLES, "p_partkey")
    return fx.table(spark, d, "part").select("p_partkey", classify.event_type(title).alias("event_type"))


@query
def event_location(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat(pick(fx.EVENT_TITLES, "p_partkey"), F.expr("case when p_partkey % 3 = 0 then concat(' at ', p_name) else '' end"))
    return fx.table(spark, d, "part").select("p_partkey", classify.location_in_title(title).alias("location"))


# ---- boards ----------------------------------------------------------------------------------

POSTING_COLUMNS = [
    "id", "company_id", "source_id", "canonical_url", "application_url", "title", "description", "locations",
    "employment_type", "content_fingerprint", "extraction_confidence",
]


def _ingest(provider: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = board_payloads.payload_postings(fx.payloads(spark, d, provider), provider)
        wanted = postings.wanted_postings(found, fx.view(spark, d, "v_targets"))
        return flat(dedup.dedup_board_postings(wanted).select(*POSTING_COLUMNS))

    return run


for _provider in board_payloads.BOARDS:
    QUERIES[f"ingest_{_provider.lower()}"] = _ingest(_provider)


@query
def payload_failures(spark: SparkSession, d: str) -> DataFrame:
    landed = None
    for provider in board_payloads.BOARDS:
        rows = fx.payloads(spark, d, provider)
        landed = rows if landed is None else landed.unionByName(rows)
    return board_payloads.payload_failures(landed).drop("scan_id", "source_url")


@query
def stitch_pages(spark: SparkSession, d: str) -> DataFrame:
    landed = None
    for provider in ("EIGHTFOLD", "JIBE", "WORKDAY", "PHENOM", "ORACLE_HCM"):
        rows = fx.payloads(spark, d, provider).withColumn("source_id", F.concat(F.lit(provider), "source_id"))
        landed = rows if landed is None else landed.unionByName(rows)
    kept = board_payloads.stitch_pages(landed)
    return kept.select("provider", "source_id", "page_no", F.col("record_count").cast("bigint").alias("record_count"))


# ---- pages -----------------------------------------------------------------------------------


@query
def html_anchor_links(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.spread(fx.table(spark, d, "pages")).select("page_id", F.col("url").alias("source_url"), "html")
    return pages.page_links(rows).drop("source_url")


def _layer(*layers: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = pages.page_postings(fx.rich_pages(spark, d), *layers)
        wanted = postings.wanted_postings(found, fx.view(spark, d, "v_targets"))
        return flat(dedup.dedup_page_postings(wanted).select(*POSTING_COLUMNS))

    return run


QUERIES["html_jsonld_jobs"] = _layer("jsonld")
QUERIES["html_pair_jobs"] = _layer("pair")
QUERIES["html_tuple_jobs"] = _layer("tuple")
QUERIES["html_jobs"] = _layer()


@query
def dedup_page(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates made from line items: one page per order, one URL per line status and return flag."""
    rows = fx.table(spark, d, "lineitem").selectExpr(
        "concat('o', l_orderkey) as source_id",
        "concat('https://jobs.example/', l_returnflag, l_linestatus) as canonical_url",
        "cast(element_at(array(0.95D, 0.75D, 0.7D, 0.55D), cast(l_linenumber % 4 + 1 as int)) as double) as extraction_confidence",
        "cast(l_linenumber as bigint) * 1000000000 + l_partkey as ordinal",
        "concat('Intern ', l_suppkey) as title",
    )
    return dedup.dedup_page_postings(rows)


@query
def dedup_company(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "orders").selectExpr(
        "concat('t', o_custkey % 50) as company_id",
        "concat('https://jobs.example/', o_orderpriority, '/', o_orderstatus) as canonical_url",
        "concat('s', lpad(o_orderkey, 12, '0')) as source_id",
        "cast(element_at(array(0.99D, 0.95D, 0.55D), cast(o_orderkey % 3 + 1 as int)) as double) as extraction_confidence",
        "o_totalprice as price",
    )
    return dedup.dedup_company_postings(rows)


@query
def event_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.rich_pages(spark, d).withColumnRenamed("source_url", "url")
    read = pages.read_event_pages(rows, fx.view(spark, d, "v_targets"), fx.sources(spark, d))
    keep = [
        "id", "company_id", "source_id", "source_url", "canonical_url", "title", "description", "event_type",
        "format", "location", "audience", "status", "content_fingerprint", "extraction_confidence", "rejection",
    ]
    return flat(read.select(*keep))


def _event_import(spark: SparkSession, d: str) -> event_import.EventImport:
    """Three of four pages are submitted under an allowed URL; every third is stored already, half of these as it was before."""
    submitted = "case when page_id % 4 = 0 then source_url else concat('https://rsvp.withgoogle.com/events/', page_id) end"
    rows = fx.rich_pages(spark, d).withColumn("url", F.expr(submitted))
    targets, sources = fx.view(spark, d, "v_targets"), fx.sources(spark, d)
    read = pages.read_event_pages(rows.where("page_id % 3 = 0 and page_id % 4 <> 0"), targets, sources).where("rejection is null").drop("rejection")
    odd = F.col("canonical_url").rlike("[13579]$")
    stored = read.withColumn("content_fingerprint", F.when(odd, F.lit("before")).otherwise(F.col("content_fingerprint")))
    return event_import.import_events(rows, targets, sources, stored)


@query
def event_import_result(spark: SparkSession, d: str) -> DataFrame:
    done = _event_import(spark, d)
    events = done.events.select("company_id", F.col("canonical_url").alias("url"), "title", "content_fingerprint", "change_kind", F.lit(None).cast("string").alias("reason"))
    none = [F.lit(None).cast("string").alias(c) for c in ("title", "content_fingerprint", "change_kind")]
    return events.unionByName(done.rejected.select("company_id", "url", *none, "reason"))


@query
def event_import_messages(spark: SparkSession, d: str) -> DataFrame:
    sent = _event_import(spark, d).messages
    content = F.get_json_object("payload", "$.content").alias("content")
    return sent.select("id", content, F.get_json_object("payload", "$.embeds[0].title").alias("title"), F.get_json_object("payload", "$.embeds[0].url").alias("url"))


PAGE_URLS = [
    "https://ok.example/x", "http://127.0.0.1/x", "http://192.168.0.1/", "https://user:pw@h.example/", "ftp://h.example/",
    "not a url", "http://printer.local/", "https://rsvp.withgoogle.com/events/", "http://172.31.0.9/", "https://rsvp.withgoogle.com/other/",
]


@query
def page_admission(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.spread(fx.table(spark, d, "pages")).select("page_id", pick(PAGE_URLS, "page_id").alias("source_url"), "html")
    allowed = urls.event_url_allowed(F.col("source_url")).alias("event_url_allowed")
    return pages.admitted_pages(rows).select("page_id", "source_url", "rejection", allowed)


# ---- scans -----------------------------------------------------------------------------------


def landed_scan(spark: SparkSession, d: str) -> DataFrame:
    """Pages (every third without a job) and two boards, as a crawler lands them."""
    none = F.lit(None).cast("string")
    html = F.when(F.col("page_id") % 3 == 0, F.lit("<html><div id='app'></div></html>")).otherwise(F.col("html"))
    page_rows = fx.rich_pages(spark, d).select(
        F.lit("scan").alias("scan_id"), "company_id", "source_id", "source_url", F.lit("GENERIC_HTML").alias("provider"),
        none.alias("api_origin"), none.alias("site"), F.lit(0).alias("query_no"), F.lit(1).alias("page_no"), "observed_at",
        html.alias("body"),
    )
    greenhouse = fx.payloads(spark, d, "GREENHOUSE").withColumn("source_id", F.concat(F.lit("g"), "source_id"))
    return page_rows.unionByName(greenhouse).unionByName(fx.payloads(spark, d, "EIGHTFOLD"))


@query
def source_results(spark: SparkSession, d: str) -> DataFrame:
    outcome = discovery.scan(landed_scan(spark, d), fx.view(spark, d, "v_targets"))
    return outcome.results.select("company_id", "source_id", "provider", "discovered_count", "united_states_count", "status", "message")


@query
def scan_postings(spark: SparkSession, d: str) -> DataFrame:
    outcome = discovery.scan(landed_scan(spark, d), fx.view(spark, d, "v_targets"))
    return flat(outcome.postings.select(*POSTING_COLUMNS))


def run_results(spark: SparkSession, d: str) -> DataFrame:
    """Source results from orders: a run covers a hundred consecutive orders."""
    return fx.table(spark, d, "orders").selectExpr(
        "concat('run-', o_orderkey div 100) as scan_id",
        "concat('t', o_custkey % 20) as company_id",
        "concat('s', o_orderkey) as source_id",
        "concat('https://s', o_orderkey, '.example') as source_url",
        "case when o_orderkey % 4 = 0 then 'GENERIC_HTML' else 'LEVER' end as provider",
        "case when o_orderstatus <> 'P' then o_custkey % 7 end as discovered_count",
        "case when o_orderstatus <> 'P' then o_custkey % 3 end as united_states_count",
        "case when o_orderstatus = 'P' then 'FAILED' else 'SUCCESS' end as status",
        "case when o_orderstatus = 'P' then o_orderpriority end as message",
        "o_orderdate as scanned_at",
        "o_orderdate + make_dt_interval(0, 0, 1, 0) as finished_at",
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    results = run_results(spark, d)
    jobs = results.groupBy("scan_id").agg(F.coalesce(F.sum("united_states_count"), F.lit(0)).alias("job_count"))
    return scans.summarize_runs(results, jobs)


def run_text(df: DataFrame) -> DataFrame:
    failed = F.transform("failures", lambda f: F.concat_ws(",", f["company_id"], f["source_id"], f["provider"], f["message"]))
    good = F.transform(
        "source_results",
        lambda r: F.concat_ws(",", r["company_id"], r["source_id"], r["provider"], r["discovered_count"].cast("string"), r["united_states_count"].cast("string")),
    )
    return flat(df.withColumns({"failures": failed, "source_results": good}))


@query
def scan_summary(spark: SparkSession, d: str) -> DataFrame:
    return run_text(scans.with_details(runs(spark, d), run_results(spark, d)))


@query
def health(spark: SparkSession, d: str) -> DataFrame:
    latest = scans.health(runs(spark, d).withColumnRenamed("scan_id", "id"))
    return run_text(scans.with_details(latest, run_results(spark, d), "id"))


@query
def health_without_scans(spark: SparkSession, d: str) -> DataFrame:
    empty = runs(spark, d).withColumnRenamed("scan_id", "id").where("target_count < 0")
    return scans.health(empty).select("status")


@query
def scan_message(spark: SparkSession, d: str) -> DataFrame:
    changes = fx.view(spark, d, "v_changes").selectExpr("concat('run-', cast(substr(id, 2) as bigint) div 100) as scan_id", "kind")
    counts = runs(spark, d).join(scans.change_counts(changes, ["scan_id"]), "scan_id", "left").fillna(0, ["new_count", "updated_count"])
    return scans.scan_messages(counts).select("scan_id", "message")


@query
def dashboard_metrics(spark: SparkSession, d: str) -> DataFrame:
    return scans.dashboard_metrics(
        fx.view(spark, d, "v_targets"), fx.sources(spark, d), fx.view(spark, d, "v_postings"),
        fx.view(spark, d, "v_events"), fx.view(spark, d, "v_changes"),
    )


# ---- snapshot and history --------------------------------------------------------------------

STATE_COLUMNS = ["id", "company_id", "source_id", "canonical_url", "title", "first_seen_at", "last_seen_at", "content_fingerprint", "active", "missed_scans"]


def _day(number: int) -> Column:
    return stamp(f"2024-01-{number:02d} 00:00:00")


def _last_day(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The state after all scans but the last ones, built by replay; what the last ones saw, and their sources."""
    seen, done = fx.sightings(spark, d), fx.scans(spark, d)
    last = F.lit(done.agg(F.max("scanned_at")).first()[0])
    stored = replay.replay_snapshot(seen.where(F.col("last_seen_at") < last), done.where(F.col("scanned_at") < last))
    return stored, seen.where(F.col("last_seen_at") == last), done.where(F.col("scanned_at") == last)


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.merge_scan(*_last_day(spark, d))


@query
def snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    return flat(_merged(spark, d).select(*STATE_COLUMNS, "change_kind"))


@query
def scan_changes(spark: SparkSession, d: str) -> DataFrame:
    return flat(snapshot.changes_of(_merged(spark, d)).drop("id"))


@query
def snapshot_merge_in_place(spark: SparkSession, d: str) -> DataFrame:
    """The same merge with the stored side kept in a bucketed table."""
    stored, today, ticked = _last_day(spark, d)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/snapshots"
    held = snapshot.hold_bucketed(stored, f"snapshot_{uuid.uuid4().hex}", folder, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return flat(snapshot.merge_in_place(held, today, ticked).select(*STATE_COLUMNS, "change_kind"))


@query
def replay_changes(spark: SparkSession, d: str) -> DataFrame:
    changes = replay.replay_changes(fx.sightings(spark, d))
    return flat(changes.select("job_id", "company_id", "canonical_url", "kind", "created_at"))


@query
def replay_onto_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A history cut in two: the second half replayed on the state the first half left."""
    seen, done = fx.sightings(spark, d), fx.scans(spark, d)
    early = F.col("last_seen_at") < _day(SNAPSHOT_DAY)
    stored = replay.replay_snapshot(seen.where(early), done.where(F.col("scanned_at") < _day(SNAPSHOT_DAY)))
    later = done.where(F.col("scanned_at") >= _day(SNAPSHOT_DAY))
    return flat(replay.replay_snapshot(seen.where(~early), later, stored).select(*STATE_COLUMNS))


@query
def missed_scans(spark: SparkSession, d: str) -> DataFrame:
    return flat(replay.replay_snapshot(fx.sightings(spark, d), fx.scans(spark, d)).select(*STATE_COLUMNS))


@query
def late_sightings(spark: SparkSession, d: str) -> DataFrame:
    """All sightings, as if they arrived once more after the state of all days but the last."""
    stored, _, _ = _last_day(spark, d)
    _, late = replay.split_late(fx.sightings(spark, d), stored)
    return flat(late.select("id", "source_id", "last_seen_at"))


@query
def reactivation(spark: SparkSession, d: str) -> DataFrame:
    return flat(replay.reactivations(fx.sightings(spark, d), fx.scans(spark, d)))


@query
def event_merge(spark: SparkSession, d: str) -> DataFrame:
    stored = fx.view(spark, d, "v_events")
    imported = stored.where("cast(substr(id, 2) as bigint) % 3 <> 0").selectExpr(
        "* except (canonical_url, content_fingerprint, last_seen_at, first_seen_at, title)",
        "case when cast(substr(id, 2) as bigint) % 3 = 1 then canonical_url else concat(canonical_url, '/new') end as canonical_url",
        "case when cast(substr(id, 2) as bigint) % 2 = 1 then content_fingerprint else 'changed' end as content_fingerprint",
        "timestamp_ntz '2026-06-01 00:00:00' as last_seen_at",
        "timestamp_ntz '2026-06-01 00:00:00' as first_seen_at",
        "upper(title) as title",
    )
    merged = snapshot.merge_events(stored, imported)
    return flat(merged.select("id", "company_id", "canonical_url", "title", "first_seen_at", "last_seen_at", "content_fingerprint", "active", "change_kind"))


@query
def active_postings(spark: SparkSession, d: str) -> DataFrame:
    return flat(snapshot.active_postings(fx.view(spark, d, "v_postings")).select("id", "company_id", "title", "last_seen_at", "missed_scans"))


@query
def active_events(spark: SparkSession, d: str) -> DataFrame:
    return flat(snapshot.active_events(fx.view(spark, d, "v_events")).select("id", "title", "starts_at", "last_seen_at"))


# ---- readers ---------------------------------------------------------------------------------


@query
def opportunity_feed(spark: SparkSession, d: str) -> DataFrame:
    return feed.opportunity_feed(fx.view(spark, d, "v_postings").where("active"), fx.view(spark, d, "v_targets").where("n % 10 <> 9"))


@query
def event_feed(spark: SparkSession, d: str) -> DataFrame:
    return feed.event_feed(fx.view(spark, d, "v_events"), fx.view(spark, d, "v_targets").where("n % 10 <> 9"))


@query
def feed_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.view(spark, d, "v_postings").select("id", "company_id", "canonical_url", "title")
    found = rows.where("cast(substr(id, 2) as bigint) % 3 <> 0").withColumn("title", F.upper("title"))
    return feed.merge_feed(found, rows.where("cast(substr(id, 2) as bigint) % 2 = 0"))


@query
def opportunities(spark: SparkSession, d: str) -> DataFrame:
    both = feed.opportunities(fx.view(spark, d, "v_postings"), fx.view(spark, d, "v_events"))
    return flat(both.select("kind", "id", "company_id", "title", "employment_type", "event_type", "starts_at"))


# ---- inbox and outbox ------------------------------------------------------------------------


@query
def change_log(spark: SparkSession, d: str) -> DataFrame:
    return flat(inbox.change_log(fx.view(spark, d, "v_changes"), unread_only=True))


@query
def inbox_notifications(spark: SparkSession, d: str) -> DataFrame:
    rows = inbox.inbox(fx.view(spark, d, "v_changes"), fx.view(spark, d, "v_targets"), fx.view(spark, d, "v_postings"), unread_only=True)
    return flat(rows.select("id", "job_id", "company_id", "kind", "created_at", "company_name", "job_title", "application_url"))


QUERIES["inbox"] = QUERIES.pop("inbox_notifications")


@query
def inbox_apply_marks(spark: SparkSession, d: str) -> DataFrame:
    changes = fx.view(spark, d, "v_changes")
    marks = fx.table(spark, d, "lineitem").selectExpr("concat('c', l_orderkey) as id", "l_shipdate as read_at").where("cast(substr(id, 2) as bigint) % 2 = 0")
    dismissed = changes.where("cast(substr(id, 2) as bigint) % 5 = 0").select("id")
    return flat(inbox.dismiss(inbox.mark_read(changes, marks), dismissed).select("id", "kind", "read_at"))


@query
def inbox_counts(spark: SparkSession, d: str) -> DataFrame:
    changes = fx.view(spark, d, "v_changes")
    marks = fx.table(spark, d, "lineitem").selectExpr("concat('c', l_orderkey) as id", "l_shipdate as read_at").where("cast(substr(id, 2) as bigint) % 2 = 0")
    dismissed = changes.where("cast(substr(id, 2) as bigint) % 5 = 0").select("id")
    counts = inbox.mark_counts(changes, marks).unpivot([], ["marked", "unread"], "count", "n")
    return counts.unionByName(inbox.dismissed_count(changes, dismissed).unpivot([], ["dismissed"], "count", "n"))


@query
def inbox_mark_all(spark: SparkSession, d: str) -> DataFrame:
    return flat(inbox.mark_all_read(fx.view(spark, d, "v_changes"), stamp(NOW)).select("id", "read_at"))


@query
def enqueue_deliveries(spark: SparkSession, d: str) -> DataFrame:
    present = fx.view(spark, d, "v_deliveries").where("cast(substr(id, 2) as bigint) % 2 = 0")
    new = outbox.enqueue(present, fx.view(spark, d, "v_changes"), stamp(NOW))
    return flat(new)


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return outbox.claim(
        fx.view(spark, d, "v_deliveries"), fx.view(spark, d, "v_changes"), fx.view(spark, d, "v_targets"),
        fx.view(spark, d, "v_postings"), stamp(NOW),
    )


@query
def claim_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return flat(_claims(spark, d).select("id", "change_id", "attempts", "queued_at", "kind", "company_name", "job_title", "application_url"))


@query
def claimable_deliveries(spark: SparkSession, d: str) -> DataFrame:
    rows = outbox.claimable(
        fx.view(spark, d, "v_deliveries"), fx.view(spark, d, "v_changes"), fx.view(spark, d, "v_targets"),
        fx.view(spark, d, "v_postings"), stamp(NOW),
    )
    return flat(rows.select("id", "change_id", "attempts", "queued_at", "company_name", "job_title"))


@query
def delivery_claimed(spark: SparkSession, d: str) -> DataFrame:
    return flat(outbox.apply_claims(fx.view(spark, d, "v_deliveries"), _claims(spark, d), stamp(NOW)))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Every second order was tried; every sixth failed with a long message."""
    return fx.table(spark, d, "orders").where("o_orderkey % 2 = 0").selectExpr(
        "concat('d', o_orderkey) as id",
        "case when o_orderkey % 4 = 0 then concat('m', o_orderkey) end as external_id",
        "case when o_orderkey % 6 = 0 then repeat(concat(o_orderpriority, ' '), 80) end as error",
    )


@query
def delivery_apply(spark: SparkSession, d: str) -> DataFrame:
    return flat(outbox.settle(fx.view(spark, d, "v_deliveries"), outcomes(spark, d), stamp(NOW)))


@query
def delivery_changed(spark: SparkSession, d: str) -> DataFrame:
    """The rows that the outcomes change after everything claimable was claimed."""
    deliveries = fx.view(spark, d, "v_deliveries")
    claimed = outbox.claim(
        deliveries, fx.view(spark, d, "v_changes"), fx.view(spark, d, "v_targets"), fx.view(spark, d, "v_postings"), stamp(NOW), limit=None
    )
    return flat(outbox.settled(outbox.apply_claims(deliveries, claimed, stamp(NOW)), outcomes(spark, d), stamp(NOW)))


@query
def delivery_fail(spark: SparkSession, d: str) -> DataFrame:
    failed = outbox.settle(fx.view(spark, d, "v_deliveries"), outcomes(spark, d).where("error is not null"), stamp(NOW), payloads.ERROR_LENGTH)
    return flat(failed.where("status = 'FAILED'").select("id", "attempts", "next_attempt_at", "last_error"))


def _round(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    present = fx.view(spark, d, "v_deliveries").where("cast(substr(id, 2) as bigint) % 3 <> 0")
    return outbox.deliver(
        present, fx.view(spark, d, "v_changes"), fx.view(spark, d, "v_targets"), fx.view(spark, d, "v_postings"),
        outcomes(spark, d), stamp(NOW), limit=None,
    )


@query
def delivery_round(spark: SparkSession, d: str) -> DataFrame:
    """The table after a round; two thirds of the deliveries exist before it, so that the others are enqueued."""
    return flat(_round(spark, d)[0])


@query
def delivery_round_counts(spark: SparkSession, d: str) -> DataFrame:
    return _round(spark, d)[1]


@query
def delivery_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return outbox.outcome_counts(outcomes(spark, d))


@query
def notification_payload(spark: SparkSession, d: str) -> DataFrame:
    rows = inbox.with_posting(fx.view(spark, d, "v_changes"), fx.view(spark, d, "v_targets"), fx.view(spark, d, "v_postings"))
    body = payloads.job_message(F.col("kind"), F.col("company_name"), F.col("job_title"), F.col("application_url"), F.col("created_at"))
    return rows.select("id", body.alias("payload"))


@query
def event_payload(spark: SparkSession, d: str) -> DataFrame:
    events = fx.view(spark, d, "v_events").withColumn("description", F.repeat("description", 200))
    names = fx.view(spark, d, "v_targets").select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    rows = events.join(names, "company_id")
    change = F.when(F.col("active"), "NEW").otherwise("UPDATED")
    body = payloads.event_message({c: F.col(c) for c in events.columns}, F.col("company_name"), change, description_length=payloads.DESCRIPTION_LENGTH)
    return rows.select("id", body.alias("payload"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Links of admitted pages as identified records, one per page and URL, in a stable order."""
    rows = fx.spread(fx.table(spark, d, "pages")).select("page_id", F.col("url").alias("source_url"), "html")
    admitted = pages.admitted_pages(rows).where(F.col("rejection").isNull()).drop("rejection")
    links = pages.page_links(admitted)
    unique = winners(links, ["page_id", "canonical_url"], [F.col("ordinal")])
    return unique.select(
        "page_id",
        ids.posting_id(F.col("page_id").cast("string"), F.col("canonical_url")).alias("link_id"),
        "canonical_url",
        "text",
        ids.fingerprint(F.col("text"), F.col("canonical_url")).alias("content_fingerprint"),
    ).orderBy("page_id", "canonical_url")
