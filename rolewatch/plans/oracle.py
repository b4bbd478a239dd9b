"""The same results in plain SQL, for an independent engine to compute on the given tables."""

from __future__ import annotations

from . import fixtures as fx
from .fixtures import DUCK

ORACLE: dict[str, str] = {}

NOW = "timestamp '1998-06-15 12:00:00'"
TS = "'%Y-%m-%d %H:%M:%S'"


def _select(base: str, columns: fx.Columns, where: str = "true") -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns)} FROM {base} WHERE {where}"


_FAILED = fx.failed_scan("source_id", "day_no")
VIEWS = {name: _select(base, columns(DUCK)) for name, (base, columns) in fx.VIEWS.items()}
VIEWS |= {
    "v_sources": _select(
        "(SELECT c_custkey, unnest(range(0, c_custkey % 3 + 1)) AS kind_no FROM customer)", fx._sources(DUCK)
    ),
    "v_obs": f"""SELECT * FROM ({_select("events", fx._observations(DUCK))})
        QUALIFY row_number() OVER (PARTITION BY company_id, canonical_url, seen_at ORDER BY event_id DESC) = 1""",
    "v_seen": f"""SELECT substr(sha256(company_id || chr(31) || canonical_url), 1, 24) AS id, company_id, source_id,
        canonical_url, seen_at, 'f' || mark AS fp, 'Intern ' || mark AS title FROM v_obs WHERE NOT ({_FAILED})""",
    "v_scans": f"SELECT DISTINCT source_id, seen_at AS scanned_at FROM v_obs WHERE NOT ({_FAILED})",
    "v_rich": f"""SELECT page_id, page_id % 97 AS n, url, regexp_extract(url, '^(https?://[^/?#]+)') AS origin,
        {DUCK.pick(fx.TITLES, "page_id")} AS t, {DUCK.pick(fx.EVENT_TITLES, "page_id")} AS et, html FROM pages""",
}
NEEDS = {"v_seen": ["v_obs"], "v_scans": ["v_obs"]}


def with_views(body: str, *names: str) -> str:
    ordered: list[str] = []
    for name in names:
        for needed in [*NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    return body if not views else f"WITH {views}{',' if body.startswith('+') else ''} {body.lstrip('+')}"


def add(name: str, body: str, *views: str) -> None:
    ORACLE[name] = with_views(body, *views)


def joined(column: str) -> str:
    return f"array_to_string({column}, '|')"


def at(column: str) -> str:
    return f"strftime({column}, {TS})"


# ---- shared rules ----------------------------------------------------------------------------

# The patterns of the classifiers, as the checking engine spells them.
INTERN = r"(?i)\b(?:intern|internship|co[ -]?op)\b"
GRAD = r"(?i)\b(?:new grad(?:uate)?|graduate (?:role|program)|graduate .{0,30}\b(?:engineer|developer)|entry[ -]level)\b"
DEGREE = (
    r"(?i)\b(?:master(?:''s|s)?|mba|ph\.?d\.?|doctoral|doctorate|post[ -]?doc(?:toral)?"
    r"|graduate .{0,30}\bintern|high school|secondary school)\b"
)
TEAM = (
    r"(?i)\b(?:recruiter|recruiting|talent acquisition|campus recruiting|university recruiting|program manager)\b"
    r"|(?i)\bmanager\b.*\bintern(?:ship)? program\b"
)
MENU = r"(?i)^(?:early careers?|internships?(?: for students)?|university recruiting|explore |find |view |search jobs?|watch (?:the )?film)"


def matches(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, '{pattern}')"


def eligible(title: str) -> str:
    return (
        f"(NOT {matches(title, TEAM)} AND NOT {matches(title, MENU)} AND ({matches(title, GRAD)} OR "
        f"({matches(title, INTERN)} AND NOT {matches(title, DEGREE)})))"
    )


def employment(text: str) -> str:
    return (
        f"CASE WHEN {matches(text, INTERN)} THEN 'INTERNSHIP' WHEN {matches(text, GRAD)} THEN 'NEW_GRAD' "
        f"WHEN {matches(text, '(?i)\\b(?:early career|apprentice|apprenticeship)\\b')} THEN 'EARLY_CAREER' ELSE 'OTHER' END"
    )


def rules(title: str, description: str, n: str) -> str:
    """The keyword lists of ``fx.ROLE_KEYWORDS``, spelled out one by one."""
    intern = matches(title, INTERN)

    def word(pattern: str) -> str:
        return matches(f"lower({title} || ' ' || {description})", rf"(?:^|\W)(?:{pattern})(?:\W|$)")

    return (
        f"CASE {n} % 8 WHEN 1 THEN {intern} WHEN 3 THEN {intern} AND {word('software')} "
        f"WHEN 4 THEN {intern} AND {word('data')} WHEN 5 THEN {word('c\\+\\+|embedded')} "
        f"WHEN 6 THEN NOT {intern} ELSE true END"
    )


def us(value: str) -> str:
    """One location string."""
    # Names and codes of the states.
    states = (
        "Alabama|Alaska|Arizona|Arkansas|California|Colorado|Connecticut|Delaware|Florida|Georgia|Hawaii|Idaho|Illinois"
        "|Indiana|Iowa|Kansas|Kentucky|Louisiana|Maine|Maryland|Massachusetts|Michigan|Minnesota|Mississippi|Missouri"
        "|Montana|Nebraska|Nevada|New Hampshire|New Jersey|New Mexico|New York|North Carolina|North Dakota|Ohio|Oklahoma"
        "|Oregon|Pennsylvania|Rhode Island|South Carolina|South Dakota|Tennessee|Texas|Utah|Vermont|Virginia|Washington"
        "|West Virginia|Wisconsin|Wyoming|District of Columbia"
    )
    codes = (
        "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR"
        "|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC"
    )
    parts = "list_filter(list_transform(string_split(p, ','), lambda c: trim(c)), lambda c: c <> '')"
    place = (
        f"CASE WHEN len({parts}) >= 3 AND regexp_matches({parts}[-1], '^[A-Za-z][A-Za-z]$') THEN false "
        f"WHEN regexp_matches(p, '(?i)(?:^|[,–—-]\\s*)(?:{states})$') THEN true "
        f"ELSE len({parts}) = 2 AND regexp_matches({parts}[2], '^(?:{codes})$') END"
    )
    places = f"list_transform(regexp_split_to_array({value}, '[;|]'), lambda s: trim(s))"
    country = r"(?i)\b(?:United States(?: of America)?|USA|U\.S\.A\.|US)\b"
    return f"({matches(value, country)} OR len(list_filter({places}, lambda p: {place})) > 0)"


def pid(company: str, url: str) -> str:
    return f"substr(sha256({company} || chr(31) || {url}), 1, 24)"


def posting_row(company: str, source: str, url: str, app: str, title: str, description: str, locations: str, kind: str, print_: str, confidence: str) -> str:
    return (
        f"SELECT {pid(company, url)} AS id, {company} AS company_id, {source} AS source_id, {url} AS canonical_url, "
        f"{app} AS application_url, {title} AS title, {description} AS description, {locations} AS locations, "
        f"{kind} AS employment_type, sha256({print_}) AS content_fingerprint, CAST({confidence} AS DOUBLE) AS extraction_confidence"
    )


# ---- watchlist -------------------------------------------------------------------------------

_SOURCE_TEXT = "string_agg(concat_ws(',', id, kind, url, CAST(enabled AS VARCHAR), scan_cron), '|' ORDER BY kind)"
_TARGET_COLUMNS = f"t.name, t.domain, t.priority, {joined('t.role_keywords')} AS role_keywords, {joined('t.event_keywords')} AS event_keywords, {at('t.created_at')} AS created_at"
_NESTED = f"(SELECT company_id, {_SOURCE_TEXT} AS sources FROM v_sources GROUP BY company_id)"

add(
    "watchlist_nested",
    f"SELECT t.id, {_TARGET_COLUMNS}, coalesce(s.sources, '') AS sources FROM v_targets t LEFT JOIN {_NESTED} s ON s.company_id = t.id",
    "v_targets",
    "v_sources",
)
_ROUTE = "CASE WHEN lower(domain) = 'nvidia.com' THEN {e} ELSE CASE lower(trim(name)) WHEN 'stripe' THEN {g} WHEN 'amd' THEN {j} WHEN 'ramp' THEN {a} WHEN 'spotify' THEN {l} WHEN 'intel' THEN {w} WHEN 'cisco' THEN {p} WHEN 'dell' THEN {o} WHEN 'notion' THEN {n} ELSE {x} END END"
add(
    "provider_route",
    "SELECT id, name, domain, "
    + _ROUTE.format(e="'EIGHTFOLD'", g="'GREENHOUSE'", j="'JIBE'", a="'ASHBY'", l="'LEVER'", w="'WORKDAY'", p="'PHENOM'", o="'ORACLE_HCM'", n="'ASHBY'", x="'GENERIC_HTML'")
    + " AS provider, "
    + _ROUTE.format(e="'https://jobs.nvidia.com'", g="NULL", j="'https://careers.amd.com'", a="NULL", l="NULL", w="'https://intel.wd1.myworkdayjobs.com'", p="'https://careers.cisco.com'", o="'https://enterpriseplatform.dell.com'", n="NULL", x="NULL")
    + " AS api_origin, "
    + _ROUTE.format(e="NULL", g="'stripe'", j="NULL", a="'ramp'", l="'spotify'", w="'External'", p="NULL", o="'careers'", n="'notion'", x="NULL")
    + " AS site FROM v_targets",
    "v_targets",
)
add(
    "discovery_queries",
    """SELECT company_id, CAST(i AS INTEGER) AS query_no, qs[i + 1] AS query FROM (SELECT company_id, qs, unnest(range(0, len(qs))) AS i FROM (
        SELECT id AS company_id, CASE n % 8 WHEN 1 THEN ['intern'] WHEN 3 THEN ['software'] WHEN 4 THEN ['data']
        WHEN 5 THEN ['c++', 'embedded'] WHEN 6 THEN ['new grad'] ELSE ['intern', 'new grad'] END AS qs FROM v_targets))""",
    "v_targets",
)
add(
    "watchlist_preview",
    f"""SELECT t.id, t.name, upper(substr(t.name, 1, 2)) AS initials, coalesce(s.c, 0) AS source_count,
        {joined("list_slice(list_concat(t.role_keywords, t.event_keywords), 1, 5)")} AS tags
        FROM (SELECT * FROM v_targets ORDER BY lower(name), id LIMIT 3) t
        LEFT JOIN (SELECT company_id, count(*) AS c FROM v_sources GROUP BY 1) s ON s.company_id = t.id""",
    "v_targets",
    "v_sources",
)
add(
    "watchlist_conflicts",
    """+ cand AS (SELECT CASE WHEN s_suppkey % 5 = 0 THEN 't' || s_suppkey ELSE 'n' || s_suppkey END AS id,
            CASE WHEN s_suppkey % 4 = 1 THEN upper('customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) ELSE s_name END AS name,
            CASE WHEN s_suppkey % 5 IN (0, 2) THEN 'c' || s_suppkey || '.example' WHEN s_suppkey % 7 = 3 THEN 'stripe.com'
                ELSE 'n' || s_suppkey || '.example' END AS domain FROM supplier),
        hits AS (SELECT c.id AS cid, t.id AS tid FROM cand c JOIN v_targets t ON lower(t.name) = lower(c.name) AND t.id <> c.id
            UNION ALL SELECT c.id, t.id FROM cand c JOIN v_targets t ON t.domain = c.domain AND t.id <> c.id),
        ends AS (SELECT cid, min(tid) AS conflict_id FROM hits GROUP BY cid)
        SELECT c.id, c.name, c.domain, e.conflict_id FROM cand c JOIN ends e ON e.cid = c.id""",
    "v_targets",
)
add(
    "watchlist_save",
    """+ inc AS (SELECT 't' || CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE s_suppkey + 100000000 END AS id, s_name AS name, 's' || s_suppkey || '.example' AS domain FROM supplier)
        SELECT 'clean' AS "case", coalesce(i.id, t.id) AS id, coalesce(i.name, t.name) AS name, coalesce(i.domain, t.domain) AS domain, NULL::VARCHAR AS conflict_id
            FROM v_targets t FULL JOIN inc i ON i.id = t.id
        UNION ALL SELECT 'repeated', id, name, domain, NULL FROM v_targets
        UNION ALL SELECT 'repeated conflict', id, name, domain, id FROM inc""",
    "v_targets",
)
add(
    "watchlist_merge",
    f"""+ inc AS (SELECT 't' || CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE s_suppkey + 100000000 END AS id, s_name AS name,
            's' || s_suppkey || '.example' AS domain FROM supplier),
        merged AS (SELECT t.id, coalesce(i.name, t.name) AS name, coalesce(i.domain, t.domain) AS domain,
                CASE WHEN i.id IS NULL THEN t.priority ELSE 'LOW' END AS priority,
                CASE WHEN i.id IS NULL THEN {joined("t.role_keywords")} ELSE 'robotics' END AS role_keywords,
                CASE WHEN i.id IS NULL THEN {joined("t.event_keywords")} ELSE '' END AS event_keywords,
                {at("t.created_at")} AS created_at FROM v_targets t LEFT JOIN inc i ON i.id = t.id
            UNION ALL SELECT id, name, domain, 'LOW', 'robotics', '', '2026-05-05 00:00:00' FROM inc WHERE id NOT IN (SELECT id FROM v_targets)),
        src AS (SELECT company_id, {_SOURCE_TEXT} AS sources FROM v_sources WHERE company_id NOT IN (SELECT id FROM inc) GROUP BY 1
            UNION ALL SELECT id, concat_ws(',', 'new-' || id, 'CAREERS', 'https://' || domain, 'true', '0 * * * *') FROM inc)
        SELECT m.*, coalesce(s.sources, '') AS sources FROM merged m LEFT JOIN src s ON s.company_id = m.id""",
    "v_targets",
    "v_sources",
)

_INPUTS = f"""SELECT c_custkey AS n,
    CASE WHEN c_custkey % 10 = 3 THEN '' ELSE c_name END AS name,
    CASE c_custkey % 9 WHEN 0 THEN 'acme' || c_custkey || '.test' WHEN 1 THEN 'a.test/' WHEN 2 THEN '' ELSE 'acme' || c_custkey || '.test' END AS domain,
    c_custkey % 8 AS career, c_custkey % 3 AS ev,
    CASE WHEN c_custkey % 4 = 1 THEN '* * * * *' ELSE {DUCK.pick(fx.CRONS, "c_custkey")} END AS cron,
    CASE WHEN c_custkey % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS priority,
    CASE c_custkey % 8 WHEN 1 THEN 'intern' WHEN 2 THEN 'intern|new grad' WHEN 3 THEN 'software|intern' WHEN 4 THEN 'university|data'
        WHEN 5 THEN 'c++|embedded' WHEN 6 THEN 'graduate' ELSE '' END AS role_keywords,
    CASE c_custkey % 4 WHEN 1 THEN 'campus' WHEN 2 THEN 'student|tea' WHEN 3 THEN 'hack' ELSE '' END AS event_keywords FROM customer"""
_CHECKED = f"""inputs AS ({_INPUTS}), staged AS (SELECT *, substr(sha256(domain), 1, 24) AS id,
        concat_ws('|', CASE WHEN name = '' THEN 'Company name is required.' END,
            CASE WHEN domain = '' OR contains(domain, '/') THEN 'Domain must be a hostname.' END,
            CASE career WHEN 0 THEN 'Career URL must use http or https.' WHEN 2 THEN 'Career URL must be a valid URL.' END,
            CASE WHEN ev = 1 THEN 'Events URL must use http or https.' END,
            CASE WHEN career = 1 THEN 'Career URL is required.' END) AS first_errors FROM inputs),
    checked AS (SELECT *, CASE WHEN first_errors = '' AND cron IN ('not a cron', '60 * * * *', '*/0 * * * *')
        THEN 'Scan schedule must be a valid five-field cron expression.' ELSE first_errors END AS errors,
        CASE career WHEN 0 THEN 'file:///careers' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'https://acme' || n || '.test/jobs' END AS career_url,
        CASE ev WHEN 0 THEN 'https://acme' || n || '.test/events' WHEN 1 THEN 'ftp://x' END AS events_url FROM staged)"""


def _input_source(kind: str, url: str, id_: str) -> str:
    return f"concat_ws(',', {id_}, '{kind}', {url}, 'true', cron)"


_OWN_SOURCE = "substr(sha256(id || chr(31) || '{}'), 1, 24)"
add(
    "import_targets",
    f"""WITH {_CHECKED} SELECT n, id, name, domain, priority, role_keywords, event_keywords, errors,
        concat_ws('|', CASE WHEN career <> 1 THEN {_input_source("CAREERS", "career_url", _OWN_SOURCE.format("CAREERS"))} END,
            CASE WHEN ev <> 2 THEN {_input_source("EVENTS", "events_url", _OWN_SOURCE.format("EVENTS"))} END) AS sources FROM checked""",
)
add(
    "watchlist_edit",
    f"""+ {_CHECKED}, ok AS (SELECT * FROM checked WHERE errors = '')
        SELECT 't' || n AS id, o.name, o.domain, o.priority, o.role_keywords, o.event_keywords, {at("t.created_at")} AS created_at,
            concat_ws('|', {_input_source("CAREERS", "career_url", "coalesce(a.id, 'missing')")},
                CASE WHEN ev = 0 THEN {_input_source("EVENTS", "events_url", "coalesce(b.id, substr(sha256(o.id || chr(31) || 'EVENTS'), 1, 24))")} END) AS sources
        FROM ok o JOIN v_targets t ON t.id = 't' || o.n
        LEFT JOIN v_sources a ON a.company_id = t.id AND a.kind = 'CAREERS'
        LEFT JOIN v_sources b ON b.company_id = t.id AND b.kind = 'EVENTS'""".replace("SELECT 't' || n AS id", "SELECT 't' || o.n AS id"),
    "v_targets",
    "v_sources",
)
add(
    "target_requests",
    """+ r AS (SELECT 'r' || CASE WHEN (n // 100) % 2 = 0 THEN n // 100 ELSE 1000000 + n // 20 END AS request_id, id, n FROM v_targets)
        SELECT request_id, id, count(*) OVER w <= 50 AND count(*) FILTER (WHERE n % 171 = 170) OVER w = 0 AS admitted
        FROM r WINDOW w AS (PARTITION BY request_id)""",
    "v_targets",
)


def _values(rows: list[tuple]) -> str:
    def one(v: object) -> str:
        return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + ")"


def _preset_rows() -> str:
    from ..sources.presets import PRESETS

    return f"(SELECT * FROM {_values([r[:4] for r in PRESETS])} AS p(preset_id, name, domain, career_url))"


add(
    "preset_additions",
    f"""SELECT * FROM {_preset_rows()} p WHERE NOT EXISTS (SELECT 1 FROM v_targets t WHERE t.domain = p.domain)
        AND NOT EXISTS (SELECT 1 FROM v_targets t WHERE lower(t.name) = lower(p.name))""",
    "v_targets",
)
add(
    "preset_missing",
    f"""SELECT preset_id, count(*) FILTER (WHERE domain NOT IN (SELECT domain FROM v_targets)) AS missing_count
        FROM {_preset_rows()} GROUP BY preset_id""",
    "v_targets",
)
_LIST = """list AS (SELECT s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'c' || s_suppkey || '.example' ELSE 's' || s_suppkey || '.example' END AS domain,
    'https://s' || s_suppkey || '.example/careers' AS career_url FROM supplier),
    fresh AS (SELECT * FROM list WHERE domain NOT IN (SELECT domain FROM v_targets))"""
add(
    "watchlist_sync",
    f"""+ {_LIST} SELECT substr(sha256(domain), 1, 24) AS id, name, domain, 'HIGH' AS priority,
        'intern|internship|new grad|graduate|early career|university' AS role_keywords,
        'student|university|early career|campus|event|workshop|hackathon' AS event_keywords,
        concat_ws(',', substr(sha256(substr(sha256(domain), 1, 24) || chr(31) || 'CAREERS'), 1, 24), 'CAREERS', career_url, 'true', '* * * * *') AS sources
        FROM fresh""",
    "v_targets",
)
add(
    "watchlist_sync_report",
    f"""+ {_LIST} SELECT (SELECT count(*) FROM v_targets) AS before, (SELECT count(*) FROM fresh) AS added,
        (SELECT count(*) FROM v_targets) + (SELECT count(*) FROM fresh) AS "after" """,
    "v_targets",
)
add(
    "delete_cascade",
    """+ gone AS (SELECT id FROM v_targets WHERE n % 6 = 1)
        SELECT 'targets' AS table_name, id FROM v_targets WHERE n % 6 <> 1
        UNION ALL SELECT 'sources', id FROM v_sources WHERE company_id NOT IN (SELECT id FROM gone)
        UNION ALL SELECT 'postings', id FROM v_postings WHERE company_id NOT IN (SELECT id FROM gone)
        UNION ALL SELECT 'events', id FROM v_events WHERE company_id NOT IN (SELECT id FROM gone)
        UNION ALL SELECT 'changes', id FROM v_changes WHERE company_id NOT IN (SELECT id FROM gone)
        UNION ALL SELECT 'deliveries', id FROM v_deliveries WHERE change_id NOT IN (SELECT id FROM v_changes WHERE company_id IN (SELECT id FROM gone))""",
    "v_targets",
    "v_sources",
    "v_postings",
    "v_events",
    "v_changes",
    "v_deliveries",
)

# ---- schedule --------------------------------------------------------------------------------

_CRON_CASES = f"cases AS (SELECT o_orderkey, {DUCK.pick(fx.CRONS, 'o_orderkey')} AS expr, o_orderdate + to_minutes(CAST(o_orderkey * 7 % 1440 AS BIGINT)) AS tick FROM orders)"
_VALID = "expr NOT IN ('not a cron', '60 * * * *', '*/0 * * * *')"


def _due(expr: str, moment: str) -> str:
    """What each expression of ``fx.CRONS`` means, in words of SQL."""
    m, h, dom, mon, dow = (f"{part}({moment})" for part in ("minute", "hour", "day", "month", "dayofweek"))
    return (
        f"CASE {expr} WHEN '* * * * *' THEN true WHEN '*/15 9-17 * * 1-5' THEN {m} % 15 = 0 AND {h} BETWEEN 9 AND 17 AND {dow} BETWEEN 1 AND 5 "
        f"WHEN '0 * * * *' THEN {m} = 0 WHEN '30 14 1 * 0' THEN {m} = 30 AND {h} = 14 AND {dom} = 1 AND {dow} = 0 "
        f"WHEN '5/15 * * * *' THEN {m} = 5 WHEN '0,30 */6 * * *' THEN {m} IN (0, 30) AND {h} % 6 = 0 "
        f"WHEN '10-20/5 12 * 1-6 *' THEN {m} IN (10, 15, 20) AND {h} = 12 AND {mon} BETWEEN 1 AND 6 "
        f"WHEN '* * 31 12 *' THEN {dom} = 31 AND {mon} = 12 ELSE false END"
    )


add("cron_valid", f"WITH {_CRON_CASES} SELECT o_orderkey, expr, {_VALID} AS valid FROM cases")
add("cron_due", f"WITH {_CRON_CASES} SELECT o_orderkey, expr, {at('tick')} AS tick, {_due('expr', 'tick')} AS due FROM cases")
add(
    "due_sources",
    f"SELECT company_id, count(*) AS due_sources FROM v_sources WHERE enabled AND {_due('scan_cron', 'timestamp ' + repr('2026-08-16 14:30:00'))} GROUP BY company_id",
    "v_sources",
)
add(
    "scan_batch",
    """+ listed AS (SELECT id, name, row_number() OVER (ORDER BY lower(name), id) - 1 AS position, count(*) OVER () AS total FROM v_targets),
        slots AS (SELECT *, CAST(ceil(total / 25.0) AS BIGINT) AS batch_count FROM listed),
        chosen AS (SELECT *, CASE WHEN total > 25 THEN CAST(floor(epoch(timestamp '2026-08-16 14:30:00') / 300) AS BIGINT) % batch_count ELSE 0 END AS batch_index FROM slots)
        SELECT id, name, position, batch_index, batch_count FROM chosen WHERE position // 25 = batch_index""",
    "v_targets",
)
add(
    "scheduled_batch",
    f"""+ due AS (SELECT company_id, id, kind FROM v_sources WHERE enabled AND {_due('scan_cron', 'timestamp ' + repr('2026-08-16 14:30:00'))}),
        listed AS (SELECT id, row_number() OVER (ORDER BY lower(name), id) - 1 AS position, count(*) OVER () AS total FROM v_targets WHERE id IN (SELECT company_id FROM due)),
        slots AS (SELECT *, CAST(ceil(total / 25.0) AS BIGINT) AS batch_count FROM listed),
        chosen AS (SELECT *, CASE WHEN total > 25 THEN CAST(floor(epoch(timestamp '2026-08-16 14:30:00') / 300) AS BIGINT) % batch_count ELSE 0 END AS batch_index FROM slots)
        SELECT d.company_id, d.id, d.kind, c.position, c.batch_index, c.batch_count FROM due d JOIN chosen c ON c.id = d.company_id WHERE c.position // 25 = c.batch_index""",
    "v_targets",
    "v_sources",
)
add("scan_tasks", "SELECT company_id, id, kind, url FROM v_sources WHERE company_id IN (SELECT id FROM v_targets) AND enabled AND kind <> 'EVENTS'", "v_targets", "v_sources")
_TICK = """+ due AS (SELECT DISTINCT company_id, id FROM v_sources WHERE enabled AND company_id IN (SELECT id FROM v_targets) AND {due}),
    listed AS (SELECT id, row_number() OVER (ORDER BY lower(name), id) - 1 AS position, count(*) OVER () AS total FROM v_targets WHERE id IN (SELECT company_id FROM due)),
    chosen AS (SELECT id FROM listed WHERE position // 25 = CASE WHEN total > 25 THEN CAST(floor(epoch({at}) / 300) AS BIGINT) % CAST(ceil(total / 25.0) AS BIGINT) ELSE 0 END)
    SELECT (SELECT count(DISTINCT company_id) FROM due) AS due_targets, (SELECT count(*) FROM chosen) AS scanned_targets,
        (SELECT count(*) FROM due WHERE company_id IN (SELECT id FROM chosen)) AS scanned_sources,
        CASE WHEN (SELECT count(*) FROM due) = 0 THEN 'SKIPPED' ELSE 'SCANNED' END AS status"""
_AT = ("timestamp '2026-08-16 14:30:00'", "timestamp '2026-08-16 14:29:00'")
add("scheduled_tick", _TICK.format(due=_due("scan_cron", _AT[0]), at=_AT[0]), "v_targets", "v_sources")
_ASLEEP = "(CASE WHEN scan_cron = '* * * * *' THEN '0 0 1 1 *' ELSE scan_cron END)"
add("scheduled_tick_idle", _TICK.format(due=_due(_ASLEEP, _AT[1]), at=_AT[1]), "v_targets", "v_sources")
add(
    "scan_tasks_first",
    """+ first AS (SELECT id FROM v_targets ORDER BY lower(name), id LIMIT 25)
        SELECT company_id, id, kind, url FROM v_sources WHERE company_id IN (SELECT id FROM first) AND enabled AND kind <> 'EVENTS'""",
    "v_targets",
    "v_sources",
)

# ---- scalar functions ------------------------------------------------------------------------


def canonical(url: str) -> str:
    """Enough for the given page URLs, which are well-formed and lower-case."""
    bare = f"regexp_replace({url}, '#.*$', '')"
    kept = f"list_filter(string_split(regexp_extract({bare}, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(?:utm_|gh_src|lever-|source|ref)'))"
    path = f"regexp_replace({bare}, '\\?.*$', '')"
    return f"({path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END)"


add("canonical_url", f"SELECT page_id, url, {canonical('url')} AS canonical_url FROM pages")
add(
    "fingerprint",
    "SELECT doc_id, sha256(text || chr(31) || lang || chr(31) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END) AS content_fingerprint FROM documents",
)
add("posting_id", f"SELECT o_orderkey, {pid("('t' || o_custkey)", "('https://jobs.example/' || o_orderkey)")} AS posting_id FROM orders")
_DOCS = f"""docs AS (SELECT doc_id, {DUCK.pick(fx.TITLES, "doc_id")} || CASE doc_id % 5 WHEN 0 THEN ' - ' || source ELSE '' END AS title,
    CASE WHEN doc_id % 4 = 0 THEN 'Intern' WHEN doc_id % 4 = 1 THEN lang ELSE 'Entry level' END AS raw_type, text FROM documents)"""
add("employment_type", f"WITH {_DOCS} SELECT doc_id, title, {employment("lower(title || ' ' || raw_type)")} AS employment_type FROM docs")
add("eligible_title", f"WITH {_DOCS} SELECT doc_id, title, {eligible('title')} AS eligible FROM docs")
add("role_match", f"WITH {_DOCS} SELECT doc_id, {eligible('title')} AND {rules('title', 'text', 'doc_id')} AS matches FROM docs")
_EVENT_CORE = r"\b(?:internships?|students?|early career|new grads?|graduates?|university|campus|resume workshop|career workshop|hackathon|recruiting event)\b"


def event_gate(text: str, n: str) -> str:
    return (
        f"({matches(text, _EVENT_CORE)} OR CASE {n} % 4 WHEN 1 THEN contains({text}, 'campus') "
        f"WHEN 2 THEN contains({text}, 'student') OR contains({text}, 'tea') WHEN 3 THEN contains({text}, 'hack') ELSE false END)"
    )


add("event_match", f"SELECT doc_id, {event_gate("lower('Gathering ' || text)", 'doc_id')} AS matches FROM documents")
add("us_location", f"SELECT id, len(list_filter(locations, lambda l: {us('l')})) > 0 AS is_us FROM v_postings", "v_postings")
add(
    "job_detail_url",
    """WITH u AS (SELECT c_custkey, """
    + DUCK.pick([
        "https://job-boards.greenhouse.io/acme/jobs/", "https://jobs.lever.co/acme/0123456789abcdef0123-", "https://acme.example/career-programs/university/",
        "https://acme.example/jobs/search?x=", "https://jobs.acme.example/teams/eng-", "https://acme.example/job_details/", "https://acme.example/about/",
        "https://acme.example/job/abc", "https://acme.example/details/",
    ], "c_custkey")
    + """ || CASE WHEN c_custkey % 10 = 4 THEN 'film.mp4' ELSE CAST(c_custkey AS VARCHAR) END AS url FROM customer),
    p AS (SELECT *, regexp_replace(regexp_extract(url, '^https?://[^/]+(.*)$', 1), '[?#].*$', '') AS path FROM u)
    SELECT c_custkey, url, NOT regexp_matches(path, '(?i)\\.(?:mp4|mov|pdf|jpg|png)$')
        AND NOT regexp_matches(path, '(?i)/(?:search|jobsearch|early-careers?|career-programs|university-recruiting)/?$')
        AND regexp_matches(url, '(?i)(?:job-boards\\.greenhouse\\.io/.+/jobs/\\d+|jobs\\.ashbyhq\\.com/.+/[0-9a-f-]{20,}|jobs\\.lever\\.co/.+/[0-9a-f-]{20,}|https?://jobs\\.[^/]+/.+/[\\w-]{4,}|/job_details/\\d+|/details/\\d+|/jobs?/[\\w-]{4,})') AS is_detail
    FROM p""",
)


def unescaped(text: str) -> str:
    """The character references the given pages use."""
    return (
        f"replace(regexp_replace(replace(replace(replace({text}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;?', chr(1), 'g'), chr(1), '&')"
    )


def page_text(html: str) -> str:
    stripped = f"regexp_replace({html}, '(?is)<(?:script|style)[^>]*>(.*?)</(?:script|style)\\s*>|<!--.*?-->|<[^>]*>', '\\1', 'g')"
    return f"trim(regexp_replace({unescaped(stripped)}, '\\s+', ' ', 'g'))"


add("strip_markup", f"SELECT page_id, {page_text('html')} AS text FROM pages")
add(
    "clean_keywords",
    """+ w AS (SELECT id, list_filter(list_transform(list_concat(list_concat(role_keywords, [' X', 'x ', '', priority]), event_keywords), lambda v: lower(trim(v))), lambda v: v <> '') AS l FROM v_targets)
        SELECT id, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), '|') AS keywords FROM w""",
    "v_targets",
)
add("normalize_domain", f"WITH inputs AS ({_INPUTS}) SELECT n, domain, domain <> '' AND NOT contains(domain, '/') AS valid FROM inputs")
# The words that tell kinds and places of events.
_EVENT_TYPE = "CASE WHEN {t} ILIKE '%workshop%' THEN 'WORKSHOP' WHEN {t} ILIKE '%hackathon%' THEN 'HACKATHON' WHEN {t} ILIKE '%office hours%' THEN 'OFFICE_HOURS' WHEN regexp_matches({t}, '(?i)info(?:rmation)? session') THEN 'INFO_SESSION' WHEN {t} ILIKE '%conference%' THEN 'CONFERENCE' WHEN {t} ILIKE '%network%' THEN 'NETWORKING' WHEN regexp_matches({t}, '(?i)campus|university|recruit') THEN 'CAMPUS_RECRUITING' ELSE 'OTHER' END"
_PLACE = r"nullif(trim(regexp_extract({t}, '(?i)\bat\s+(?:Google\s+)?(.+)$', 1)), '')"
add("event_type", f"WITH e AS (SELECT p_partkey, {DUCK.pick(fx.EVENT_TITLES, 'p_partkey')} AS t FROM part) SELECT p_partkey, {_EVENT_TYPE.format(t='t')} AS event_type FROM e")
add(
    "event_location",
    f"WITH e AS (SELECT p_partkey, {DUCK.pick(fx.EVENT_TITLES, 'p_partkey')} || CASE WHEN p_partkey % 3 = 0 THEN ' at ' || p_name ELSE '' END AS t FROM part) SELECT p_partkey, {_PLACE.format(t='t')} AS location FROM e",
)

# ---- boards ----------------------------------------------------------------------------------

_PARTS = f"parts AS (SELECT *, {DUCK.pick(fx.TITLES, 'p_partkey')} AS t, p_partkey // 10 AS page, p_partkey // 50 AS n FROM part)"
# Per board: url, application url, description, locations, raw type, confidence.
_BOARDS = {
    "greenhouse": ("'https://g.example/' || p_partkey", None, "p_name || ' & more'", "p_brand || '|' || p_type || '|HQ|Austin, TX'", "'Eng, ' || p_type", "0.99"),
    "jibe": ("'https://careers.amd.com/jobs/' || p_partkey", None, "p_name", "p_brand || ', US|Remote|' || p_type", "''", "0.99"),
    "ashby": ("'https://a.example/' || p_partkey", "'https://a.example/' || p_partkey || '/apply'", "p_name", "p_brand || '|Remote'", "'FullTime ' || p_type", "0.99"),
    "lever": ("'https://l.example/' || p_partkey", None, "p_name || ' extra'", "p_brand || '|Boston, MA'", "p_type", "0.99"),
    "eightfold": ("'https://jobs.nvidia.com/careers/job/' || p_partkey", None, "p_name", "CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Austin, TX, US' END", "p_name", "0.98"),
    "workday": ("'https://intel.wd1.myworkdayjobs.com/job/R' || p_partkey", None, "p_name || ' R' || p_partkey", "p_brand || '|US, Oregon|Remote'", "''", "0.97"),
    "phenom": ("'https://careers.cisco.com/global/en/job/' || p_partkey", None, "p_name", "p_type || '|' || p_brand || ', California, United States'", "p_type", "0.96"),
    "oracle_hcm": ("'https://enterpriseplatform.dell.com/hcmUI/CandidateExperience/en/sites/careers/job/' || p_partkey", None, "p_name", "p_brand || '|' || p_type", "p_type", "0.96"),
}


def board_postings(name: str, pages: str = "page % 13 <> 12", source: str = "'b' || n", extra: str = "") -> str:
    url, app, description, locations, raw, confidence = _BOARDS[name]
    row = posting_row(
        "('t' || n)", f"({source})", "url", "app", "t", "description", "locations", employment("lower(t || ' ' || raw)"),
        "t || chr(31) || description || chr(31) || url || chr(31) || locations", confidence,
    )
    return (
        f"{row}{extra} FROM (SELECT *, {url} AS url, {app or url} AS app, {description} AS description, {locations} AS locations, "
        f"{raw} AS raw FROM parts WHERE {pages}) WHERE {eligible('t')} AND {rules('t', 'description', 'n')}"
    )


for _name in _BOARDS:
    add(f"ingest_{_name}", f"WITH {_PARTS} {board_postings(_name)}")

_MESSAGES = {
    "GREENHOUSE": "Greenhouse API", "JIBE": "Jibe API", "ASHBY": "Ashby API", "LEVER": "Lever API",
    "EIGHTFOLD": "Eightfold listing API", "WORKDAY": "Workday API", "PHENOM": "Phenom API", "ORACLE_HCM": "Oracle HCM API",
}
add(
    "payload_failures",
    f"""WITH {_PARTS} SELECT DISTINCT 't' || n AS company_id, 'b' || n AS source_id, provider, what || ' returned an invalid response.' AS message
        FROM parts CROSS JOIN {_values(list(_MESSAGES.items()))} AS m(provider, what) WHERE page % 13 = 12""",
)
_STITCHED = """stitched AS (SELECT *, coalesce(min(CASE WHEN c = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY n ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 1 AS unbroken
    FROM (SELECT n, page, page % 5 + 1 AS page_no, CASE WHEN page % 13 = 12 THEN 0 ELSE count(*) END AS c FROM parts GROUP BY n, page))"""
add(
    "stitch_pages",
    f"""WITH {_PARTS}, {_STITCHED} SELECT provider, provider || 'b' || n AS source_id, CAST(page_no AS INTEGER) AS page_no, c AS record_count
        FROM stitched CROSS JOIN (VALUES ('EIGHTFOLD', 3), ('JIBE', 3), ('WORKDAY', 3), ('PHENOM', 3), ('ORACLE_HCM', 5)) AS m(provider, most) WHERE unbroken AND page_no <= most""",
)

# ---- pages -----------------------------------------------------------------------------------


def page_row(layer: str) -> str:
    """Eligible records of one layer of the enriched pages."""
    url = {
        "jsonld": "origin || '/jobs/ld-' || page_id || '?k=1'",
        "pair": "origin || '/careers/pair-' || page_id",
        "tuple": "'https://jobs.example.com/acme/tuple-' || page_id",
        "link": "'https://job-boards.greenhouse.io/acme/jobs/' || (100000 + page_id)",
        "tuple_link": "'https://jobs.example.com/acme/tuple-' || page_id",
    }[layer]
    description = "'Build & ship #' || page_id" if layer == "jsonld" else "''"
    confidence = {"jsonld": "0.95", "pair": "0.75", "tuple": "0.7"}.get(layer, "0.55")
    mark = "t || chr(31) || description || chr(31) || curl" if layer == "jsonld" else "t || chr(31) || curl"
    raw = "INTERN" if layer == "jsonld" else ""
    row = posting_row(
        "('t' || n)", "('w' || page_id)", "curl", "curl", "t", "description", "'Austin, US'" if layer == "jsonld" else "''",
        employment(f"lower(t || ' {raw}')"), mark, confidence,
    )
    return (
        f"{row} FROM (SELECT *, {url} AS curl, {description} AS description FROM v_rich) "
        f"WHERE {eligible('t')} AND {rules('t', 'description', 'n')}"
    )


for _layer in ("jsonld", "pair", "tuple"):
    add(f"html_{_layer}_jobs", page_row(_layer), "v_rich")
_ALL_LAYERS = " UNION ALL ".join(page_row(layer) for layer in ("jsonld", "pair", "link", "tuple_link"))
add("html_jobs", _ALL_LAYERS, "v_rich")

# Links of the given pages are root-relative and plain, so joining them is concatenation.
_ENCODED = "array_to_string(list_transform(string_split(href, ''), lambda c: CASE WHEN unicode(c) > 127 THEN url_encode(c) ELSE c END), '')"
add(
    "html_anchor_links",
    f"""WITH bare AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)') AS origin,
            regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '(?is)<a [^>]*>.*?</a>') AS found FROM pages),
        each AS (SELECT page_id, origin, i AS ordinal, found[i + 1] AS tag FROM (SELECT *, unnest(range(0, len(found))) AS i FROM bare)),
        parts AS (SELECT *, regexp_extract(tag, 'href="([^"]*)"', 1) AS href FROM each)
        SELECT page_id, CAST(ordinal AS INTEGER) AS ordinal, href, origin || {_ENCODED} AS canonical_url, {page_text("tag")} AS text,
            regexp_matches(origin || {_ENCODED}, '(?i)https?://jobs\\.[^/]+/.+/[\\w-]{{4,}}|/jobs?/[\\w-]{{4,}}') AS is_job_detail FROM parts""",
)
add(
    "dedup_page",
    """SELECT 'o' || l_orderkey AS source_id, 'https://jobs.example/' || l_returnflag || l_linestatus AS canonical_url,
        extraction_confidence, 'Intern ' || l_suppkey AS title
        FROM (SELECT *, list_extract([0.95, 0.75, 0.7, 0.55], l_linenumber % 4 + 1)::DOUBLE AS extraction_confidence FROM lineitem)
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus
            ORDER BY extraction_confidence, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey DESC) = 1""",
)
add(
    "dedup_company",
    """SELECT 't' || (o_custkey % 50) AS company_id, 'https://jobs.example/' || o_orderpriority || '/' || o_orderstatus AS canonical_url,
        's' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS source_id, extraction_confidence, o_totalprice AS price
        FROM (SELECT *, list_extract([0.99, 0.95, 0.55], o_orderkey % 3 + 1)::DOUBLE AS extraction_confidence FROM orders)
        QUALIFY row_number() OVER (PARTITION BY o_custkey % 50, o_orderpriority, o_orderstatus ORDER BY extraction_confidence, o_orderkey DESC) = 1""",
)
_PAGE_TITLE = "trim(" + unescaped("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)") + ")"
add(
    "event_pages",
    f"""+ facts AS (SELECT *, {_PAGE_TITLE} AS page_title, CASE WHEN page_id % 4 = 0 THEN 'online' ELSE 'For students, no. ' || page_id END AS description FROM v_rich),
        named AS (SELECT *, CASE WHEN page_title = '' THEN et ELSE page_title END AS title FROM facts),
        texts AS (SELECT *, lower(title || ' ' || description) AS hay, {_PLACE.format(t="title")} AS location FROM named)
        SELECT {pid("('t' || n)", "url")} AS id, 't' || n AS company_id, coalesce(s.id, 't' || n || '-submitted-events') AS source_id,
            coalesce(s.url, x.url) AS source_url, x.url AS canonical_url, title, description, {_EVENT_TYPE.format(t="title")} AS event_type,
            CASE WHEN contains(hay, 'virtual') OR contains(hay, 'online') THEN 'VIRTUAL' ELSE 'IN_PERSON' END AS format, location,
            CASE WHEN contains(hay, 'intern') THEN 'Internship candidates' ELSE 'Early-career candidates' END AS audience,
            'REGISTRATION_OPEN' AS status,
            sha256(title || chr(31) || description || chr(31) || x.url || chr(31) || coalesce(location, '')) AS content_fingerprint,
            CAST(0.8 AS DOUBLE) AS extraction_confidence,
            CASE WHEN NOT EXISTS (SELECT 1 FROM v_targets t WHERE t.id = 't' || x.n) THEN 'The selected company is not in the watchlist.'
                WHEN NOT {event_gate("hay", "n")} THEN 'Event does not match the company event keywords.' END AS rejection
        FROM texts x LEFT JOIN v_sources s ON s.company_id = 't' || x.n AND s.kind = 'EVENTS'""".replace(pid("('t' || n)", "url"), pid("('t' || n)", "x.url")),
    "v_rich",
    "v_targets",
    "v_sources",
)
_SUBMITTED = ORACLE["event_pages"].replace(
    "page_id % 97 AS n, url,", "page_id % 97 AS n, CASE WHEN page_id % 4 = 0 THEN url ELSE 'https://rsvp.withgoogle.com/events/' || page_id END AS url,"
)
_IMPORT = f"""WITH read AS ({_SUBMITTED}), known AS (SELECT *, starts_with(canonical_url, 'https://rsvp.withgoogle.com/events/') AS allowed FROM read),
    accepted AS (SELECT *, CAST(regexp_extract(canonical_url, '([0-9]+)$', 1) AS BIGINT) AS k FROM known WHERE allowed AND rejection IS NULL),
    merged AS (SELECT *, CASE WHEN k % 3 <> 0 THEN 'NEW' WHEN k % 2 = 1 THEN 'UPDATED' END AS change_kind FROM accepted)"""
ORACLE["event_import_result"] = f"""{_IMPORT}
    SELECT company_id, canonical_url AS url, title, content_fingerprint, change_kind, NULL::VARCHAR AS reason FROM merged
    UNION ALL SELECT company_id, canonical_url, NULL, NULL, NULL, CASE WHEN allowed THEN rejection ELSE 'The first release supports direct WithGoogle RSVP event URLs.' END
        FROM known WHERE NOT allowed OR rejection IS NOT NULL"""
ORACLE["event_import_messages"] = f"""{_IMPORT}, named AS ({VIEWS["v_targets"]})
    SELECT m.id, '🎓 ' || CASE change_kind WHEN 'NEW' THEN 'New' ELSE 'Updated' END || ' early-career event at **' || t.name || '**' AS content, m.title, m.canonical_url AS url
    FROM merged m JOIN named t ON t.id = m.company_id WHERE change_kind IS NOT NULL"""
_PRIVATE = "'Private sources cannot be scanned.'"
add(
    "page_admission",
    f"""SELECT page_id, {DUCK.pick(["https://ok.example/x", "http://127.0.0.1/x", "http://192.168.0.1/", "https://user:pw@h.example/", "ftp://h.example/", "not a url", "http://printer.local/", "https://rsvp.withgoogle.com/events/", "http://172.31.0.9/", "https://rsvp.withgoogle.com/other/"], "page_id")} AS source_url,
        coalesce(CASE page_id % 10 WHEN 1 THEN {_PRIVATE} WHEN 2 THEN {_PRIVATE} WHEN 6 THEN {_PRIVATE} WHEN 8 THEN {_PRIVATE}
            WHEN 3 THEN 'Source URLs cannot contain credentials.' WHEN 4 THEN 'Only HTTP(S) sources can be scanned.' WHEN 5 THEN 'Invalid URL' END,
            CASE WHEN length(html) > 5000000 THEN 'Source response exceeded 5 MB.' END) AS rejection,
        page_id % 10 = 7 AS event_url_allowed FROM pages""",
)

# ---- scans -----------------------------------------------------------------------------------

_PAGE_JOBS = " UNION ALL ".join(
    f"SELECT * FROM ({page_row(layer)}) WHERE CAST(substr(source_id, 2) AS BIGINT) % 3 <> 0" for layer in ("jsonld", "pair", "link", "tuple_link")
)
_BROKEN = "broken AS (SELECT DISTINCT n FROM parts WHERE page % 13 = 12)"
_ASKED = "asked AS (SELECT page FROM stitched WHERE unbroken AND page_no <= 3)"
_SCAN = f"""+ {_PARTS}, {_STITCHED}, {_ASKED}, {_BROKEN},
    bad_e AS (SELECT DISTINCT n FROM stitched WHERE unbroken AND page_no <= 3 AND c = 0),
    found AS (SELECT * FROM ({_PAGE_JOBS})
        UNION ALL SELECT * FROM ({board_postings("greenhouse", source="'gb' || n")})
        UNION ALL SELECT * FROM ({board_postings("eightfold", pages="page % 13 <> 12 AND page IN (SELECT page FROM asked)")})),
    tasks AS (SELECT 't' || n AS company_id, 'w' || page_id AS source_id, 'GENERIC_HTML' AS provider, NULL AS problem FROM v_rich
        UNION ALL SELECT DISTINCT 't' || n, 'gb' || n, 'GREENHOUSE', CASE WHEN n IN (SELECT n FROM broken) THEN 'Greenhouse API returned an invalid response.' END FROM parts
        UNION ALL SELECT DISTINCT 't' || n, 'b' || n, 'EIGHTFOLD', CASE WHEN n IN (SELECT n FROM bad_e) THEN 'Eightfold listing API returned an invalid response.' END FROM parts),
    flagged AS (SELECT *, len(list_filter(string_split(locations, '|'), lambda l: {us("l")})) > 0 AS is_us FROM found),
    counts AS (SELECT source_id, count(*) AS found_n, count(*) FILTER (WHERE is_us) AS us_n FROM flagged GROUP BY 1),
    verdicts AS (SELECT t.*, coalesce(c.found_n, 0) AS found_n, coalesce(c.us_n, 0) AS us_n,
        coalesce(problem, CASE WHEN provider = 'GENERIC_HTML' AND coalesce(c.found_n, 0) = 0
            THEN 'Source loaded but no job records were extractable; provider adapter may be required.' END) AS message
        FROM tasks t LEFT JOIN counts c USING (source_id))"""
add(
    "source_results",
    _SCAN
    + """ SELECT company_id, source_id, provider, CASE WHEN message IS NULL THEN found_n END AS discovered_count,
        CASE WHEN message IS NULL THEN us_n END AS united_states_count, CASE WHEN message IS NULL THEN 'SUCCESS' ELSE 'FAILED' END AS status, message FROM verdicts""",
    "v_rich",
)
add(
    "scan_postings",
    _SCAN
    + """ SELECT f.* EXCLUDE (is_us) FROM flagged f JOIN verdicts v USING (source_id) WHERE is_us AND v.message IS NULL
        QUALIFY row_number() OVER (PARTITION BY f.company_id, canonical_url ORDER BY extraction_confidence, source_id DESC) = 1""",
    "v_rich",
)
_RUNS = """res AS (SELECT 'run-' || (o_orderkey // 100) AS scan_id, o_orderkey // 100 AS run_no, 't' || (o_custkey % 20) AS company_id, 's' || o_orderkey AS source_id,
        CASE WHEN o_orderkey % 4 = 0 THEN 'GENERIC_HTML' ELSE 'LEVER' END AS provider, o_orderstatus = 'P' AS failed, o_custkey % 7 AS found_n, o_custkey % 3 AS us_n,
        o_orderpriority AS message, o_orderdate AS scanned_at FROM orders),
    runs AS (SELECT scan_id, min(scanned_at) AS started, max(scanned_at) + INTERVAL 1 MINUTE AS finished, count(DISTINCT company_id) AS target_count,
        coalesce(CAST(sum(CASE WHEN NOT failed THEN us_n END) AS BIGINT), 0) AS job_count, count(*) FILTER (WHERE failed) AS failure_count,
        coalesce(string_agg(concat_ws(',', company_id, source_id, provider, message), '|' ORDER BY company_id, source_id) FILTER (WHERE failed), '') AS failures,
        coalesce(string_agg(concat_ws(',', company_id, source_id, provider, found_n, us_n), '|' ORDER BY company_id, source_id) FILTER (WHERE NOT failed), '') AS source_results
        FROM res GROUP BY scan_id)"""
_RUN_COLUMNS = f"{at('started')} AS started_at, {at('finished')} AS finished_at, target_count, failure_count, failures, source_results, job_count"
add("scan_summary", f"WITH {_RUNS} SELECT scan_id, {_RUN_COLUMNS} FROM runs")
add("health", f"WITH {_RUNS} SELECT 'SCANNED' AS status, scan_id AS id, {_RUN_COLUMNS} FROM runs ORDER BY started DESC, scan_id DESC LIMIT 1")
add("health_without_scans", f"WITH {_RUNS} SELECT CASE WHEN count(*) = 0 THEN 'NO_SCANS' ELSE 'SCANNED' END AS status FROM runs WHERE target_count < 0")
add(
    "scan_message",
    f"""+ {_RUNS}, ch AS (SELECT 'run-' || (CAST(substr(id, 2) AS BIGINT) // 100) AS scan_id, count(*) FILTER (WHERE kind = 'NEW') AS a,
            count(*) FILTER (WHERE kind = 'UPDATED') AS b FROM v_changes GROUP BY 1)
        SELECT scan_id, 'Found ' || job_count || ' matching ' || CASE WHEN job_count = 1 THEN 'role' ELSE 'roles' END || ' · ' || coalesce(a, 0) || ' new · '
            || coalesce(b, 0) || ' updated' || CASE WHEN failure_count = 0 THEN '' WHEN failure_count = 1 THEN ' · 1 source failed'
            ELSE ' · ' || failure_count || ' source failures' END AS message FROM runs LEFT JOIN ch USING (scan_id)""",
    "v_changes",
)
add(
    "dashboard_metrics",
    """SELECT (SELECT count(*) FROM v_targets) AS target_count, (SELECT count(*) FROM v_sources) AS source_count,
        (SELECT count(*) FROM v_postings WHERE active) AS posting_count, (SELECT count(*) FROM v_events WHERE active) AS event_count,
        (SELECT count(*) FROM v_changes WHERE read_at IS NULL) AS unread_count""",
    "v_targets",
    "v_sources",
    "v_postings",
    "v_events",
    "v_changes",
)

# ---- snapshot and history --------------------------------------------------------------------


def state(until: str, name: str) -> str:
    """The state after all scans up to and including a day."""
    return f"""{name} AS (SELECT s.id, s.company_id, s.source_id, s.canonical_url, s.title, f.first_at, s.seen_at AS last_at, s.fp,
        least(2, (SELECT count(*) FROM v_scans c WHERE c.source_id = s.source_id AND c.scanned_at > s.seen_at AND c.scanned_at <= {until})) AS strikes
        FROM (SELECT * FROM v_seen WHERE seen_at <= {until} QUALIFY row_number() OVER (PARTITION BY company_id, canonical_url ORDER BY seen_at DESC) = 1) s
        JOIN (SELECT company_id, canonical_url, min(seen_at) AS first_at FROM v_seen GROUP BY 1, 2) f USING (company_id, canonical_url))"""


_STATE = f"id, company_id, source_id, canonical_url, title, {at('first_at')} AS first_seen_at, {at('last_at')} AS last_seen_at, fp AS content_fingerprint, strikes < 2 AS active, CAST(strikes AS INTEGER) AS missed_scans"
_LOG = "log AS (SELECT *, lag(fp) OVER (PARTITION BY company_id, canonical_url ORDER BY seen_at) AS before FROM v_seen), changes AS (SELECT *, CASE WHEN before IS NULL THEN 'NEW' WHEN before <> fp THEN 'UPDATED' END AS kind FROM log)"
_LAST, _END = "(SELECT max(scanned_at) FROM v_scans)", "timestamp '2024-12-31'"
add("missed_scans", f"+ {state(_END, 'final')} SELECT {_STATE} FROM final", "v_seen", "v_scans")
add("replay_onto_snapshot", f"+ {state(_END, 'final')} SELECT {_STATE} FROM final", "v_seen", "v_scans")
add(
    "snapshot_merge",
    f"+ {state(_LAST, 'final')}, {_LOG} SELECT f.*, c.kind AS change_kind FROM (SELECT {_STATE} FROM final) f LEFT JOIN changes c ON c.company_id = f.company_id AND c.canonical_url = f.canonical_url AND c.seen_at = {_LAST}",
    "v_seen",
    "v_scans",
)
add(
    "scan_changes",
    f"+ {_LOG} SELECT id AS job_id, company_id, kind, {at('seen_at')} AS created_at, CAST(NULL AS VARCHAR) AS read_at FROM changes WHERE kind IS NOT NULL AND seen_at = {_LAST}",
    "v_seen",
    "v_scans",
)
ORACLE["snapshot_merge_in_place"] = ORACLE["snapshot_merge"]
add(
    "replay_changes",
    f"+ {_LOG} SELECT id AS job_id, company_id, canonical_url, kind, {at('seen_at')} AS created_at FROM changes WHERE kind IS NOT NULL",
    "v_seen",
)
add(
    "late_sightings",
    f"""SELECT s.id, s.source_id, {at("s.seen_at")} AS last_seen_at FROM v_seen s
        JOIN (SELECT company_id, canonical_url, max(seen_at) AS stored FROM v_seen WHERE seen_at < {_LAST} GROUP BY 1, 2) k USING (company_id, canonical_url)
        WHERE s.seen_at <= k.stored""",
    "v_seen",
    "v_scans",
)
add(
    "reactivation",
    f"""+ pairs AS (SELECT *, lag(source_id) OVER w AS s0, lag(seen_at) OVER w AS t0, lag(fp) OVER w AS fp0 FROM v_seen WINDOW w AS (PARTITION BY company_id, canonical_url ORDER BY seen_at))
        SELECT company_id, canonical_url, source_id, {at("seen_at")} AS reopened_at, fp0 <> fp AS is_update FROM pairs p
        WHERE t0 IS NOT NULL AND (SELECT count(*) FROM v_scans c WHERE c.source_id = p.s0 AND c.scanned_at > p.t0 AND c.scanned_at < p.seen_at) >= 2""",
    "v_seen",
    "v_scans",
)
_K = "CAST(substr(id, 2) AS BIGINT)"
add(
    "event_merge",
    f"""+ s AS (SELECT *, {_K} AS k FROM v_events),
        known AS (SELECT id, company_id, canonical_url, CASE WHEN k % 3 = 1 THEN upper(title) ELSE title END AS title, {at("first_seen_at")} AS first_seen_at,
            CASE WHEN k % 3 = 1 THEN '2026-06-01 00:00:00' ELSE {at("last_seen_at")} END AS last_seen_at,
            CASE WHEN k % 3 = 1 AND k % 2 = 0 THEN 'changed' ELSE content_fingerprint END AS content_fingerprint,
            active OR k % 3 = 1 AS active, CASE WHEN k % 3 = 1 AND k % 2 = 0 THEN 'UPDATED' END AS change_kind FROM s),
        new AS (SELECT id, company_id, canonical_url || '/new' AS canonical_url, upper(title) AS title, '2026-06-01 00:00:00' AS first_seen_at, '2026-06-01 00:00:00' AS last_seen_at,
            CASE WHEN k % 2 = 0 THEN 'changed' ELSE content_fingerprint END AS content_fingerprint, true AS active, 'NEW' AS change_kind FROM s WHERE k % 3 = 2)
        SELECT * FROM known UNION ALL SELECT * FROM new""",
    "v_events",
)
add("active_postings", f"SELECT id, company_id, title, {at('last_seen_at')} AS last_seen_at, missed_scans FROM v_postings WHERE active", "v_postings")
add("active_events", f"SELECT id, title, {at('starts_at')} AS starts_at, {at('last_seen_at')} AS last_seen_at FROM v_events WHERE active", "v_events")

# ---- readers ---------------------------------------------------------------------------------

_NAMED = "LEFT JOIN (SELECT id AS tid, name FROM v_targets WHERE n % 10 <> 9) t ON t.tid = x.company_id"
add(
    "opportunity_feed",
    f"""SELECT x.id, coalesce(t.name, 'Unknown company') AS company_name, lower(replace(employment_type, '_', ' ')) AS employment_type, title,
        CASE WHEN array_to_string(locations, '') = '' THEN 'Location not provided' ELSE array_to_string(locations, ' · ') END AS locations,
        CAST(round(extraction_confidence * 100) AS INTEGER) || '% extraction confidence' AS confidence, application_url
        FROM v_postings x {_NAMED} WHERE active""",
    "v_postings",
    "v_targets",
)
add(
    "event_feed",
    f"""SELECT x.id, coalesce(t.name, 'Unknown company') AS company_name, lower(replace(event_type, '_', ' ')) AS event_type, title,
        coalesce(location, CASE WHEN format = 'VIRTUAL' THEN 'Virtual' ELSE 'Location not announced' END) AS place,
        lower(replace(status, '_', ' ')) AS status, registration_url FROM v_events x {_NAMED}""",
    "v_events",
    "v_targets",
)
add(
    "feed_merge",
    f"""SELECT id, company_id, canonical_url, CASE WHEN {_K} % 2 = 0 THEN title ELSE upper(title) END AS title FROM v_postings
        WHERE {_K} % 3 <> 0 OR {_K} % 2 = 0""",
    "v_postings",
)
add(
    "opportunities",
    f"""SELECT 'JOB' AS kind, id, company_id, title, employment_type, CAST(NULL AS VARCHAR) AS event_type, CAST(NULL AS VARCHAR) AS starts_at FROM v_postings
        UNION ALL SELECT 'EVENT', id, company_id, title, NULL, event_type, {at("starts_at")} FROM v_events""",
    "v_postings",
    "v_events",
)

# ---- inbox and outbox ------------------------------------------------------------------------

add("change_log", f"SELECT id, job_id, company_id, kind, {at('created_at')} AS created_at, {at('read_at')} AS read_at FROM v_changes WHERE read_at IS NULL", "v_changes")
_ITEMS = "v_changes c JOIN v_targets t ON t.id = c.company_id JOIN v_postings p ON p.id = c.job_id"
add(
    "inbox",
    f"SELECT c.id, c.job_id, c.company_id, c.kind, {at('c.created_at')} AS created_at, t.name AS company_name, p.title AS job_title, p.application_url FROM {_ITEMS} WHERE c.read_at IS NULL",
    "v_changes",
    "v_targets",
    "v_postings",
)
add(
    "inbox_apply_marks",
    f"""+ marks AS (SELECT 'c' || l_orderkey AS id, min(l_shipdate) AS at FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1)
        SELECT c.id, c.kind, strftime(coalesce(c.read_at, m.at), {TS}) AS read_at FROM v_changes c LEFT JOIN marks m ON m.id = c.id WHERE CAST(substr(c.id, 2) AS BIGINT) % 5 <> 0""",
    "v_changes",
)
add(
    "inbox_counts",
    """+ marks AS (SELECT DISTINCT 'c' || l_orderkey AS id FROM lineitem WHERE l_orderkey % 2 = 0 AND l_shipdate IS NOT NULL)
        SELECT CASE WHEN id IN (SELECT id FROM marks) THEN 'marked' ELSE 'unread' END AS count, count(*) AS n FROM v_changes WHERE read_at IS NULL GROUP BY 1
        UNION ALL SELECT 'dismissed', count(*) FROM v_changes WHERE CAST(substr(id, 2) AS BIGINT) % 5 = 0""",
    "v_changes",
)
add("inbox_mark_all", f"SELECT id, strftime(coalesce(read_at, {NOW}), {TS}) AS read_at FROM v_changes", "v_changes")
add(
    "enqueue_deliveries",
    f"""SELECT substr(sha256(c.id || chr(31) || 'DISCORD'), 1, 32) AS id, c.id AS change_id, 'DISCORD' AS channel, 'PENDING' AS status, CAST(0 AS INTEGER) AS attempts,
        strftime({NOW}, {TS}) AS next_attempt_at, CAST(NULL AS VARCHAR) AS last_error, CAST(NULL AS VARCHAR) AS external_id,
        strftime({NOW}, {TS}) AS created_at, strftime({NOW}, {TS}) AS updated_at
        FROM v_changes c WHERE c.id NOT IN (SELECT change_id FROM v_deliveries WHERE channel = 'DISCORD' AND {_K} % 2 = 0)""",
    "v_changes",
    "v_deliveries",
)
_READY = f"""ready AS (SELECT d.id, d.change_id, d.attempts, d.created_at AS queued, c.kind, t.name AS company_name, p.title AS job_title, p.application_url
    FROM v_deliveries d JOIN v_changes c ON c.id = d.change_id JOIN v_targets t ON t.id = c.company_id JOIN v_postings p ON p.id = c.job_id
    WHERE d.channel = 'DISCORD' AND d.status IN ('PENDING', 'FAILED') AND d.next_attempt_at <= {NOW} AND p.active AND p.missed_scans = 0),
    claims AS (SELECT * FROM ready ORDER BY queued, id LIMIT 10)"""
_OUTBOX = ("v_deliveries", "v_changes", "v_targets", "v_postings")
add(
    "claim_deliveries",
    f"+ {_READY} SELECT id, change_id, attempts + 1 AS attempts, {at('queued')} AS queued_at, kind, company_name, job_title, application_url FROM claims",
    *_OUTBOX,
)
add("claimable_deliveries", f"+ {_READY} SELECT id, change_id, attempts, {at('queued')} AS queued_at, company_name, job_title FROM ready", *_OUTBOX)
add(
    "delivery_claimed",
    f"""+ {_READY} SELECT d.id, d.change_id, d.channel, CASE WHEN k.id IS NULL THEN d.status ELSE 'SENDING' END AS status,
        d.attempts + CASE WHEN k.id IS NULL THEN 0 ELSE 1 END AS attempts, {at("d.next_attempt_at")} AS next_attempt_at, d.last_error, d.external_id,
        {at("d.created_at")} AS created_at, strftime(CASE WHEN k.id IS NULL THEN d.updated_at ELSE {NOW} END, {TS}) AS updated_at
        FROM v_deliveries d LEFT JOIN claims k ON k.id = d.id""",
    *_OUTBOX,
)
_OUTCOMES = """outc AS (SELECT 'd' || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'm' || o_orderkey END AS external_id,
    CASE WHEN o_orderkey % 6 = 0 THEN repeat(o_orderpriority || ' ', 80) END AS error FROM orders WHERE o_orderkey % 2 = 0)"""
_RETRY = f"{NOW} + to_minutes(CASE WHEN d.attempts <= 1 THEN 1 WHEN d.attempts = 2 THEN 5 WHEN d.attempts = 3 THEN 15 ELSE 60 END)"
add(
    "delivery_apply",
    f"""+ {_OUTCOMES} SELECT d.id, d.change_id, d.channel, CASE WHEN o.id IS NULL THEN d.status WHEN o.error IS NULL THEN 'SENT' ELSE 'FAILED' END AS status, d.attempts,
        strftime(CASE WHEN o.error IS NULL THEN d.next_attempt_at ELSE {_RETRY} END, {TS}) AS next_attempt_at,
        CASE WHEN o.id IS NULL THEN d.last_error ELSE o.error END AS last_error,
        CASE WHEN o.id IS NOT NULL AND o.error IS NULL THEN coalesce(o.external_id, 'accepted') ELSE d.external_id END AS external_id,
        {at("d.created_at")} AS created_at, strftime(CASE WHEN o.id IS NULL THEN d.updated_at ELSE {NOW} END, {TS}) AS updated_at
        FROM v_deliveries d LEFT JOIN outc o ON o.id = d.id""",
    "v_deliveries",
)
add(
    "delivery_changed",
    f"""+ {_READY}, {_OUTCOMES}, sending AS (SELECT d.* REPLACE (d.attempts + CASE WHEN k.id IS NULL THEN 0 ELSE 1 END AS attempts)
            FROM v_deliveries d LEFT JOIN ready k ON k.id = d.id WHERE k.id IS NOT NULL OR d.status = 'SENDING')
        SELECT d.id, d.change_id, d.channel, CASE WHEN o.error IS NULL THEN 'SENT' ELSE 'FAILED' END AS status, CAST(d.attempts AS INTEGER) AS attempts,
        strftime(CASE WHEN o.error IS NULL THEN d.next_attempt_at ELSE {_RETRY} END, {TS}) AS next_attempt_at, o.error AS last_error,
        CASE WHEN o.error IS NULL THEN coalesce(o.external_id, 'accepted') ELSE d.external_id END AS external_id,
        {at("d.created_at")} AS created_at, strftime({NOW}, {TS}) AS updated_at FROM sending d JOIN outc o ON o.id = d.id""",
    *_OUTBOX,
)
add(
    "delivery_fail",
    f"""+ {_OUTCOMES} SELECT d.id, d.attempts, strftime(CASE WHEN o.error IS NULL THEN d.next_attempt_at ELSE {_RETRY} END, {TS}) AS next_attempt_at,
        CASE WHEN o.error IS NULL THEN d.last_error ELSE substr(o.error, 1, 500) END AS last_error
        FROM v_deliveries d LEFT JOIN outc o ON o.id = d.id AND o.error IS NOT NULL WHERE d.status = 'FAILED' OR o.error IS NOT NULL""",
    "v_deliveries",
)
_ROUND = f"""{_OUTCOMES}, present AS (SELECT * FROM v_deliveries WHERE {_K} % 3 <> 0),
    queued AS (SELECT substr(sha256(c.id || chr(31) || 'DISCORD'), 1, 32) AS id, c.id AS change_id FROM v_changes c WHERE c.id NOT IN (SELECT change_id FROM present WHERE channel = 'DISCORD')),
    waiting AS (SELECT id, change_id, channel, status, attempts, next_attempt_at, last_error, external_id, created_at, updated_at FROM present
        UNION ALL SELECT id, change_id, 'DISCORD', 'PENDING', 0, {NOW}, NULL, NULL, {NOW}, {NOW} FROM queued),
    claimed AS (SELECT w.id FROM waiting w JOIN v_changes c ON c.id = w.change_id JOIN v_targets t ON t.id = c.company_id JOIN v_postings p ON p.id = c.job_id
        WHERE w.channel = 'DISCORD' AND w.status IN ('PENDING', 'FAILED') AND w.next_attempt_at <= {NOW} AND p.active AND p.missed_scans = 0),
    answered AS (SELECT * FROM outc WHERE id IN (SELECT id FROM claimed)),
    tried AS (SELECT w.* REPLACE (w.attempts + CASE WHEN k.id IS NULL THEN 0 ELSE 1 END AS attempts), k.id IS NOT NULL AS taken FROM waiting w LEFT JOIN claimed k ON k.id = w.id)"""
add(
    "delivery_round",
    f"""+ {_ROUND} SELECT d.id, d.change_id, d.channel, CASE WHEN o.error IS NOT NULL THEN 'FAILED' WHEN o.id IS NOT NULL THEN 'SENT' WHEN taken THEN 'SENDING' ELSE d.status END AS status,
        CAST(d.attempts AS INTEGER) AS attempts, strftime(CASE WHEN o.error IS NULL THEN d.next_attempt_at ELSE {_RETRY} END, {TS}) AS next_attempt_at,
        CASE WHEN o.id IS NULL THEN d.last_error ELSE o.error END AS last_error,
        CASE WHEN o.id IS NOT NULL AND o.error IS NULL THEN coalesce(o.external_id, 'accepted') ELSE d.external_id END AS external_id,
        {at("d.created_at")} AS created_at, strftime(CASE WHEN taken THEN {NOW} ELSE d.updated_at END, {TS}) AS updated_at
        FROM tried d LEFT JOIN answered o ON o.id = d.id""",
    *_OUTBOX,
)
add(
    "delivery_round_counts",
    f"""+ {_ROUND} SELECT (SELECT count(*) FROM queued) AS queued, (SELECT count(*) FROM claimed) AS claimed,
        (SELECT count(*) FROM answered WHERE error IS NULL) AS sent, (SELECT count(*) FROM answered WHERE error IS NOT NULL) AS failed""",
    *_OUTBOX,
)
add("delivery_outcomes", f"WITH {_OUTCOMES} SELECT count(*) FILTER (WHERE error IS NULL) AS sent, count(*) FILTER (WHERE error IS NOT NULL) AS failed FROM outc")
_ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"
add(
    "notification_payload",
    f"""SELECT c.id, '{{"username":"Rolewatch","content":"' || CASE c.kind WHEN 'NEW' THEN '🚨 New opportunity at **' ELSE '📝 Opportunity updated at **' END || t.name
        || '**","embeds":[{{"title":"' || p.title || '","url":"' || p.application_url || '","color":' || CASE c.kind WHEN 'NEW' THEN '2058312' ELSE '16032353' END
        || ',"fields":[{{"name":"Company","value":"' || t.name || '","inline":true}},{{"name":"Change","value":"'
        || CASE c.kind WHEN 'NEW' THEN 'New role' ELSE 'Posting updated' END || '","inline":true}}],"timestamp":"' || strftime(c.created_at, {_ISO})
        || '","footer":{{"text":"Rolewatch discovery alert"}}}}],"allowed_mentions":{{"parse":[]}}}}' AS payload FROM {_ITEMS}""",
    "v_changes",
    "v_targets",
    "v_postings",
)
# Toronto moves its clocks on 8 March 2026 at 07:00 UTC.
_LOCAL = "starts_at - CASE WHEN starts_at < timestamp '2026-03-08 07:00:00' THEN INTERVAL 5 HOUR ELSE INTERVAL 4 HOUR END"
add(
    "event_payload",
    f"""SELECT e.id, '{{"username":"Rolewatch","content":"🎓 ' || CASE WHEN active THEN 'New' ELSE 'Updated' END || ' early-career event at **' || t.name
        || '**","embeds":[{{"title":"' || title || '","url":"' || registration_url || '","color":4359668,"description":"' || substr(repeat(description, 200), 1, 3000)
        || '","fields":[{{"name":"Location","value":"' || coalesce(location, 'Not announced') || '","inline":true}},{{"name":"Starts","value":"'
        || coalesce(strftime({_LOCAL}, '%-m/%-d/%Y, %-I:%M:%S %p'), 'Not announced') || '","inline":true}},{{"name":"Status","value":"'
        || lower(replace(status, '_', ' ')) || '","inline":true}}],"timestamp":"' || strftime(last_seen_at, {_ISO})
        || '","footer":{{"text":"Rolewatch event alert"}}}}],"allowed_mentions":{{"parse":[]}}}}' AS payload
        FROM v_events e JOIN v_targets t ON t.id = e.company_id""",
    "v_events",
    "v_targets",
)
