"""Table schemas as DDL strings."""

POSTING = """
    id STRING, company_id STRING, source_id STRING, source_url STRING, canonical_url STRING,
    application_url STRING, title STRING, description STRING, locations ARRAY<STRING>,
    employment_type STRING, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP,
    content_fingerprint STRING, extraction_confidence DOUBLE
"""
SNAPSHOT = POSTING + ", active BOOLEAN, missed_scans INT"
EVENT = """
    id STRING, company_id STRING, source_id STRING, source_url STRING, canonical_url STRING,
    registration_url STRING, title STRING, description STRING, event_type STRING,
    starts_at TIMESTAMP, ends_at TIMESTAMP, timezone STRING, format STRING, location STRING,
    registration_deadline TIMESTAMP, audience ARRAY<STRING>, status STRING,
    first_seen_at TIMESTAMP, last_seen_at TIMESTAMP, content_fingerprint STRING,
    extraction_confidence DOUBLE, active BOOLEAN
"""
TARGET = """
    id STRING, name STRING, domain STRING, priority STRING, role_keywords ARRAY<STRING>,
    event_keywords ARRAY<STRING>, created_at TIMESTAMP
"""
TARGET_SOURCE = "id STRING, company_id STRING, kind STRING, url STRING, enabled BOOLEAN, scan_cron STRING"
TARGET_INPUT = """
    name STRING, domain STRING, career_url STRING, early_careers_url STRING, events_url STRING,
    priority STRING, role_keywords ARRAY<STRING>, event_keywords ARRAY<STRING>, scan_cron STRING
"""
# What a crawler landed: JSON payloads of boards, and pages under the provider GENERIC_HTML.  The row
# records the route it was fetched by, so reading it needs no join.
LANDED = """
    scan_id STRING, company_id STRING, source_id STRING, source_url STRING, provider STRING,
    api_origin STRING, site STRING, query_no INT, page_no INT, observed_at TIMESTAMP, body STRING
"""
# Fixed value: the provider of the row that ends a scan; its page_no is the number of the scan's other rows.
SCAN_END = "SCAN_END"
CHANGE = "id STRING, job_id STRING, company_id STRING, kind STRING, created_at TIMESTAMP, read_at TIMESTAMP"
DELIVERY = """
    id STRING, change_id STRING, channel STRING, status STRING, attempts INT,
    next_attempt_at TIMESTAMP, last_error STRING, external_id STRING,
    created_at TIMESTAMP, updated_at TIMESTAMP
"""
SCAN_RUN = """
    id STRING, started_at TIMESTAMP, finished_at TIMESTAMP, target_count INT, job_count INT,
    failure_count INT
"""

# Source kinds are a closed list, at most one source of each per company.
SOURCE_KINDS = ["CAREERS", "EARLY_CAREERS", "EVENTS"]
PRIORITIES = ["HIGH", "MEDIUM", "LOW"]
