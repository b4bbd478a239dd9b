"""The watchlist: targets and their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import clean_keywords, search_queries
from ..functions.cron import is_valid_cron
from ..functions.ids import fingerprint
from ..functions.text import let, lit_true, null_if_blank, text_or_empty, trim_text
from ..functions.urls import http_url_error, parsed_url
from ..schemas import SOURCE_KINDS
from .shaping import join_dimension

DEFAULT_CRON = "* * * * *"
DEFAULT_PRIORITY = "MEDIUM"
TAG_COUNT = 5

_INPUT_URLS = [
    ("CAREERS", "career_url", "Career URL"),
    ("EARLY_CAREERS", "early_careers_url", "Early-careers URL"),
    ("EVENTS", "events_url", "Events URL"),
]


def nest_sources(sources: DataFrame) -> DataFrame:
    """One row per company with its sources ordered by kind.

    A company has at most one source per kind and the kinds are a closed list, so the aggregate has a
    fixed size instead of collecting rows.
    """
    source = F.struct("id", "kind", "url", "enabled", "scan_cron")
    per_kind = [F.max(F.when(F.col("kind") == kind, source)) for kind in sorted(SOURCE_KINDS)]
    return sources.groupBy("company_id").agg(F.array_compact(F.array(*per_kind)).alias("sources"))


def watchlist(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Targets by name, each with its sources."""
    nested = nest_sources(sources).withColumnRenamed("company_id", "id")
    none = F.array().cast(nested.schema["sources"].dataType)
    joined = targets.join(nested, "id", "left").withColumn("sources", F.coalesce("sources", none))
    return joined.orderBy(F.lower("name"), "id")


def normalize_domain(value: Column) -> Column:
    host = F.regexp_replace(F.lower(trim_text(text_or_empty(value))), r"^https?://", "")
    return F.regexp_replace(host, r"/\z", "")


def validate_targets(inputs: DataFrame) -> DataFrame:
    """Inputs with ``errors`` (empty when fine) and the cleaned target columns, sources nested.

    Ids derive from the domain, so importing the same company twice yields the same id.
    """

    def source(kind: str, column: str, company: Column, cron: Column) -> Column:
        def build(url: Column) -> Column:
            return F.struct(
                F.substring(fingerprint(company, F.lit(kind)), 1, 24).alias("id"),
                F.lit(kind).alias("kind"),
                url.alias("url"),
                F.lit(True).alias("enabled"),
                cron.alias("scan_cron"),
            )

        given = trim_text(text_or_empty(F.col(column)))
        return F.when(given != "", let(parsed_url(given), build))

    domain = normalize_domain(F.col("domain"))
    cron = F.coalesce(null_if_blank(trim_text(F.col("scan_cron"))), F.lit(DEFAULT_CRON))
    staged = inputs.withColumns(
        {
            "_name": trim_text(text_or_empty(F.col("name"))),
            "_domain": domain,
            "_id": F.substring(fingerprint(domain), 1, 24),
            "_cron": cron,
        }
    )
    # The messages about a target that cannot be saved.
    problems = [
        F.when(F.col("_name") == "", F.lit("Company name is required.")),
        F.when(
            (F.col("_domain") == "") | F.col("_domain").contains("/"), F.lit("Domain must be a hostname.")
        ),
    ]
    for _, column, label in _INPUT_URLS:
        given = trim_text(text_or_empty(F.col(column)))
        problems.append(F.when(given != "", http_url_error(given, label)))
    missing = trim_text(text_or_empty(F.col("career_url"))) == ""
    problems.append(F.when(missing, F.lit("Career URL is required.")))
    bad_cron = F.array(F.lit("Scan schedule must be a valid five-field cron expression."))

    def with_cron(errors: Column) -> Column:
        return F.when((F.size(errors) == 0) & ~is_valid_cron(F.col("_cron")), bad_cron).otherwise(errors)

    sources = F.array_compact(
        F.array(*[source(kind, column, F.col("_id"), F.col("_cron")) for kind, column, _ in _INPUT_URLS])
    )
    own = {"id", "name", "domain", "priority", "role_keywords", "event_keywords", "sources", "errors"}
    used = {"name", "domain", "priority", "role_keywords", "event_keywords", "scan_cron"} | {c for _, c, _ in _INPUT_URLS}
    carried = [c for c in inputs.columns if c not in own | used]
    return staged.select(
        *carried,
        F.col("_id").alias("id"),
        F.col("_name").alias("name"),
        F.col("_domain").alias("domain"),
        F.coalesce("priority", F.lit(DEFAULT_PRIORITY)).alias("priority"),
        clean_keywords(F.col("role_keywords")).alias("role_keywords"),
        clean_keywords(F.col("event_keywords")).alias("event_keywords"),
        sources.alias("sources"),
        let(F.array_compact(F.array(*problems)), with_cron).alias("errors"),
    )


def admit_requests(requests: DataFrame, limit: int | None = None) -> DataFrame:
    """Requests of well-formed targets, at most ``limit`` if one is given, all or nothing: adds ``admitted``.

    ``requests`` has request_id and the nested target columns.
    """
    required = ["id", "name", "domain", "created_at", "role_keywords", "event_keywords", "sources"]
    formed = F.lit(True)
    for column in required:
        formed &= F.col(column).isNotNull()
    sources = F.forall("sources", lambda s: s["id"].isNotNull() & s["url"].isNotNull() & s["kind"].isNotNull() & s["scan_cron"].isNotNull())
    formed &= lit_true(sources)
    fits = F.lit(True) if limit is None else F.count("*") <= limit
    verdicts = requests.groupBy("request_id").agg((fits & (F.count_if(~formed) == 0)).alias("admitted"))
    return join_dimension(requests, verdicts, ["request_id"], "inner")


def conflicts(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose name or domain another target already has: adds ``conflict_id`` where so.

    Existing targets are first reduced to two ids per name and per domain, which is enough to find
    one that differs from the candidate, and keeps a popular name from pairing with itself.
    """

    def ids(rows: DataFrame, key: Column, prefix: str) -> DataFrame:
        return rows.groupBy(key.alias(f"_{prefix}")).agg(
            F.min("id").alias(f"_{prefix}_min"), F.max("id").alias(f"_{prefix}_max")
        )

    keyed = candidates.withColumns({"_name": F.lower("name"), "_domain": F.col("domain")})
    keyed = join_dimension(keyed, ids(existing, F.lower("name"), "name"), ["_name"])
    keyed = join_dimension(keyed, ids(existing, F.col("domain"), "domain"), ["_domain"])
    found = F.least(
        *[F.when(F.col(c) != F.col("id"), F.col(c)) for c in ("_name_min", "_name_max", "_domain_min", "_domain_max")]
    )
    return keyed.select(*candidates.columns, found.alias("conflict_id")).where(F.col("conflict_id").isNotNull())


def save_targets(stored: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Save candidates only if none is in conflict: the watchlist after it, and the conflicts.

    A conflict is a name or domain that a stored target with another id has, or that two candidates
    with different ids share; candidates repeated under one id are in conflict with each other
    (``conflict_id`` is then their own id).  With any conflict the stored table stays as it is.
    """
    repeats = candidates.groupBy("id").agg(F.count("*").alias("_times")).where("_times > 1")
    repeated = join_dimension(candidates, repeats.select("id"), ["id"], "left_semi").withColumn("conflict_id", F.col("id"))
    against = stored.select("id", "name", "domain").unionByName(candidates.select("id", "name", "domain"))
    found = conflicts(candidates, against).unionByName(repeated.select(*candidates.columns, "conflict_id"))
    # One row, which says whether anything may be saved.
    clean = found.agg((F.count("*") == 0).alias("_clean"), F.lit(1).alias("_one"))
    allowed = candidates.withColumn("_one", F.lit(1)).join(F.broadcast(clean), "_one").where("_clean")
    return merge_targets(stored, allowed.select(*candidates.columns)), found


def merge_targets(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or replace targets by id; a stored target keeps its creation time."""
    both = stored.alias("s").join(incoming.withColumn("_given", F.lit(True)).alias("n"), "id", "full_outer")
    given = F.col("n._given").isNotNull()
    columns = []
    for name in stored.columns:
        if name == "id":
            columns.append(F.col("id"))
        elif name == "created_at":
            columns.append(F.coalesce(F.col("s.created_at"), F.col("n.created_at")).alias(name))
        else:
            columns.append(F.when(given, F.col(f"n.{name}")).otherwise(F.col(f"s.{name}")).alias(name))
    return both.select(*columns)


def merge_sources(stored: DataFrame, incoming: DataFrame, saved: DataFrame) -> DataFrame:
    """Replace all sources of the saved targets; ``saved`` has their ids in ``id``."""
    companies = saved.select(F.col("id").alias("company_id")).distinct()
    kept = join_dimension(stored, companies, ["company_id"], "left_anti")
    return kept.unionByName(incoming.select(*stored.columns))


def edit_targets(current: DataFrame, current_sources: DataFrame, edits: DataFrame) -> DataFrame:
    """Validated new versions that keep id, creation time and, per kind, the source id.

    ``edits`` is the error-free output of ``validate_targets`` with the edited target in ``target_id``.
    """
    kept = current.select(F.col("id").alias("target_id"), "created_at")
    known = nest_sources(current_sources).select(F.col("company_id").alias("target_id"), F.col("sources").alias("_known"))
    edited = edits.join(kept, "target_id").join(known, "target_id", "left")

    def same_source(source: Column) -> Column:
        before = F.try_element_at(F.filter("_known", lambda k: k["kind"] == source["kind"]), F.lit(1))
        return source.withField("id", F.coalesce(before["id"], source["id"]))

    return edited.select(
        F.col("target_id").alias("id"),
        "name",
        "domain",
        "priority",
        "role_keywords",
        "event_keywords",
        "created_at",
        F.transform("sources", same_source).alias("sources"),
    )


def unnest_sources(targets: DataFrame) -> DataFrame:
    exploded = targets.select(F.col("id").alias("company_id"), F.explode("sources").alias("s"))
    return exploded.select("s.id", "company_id", "s.kind", "s.url", "s.enabled", "s.scan_cron")


def absent(candidates: DataFrame, targets: DataFrame, by_name: bool = True) -> DataFrame:
    """Candidates whose domain (and, by default, name) is not on the watchlist yet."""
    missing = candidates.join(targets.select("domain").distinct(), "domain", "left_anti")
    if by_name:
        names = targets.select(F.lower("name").alias("_name")).distinct()
        missing = missing.withColumn("_name", F.lower("name")).join(names, "_name", "left_anti").drop("_name")
    return missing


def missing_per_preset(presets: DataFrame, targets: DataFrame) -> DataFrame:
    """How many companies of each preset the watchlist lacks, by domain."""
    marked = presets.join(
        targets.select("domain").distinct().withColumn("_present", F.lit(True)), "domain", "left"
    )
    return marked.groupBy("preset_id").agg(F.count_if(F.col("_present").isNull()).alias("missing_count"))


def sync_targets(companies: DataFrame, targets: DataFrame, role_keywords: list[str], event_keywords: list[str]) -> DataFrame:
    """Default targets for the companies whose domain is missing from the watchlist."""
    new = absent(companies, targets, by_name=False)
    company = F.substring(fingerprint(F.col("domain")), 1, 24)
    source = F.struct(
        F.substring(fingerprint(company, F.lit("CAREERS")), 1, 24).alias("id"),
        F.lit("CAREERS").alias("kind"),
        F.col("career_url").alias("url"),
        F.lit(True).alias("enabled"),
        F.lit(DEFAULT_CRON).alias("scan_cron"),
    )
    return new.select(
        company.alias("id"),
        "name",
        "domain",
        F.lit("HIGH").alias("priority"),
        F.array(*[F.lit(k) for k in role_keywords]).alias("role_keywords"),
        F.array(*[F.lit(k) for k in event_keywords]).alias("event_keywords"),
        F.array(source).alias("sources"),
    )


def sync_report(targets: DataFrame, additions: DataFrame) -> DataFrame:
    """Sizes before and after a synchronisation; the names are the rows of ``additions``."""
    both = targets.select(F.lit(1).alias("before"), F.lit(0).alias("added")).unionAll(
        additions.select(F.lit(0).alias("before"), F.lit(1).alias("added"))
    )
    return both.agg(
        F.coalesce(F.sum("before"), F.lit(0)).alias("before"),
        F.coalesce(F.sum("added"), F.lit(0)).alias("added"),
        F.coalesce(F.sum(F.col("before") + F.col("added")), F.lit(0)).alias("after"),
    )


def preview(targets: DataFrame, sources: DataFrame, count: int = 3) -> DataFrame:
    """The first targets of the list with their number of sources and first tags."""
    tags = F.slice(F.concat("role_keywords", "event_keywords"), 1, TAG_COUNT)
    first = targets.orderBy(F.lower("name"), "id").limit(count)
    nested = nest_sources(sources).withColumnRenamed("company_id", "id")
    return first.join(nested, "id", "left").select(
        "id",
        "name",
        F.upper(F.substring("name", 1, 2)).alias("initials"),
        F.coalesce(F.size("sources"), F.lit(0)).cast("bigint").alias("source_count"),
        tags.alias("tags"),
    )


def delete_targets(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """Remove targets and all that hangs on them.  ``deleted`` has the target ids in ``id``.

    ``tables``: targets, sources, postings, events, changes, deliveries.
    """
    gone = deleted.select(F.col("id").alias("company_id")).distinct()
    kept = {"targets": tables["targets"].join(deleted.select("id").distinct(), "id", "left_anti")}
    for name in ("sources", "postings", "events", "changes"):
        kept[name] = join_dimension(tables[name], gone, ["company_id"], "left_anti")
    lost = join_dimension(tables["changes"], gone, ["company_id"], "left_semi").select(F.col("id").alias("change_id"))
    kept["deliveries"] = tables["deliveries"].join(lost, "change_id", "left_anti")
    return kept


def queries_per_target(targets: DataFrame) -> DataFrame:
    """Search terms of every target, numbered in the order they are asked."""
    return targets.select(
        F.col("id").alias("company_id"), F.posexplode(search_queries(F.col("role_keywords"))).alias("query_no", "query")
    )
