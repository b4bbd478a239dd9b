"""Which job board serves which company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_text

GENERIC = "GENERIC_HTML"

# Boards of the public posting API, keyed by lower-case company name.
GREENHOUSE = {
    "adyen": "adyen", "affirm": "affirm", "airbnb": "airbnb", "akuna capital": "akunacapital",
    "anduril": "andurilindustries", "anthropic": "anthropic", "asana": "asana", "block": "block",
    "brex": "brex", "chime": "chime", "cloudflare": "cloudflare", "cockroach labs": "cockroachlabs",
    "coinbase": "coinbase", "coreweave": "coreweave", "databricks": "databricks", "datadog": "datadog",
    "discord": "discord", "dropbox": "dropbox", "duolingo": "duolingo", "elastic": "elastic",
    "figma": "figma", "five rings": "fiveringsllc", "gitlab": "gitlab", "godaddy": "godaddy",
    "grafana labs": "grafanalabs", "imc": "imc", "jane street": "janestreet", "jump trading": "jumptrading",
    "linkedin": "linkedin", "mongodb": "mongodb", "okta": "okta", "pinterest": "pinterest",
    "reddit": "reddit", "robinhood": "robinhood", "roblox": "roblox",
    "samsung semiconductor": "samsungsemiconductor", "scale ai": "scaleai", "sofi": "sofi",
    "stripe": "stripe", "temporal": "temporaltechnologies", "together ai": "togetherai", "vercel": "vercel",
    "virtu": "virtu", "xai": "xai",
}
ASHBY = {"crusoe": "crusoe", "docker": "docker", "lambda": "lambda", "notion": "notion", "ramp": "ramp", "sentry": "sentry"}
LEVER = {"belvedere trading": "belvederetrading", "palantir": "palantir", "spotify": "spotify"}

# API origins keyed by company domain, and by company name with the site path.
EIGHTFOLD = {
    "americanexpress.com": "https://aexp.eightfold.ai",
    "capitalone.com": "https://capitalone.eightfold.ai",
    "micron.com": "https://careers.micron.com",
    "microsoft.com": "https://apply.careers.microsoft.com",
    "jobs.netflix.com": "https://explore.jobs.netflix.net",
    "nvidia.com": "https://jobs.nvidia.com",
    "qualcomm.com": "https://careers.qualcomm.com",
    "twilio.com": "https://jobs.twilio.com",
}
JIBE = {
    "amd": "https://careers.amd.com",
    "arm": "https://careers.arm.com",
    "booking.com": "https://careers.booking.com",
    "github": "https://www.github.careers",
    "sig": "https://careers.sig.com",
}
WORKDAY = {
    "adobe": ("https://adobe.wd5.myworkdayjobs.com", "external_experienced"),
    "autodesk": ("https://autodesk.wd1.myworkdayjobs.com", "Ext"),
    "expedia": ("https://expedia.wd108.myworkdayjobs.com", "search"),
    "intel": ("https://intel.wd1.myworkdayjobs.com", "External"),
    "mastercard": ("https://mastercard.wd1.myworkdayjobs.com", "CorporateCareers"),
    "workday": ("https://workday.wd5.myworkdayjobs.com", "Workday"),
}
PHENOM = {
    "cisco": "https://careers.cisco.com",
    "ebay": "https://jobs.ebayinc.com",
    "hpe": "https://careers.hpe.com",
    "snowflake": "https://careers.snowflake.com",
}
ORACLE_HCM = {"dell": ("https://enterpriseplatform.dell.com", "careers")}

# Order in which boards are tried.
PRECEDENCE = ["EIGHTFOLD", "GREENHOUSE", "JIBE", "ASHBY", "LEVER", "WORKDAY", "PHENOM", "ORACLE_HCM"]


def _registry() -> dict[str, list[tuple[str, str, str | None, str | None]]]:
    """Rows of key, provider, API origin and site, by the target column the key is compared with."""

    def plain(provider: str, table: dict[str, str]) -> list[tuple[str, str, str | None, str | None]]:
        return [(key, provider, value, None) for key, value in table.items()]

    def boards(provider: str, table: dict[str, str]) -> list[tuple[str, str, str | None, str | None]]:
        return [(key, provider, None, value) for key, value in table.items()]

    def sites(provider: str, table: dict[str, tuple[str, str]]) -> list[tuple[str, str, str | None, str | None]]:
        return [(key, provider, origin, site) for key, (origin, site) in table.items()]

    by_name = (
        boards("GREENHOUSE", GREENHOUSE)
        + plain("JIBE", JIBE)
        + boards("ASHBY", ASHBY)
        + boards("LEVER", LEVER)
        + sites("WORKDAY", WORKDAY)
        + plain("PHENOM", PHENOM)
        + sites("ORACLE_HCM", ORACLE_HCM)
    )
    return {"domain": plain("EIGHTFOLD", EIGHTFOLD), "name": by_name}


def _lookup(rows: list[tuple[str, str, str | None, str | None]]) -> Column:
    """The registry is a fixed list of some eighty rows, so it travels as a map literal."""
    best: dict[str, tuple[str, str | None, str | None]] = {}
    for key, provider, origin, site in sorted(rows, key=lambda r: PRECEDENCE.index(r[1])):
        best.setdefault(key, (provider, origin, site))
    entries = []
    for key, (provider, origin, site) in best.items():
        entries.append(F.lit(key))
        entries.append(
            F.struct(
                F.lit(provider).alias("provider"),
                F.lit(origin).cast("string").alias("api_origin"),
                F.lit(site).cast("string").alias("site"),
            )
        )
    return F.create_map(*entries)


def route_targets(targets: DataFrame) -> DataFrame:
    """Add ``provider``, ``api_origin`` and ``site``.  A board found by domain wins over one found by name."""
    registry = _registry()
    route = F.coalesce(
        F.try_element_at(_lookup(registry["domain"]), F.lower(F.col("domain"))),
        F.try_element_at(_lookup(registry["name"]), F.lower(trim_text(F.col("name")))),
    )
    return targets.withColumn("_route", route).select(
        *targets.columns,
        F.coalesce(F.col("_route.provider"), F.lit(GENERIC)).alias("provider"),
        F.col("_route.api_origin").alias("api_origin"),
        F.col("_route.site").alias("site"),
    )
