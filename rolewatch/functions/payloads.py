"""Message bodies and display strings derived from changes, events and postings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Colours of the message cards.
NEW_COLOR = 0x1F6848
UPDATED_COLOR = 0xF4A261
EVENT_COLOR = 0x4285F4

# Seconds until the next attempt after the first, second, third and later failures.
BACKOFF_SECONDS = [60, 300, 900, 3600]
# UTF-16 units that the original keeps of an error and of a description; limits a caller may ask for.
ERROR_LENGTH = 500
DESCRIPTION_LENGTH = 3000

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso_instant(at: Column) -> Column:
    return F.date_format(at, ISO_MILLIS)


def utf16_prefix(value: Column, units: int | None) -> Column:
    """The first ``units`` UTF-16 units, as string slicing counts them; a split pair is replaced.  Without a number, all of it."""
    if units is None:
        return value

    def cut(text: Column) -> Column:
        encoded = F.substring(F.encode(text, "UTF-16BE"), 1, 2 * units)
        torn = F.hex(F.substring(encoded, 2 * units - 1, 1)).rlike("^D[89AB]")
        whole = F.decode(F.substring(encoded, 1, 2 * (units - 1)), "UTF-16BE")
        head = F.when(torn, F.concat(whole, F.lit("\uFFFD"))).otherwise(F.decode(encoded, "UTF-16BE"))
        return F.when(F.length(text) * 2 <= units, text).otherwise(head)

    return let(value, cut)


def words(enum: Column) -> Column:
    """``REGISTRATION_OPEN`` reads "registration open"."""
    return F.lower(F.replace(enum, F.lit("_"), F.lit(" ")))


def _field(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(True).alias("inline"))


def _silent() -> Column:
    return F.struct(F.array().cast("array<string>").alias("parse")).alias("allowed_mentions")


def job_message(
    kind: Column,
    company_name: Column,
    job_title: Column,
    application_url: Column,
    created_at: Column,
    sender: str = "Rolewatch",
) -> Column:
    """JSON body that announces a new or changed posting."""
    is_new = kind == "NEW"
    headline = F.when(is_new, F.lit("\U0001f6a8 New opportunity at **")).otherwise(
        F.lit("\U0001f4dd Opportunity updated at **")
    )
    card = F.struct(
        job_title.alias("title"),
        application_url.alias("url"),
        F.when(is_new, F.lit(NEW_COLOR)).otherwise(F.lit(UPDATED_COLOR)).alias("color"),
        F.array(
            _field("Company", company_name),
            _field("Change", F.when(is_new, F.lit("New role")).otherwise(F.lit("Posting updated"))),
        ).alias("fields"),
        iso_instant(created_at).alias("timestamp"),
        F.struct(F.lit(f"{sender} discovery alert").alias("text")).alias("footer"),
    )
    return F.to_json(
        F.struct(
            F.lit(sender).alias("username"),
            F.concat(headline, company_name, F.lit("**")).alias("content"),
            F.array(card).alias("embeds"),
            _silent(),
        )
    )


def event_message(
    event: dict[str, Column], company_name: Column, change: Column, sender: str = "Rolewatch", description_length: int | None = None
) -> Column:
    """JSON body that announces a recruiting event.  ``event`` maps column names to columns; ``description_length`` is the channel's limit, if it has one."""
    local = F.date_format(
        F.from_utc_timestamp(event["starts_at"], event["timezone"]), "M/d/yyyy, h:mm:ss a"
    )
    card = F.struct(
        event["title"].alias("title"),
        event["registration_url"].alias("url"),
        F.lit(EVENT_COLOR).alias("color"),
        utf16_prefix(event["description"], description_length).alias("description"),
        F.array(
            _field("Location", F.coalesce(event["location"], F.lit("Not announced"))),
            _field("Starts", F.coalesce(local, F.lit("Not announced"))),
            _field("Status", words(event["status"])),
        ).alias("fields"),
        iso_instant(event["last_seen_at"]).alias("timestamp"),
        F.struct(F.lit(f"{sender} event alert").alias("text")).alias("footer"),
    )
    verb = F.when(change == "NEW", F.lit("New")).otherwise(F.lit("Updated"))
    return F.to_json(
        F.struct(
            F.lit(sender).alias("username"),
            F.concat(
                F.lit("\U0001f393 "), verb, F.lit(" early-career event at **"), company_name, F.lit("**")
            ).alias("content"),
            F.array(card).alias("embeds"),
            _silent(),
        )
    )


def retry_at(now: Column, attempts: Column) -> Column:
    """When a delivery may be tried again after its n-th failed attempt."""
    delays = F.array(*[F.lit(s) for s in BACKOFF_SECONDS])
    step = F.greatest(F.least(attempts, F.lit(len(BACKOFF_SECONDS))), F.lit(1)).cast("int")
    return now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.element_at(delays, step).cast("decimal(18,6)"))


def confidence_label(confidence: Column) -> Column:
    percent = F.floor(confidence * 100 + 0.5)
    return F.concat(percent.cast("string"), F.lit("% extraction confidence"))


def locations_label(locations: Column) -> Column:
    text = F.array_join(locations, " \u00b7 ")
    return F.when(lit_non_empty(text), text).otherwise(F.lit("Location not provided"))


def lit_non_empty(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def event_place_label(location: Column, event_format: Column) -> Column:
    fallback = F.when(event_format == "VIRTUAL", F.lit("Virtual")).otherwise(F.lit("Location not announced"))
    return F.coalesce(location, fallback)


# The wording of messages and cards, here and in the functions above.
def scan_message(roles: Column, new: Column, updated: Column, failures: Column) -> Column:
    """One line about a scan, plural forms included."""
    tail = F.when(
        failures > 0,
        F.concat(
            F.lit(" \u00b7 "),
            failures.cast("string"),
            F.lit(" source "),
            F.when(failures == 1, F.lit("failed")).otherwise(F.lit("failures")),
        ),
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("Found "),
        roles.cast("string"),
        F.lit(" matching "),
        F.when(roles == 1, F.lit("role")).otherwise(F.lit("roles")),
        F.lit(" \u00b7 "),
        new.cast("string"),
        F.lit(" new \u00b7 "),
        updated.cast("string"),
        F.lit(" updated"),
        tail,
    )
