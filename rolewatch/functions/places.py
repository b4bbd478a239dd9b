"""Location predicate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import EDGE, START, let, lit_true, split_trim, trim_text

# State names and postal codes, District of Columbia included.
STATES = (
    "Alabama|Alaska|Arizona|Arkansas|California|Colorado|Connecticut|Delaware|Florida|Georgia|Hawaii|Idaho"
    "|Illinois|Indiana|Iowa|Kansas|Kentucky|Louisiana|Maine|Maryland|Massachusetts|Michigan|Minnesota"
    "|Mississippi|Missouri|Montana|Nebraska|Nevada|New Hampshire|New Jersey|New Mexico|New York"
    "|North Carolina|North Dakota|Ohio|Oklahoma|Oregon|Pennsylvania|Rhode Island|South Carolina"
    "|South Dakota|Tennessee|Texas|Utah|Vermont|Virginia|Washington|West Virginia|Wisconsin|Wyoming"
    "|District of Columbia"
)
STATE_CODES = (
    "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC"
    "|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC"
)
COUNTRY = rf"(?i){START}(?:United States(?: of America)?|USA|U\.S\.A\.|US){EDGE}"


def _is_us_place(place: Column) -> Column:
    """One place such as "Bellevue, WA"; a trailing country code after two parts wins over the state."""
    state_at_end = rf"(?i)(?:^|[,\u2013\u2014-]\s*)(?:{STATES})\z"

    def decide(parts: Column) -> Column:
        last = F.try_element_at(parts, F.lit(-1))
        return (
            F.when(lit_true((F.size(parts) >= 3) & last.rlike(r"^[A-Za-z]{2}\z")), F.lit(False))
            .when(place.rlike(state_at_end), F.lit(True))
            .otherwise(lit_true((F.size(parts) == 2) & last.rlike(rf"^(?:{STATE_CODES})\z")))
        )

    return let(split_trim(place, ","), decide)


def is_us_location(locations: Column) -> Column:
    """Any of the locations lies in the United States."""

    def one(location: Column) -> Column:
        places = F.transform(F.split(location, "[;|]"), lambda p: trim_text(p))
        return location.rlike(COUNTRY) | F.exists(places, _is_us_place)

    return lit_true(F.exists(locations, one))
