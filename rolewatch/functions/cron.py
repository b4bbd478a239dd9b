"""Five-field UTC cron expressions.  Use a session time zone of UTC with TIMESTAMP columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, let, lit_true, trim_text

# Minute, hour, day of month, month, weekday.
RANGES = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]


def _whole(text: Column) -> Column:
    """Number a blank or decimal text stands for, NULL unless it is whole."""
    number = F.when(text == "", F.lit(0.0)).when(
        text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"), text.try_cast("double")
    )
    return F.when(number == F.floor(number), number)


def _piece(text: Column, low: int, high: int) -> Column:
    """One comma-separated piece as start, end and step."""
    span = F.split_part(text, F.lit("/"), F.lit(1))
    stride = F.split_part(text, F.lit("/"), F.lit(2))
    is_span = span.contains("-")
    start = F.when(is_span, F.split_part(span, F.lit("-"), F.lit(1))).otherwise(span)
    end = F.when(is_span, F.split_part(span, F.lit("-"), F.lit(2))).otherwise(span)
    return F.struct(
        F.when(span == "*", F.lit(float(low))).otherwise(_whole(start)).alias("start"),
        F.when(span == "*", F.lit(float(high))).otherwise(_whole(end)).alias("end"),
        F.when(stride == "", F.lit(1.0)).otherwise(_whole(stride)).alias("step"),
    )


def _field(field: Column, low: int, high: int, value: Column | None) -> Column:
    """Some piece of the field is well-formed and, given a value, selects it."""

    def hit(piece: Column) -> Column:
        usable = (
            (piece["step"] >= 1)
            & (piece["start"] >= low)
            & (piece["end"] <= high)
            & (piece["start"] <= piece["end"])
        )
        if value is not None:
            usable &= value.between(piece["start"], piece["end"])
            usable &= F.when(usable, (value - piece["start"]) % piece["step"] == 0)
        return lit_true(usable)

    pieces = F.transform(F.split(field, ",", -1), lambda p: _piece(p, low, high))
    return F.exists(pieces, hit)


def _fields(expression: Column) -> Column:
    return F.split(trim_text(expression), f"{SPACE}+", -1)


def is_valid_cron(expression: Column) -> Column:
    def valid(fields: Column) -> Column:
        verdict = F.size(fields) == 5
        for index, (low, high) in enumerate(RANGES):
            verdict &= _field(F.get(fields, F.lit(index)), low, high, None)
        return lit_true(verdict)

    return let(_fields(expression), valid)


def cron_matches(expression: Column, at: Column) -> Column:
    """Due at this minute.  All five fields must agree; weekdays run 0 to 6 from Sunday."""
    values = [F.minute(at), F.hour(at), F.dayofmonth(at), F.month(at), F.dayofweek(at) - 1]

    def due(fields: Column) -> Column:
        verdict = F.size(fields) == 5
        for index, (low, high) in enumerate(RANGES):
            verdict &= _field(F.get(fields, F.lit(index)), low, high, values[index])
        return lit_true(verdict)

    return let(_fields(expression), due)
