"""Dates: format tokens, epoch seconds, offsets, date-part arguments, interval text, time zones."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date tokens and the patterns they stand for. W and o have no pattern.
TOKENS = {
    "Y": "yyyy",
    "y": "yy",
    "M": "MMM",
    "m": "MM",
    "n": "M",
    "F": "MMMM",
    "D": "EEE",
    "d": "dd",
    "l": "EEEE",
    "j": "d",
    "H": "HH",
    "h": "hh",
    "i": "mm",
    "s": "ss",
    "A": "a",
}

# Interval units in seconds, with their singular and plural.
UNITS = [
    (31536000, "year", "years"),
    (2592000, "month", "months"),
    (604800, "week", "weeks"),
    (86400, "day", "days"),
    (3600, "hour", "hours"),
    (60, "min", "min"),
    (1, "sec", "sec"),
]

# Time zone names by standard offset in seconds.
ZONES_BY_OFFSET = {
    -39600: "Pacific/Apia",
    -36000: "Pacific/Honolulu",
    -32400: "America/Anchorage",
    -28800: "America/Los_Angeles",
    -25200: "America/Denver",
    -21600: "America/Chicago",
    -18000: "America/New_York",
    -14400: "America/Halifax",
    -10800: "America/Sao_Paulo",
    -3600: "Atlantic/Azores",
    0: "Europe/London",
    3600: "Europe/Paris",
    7200: "Europe/Helsinki",
    10800: "Europe/Moscow",
    14400: "Asia/Dubai",
    18000: "Asia/Karachi",
    19800: "Asia/Kolkata",
    20700: "Asia/Katmandu",
    21600: "Asia/Novosibirsk",
    25200: "Asia/Krasnoyarsk",
    28800: "Asia/Shanghai",
    32400: "Asia/Tokyo",
    36000: "Australia/Melbourne",
    43200: "Pacific/Auckland",
}


def _column(item: str | Column) -> Column:
    return F.col(item) if isinstance(item, str) else item


def formatted(field: str | Column, tokens: str) -> Column:
    """A date as text by single-letter tokens; other characters stay as they are."""
    column = _column(field)

    def text(piece: str) -> Column:
        if piece == "W":
            return F.lpad(F.weekofyear(column).cast("string"), 2, "0")
        if piece == "o":
            return F.extract(F.lit("YEAROFWEEK"), column).cast("string")
        return F.date_format(column, TOKENS[piece]) if piece in TOKENS else F.lit(piece)

    return F.concat(*[text(piece) for piece in re.findall(r"[A-Za-z]|[^A-Za-z]+", tokens)])


def from_epoch(seconds: str | Column) -> Column:
    """Seconds since 1970 as a timestamp."""
    return F.timestamp_seconds(_column(seconds))


def with_offset(field: str | Column, seconds: int) -> Column:
    """A timestamp moved by a time zone offset; no offset changes nothing."""
    return _column(field) + F.expr(f"INTERVAL {int(seconds)} SECONDS") if seconds else _column(field)


def date_arguments(field: str | Column) -> dict[str, Column]:
    """The zero-padded texts a date argument is compared with."""
    formats = {"day": "d", "month": "m", "year": "Y", "year_month": "Ym", "week": "W", "full_date": "Ymd"}
    return {name: formatted(field, tokens) for name, tokens in formats.items()}


def interval_text(seconds: str | Column, granularity: int = 2) -> Column:
    """A duration as its largest units, at most ``granularity`` of them and without a gap."""
    left = _column(seconds).cast("bigint")
    steps = []
    for size, one, many in UNITS:
        n = F.floor(left / F.lit(size)).cast("bigint")
        name = F.when(n == 1, F.lit(one)).otherwise(F.lit(many))
        steps.append(F.when(n > 0, F.concat_ws(" ", n.cast("string"), name)).otherwise(F.lit("")))
        left = F.pmod(left, F.lit(size))

    def shown(units: Column) -> Column:
        first = F.array_position(F.transform(units, lambda u: u != ""), True)
        run = F.slice(units, F.greatest(first, F.lit(1)).cast("int"), granularity)
        return F.when(first == 0, F.lit("0 sec")).otherwise(_joined(run))

    # One-element arrays: the texts are worked out once, though named several times.
    text = F.transform(F.array(F.array(*steps)), shown)[0]
    return F.when(_column(seconds).isNull(), F.lit("")).otherwise(text)


def _joined(run: Column) -> Column:
    """The texts before the first empty one, joined by blanks."""

    def before_gap(texts: Column) -> Column:
        gap = F.array_position(texts, "").cast("int")
        return F.when(gap > 0, F.slice(texts, F.lit(1), F.greatest(gap, F.lit(1)) - 1)).otherwise(texts)

    return F.array_join(F.transform(F.array(run), before_gap)[0], " ")


def zone_of_offset(seconds: str | Column) -> Column:
    """The zone name of a standard offset, UTC if none has it."""
    entries = [F.lit(x) for pair in ZONES_BY_OFFSET.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), _column(seconds).cast("int")), F.lit("UTC"))


def first_valid_zone(candidates: Sequence[str | Column], known: Sequence[str], default: str) -> Column:
    """The first candidate that is a known zone, else the site's default."""
    valid = [F.when(_column(c).isin(*known), _column(c)) for c in candidates]
    return F.coalesce(*valid, F.lit(default))
