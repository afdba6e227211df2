"""Small column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: shape of an RFC 3339 timestamp, which the lenient parser alone would not enforce.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


# Fixed value: the characters that count as white space around a value.
WHITESPACE = " \t\n\r\x0b\x0c"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def trim_null(value: Column) -> Column:
    """Text without white space around it, empty becomes null."""
    return F.nullif(strip(value), F.lit(""))


def hash8(value: Column) -> Column:
    """First eight hex digits of the SHA-256 of the text."""
    return F.substring(F.sha2(value, 256), 1, 8)


def parse_rfc3339(value: Column) -> Column:
    """Timestamp, null unless the text has a date, a time and an offset."""
    return F.when(value.rlike(RFC3339), F.try_to_timestamp(value))


def rfc3339(moment: Column) -> Column:
    """UTC text of a timestamp, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end; null when either is missing or time runs backwards."""
    gap = F.unix_micros(end) - F.unix_micros(start)
    return F.when(gap >= 0, F.floor(gap / 1000).cast("bigint"))


def collapse_spaces(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def truncate(value: Column, width: int) -> Column:
    """Whitespace-collapsed text of at most `width` characters, cut with three dots."""
    flat = collapse_spaces(value)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.substring(flat, 1, width - 3), F.lit("...")))


def group_thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def contains_any(value: Column, *needles: str) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | value.contains(needle)
    return found
