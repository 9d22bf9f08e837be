"""Times as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 3339 to the second, with a fraction and a zone (fixed form).
RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)\z"
DAY_MS = 86_400_000


def rfc3339_millis(text: Column) -> Column:
    """Epoch milliseconds of an RFC 3339 time, its fraction cut after three digits; null for anything else."""
    zone = F.regexp_extract(text, RFC3339, 2)
    second = F.unix_seconds(F.try_to_timestamp(F.concat(F.substring(text, 1, 19), zone), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    fraction = F.rpad(F.substring(F.regexp_extract(text, RFC3339, 1), 2, 3), 3, "0").cast("int")
    return F.when(text.rlike(RFC3339), second * 1000 + fraction)


def bound_millis(text: Column, end: bool = False) -> Column:
    """The bound that a filter takes from a UTC date (its first or, as an end, last millisecond) or an RFC 3339 time."""
    day = F.unix_date(F.try_to_date(text, "yyyy-MM-dd")).cast("bigint") * DAY_MS + (DAY_MS - 1 if end else 0)
    return F.when(F.char_length(text) == 10, day).otherwise(rfc3339_millis(text))
