"""Dates of mail headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PATTERN = r"(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+(\d{1,2}:\d{2}(?::\d{2})?)(?:\s+([+-]\d{4}))?"


def parse_date(c: Column) -> Column:
    """The time of an RFC 2822 date, or null; without an offset, or with -0000, as UTC.

    The weekday and comments such as (PDT) are not looked at.  Dates of other
    shapes are left to the parser of ``sources.mime``.
    """
    part = lambda i: F.regexp_extract(c, _PATTERN, i)
    clock = F.when(F.length(part(4)) <= 5, F.concat(part(4), F.lit(":00"))).otherwise(part(4))
    zone = F.when(part(5).isin("", "-0000"), "+0000").otherwise(part(5))
    month = F.concat(F.upper(F.left(part(2), F.lit(1))), F.lower(F.substring(part(2), 2, 2)))
    return F.try_to_timestamp(F.concat_ws(" ", part(1), month, part(3), clock, zone), F.lit("d MMM yyyy H:mm:ss Z"))
