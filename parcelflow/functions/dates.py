"""Dates and ages as column expressions; every function takes its as-of date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two lists of date formats, first match wins.
FEED_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss")
AREA_FORMATS = ("yyyy-MM-dd", "dd-MMM-yyyy", "MM/dd/yyyy")
# Days after which a verdict is due again, by the tier of the website.
RECHECK_YES = {1: 180, 2: 30, 3: 14, 4: 14}
RECHECK_NO, RECHECK_UNCLEAR = 60, 7


def parse_date(text: Column, formats: Sequence[str] = FEED_FORMATS, cut: bool = True) -> Column:
    """The first format that reads the text; ``cut`` drops what follows the first space."""
    t = F.trim(text)
    t = F.substring_index(t, " ", 1) if cut else t
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in formats])


def days_open(issued: Column, as_of: dt.date) -> Column:
    """D02."""
    return F.greatest(F.datediff(F.lit(as_of), issued), F.lit(0))


def years_operating(issued: Column, as_of: dt.date, digits: int = 1) -> Column:
    """Days / 365.25, half-even."""
    return F.bround(F.datediff(F.lit(as_of), issued) / F.lit(365.25), digits) + F.lit(0.0)


def ago_label(days: Column) -> Column:
    """D04."""
    s = lambda c: c.cast("string")
    return (
        F.when(days <= 1, F.lit("today")).when(days <= 60, F.concat(s(days), F.lit("d ago")))
        .when(days <= 365, F.concat(s(F.bround(days / 30).cast("int")), F.lit("mo ago")))
        .otherwise(F.concat(F.format_string("%.1f", F.bround(days / F.lit(365.0), 1)), F.lit("y ago")))
    )


def licensed_label(days: Column) -> Column:
    """Today, then days below two weeks, then weeks."""
    return F.when(days <= 1, F.lit("today")).when(days < 14, F.concat(days.cast("string"), F.lit("d"))).otherwise(F.concat(F.floor(days / 7).cast("string"), F.lit("w")))


def latest(a: Column, b: Column) -> Column:
    """The later date; null only if both are."""
    return F.greatest(a, b)


def due(checked: Column, verdict: Column, tier: Column, as_of: dt.datetime) -> Column:
    """Whether a verdict's age has reached its limit; unreadable or unknown ones are due."""
    age = F.datediff(F.lit(as_of).cast("date"), checked.cast("date"))
    limit = F.when(verdict == "yes", F.coalesce(*[F.when(tier == k, F.lit(v)) for k, v in RECHECK_YES.items()])).when(verdict == "no", RECHECK_NO).when(verdict == "unclear", RECHECK_UNCLEAR)
    return F.coalesce(age >= limit, F.lit(True))
