"""Dates as filed, and calendar quarters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ways in which dates are written.
FORMATS = ["yyyy-MM-dd", "yyyyMMdd", "M/d/yyyy", "M/d/yy", "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy"]
MONTH_FORMATS = ["M/yyyy", "MMMM yyyy", "MMM yyyy"]


def any_date(text: Column) -> Column:
    """The first format that reads the text; a month alone is its last day; null for none.

    A format is tried only on texts with its signs in their order, since each failure costs an exception.
    """
    read = lambda f: F.when(text.like("%".join(["", *re.findall("[^A-Za-z]", f), ""]) or "%") & ~_foreign(text, f), F.try_to_date(text, f))
    return F.coalesce(*map(read, FORMATS), *(F.last_day(read(f)) for f in MONTH_FORMATS))


def _foreign(text: Column, pattern: str) -> Column:
    """A text with a slash or a space, where a format of figures alone has none."""
    return text.rlike("[/ ]") if pattern.isalpha() else F.lit(False)


def quarter_end(date: Column) -> Column:
    """Last day of the calendar quarter."""
    return F.last_day(F.add_months(F.date_trunc("quarter", date).cast("date"), 2))
