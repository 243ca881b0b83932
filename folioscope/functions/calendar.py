"""Months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The months that are counted, and the last month that is published.
FIRST_MONTH = "2001-01-01"
LAST_COUNTED_MONTH = "2016-12-01"
LAST_SERIES_MONTH = "2016-09-01"


def month_key(time: Column) -> Column:
    """First day of the month of a time, as DATE."""
    return F.trunc(time, "month")


def month_label(month: Column) -> Column:
    """``2001_1`` for January 2001."""
    return F.concat_ws("_", F.year(month).cast("string"), F.month(month).cast("string"))


def month_date(month: Column) -> Column:
    """``2001-01-01`` for January 2001."""
    return F.date_format(month, "yyyy-MM-dd")


def label_month(label: Column) -> Column:
    """Month of a ``2001_1`` label."""
    parts = F.split(label, "_")
    return F.make_date(parts[0].cast("int"), parts[1].cast("int"), F.lit(1))


def month_sequence(first: str = FIRST_MONTH, last: str = LAST_SERIES_MONTH) -> Column:
    """Array of all months from ``first`` to ``last``."""
    return F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))


def in_months(month: Column, first: str = FIRST_MONTH, last: str = LAST_COUNTED_MONTH) -> Column:
    return month.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
