"""Months and days of a timestamp."""

from pyspark.sql import Column, functions as F


def month(ts: Column) -> Column:
    """First day of the month: a four-byte grouping key."""
    return F.trunc(F.to_date(ts), "MM")


def period(month_or_ts: Column) -> Column:
    """'yyyy-MM'."""
    return F.substring(F.to_date(month_or_ts).cast("string"), 1, 7)


def day_bit(ts: Column) -> Column:
    """One bit per day of the month; or-ed over a month, the set bits are its distinct days."""
    return F.call_function("shiftleft", F.lit(1), F.dayofmonth(F.to_date(ts)) - 1)
