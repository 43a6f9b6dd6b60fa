"""Calendar expressions; the session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the only accepted written form of a day.
DAY_SHAPE = r"^\d{4}-\d{2}-\d{2}$"


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def real_day(text: Column) -> Column:
    """The day a text names, or null when the shape or the day itself is wrong."""
    return F.when(text.rlike(DAY_SHAPE), F.try_to_date(text, "yyyy-MM-dd"))


def stored_day(text: Column) -> Column:
    """The day of a full date, which a time may follow; null for a year or month alone."""
    return F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_date(F.substring(F.ltrim(text), 1, 10), "yyyy-MM-dd"))


def weekend_name(day: Column) -> Column:
    """``Saturday`` or ``Sunday``, otherwise null."""
    return F.when(F.dayofweek(day).isin(1, 7), F.date_format(day, "EEEE"))


def before_next_day(last: Column) -> Column:
    """Midnight after ``last``: the open upper end of an inclusive day range."""
    return F.date_add(last, 1).cast("timestamp")
