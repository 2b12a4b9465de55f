"""Calendar, numeric and text column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display order of the weekday and month profiles.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weekday_from_monday(day) -> Column:
    """0 = Monday … 6 = Sunday."""
    return F.weekday(_col(day))


def is_weekend(day) -> Column:
    return (F.weekday(_col(day)) >= 5).cast("int")


def is_month_end(day) -> Column:
    return (F.last_day(_col(day)) == _col(day)).cast("int")


def day_name(day) -> Column:
    return F.date_format(_col(day), "EEEE")


def month_name(day) -> Column:
    return F.date_format(_col(day), "MMMM")


CALENDAR = {
    "day_of_week": weekday_from_monday,
    "day_of_month": lambda d: F.dayofmonth(_col(d)),
    "week_of_year": lambda d: F.weekofyear(_col(d)),
    "month": lambda d: F.month(_col(d)),
    "quarter": lambda d: F.quarter(_col(d)),
    "year": lambda d: F.year(_col(d)),
    "is_weekend": is_weekend,
    "is_month_end": is_month_end,
}


def calendar_columns(day, names) -> list[Column]:
    """Aliased calendar columns for a ``select``."""
    return [CALENDAR[name](day).alias(name) for name in names]


def flag(condition: Column) -> Column:
    """0/1 with null counted as false."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def at_least_zero(x) -> Column:
    """Clip below at zero; null stays null."""
    x = _col(x)
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def money_text(x) -> Column:
    return F.format_string("$%.2f", _col(x))


def date_text(day) -> Column:
    return F.date_format(_col(day), "yyyy-MM-dd")


def whole(x) -> Column:
    """Truncate toward zero for summaries."""
    return _col(x).cast("bigint")


def tidy(x, places: int) -> Column:
    """Round for reports.

    The small offset keeps exact halves (frequent in means of cent amounts)
    off the rounding edge, where the order of a distributed sum would decide;
    adding 0.0 folds negative zero.
    """
    return F.round(_col(x) + F.lit(10.0 ** -(places + 4)), places) + F.lit(0.0)
