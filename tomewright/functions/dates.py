"""Dates and instants kept as text, and ages. The clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ADULT_AGE, FIRST_YEAR, OLDEST_AGE, YEARS_AHEAD

# The forms of a day and of an instant; that the day exists is for the cast to tell.
DAY = r"^\d{4}-\d{2}-\d{2}\z"
INSTANT = r"^\d{4}-\d{2}-\d{2}T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{1,3})?Z\z"


def exact_date(x: Column) -> Column:
    """A calendar date that exists, as text; null for anything else."""
    return F.when(x.rlike(DAY) & x.try_cast("date").isNotNull(), x)


def instant(x: Column) -> Column:
    """An exact UTC instant as a timestamp; null for dates alone, other zones and days that don't exist."""
    return F.when(x.rlike(INSTANT), F.try_to_timestamp(x))


def instant_text(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parses(x: Column) -> Column:
    """Whether a stamp is an ISO date or instant; other spellings are not accepted."""
    return F.coalesce(F.try_to_timestamp(x).isNotNull(), F.lit(False))


def release_date(x: Column, as_of: str) -> Column:
    """The day of a release date or stamp that exists and lies between 1900 and three years ahead."""
    day = exact_date(F.substring(x, 1, 10))
    year = F.substring(x, 1, 4).try_cast("int")
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}(?:\z|T)") & (year >= FIRST_YEAR) & (year <= int(as_of[:4]) + YEARS_AHEAD), day)


def birth_date(x: Column, as_of: str) -> Column:
    """A birth date that exists, is not in the future and not more than 120 years back."""
    today, year = as_of[:10], int(as_of[:4])
    return F.when((x <= today) & (F.substring(x, 1, 4).try_cast("int") >= year - OLDEST_AGE), exact_date(x))


def adult_cutoff(as_of: str) -> str:
    """The latest birth date that is of age: the calendar day, years back."""
    return f"{int(as_of[:4]) - ADULT_AGE:04d}{as_of[4:10]}"


def is_adult(birth: Column, as_of: str) -> Column:
    return F.coalesce(birth_date(birth, as_of) <= adult_cutoff(as_of), F.lit(False))


def display_date(x: Column, pattern: str = "MMM d, yyyy") -> Column:
    return F.when(x.isNull() | (x == ""), "Date to be announced").otherwise(F.date_format(F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd"), pattern))


def plus_days(x: Column, days: int) -> Column:
    return x + F.expr(f"interval {days} days")
