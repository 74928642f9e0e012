"""Date columns: strict parsing, partial dates and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_DATE_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
MONTH_RE = r"^[0-9]{4}-[0-9]{2}$"
YEAR_RE = r"^[0-9]{4}$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strict_date(col: Column | str) -> Column:
    """``yyyy-MM-dd`` text to DATE; anything else (or an impossible day) is NULL.

    Spark alone would read ``2026-08`` as the first of the month; the pattern
    guard keeps the result equal to a strict ISO parse.
    """
    c = _c(col)
    return F.when(c.rlike(FULL_DATE_RE), c.try_cast("date"))


def date_format_of(col: Column | str) -> Column:
    """Which registry date format a text uses: yyyy, yyyy-MM, yyyy-MM-dd or NULL."""
    c = _c(col)
    return (F.when(c.rlike(FULL_DATE_RE), F.lit("yyyy-MM-dd"))
            .when(c.rlike(MONTH_RE), F.lit("yyyy-MM"))
            .when(c.rlike(YEAR_RE), F.lit("yyyy")))


def partial_date_lo(col: Column | str) -> Column:
    """First day covered by a partial date (``2022`` -> 2022-01-01)."""
    c = _c(col)
    return (F.when(c.rlike(FULL_DATE_RE), c.try_cast("date"))
            .when(c.rlike(MONTH_RE), F.concat(c, F.lit("-01")).try_cast("date"))
            .when(c.rlike(YEAR_RE), F.concat(c, F.lit("-01-01")).try_cast("date")))


def partial_date_hi(col: Column | str) -> Column:
    """Last day covered by a partial date (``2022-02`` -> 2022-02-28)."""
    c = _c(col)
    return (F.when(c.rlike(FULL_DATE_RE), c.try_cast("date"))
            .when(c.rlike(MONTH_RE), F.last_day(F.concat(c, F.lit("-01")).try_cast("date")))
            .when(c.rlike(YEAR_RE), F.concat(c, F.lit("-12-31")).try_cast("date")))


# Our choice where the contract is silent: a year is 365.25 days and a month
# a twelfth of it.
MINUTES_PER_UNIT = {
    "MINUTE": 1.0,
    "HOUR": 60.0,
    "DAY": 1440.0,
    "WEEK": 10080.0,
    "MONTH": 525960.0 / 12.0,
    "YEAR": 525960.0,
}
DURATION_RE = r"^\s*([0-9]+(?:\.[0-9]+)?)\s+([A-Za-z]+?)S?\s*$"


def duration_minutes(col: Column | str) -> Column:
    """Registry duration text ("16 Years", "6 Months") as minutes (DOUBLE)."""
    c = F.upper(_c(col))
    number = F.regexp_extract(c, DURATION_RE, 1)
    unit = F.regexp_extract(c, DURATION_RE, 2)
    factor = F.lit(None).cast("double")
    for name, minutes in MINUTES_PER_UNIT.items():
        factor = F.when(unit == name, F.lit(minutes)).otherwise(factor)
    return F.when(number != "", number.try_cast("double") * factor)
