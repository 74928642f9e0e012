"""Trial identifiers: validity and canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a trial id is NCT followed by eight digits.
NCT_RE = r"^NCT[0-9]{8}$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_valid_nct(col: Column | str) -> Column:
    return F.coalesce(_c(col).rlike(NCT_RE), F.lit(False))


def canonical_nct(col: Column | str) -> Column:
    """Normalise case, spaces and leading zeros: ``nct42`` -> ``NCT00000042``; more than eight
    digits stay as many.

    Text that is not NCT plus digits has no canonical form (NULL).
    """
    c = F.upper(F.trim(_c(col)))
    digits = F.regexp_extract(c, r"^NCT0*([0-9]+)$", 1)
    return F.when(digits != "", F.concat(F.lit("NCT"), padded(digits, 8)))


def nct_from_number(col: Column | str) -> Column:
    """Stand-in ids built from integer keys: 42 -> NCT00000042, 123456789 -> NCT123456789."""
    return F.concat(F.lit("NCT"), padded(_c(col), 8))


def padded(col: Column, width: int) -> Column:
    """A number as text with leading zeros up to ``width``; a longer one stays whole
    (``lpad`` alone would cut it)."""
    text = col.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))
