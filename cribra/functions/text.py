"""Text helpers: token budgets, error cuts, blank tests and run names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Output-token budget rule (minimum, ceiling, chars per token,
# output ratio) and the error cut length.
MIN_MAX_TOKENS = 1000
MAX_TOKEN_CEILING = 8000
CHARS_PER_TOKEN = 4
OUTPUT_RATIO = 3.0
ERROR_CUT = 400

# Fixed value: the safe batch and run name pattern.
SAFE_NAME_RE = r"^[A-Za-z0-9._-]{1,64}$"
_SAFE_NAME = re.compile(SAFE_NAME_RE)


class UnsafeNameError(ValueError):
    """A batch or run name that must not become a path part."""


def validate_name(name: str) -> str:
    """Driver-side guard: names become folder names, so the charset is closed."""
    if not isinstance(name, str) or not _SAFE_NAME.fullmatch(name):
        raise UnsafeNameError(f"name {name!r} must match {SAFE_NAME_RE}")
    return name


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def token_budget(text: Column | str) -> Column:
    """Output-token ceiling scaled to the prose: clip(len/4*3, 1000, 8000)."""
    estimated = F.floor(F.length(_c(text)) / F.lit(float(CHARS_PER_TOKEN)) * F.lit(OUTPUT_RATIO))
    return F.greatest(F.lit(MIN_MAX_TOKENS).cast("long"),
                      F.least(estimated, F.lit(MAX_TOKEN_CEILING).cast("long")))


def retry_budget(budget: Column | str) -> Column:
    """The one retry after truncation gets twice the budget, up to the ceiling."""
    return F.least(_c(budget) * 2, F.lit(MAX_TOKEN_CEILING).cast("long"))


def cut_error(error: Column | str) -> Column:
    """Error text as stored: 'unknown' when missing, cut to 400 characters."""
    return F.substring(F.coalesce(_c(error), F.lit("unknown")), 1, ERROR_CUT)


def is_throttled(error: Column | str) -> Column:
    """A failure caused by rate limiting: its text holds ``429`` (NULL-safe)."""
    return F.coalesce(_c(error), F.lit("")).contains("429")


def has_text(col: Column | str) -> Column:
    """True when the text holds any non-whitespace character."""
    return F.coalesce(_c(col).rlike(r"\S"), F.lit(False))


def numbered(prefix: Column | str, index: Column | str) -> Column:
    """``<prefix>-NNNN``: batch names inside a run."""
    return F.format_string("%s-%04d", _c(prefix), _c(index))


def list_size(col: Column | str) -> Column:
    """Number of elements, NULL for a NULL list whatever ``sizeOfNull`` says."""
    c = _c(col)
    return F.when(c.isNotNull(), F.size(c))
