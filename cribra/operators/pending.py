"""Pending work: trials with prose that no success or exhausted failure covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MAX_ATTEMPTS = 3  # reference default


def pending_trials(bronze: DataFrame, done: DataFrame, failures: DataFrame | None,
                   signature: str, retry_failed: bool = False,
                   max_attempts: int = MAX_ATTEMPTS, id_col: str = "nct_id",
                   text_col: str = "eligibility") -> DataFrame:
    """Bronze trials with prose, minus those done under ``signature``, minus
    (unless ``retry_failed``) those whose failures reached ``max_attempts``.

    ``done`` holds the ids with a successful attempt (or Silver rows) and a
    ``signature`` column; other signatures count as absent. Both exclusions
    are left anti joins, which AQE turns into broadcast joins when the
    excluded side is measured small.
    """
    # Prose present and not empty; whitespace-only prose stays pending and gets
    # an ok, empty result without a call (see ``extract.extract_with``).
    todo = bronze.where(F.length(F.col(text_col)) > 0).select(id_col, text_col)
    finished = done.where(F.col("signature") == signature).select(id_col)
    out = todo.join(finished, id_col, "left_anti")
    if not retry_failed and failures is not None:
        exhausted = failures.where((F.col("signature") == signature)
                                   & (F.col("attempts") >= max_attempts)).select(id_col)
        out = out.join(exhausted, id_col, "left_anti")
    return out


def pending_limited(pending: DataFrame, n: int, id_col: str = "nct_id") -> DataFrame:
    """The first ``n`` pending trials in id order (a top-n, not a global sort)."""
    return pending.orderBy(id_col).limit(n)
