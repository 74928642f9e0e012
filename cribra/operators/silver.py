"""Silver: criteria rows, replace-per-trial writes, failure counters, progress.

State changes are pure functions of DataFrames: each returns the next version
of a table, so a batch commit is one write of that result (or one append to
the attempt log) and a rerun of the same batch gives the same table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cribra.functions.text import cut_error, is_throttled


def outcomes_to_rows(outcomes: DataFrame, signature: str, id_col: str = "nct_id",
                     criteria_col: str = "criteria", extra: Sequence[str] = ()) -> DataFrame:
    """Ok outcomes to one typed row per criterion, 0-based ordinal, signature on each."""
    ok = outcomes.where(F.col(criteria_col).isNotNull())
    exploded = ok.select(id_col, *extra, F.posexplode(criteria_col).alias("ordinal", "c"))
    return exploded.select(
        id_col,
        F.lit(signature).alias("signature"),
        F.col("ordinal").cast("int").alias("ordinal"),
        F.col("c.criterion_id").alias("criterion_id"),
        F.col("c.text").alias("text"),
        F.col("c.kind").alias("kind"),
        F.col("c.is_exclusion").cast("boolean").alias("is_exclusion"),
        *extra,
    )


def to_staging_strings(rows: DataFrame, cols: Sequence[str] = ("ordinal", "is_exclusion")) -> DataFrame:
    """Numbers and booleans as text for an all-string landing line."""
    return rows.select(*[F.col(c).cast("string").alias(c) if c in cols else F.col(c)
                         for c in rows.columns])


def from_staging_strings(rows: DataFrame) -> DataFrame:
    """The typed append: text columns back to INT and BOOLEAN."""
    return rows.select(*[
        F.col(c).cast("int").alias(c) if c == "ordinal"
        else F.col(c).cast("boolean").alias(c) if c == "is_exclusion"
        else F.col(c)
        for c in rows.columns])


def replace_by_key(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All target rows of a key present in ``source`` are replaced by the source rows.

    Keys absent from the source, and rows of other signatures when the
    signature is part of ``keys``, are untouched.
    """
    replaced = source.select(*keys).distinct()
    return target.join(replaced, list(keys), "left_anti").unionByName(source)


def accumulate_failures(target: DataFrame | None, outcomes: DataFrame, signature: str,
                        id_col: str = "nct_id", order_col: str | None = None,
                        error_col: str = "error") -> DataFrame:
    """+1 attempt per genuine failure, insert at 1; last error kept, cut to 400.

    Throttled outcomes (error holds ``429``) say nothing about the trial and are
    never counted. Several failures of one trial in a batch add up; the last by
    ``order_col`` gives the error text (the largest text without one). Output: (nct_id, signature, error, attempts).
    ``target=None`` means no counters yet.
    """
    failed = outcomes.where(F.col(error_col).isNotNull() & ~is_throttled(error_col))
    # Without an order the largest error text is kept: an arbitrary one would change by layout.
    last_key = F.col(order_col) if order_col else F.col(error_col)
    batch = failed.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by(F.col(error_col), last_key).alias("_err"),
    ).withColumn("signature", F.lit(signature))
    if target is None:
        return batch.select(id_col, "signature", cut_error(F.col("_err")).alias("error"),
                            F.col("_n").cast("int").alias("attempts"))
    t = target.alias("t")
    s = batch.alias("s")
    joined = t.join(s, [id_col, "signature"], "full_outer")
    return joined.select(
        id_col,
        "signature",
        F.when(F.col("s._n").isNotNull(), cut_error(F.col("s._err")))
         .otherwise(F.col("t.error")).alias("error"),
        (F.coalesce(F.col("t.attempts"), F.lit(0)) + F.coalesce(F.col("s._n"), F.lit(0)))
        .cast("int").alias("attempts"),
    )


def clear_failures(failures: DataFrame, outcomes: DataFrame, signature: str,
                   id_col: str = "nct_id", error_col: str = "error") -> DataFrame:
    """A success removes the counter of that trial under this signature.

    One anti join on (trial, signature): counters of other signatures never
    match, so the table is read once.
    """
    ok = (outcomes.where(F.col(error_col).isNull()).select(id_col).distinct()
          .withColumn("signature", F.lit(signature)))
    return failures.join(ok, [id_col, "signature"], "left_anti")


def run_counters(outcomes: DataFrame, error_col: str = "error") -> DataFrame:
    """succeeded, failed, rate_limited (a subset of failed), attempted."""
    err = F.col(error_col)
    return outcomes.agg(
        F.count_if(err.isNull()).alias("succeeded"),
        F.count_if(err.isNotNull()).alias("failed"),
        F.count_if(err.isNotNull() & is_throttled(err)).alias("rate_limited"),
        F.count(F.lit(1)).alias("attempted"),
    )


def silver_stats(silver: DataFrame, failures: DataFrame, bronze: DataFrame, signature: str,
                 text_col: str = "eligibility", id_col: str = "nct_id") -> DataFrame:
    """trials, criteria, failed, total in one row (zeros when empty).

    One pass over a tagged union instead of four scalar subqueries: each input
    is scanned once and the global aggregate is partial per task.
    """
    s = silver.where(F.col("signature") == signature).select(
        F.lit(0).alias("_src"), F.col(id_col).alias("_id"))
    f = failures.where(F.col("signature") == signature).select(
        F.lit(1).alias("_src"), F.lit(None).cast("string").alias("_id"))
    b = bronze.where(F.col(text_col).isNotNull()).select(
        F.lit(2).alias("_src"), F.lit(None).cast("string").alias("_id"))
    u = s.unionByName(f).unionByName(b)
    src = F.col("_src")
    return u.agg(
        F.count_distinct(F.when(src == 0, F.col("_id"))).alias("trials"),
        F.count_if(src == 0).alias("criteria"),
        F.count_if(src == 1).alias("failed"),
        F.count_if(src == 2).alias("total"),
    )


def run_result(counters: DataFrame, stats: DataFrame, signature: str) -> DataFrame:
    """One row: a run's counters with what remains, and whether throttling ended it.

    ``counters`` is ``run_counters``, ``stats`` is ``silver_stats``: the criteria under the
    signature, and the trials still to do. Each is one row.
    """
    one = stats.select(F.struct("criteria", (F.col("total") - F.col("trials")).alias("remaining")).alias("s")).scalar()
    remaining = one.getField("remaining")
    return counters.select(
        F.lit(signature).alias("signature"), F.col("succeeded").alias("trials_written"),
        one.getField("criteria").alias("criteria_written"), "succeeded", "failed", "rate_limited",
        remaining.alias("remaining"),
        ((remaining > 0) & (F.col("rate_limited") > 0) & (F.col("failed") > 0)).alias("quota_exhausted"))


def progress_percent(done: Column, total: Column) -> Column:
    """100 * done / total with one decimal; a total of 0 counts as 1."""
    return F.round(done.cast("double") * 100.0 / F.greatest(total, F.lit(1)).cast("double"), 1)


def kind_distribution(criteria: DataFrame, kind_col: str = "kind") -> DataFrame:
    """Criteria per kind and each kind's share of all criteria.

    The grouped result has at most one row per kind (twenty), so the share's
    total is a window over that bounded result.
    """
    counts = criteria.groupBy(kind_col).agg(F.count(F.lit(1)).alias("criteria"))
    total = F.sum("criteria").over(Window.partitionBy())
    return counts.select(
        kind_col, "criteria",
        (F.col("criteria").cast("double") / total.cast("double")).alias("share"),
    )


def batch_counts(rows: DataFrame, batch_col: str = "batch", id_col: str = "nct_id") -> DataFrame:
    """Criteria rows and trials written per batch."""
    return rows.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("criteria"),
        F.count_distinct(id_col).alias("trials"),
    )
