"""Many requested ranges against many intervals: an overlap join by bins.

Both sides name their bounds as whole numbers (days, minutes), both inclusive; a
missing bound is open. Each row is dealt to the bins it covers, rows of one bin
meet by an equi-join, and a pair is kept in the one bin that holds the later of
their two starts, so no pair comes twice and nothing needs a distinct. A bin with
very many intervals is split by a salt: its intervals are dealt over the salts and
its ranges, the smaller side, go to each. No bin is a task of its own size.

Where only the number of pairs a range has is wanted, no pair is made: an interval that
does not meet a range starts after its end or ends before its start, never both, so the
number is that of starts up to the range's end less that of ends before its start. Both
are running counts over bounds, so the work grows with the rows and not with the pairs.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cribra.functions.dates import duration_minutes, partial_date_hi, partial_date_lo
from cribra.session import checkpoint_dir

#: Intervals of a bin that one salt holds.
BIN_ROWS = 100_000


def overlap_join(intervals: DataFrame, ranges: DataFrame, width: int, lo: str = "lo", hi: str = "hi",
                 from_col: str = "from", to_col: str = "to", bin_rows: int = BIN_ROWS,
                 count: str | None = None) -> DataFrame:
    """All pairs of rows that overlap, with the columns of both sides (names must differ).

    ``width``: of a bin, about the length of a usual interval. An empty interval
    (``lo > hi``) overlaps nothing; open ends reach to the ends of the other side.
    With ``count``, each range that overlaps any interval comes once, with their number
    under that name; bins are then of the bounds' own span.
    """
    i_lo, i_hi, r_lo, r_hi = (F.col(c).cast("long") for c in (lo, hi, from_col, to_col))
    if count is not None:
        # Each side is read, and its texts are parsed, once.
        intervals = _kept(intervals.groupBy(i_lo.alias(lo), i_hi.alias(hi)).agg(F.count(F.lit(1)).alias("_n")))
        ranges = _kept(ranges)
    # Two numbers a side: the span of known bounds, beyond which an open end need not go.
    ends_i = intervals.agg(F.min(F.least(i_lo, i_hi)).alias("a"), F.max(F.greatest(i_lo, i_hi)).alias("z")).first()
    ends_r = ranges.agg(F.min(F.least(r_lo, r_hi)).alias("a"), F.max(F.greatest(r_lo, r_hi)).alias("z")).first()
    known = [x for x in (ends_i["a"], ends_i["z"], ends_r["a"], ends_r["z"]) if x is not None]
    least, most = (min(known), max(known)) if known else (0, 0)

    def binned(df: DataFrame, a: Column, z: Column, names: tuple[str, str]) -> DataFrame:
        start, stop = F.coalesce(a, F.lit(least)), F.coalesce(z, F.lit(most))
        return df.withColumns({names[0]: start, names[1]: stop}).where(F.col(names[0]) <= F.col(names[1]))

    def bins(names: tuple[str, str]) -> Column:
        return F.explode(F.sequence(F.floor(F.col(names[0]) / width).cast("long"),
                                    F.floor(F.col(names[1]) / width).cast("long")))

    left = binned(intervals, i_lo, i_hi, ("_ia", "_iz"))
    right = binned(ranges, r_lo, r_hi, ("_ra", "_rz"))
    if count is not None:
        step = isqrt(most - least) + 1
        upto = _running(left.select(F.col("_ia").alias("_rz"), "_n"), right, "_rz", step)
        past = _running(left.select(F.col("_iz").alias("_ra"), "_n"), right, "_ra", step)
        return (right.join(upto.select("_rz", F.col("_upto").alias("_starts")), "_rz")
                .join(past.select("_ra", F.col("_below").alias("_ends")), "_ra")
                .withColumn(count, F.col("_starts") - F.col("_ends")).where(F.col(count) > 0)
                .select(*ranges.columns, count))
    placed = left.withColumn("_bin", bins(("_ia", "_iz")))
    # One row per bin.
    salts = (left.select(bins(("_ia", "_iz")).alias("_bin")).groupBy("_bin").count()
             .select("_bin", F.ceil(F.col("count") / bin_rows).cast("long").alias("_salts")))
    placed = placed.join(salts, "_bin").withColumn(
        "_salt", F.pmod(F.xxhash64(*intervals.columns, "_ia", "_iz"), F.col("_salts"))).drop("_salts")
    asked = (right.withColumn("_bin", bins(("_ra", "_rz"))).join(salts, "_bin")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts"))
    pairs = placed.join(asked, ["_bin", "_salt"]).where(
        (F.col("_ia") <= F.col("_rz")) & (F.col("_ra") <= F.col("_iz"))
        & (F.col("_bin") == F.floor(F.greatest("_ia", "_ra") / width)))
    return pairs.select(*intervals.columns, *ranges.columns)


def _kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _running(bounds: DataFrame, asked: DataFrame, at: str, step: int) -> DataFrame:
    """Number ``_n`` of ``bounds`` below (``_below``) and up to (``_upto``) each value of ``at`` on either side.

    Counted by value first, then within bins of ``step`` values, then over the totals of
    the bins: with the root of the span as step, neither holds more rows than that.
    """
    each = (bounds.union(asked.select(at, F.lit(0).cast("long")))
            .groupBy(at).agg(F.sum("_n").alias("_n")).withColumn("_bin", F.floor(F.col(at) / step).cast("long")))
    bins = each.groupBy("_bin").agg(F.sum("_n").alias("_all"))
    before = bins.select("_bin", (F.sum("_all").over(Window.orderBy("_bin")) - F.col("_all")).alias("_before"))
    return (each.withColumn("_in", F.sum("_n").over(Window.partitionBy("_bin").orderBy(at)))
            .join(before, "_bin").withColumn("_upto", F.col("_before") + F.col("_in"))
            .select(at, "_upto", (F.col("_upto") - F.col("_n")).alias("_below")))


def partial_date_days(text: Column | str) -> tuple[Column, Column]:
    """First and last day that a partial date covers, as days since 1970-01-01."""
    return F.unix_date(partial_date_lo(text)).cast("long"), F.unix_date(partial_date_hi(text)).cast("long")


def age_minutes(text: Column | str) -> Column:
    """An age text as whole minutes."""
    return F.round(duration_minutes(text)).cast("long")
