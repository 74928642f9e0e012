"""Field statistics of the registry contract, as distributed aggregates.

Top-k lists use ``orderBy().limit()`` (a per-task top-k merged once), counts of
distinct values are aggregates, and scalars join the rows as scalar
subqueries, so no statistic pulls a whole column into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cribra.functions.dates import date_format_of, partial_date_hi, partial_date_lo
from cribra.functions.text import list_size

TOP_N = 10  # ours: the contract does not say how many top values


def materialize(df: DataFrame) -> DataFrame:
    """Write a small aggregate that several branches read to the shared
    checkpoint folder (reliable checkpoint), so it is computed once."""
    from cribra.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _top(counts: DataFrame, value_col: str, count_col: str, n: int) -> DataFrame:
    order = [F.col(count_col).desc(), F.col(value_col).asc()]
    top = counts.orderBy(*order).limit(n)
    # ``n`` rows at most: numbering them in one task is bounded.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def enum_stats(df: DataFrame, id_col: str, value_col: str, n: int = TOP_N) -> DataFrame:
    """Top values by number of studies having them, plus unique and missing counts.

    A study counts once per value (distinct (id, value) pairs); a list-valued
    field is exploded first. Missing = studies with no value (or an empty list).
    """
    from pyspark.sql import types as T
    v = F.col(value_col)
    is_list = isinstance(df.select(v).schema.fields[0].dataType, T.ArrayType)
    values = F.explode_outer(v) if is_list else v
    pairs = df.select(id_col, values.alias("value")).where("value IS NOT NULL").distinct()
    counts = pairs.groupBy("value").agg(F.count(F.lit(1)).alias("studies"))
    unique = counts.select(F.count(F.lit(1))).scalar()
    absent = (F.coalesce(list_size(v), F.lit(0)) == 0) if is_list else v.isNull()
    missing = df.select(F.count_if(absent)).scalar()
    return _top(counts, "value", "studies", n).select(
        "value", "studies", "rank", unique.alias("unique_values"), missing.alias("missing"))


def string_stats(df: DataFrame, id_col: str, value_col: str, n: int = TOP_N) -> DataFrame:
    """Enum statistics plus the longest value and its study (ties: smallest id)."""
    base = enum_stats(df, id_col, value_col, n)
    v = F.col(value_col)
    longest = df.where(v.isNotNull()).select(
        F.min_by(F.struct(v.alias("v"), F.col(id_col).alias("i"), F.length(v).alias("l")),
                 F.struct((-F.length(v)).alias("nl"), F.col(id_col).alias("i"))).alias("m"))
    lv = longest.select(F.col("m.v")).scalar()
    li = longest.select(F.col("m.i")).scalar()
    ll = longest.select(F.col("m.l")).scalar()
    return base.select("*", lv.alias("longest_value"), li.alias("longest_id"),
                       ll.alias("longest_chars"))


def date_stats(df: DataFrame, text_col: str) -> DataFrame:
    """Earliest and latest day covered, formats seen, and missing count."""
    t = F.col(text_col)
    fmt = date_format_of(t)
    return df.agg(
        F.min(partial_date_lo(t)).alias("min_date"),
        F.max(partial_date_hi(t)).alias("max_date"),
        F.array_join(F.sort_array(F.collect_set(fmt)), ",").alias("formats"),
        F.count_if(t.isNull()).alias("missing"),
    )


def numeric_stats(df: DataFrame, value_col: str, field: str | None = None,
                  avg_digits: int = 4) -> DataFrame:
    """min, max, avg (rounded: float sums depend on order) and missing count."""
    v = F.col(value_col).cast("double")
    return df.agg(
        F.lit(field or value_col).alias("field"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.round(F.avg(v), avg_digits).alias("avg_value"),
        F.count_if(v.isNull()).alias("missing"),
    )


def boolean_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """true, false and missing counts per boolean field (one row per field)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("boolean").alias("value"))
        for c in cols])).alias("kv")).select("kv.field", "kv.value")
    return long.groupBy("field").agg(
        F.count_if(F.col("value")).alias("true_count"),
        F.count_if(~F.col("value")).alias("false_count"),
        F.count_if(F.col("value").isNull()).alias("missing"),
    )


def list_size_stats(sizes: DataFrame, size_col: str = "size", n: int = TOP_N) -> DataFrame:
    """min, max and number of distinct list sizes, and the most common sizes."""
    counts = materialize(sizes.groupBy(size_col).agg(F.count(F.lit(1)).alias("studies")))
    # The top sizes, min, max and the number of distinct sizes all read the
    # size histogram (one row per distinct size), written once to the shared
    # checkpoint folder instead of re-aggregating every list per consumer.
    mn = counts.select(F.min(size_col)).scalar()
    mx = counts.select(F.max(size_col)).scalar()
    uq = counts.select(F.count(F.lit(1))).scalar()
    return _top(counts, size_col, "studies", n).select(
        F.col(size_col).alias("size"), "studies", "rank",
        mn.alias("min_size"), mx.alias("max_size"), uq.alias("unique_sizes"))


def array_sizes(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """Sizes of a list field held as an array in each study (NULL list = size 0)."""
    return df.select(id_col, F.coalesce(list_size(array_col), F.lit(0)).alias("size"))


# Ours: the byte ranges of the document-size histogram.
SIZE_RANGES = ((0, 1_000), (1_000, 10_000), (10_000, 100_000), (100_000, None))
PERCENTILES = (0.5, 0.9, 0.99)


def _percentiles(sizes: DataFrame, value_col: str, count_col: str,
                 ps: Sequence[float]) -> list[Column]:
    """Exact linearly interpolated percentiles of a histogram (one row per distinct value).

    The histogram is summed per chunk of values first, then within chunks, so
    neither running sum puts all distinct values into one task.
    """
    chunk = F.floor(F.col(value_col) / F.lit(4096))
    up = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    before = (sizes.groupBy(chunk.alias("_c")).agg(F.sum(count_col).alias("_n"))
              .select("_c", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("_c").orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0)
    ends = (sizes.withColumn("_c", chunk).join(before, "_c")
            .select(value_col, (F.col("_before") + F.sum(count_col).over(inside)).alias("_end")))
    n = sizes.select(F.sum(count_col)).scalar()
    picks, out = [], []
    for k, p in enumerate(ps):
        place = F.lit(p) * (n - 1).cast("double")
        for side, at in (("a", F.floor(place)), ("b", F.ceil(place))):
            picks.append(F.min(F.when(F.col("_end") > at, F.col(value_col))).cast("double").alias(f"{side}{k}"))
        out.append(F.col(f"a{k}") + (F.col(f"b{k}") - F.col(f"a{k}")) * (place - F.floor(place)))
    got = ends.agg(*picks).select(F.struct(*[x.alias(f"p{k}") for k, x in enumerate(out)]).alias("p"))
    return [got.select(f"p.p{k}").scalar() for k in range(len(ps))]


def size_stats(docs: DataFrame, id_col: str, bytes_col: str = "bytes") -> DataFrame:
    """Document sizes: histogram by range, with total, average, largest and percentiles.

    One pass over the documents gives (bytes, documents, smallest id), stored;
    everything else reads that histogram.
    """
    b, n = F.col(bytes_col), F.col("_docs")
    sizes = materialize(docs.groupBy(b).agg(F.count(F.lit(1)).alias("_docs"), F.min(id_col).alias("_id")))
    known = sizes.where(b.isNotNull())
    label = F.lit(None).cast("string")
    lo_col = F.lit(None).cast("long")
    for lo, hi in reversed(SIZE_RANGES):
        cond = (b >= lo) if hi is None else ((b >= lo) & (b < hi))
        label = F.when(cond, F.lit(f"{lo}-{hi if hi is not None else 'max'}")).otherwise(label)
        lo_col = F.when(cond, F.lit(lo).cast("long")).otherwise(lo_col)
    hist = sizes.groupBy(label.alias("size_range"), lo_col.alias("range_lo")).agg(F.sum(n).alias("docs"))
    top = F.max_by(F.struct(F.col("_id").alias("i"), b.alias("b")), b)
    totals = sizes.agg(F.struct(F.sum(n).alias("n"), F.sum(b * n).cast("long").alias("s"),
                                top.alias("m")).alias("t"))
    pct = _percentiles(known, bytes_col, "_docs", PERCENTILES)
    return hist.select(
        "size_range", "range_lo", "docs",
        totals.select("t.n").scalar().alias("total_docs"),
        totals.select("t.s").scalar().alias("total_bytes"),
        totals.select(F.col("t.s").cast("double") / F.col("t.n").cast("double")).scalar().alias("avg_bytes"),
        totals.select("t.m.i").scalar().alias("largest_id"),
        totals.select("t.m.b").scalar().alias("largest_bytes"),
        *[x.alias(f"p{int(round(p * 100))}") for p, x in zip(PERCENTILES, pct)],
    )
