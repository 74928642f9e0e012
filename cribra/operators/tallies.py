"""Field statistics kept up by signed counts instead of a scan.

A tally is how many rows have a value of a field: ``field``, ``value`` (as text, null for
missing) and ``n``. Change rows give signed tallies, +1 for a row's new image and -1 for its
old one, so adding them to the stored tallies is exact for updates and deletes too, in any
order. The statistics of the registry contract are then read from one row per distinct
value; the table itself is not scanned.

What needs a row's id beside its value (the study with the longest text or the largest
document) is not a count and stays with ``operators.stats``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribra.functions.dates import date_format_of, partial_date_hi, partial_date_lo
from cribra.functions.text import list_size
from cribra.operators import stats as ST

ROWS = "*"    # the field that counts rows


@dataclass(frozen=True)
class Field:
    """``how``: ``value`` of a column, distinct values of a ``list`` (a missing or empty one is
    missing), its ``size``, or the ``bytes`` of a text."""
    name: str
    column: str
    how: str = "value"

    def values(self) -> Column:
        """The field's values in a row as an array of text."""
        c = F.col(self.column)
        if self.how == "list":
            some = F.transform(F.array_distinct(F.filter(c, lambda x: x.isNotNull())), lambda x: x.cast("string"))
            empty = F.array(F.lit(None).cast("string"))
            return F.when(F.coalesce(list_size(c), F.lit(0)) == 0, empty).otherwise(some)
        if self.how == "size":
            return F.array(F.coalesce(list_size(c), F.lit(0)).cast("string"))
        if self.how == "bytes":
            return F.array(F.octet_length(c).cast("string"))
        if self.how == "value":
            return F.array(c.cast("string"))
        raise ValueError(f"unknown tally {self.how!r}")


def _tally(rows: DataFrame, fields: Sequence[Field], sign: Column) -> DataFrame:
    each = [F.struct(F.lit(ROWS).alias("field"), F.lit(None).cast("string").alias("value"))]

    def named(f: Field) -> Column:
        return F.transform(f.values(), lambda v: F.struct(F.lit(f.name).alias("field"), v.alias("value")))

    lists = [named(f) for f in fields]
    long = rows.select(sign.cast("long").alias("s"), F.explode(F.concat(F.array(*each), *lists)).alias("x"))
    return (long.groupBy("x.field", "x.value").agg(F.sum("s").alias("n")).where("n != 0"))


def tally(rows: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """A full count of a table."""
    return _tally(rows, fields, F.lit(1))


def signed(changes: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """What change rows add to a table's tallies; one partial aggregate."""
    new = F.col("change_type").isin("insert", "update_postimage")
    return _tally(changes, fields, F.when(new, 1).otherwise(-1))


def add(tallies: DataFrame, delta: DataFrame) -> DataFrame:
    """Tallies after a delta; a value that no row has any more is gone."""
    both = tallies.select("field", "value", "n").unionByName(delta.select("field", "value", "n"))
    return both.groupBy("field", "value").agg(F.sum("n").alias("n")).where("n != 0")


# ---- statistics from tallies -------------------------------------------------

def row_count(tallies: DataFrame) -> Column:
    return F.coalesce(tallies.where(F.col("field") == ROWS).select(F.sum("n")).scalar(), F.lit(0)).cast("long")


def _of(tallies: DataFrame, field: str, kind: str = "string") -> DataFrame:
    return tallies.where(F.col("field") == field).select(F.col("value").cast(kind).alias("value"), "n")


def missing_count(tallies: DataFrame, field: str) -> Column:
    found = _of(tallies, field).where("value IS NULL").select(F.sum("n")).scalar()
    return F.coalesce(found, F.lit(0)).cast("long")


def enum_stats(tallies: DataFrame, field: str, n: int = ST.TOP_N) -> DataFrame:
    """As ``stats.enum_stats``."""
    counts = _of(tallies, field).where("value IS NOT NULL").select("value", F.col("n").alias("studies"))
    return ST._top(counts, "value", "studies", n).select(
        "value", "studies", "rank", counts.select(F.count(F.lit(1))).scalar().alias("unique_values"),
        missing_count(tallies, field).alias("missing"))


def date_stats(tallies: DataFrame, field: str) -> DataFrame:
    """As ``stats.date_stats``."""
    t, rows = F.col("value"), _of(tallies, field)
    return rows.agg(
        F.min(partial_date_lo(t)).alias("min_date"), F.max(partial_date_hi(t)).alias("max_date"),
        F.array_join(F.sort_array(F.collect_set(date_format_of(t))), ",").alias("formats"),
        F.coalesce(F.sum(F.when(t.isNull(), F.col("n"))), F.lit(0)).cast("long").alias("missing"))


def numeric_stats(tallies: DataFrame, field: str, avg_digits: int = 4) -> DataFrame:
    """As ``stats.numeric_stats``."""
    v, n = F.col("value"), F.col("n")
    known = F.when(v.isNotNull(), n)
    return _of(tallies, field, "double").agg(
        F.lit(field).alias("field"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
        F.round(F.sum(v * n) / F.sum(known), avg_digits).alias("avg_value"),
        F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).cast("long").alias("missing"))


def boolean_stats(tallies: DataFrame, fields: Sequence[str]) -> DataFrame:
    """As ``stats.boolean_stats``."""
    v, n = F.col("value").cast("boolean"), F.col("n")

    def total(hit: Column) -> Column:
        return F.coalesce(F.sum(F.when(hit, n)), F.lit(0)).cast("long")

    return tallies.where(F.col("field").isin(*fields)).groupBy("field").agg(
        total(v).alias("true_count"), total(~v).alias("false_count"), total(v.isNull()).alias("missing"))


def size_stats(tallies: DataFrame, field: str) -> DataFrame:
    """Totals, average and percentiles of sizes, one row (``stats.size_stats`` but for the ranges' ids)."""
    sizes = _of(tallies, field, "long").where("value IS NOT NULL")
    v, n = F.col("value"), F.col("n")
    out = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("docs"),
                    F.sum(v * n).cast("long").alias("total_bytes"),
                    (F.sum(v * n).cast("double") / F.sum(n).cast("double")).alias("avg_bytes"),
                    F.min(v).alias("min_bytes"), F.max(v).alias("max_bytes"))
    pct = ST._percentiles(sizes, "value", "n", ST.PERCENTILES)
    return out.select("*", *[x.alias(f"p{int(round(p * 100))}") for p, x in zip(ST.PERCENTILES, pct)])
