"""Order-dependent operators: exact global row index, pages, limits, projection."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOW_BITS = (1 << 33) - 1


def global_index(df: DataFrame, order_cols: Sequence[str], name: str = "row_index",
                 partitions: int | None = None, stable: bool = False) -> DataFrame:
    """Exact 0-based position of each row in ``order_cols`` order, without one task.

    The rows are range-partitioned, sorted within partitions and stored once in
    the shared checkpoint folder with their (partition, position in partition).
    Everything after reads that stored layout: the source is not read again, so
    keys that depend on how it was split (a place in a file's split, say) stay
    as they were, whatever the cluster looks like later. Per-partition counts,
    one row per partition, give each partition's offset. ``order_cols`` must be
    unique.

    ``stable=True`` says that the keys come from the data alone: then only the
    keys are stored, and the positions join back to the rows, which spares
    writing wide rows.
    """
    from cribra.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    keys = list(order_cols)
    # Without an explicit count AQE may coalesce adjacent ranges, which keeps
    # the order (small key sets do not pay for hundreds of empty tasks).
    rows = df.select(*keys) if stable else df
    ranged = (rows.repartitionByRange(partitions, *keys) if partitions
              else rows.repartitionByRange(*keys))
    ranged = (ranged.sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    ranged = ranged.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_local", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: bounded by the partition count, safe to broadcast.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    placed = (ranged.join(F.broadcast(offsets), "_pid")
              .select(*rows.columns, (F.col("_off") + F.col("_local")).alias(name)))
    return df.join(placed, keys) if len(rows.columns) < len(df.columns) else placed


def chunk_index(df: DataFrame, order_cols: Sequence[str], size: int,
                name: str = "batch_index", stable: bool = False) -> DataFrame:
    """Runs of ``size`` rows in order, the last one short (``stable``: see ``global_index``)."""
    idx = global_index(df, order_cols, "_ri", stable=stable)
    return idx.withColumn(name, F.floor(F.col("_ri") / F.lit(size)).cast("long")).drop("_ri")


def first_n(df: DataFrame, order_cols: Sequence[str | Column], n: int) -> DataFrame:
    """First ``n`` in order: a per-task top-n then a merge (TakeOrderedAndProject)."""
    return df.orderBy(*order_cols).limit(n)


# Sort rule of the registry (ours where the contract is silent): missing values
# last, dates newest first and numbers smallest first unless a direction is
# given, and the trial id breaks ties so pages are stable.
def default_direction(df: DataFrame, col: str) -> str:
    return "desc" if isinstance(df.schema[col].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "asc"


def sort_key(df: DataFrame, col: str, direction: str | None = None) -> Column:
    direction = direction or default_direction(df, col)
    c = F.col(col)
    return c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last()


def sort_page(df: DataFrame, sort: Sequence[tuple[str, str | None]], id_col: str,
              page_size: int, position: str = "position") -> DataFrame:
    """One page of studies under at most two sort keys, with its 1-based position."""
    if len(sort) > 2:
        raise ValueError("at most two sort keys")
    keys = [sort_key(df, c, d) for c, d in sort] + [F.col(id_col).asc()]
    page = df.orderBy(*keys).limit(page_size)
    # The page is at most ``page_size`` rows, so numbering it in one task is bounded.
    return page.withColumn(position, F.row_number().over(Window.orderBy(*keys)))


# ---- pages by token: a cursor over the sort keys --------------------------------

def _directions(df: DataFrame, sort: Sequence[tuple[str, str | None]], id_col: str) -> list[tuple[str, str]]:
    """Columns of the order and their directions; the id, which breaks ties, comes last."""
    if len(sort) > 2:
        raise ValueError("at most two sort keys")
    return [*((c, d or default_direction(df, c)) for c, d in sort), (id_col, "asc")]


def page_token(df: DataFrame, sort: Sequence[tuple[str, str | None]], id_col: str) -> Column:
    """A row's place in the order as text: the sort and the row's keys, missing ones left out."""
    keys = _directions(df, sort, id_col)
    named = ",".join(f"{c}:{d}" for c, d in keys)
    place = [F.col(c).cast("string").alias(f"k{i}") for i, (c, _) in enumerate(keys)]
    return F.base64(F.to_json(F.struct(F.lit(named).alias("sort"), *place)).cast("binary"))


def page_after(df: DataFrame, sort: Sequence[tuple[str, str | None]], id_col: str, page_size: int,
               token: str | None = None) -> DataFrame:
    """The page behind a token (the first page without one), each row with its ``token``.

    The order is that of ``sort_page``: missing keys last, the id breaks ties. The
    token's keys become a filter, so a page costs one per-task top-n of its own
    size however far back it is; a page's last token leads to the next page.
    """
    keys = _directions(df, sort, id_col)
    rows = df
    if token is not None:
        place = json.loads(base64.b64decode(token))
        named = ",".join(f"{c}:{d}" for c, d in keys)
        if place.get("sort") != named:
            raise ValueError(f"the token is of the order {place.get('sort')!r}, not of {named!r}")
        behind, same = F.lit(False), F.lit(True)
        for i, (c, d) in enumerate(keys):
            held, col = place.get(f"k{i}"), F.col(c)
            if held is None:                       # nothing stands behind a missing key
                same = same & col.isNull()
                continue
            at = F.lit(held).cast(df.schema[c].dataType)
            behind = behind | (same & (((col < at) if d == "desc" else (col > at)) | col.isNull()))
            same = same & (col == at)
        rows = df.where(F.coalesce(behind, F.lit(False)))
    order = [sort_key(df, c, d) for c, d in keys]
    return rows.withColumn("token", page_token(df, sort, id_col)).orderBy(*order).limit(page_size)


def pages(df: DataFrame, sort: Sequence[tuple[str, str | None]], id_col: str, page_size: int,
          upto: int, page: str = "page") -> DataFrame:
    """The first ``upto`` pages, walked by their tokens (a page's tokens reach the driver)."""
    out, token = None, None
    for number in range(1, upto + 1):
        rows = page_after(df, sort, id_col, page_size, token)
        numbered = rows.withColumn(page, F.lit(number))
        out = numbered if out is None else out.unionByName(numbered)
        tokens = rows.select("token").collect()          # at most page_size, in order
        if len(tokens) < page_size:
            break
        token = tokens[-1]["token"]
    return out


def _leaves(dtype: T.DataType, prefix: str) -> list[str]:
    if isinstance(dtype, T.StructType):
        out: list[str] = []
        for f in dtype.fields:
            out.extend(_leaves(f.dataType, f"{prefix}.{f.name}"))
        return out
    return [prefix]


def project_fields(df: DataFrame, paths: Sequence[str], flatten: bool = False,
                   keep: Sequence[str] = ()) -> DataFrame:
    """Select field paths; a branch brings all its leaves.

    Nested structs stay nested unless ``flatten``, which names each leaf by its
    path with ``_``. Catalyst prunes every other field down to the scan.
    """
    cols: list[Column] = [F.col(k) for k in keep]
    for p in paths:
        if not flatten:
            cols.append(F.col(p).alias(p.split(".")[-1]))
            continue
        dtype = df.select(F.col(p)).schema.fields[0].dataType
        for leaf in _leaves(dtype, p):
            cols.append(F.col(leaf).alias(leaf.replace(".", "_")))
    return df.select(*cols)
