"""Row predicates: the registry scope, incremental range, ids and the contract filters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribra.functions.dates import duration_minutes
from cribra.functions.geo import (CELL_DEGREES, KM_PER_UNIT, cell_of, covering_cells, haversine_km,
                                  in_cells)
from cribra.functions.ids import canonical_nct, is_valid_nct

# The configured scope (condition ancestor, study type, status).
SCOPE_ANCESTOR = "Neoplasms"
SCOPE_STUDY_TYPE = "INTERVENTIONAL"
RECRUITING = ("RECRUITING",)


def has_term(array_col: str | Column, term: str, field: str | None = None) -> Column:
    """``exists(array, a -> a[.field] = term)``: equality, as the contract leaves it open."""
    c = F.col(array_col) if isinstance(array_col, str) else array_col
    return F.coalesce(F.exists(c, lambda a: (a[field] if field else a) == F.lit(term)),
                      F.lit(False))


def scope_filter(df: DataFrame, ancestors_col: str, type_col: str, status_col: str,
                 term: str = SCOPE_ANCESTOR, study_type: str = SCOPE_STUDY_TYPE,
                 statuses: Sequence[str] | None = RECRUITING,
                 ancestor_field: str | None = "term") -> DataFrame:
    """Condition ancestor and study type; recruiting only unless ``statuses`` is None."""
    cond = has_term(ancestors_col, term, ancestor_field) & (F.col(type_col) == study_type)
    if statuses is not None:
        cond = cond & F.col(status_col).isin(list(statuses))
    return df.where(cond)


def scope_count(scoped: DataFrame) -> DataFrame:
    """Size of a scope without its rows (a distributed count)."""
    return scoped.agg(F.count(F.lit(1)).alias("scope_count"))


def updated_since(df: DataFrame, date_col: str, since: date | str | None) -> DataFrame:
    """Inclusive lower bound on the last-update date; None keeps everything."""
    if since is None:
        return df
    return df.where(F.col(date_col) >= F.lit(str(since)).cast("date"))


def custom_filter(df: DataFrame, predicate: Column) -> DataFrame:
    """A caller's own predicate replaces the scope."""
    return df.where(predicate)


def valid_ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.withColumn("valid", is_valid_nct(id_col))


def filter_status(df: DataFrame, status_col: str, statuses: Sequence[str]) -> DataFrame:
    return df.where(F.col(status_col).isin(list(statuses)))


def filter_ids(df: DataFrame, id_col: str, aliases_col: str | None,
               ids: Sequence[str] | DataFrame) -> DataFrame:
    """Studies whose id or any alias equals a requested id, after canonical form.

    A short list is a literal set; a long one comes as a DataFrame of ``id`` and
    is applied as a semi join (Spark broadcasts it only when its measured size
    is under the broadcast threshold).
    """
    if isinstance(ids, DataFrame):
        want = ids.select(canonical_nct("id").alias("_cid")).where("_cid IS NOT NULL").distinct()
        # Only ids and keys are exploded and matched; whole rows then stay or go by their id
        # and aliases, so rows that repeat an id all stay, as in the list form.
        names = F.array(canonical_nct(id_col))
        narrow = [id_col]
        if aliases_col:
            names = F.array_union(names, F.coalesce(F.transform(aliases_col, canonical_nct),
                                                    F.array().cast("array<string>")))
            narrow.append(aliases_col)
        keys = df.select(*narrow).distinct().select(*narrow, F.explode(names).alias("_cid"))
        hit = keys.join(want, "_cid", "left_semi").select(*narrow).distinct().alias("h")
        match = F.lit(True)
        for c in narrow:
            match = match & F.col(f"d.{c}").eqNullSafe(F.col(f"h.{c}"))
        return df.alias("d").join(hit, match, "left_semi")
    wanted = sorted({x for x in (_py_canonical(i) for i in ids) if x})
    arr = F.array(*[F.lit(x) for x in wanted]) if wanted else F.array().cast("array<string>")
    cond = canonical_nct(id_col).isin(wanted)
    if aliases_col:
        cond = cond | F.coalesce(F.arrays_overlap(F.transform(aliases_col, canonical_nct), arr),
                                 F.lit(False))
    return df.where(cond)


def _py_canonical(text: str) -> str | None:
    import re
    m = re.fullmatch(r"NCT0*([0-9]+)", text.strip().upper())
    return f"NCT{int(m.group(1)):08d}" if m else None


def filter_geo(df: DataFrame, locations_col: str, lat: float, lon: float, distance: float,
               unit: str, lat_field: str = "lat", lon_field: str = "lon") -> DataFrame:
    """Studies with any location within ``distance`` (unit must be given: km or mi)."""
    if unit not in KM_PER_UNIT:
        raise ValueError(f"unit must be one of {sorted(KM_PER_UNIT)}")
    limit_km = distance * KM_PER_UNIT[unit]

    def field(p: Column, path: str) -> Column:
        for part in path.split("."):
            p = p[part]
        return p

    near = F.exists(F.col(locations_col), lambda p: haversine_km(
        field(p, lat_field), field(p, lon_field), F.lit(lat), F.lit(lon)) <= F.lit(limit_km))
    return df.where(F.coalesce(near, F.lit(False)))


def _at(p: Column, path: str) -> Column:
    for part in path.split("."):
        p = p[part]
    return p


def location_cells(df: DataFrame, id_col: str, locations_col: str, lat_field: str = "lat",
                   lon_field: str = "lon", step: float = CELL_DEGREES) -> DataFrame:
    """One row per location: id, ``lat``, ``lon`` and its grid ``cell``.

    Written by ``write_location_cells`` it is an index: sorted by cell, so a circle's
    cells skip row groups. A study without locations has no row.
    """
    one = df.select(id_col, F.explode(locations_col).alias("_p"))
    lat, lon = (_at(F.col("_p"), f).cast("double") for f in (lat_field, lon_field))
    return one.select(id_col, lat.alias("lat"), lon.alias("lon")).withColumn(
        "cell", cell_of(F.col("lat"), F.col("lon"), step))


def write_location_cells(cells: DataFrame, path: str) -> None:
    cells.repartitionByRange("cell").sortWithinPartitions("cell").write.parquet(path)


def near_by_cells(cells: DataFrame, id_col: str, lat: float, lon: float, distance: float, unit: str,
                  step: float = CELL_DEGREES) -> DataFrame:
    """Ids with any location within ``distance``, as ``filter_geo``: the circle's cells are a
    filter on the scan, and the distance is computed for what they hold."""
    if unit not in KM_PER_UNIT:
        raise ValueError(f"unit must be one of {sorted(KM_PER_UNIT)}")
    km = distance * KM_PER_UNIT[unit]
    some = cells.where(in_cells(F.col("cell"), covering_cells(lat, lon, km, step)))
    near = haversine_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= F.lit(km)
    return some.where(near).select(id_col).distinct()


def filter_age(df: DataFrame, min_col: str, max_col: str, lo: str | None, hi: str | None) -> DataFrame:
    """Studies open to some age in [lo, hi]; a missing bound on either side is open."""
    smin, smax = duration_minutes(min_col), duration_minutes(max_col)
    cond = F.lit(True)
    if hi is not None:
        cond = cond & (smin.isNull() | (smin <= duration_minutes(F.lit(hi))))
    if lo is not None:
        cond = cond & (smax.isNull() | (smax >= duration_minutes(F.lit(lo))))
    return df.where(cond)


def filter_partial_date(df: DataFrame, lo_col: str, hi_col: str,
                        start: str | None, end: str | None) -> DataFrame:
    """Studies whose partial date [lo, hi] overlaps [start, end]."""
    cond = F.col(lo_col).isNotNull()
    if end is not None:
        cond = cond & (F.col(lo_col) <= F.lit(end).cast("date"))
    if start is not None:
        cond = cond & (F.col(hi_col) >= F.lit(start).cast("date"))
    return df.where(cond)
