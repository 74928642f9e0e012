"""Registry pages: one JSON page per file, studies validated against the fixed schema.

Each file holds ``{"studies": [...], "nextPageToken": ..., "totalCount": ...}``.
Files are read whole (a page is bounded by the registry's page size), parsed
with the fixed schema, and exploded to one row per study with its arrival
order ``(page_file, pos)``; page files must sort by name in page order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cribra.functions.dates import strict_date
from cribra.functions.text import list_size
from cribra.schemas import OVERALL_STATUS, PAGE_DDL, PHASE, SEX, STANDARD_AGE, STUDY_TYPE
from cribra.session import checkpoint_dir

CORRUPT = "_corrupt"
PAGE_KEYS = ("studies", "nextPageToken", "totalCount")


# Where the small enums above apply; further ones come from the contract (contract_enums).
SCOPE_ENUMS: dict[str, tuple[str, ...]] = {
    "protocolSection.statusModule.overallStatus": OVERALL_STATUS,
    "protocolSection.designModule.studyType": STUDY_TYPE,
    "protocolSection.designModule.phases": PHASE,
    "protocolSection.eligibilityModule.sex": SEX,
    "protocolSection.eligibilityModule.stdAges": STANDARD_AGE,
}
FULL_DATES = tuple(f"protocolSection.statusModule.{x}PostDateStruct.date"
                   for x in ("studyFirst", "resultsFirst", "dispFirst", "lastUpdate"))
TRIAL_ID = "protocolSection.identificationModule.nctId"
POINTS = "protocolSection.contactsLocationsModule.locations.geoPoint"


def contract_enums(spec: Mapping, root: str = "Study") -> dict[str, tuple[str, ...]]:
    """Field path -> allowed values of every enum below ``root`` in the registry's
    OpenAPI document (parsed, as a dict). Lists do not show in a path."""
    schemas = spec["components"]["schemas"]
    found: dict[str, tuple[str, ...]] = {}

    def walk(node: Mapping, path: str, above: tuple[str, ...]) -> None:
        ref = node.get("$ref")
        if ref:
            name = ref.rsplit("/", 1)[1]
            if name not in above:
                walk(schemas[name], path, (*above, name))
            return
        for part in node.get("allOf", ()):
            walk(part, path, above)
        if "enum" in node:
            found[path] = tuple(str(v) for v in node["enum"])
        if "items" in node:
            walk(node["items"], path, above)
        for name, child in node.get("properties", {}).items():
            walk(child, f"{path}.{name}".lstrip("."), above)

    walk(schemas[root], "", (root,))
    return found


def _any_at(value: Column, dtype: T.DataType, path: list[str],
            bad: Callable[[Column], Column]) -> Column:
    """Whether ``bad`` holds at any place that ``path`` reaches; lists are entered."""
    if isinstance(dtype, T.ArrayType):
        inside = F.exists(value, lambda e: _any_at(e, dtype.elementType, path, bad))
    elif not path:
        inside = bad(value)
    elif not isinstance(dtype, T.StructType) or path[0] not in dtype.names:
        return F.lit(False)
    else:
        inside = _any_at(value[path[0]], dtype[path[0]].dataType, path[1:], bad)
    return F.coalesce(inside, F.lit(False))


def _page_problem(parsed: Column, keys: Column, page: T.StructType,
                  enums: Mapping[str, Sequence[str]]) -> Column:
    """Why a page is invalid, or NULL: bad JSON or a type mismatch, no
    ``studies``, unknown page-level keys (pages forbid extras), an unknown enum
    value, a full date that is none, a trial id without 11 characters, a point
    without latitude or longitude."""
    studies = parsed["studies"]
    study = page["studies"].dataType.elementType
    extra = list_size(F.array_except(keys, F.array(*[F.lit(k) for k in PAGE_KEYS])))

    def wrong(paths: Iterable[str], bad: Callable[[str], Callable[[Column], Column]]) -> Column:
        def one(s: Column) -> Column:
            out = F.lit(False)
            for p in paths:
                out = out | _any_at(s, study, p.split("."), bad(p))
            return out
        return F.coalesce(F.exists(studies, one), F.lit(False))

    unknown = wrong(enums, lambda p: lambda v: v.isNotNull() & ~v.isin(list(enums[p])))
    no_date = wrong(FULL_DATES, lambda _: lambda v: v.isNotNull() & strict_date(v.cast("string")).isNull())
    bad_id = wrong([TRIAL_ID], lambda _: lambda v: F.length(v) != 11)
    no_point = wrong([POINTS], lambda _: lambda v: v.isNotNull() & (v["lat"].isNull() | v["lon"].isNull()))
    return (F.when(parsed[CORRUPT].isNotNull() | keys.isNull(), F.lit("malformed page or wrong type"))
             .when(studies.isNull(), F.lit("page has no studies"))
             .when(extra > 0, F.lit("unknown page field"))
             .when(unknown, F.lit("unknown enum value"))
             .when(no_date, F.lit("not a full date"))
             .when(bad_id, F.lit("trial id without 11 characters"))
             .when(no_point, F.lit("point without latitude or longitude")))


def parse_pages(pages: DataFrame, text_col: str = "value", keep: Sequence[str] = ("page_file",),
                enums: Mapping[str, Sequence[str]] = SCOPE_ENUMS) -> DataFrame:
    """Page texts to (keep..., parsed page, problem)."""
    parsed = F.from_json(text_col, f"{PAGE_DDL}, {CORRUPT} string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = pages.select(*keep, parsed.alias("page"), F.json_object_keys(text_col).alias("_keys"))
    return rows.select(*keep, "page", _page_problem(
        F.col("page"), F.col("_keys"), rows.schema["page"].dataType, enums).alias("problem"))


def read_page_files(spark: SparkSession, path: str, page_per_line: bool = False,
                    enums: Mapping[str, Sequence[str]] = SCOPE_ENUMS) -> DataFrame:
    """One row per page: (page_file, parsed page, problem)."""
    return parse_pages(page_texts(spark, path, page_per_line), enums=enums)


def page_texts(spark: SparkSession, path: str, page_per_line: bool = False) -> DataFrame:
    """One row per page: (page_file, value).

    Pages are one per file by default (read whole); ``page_per_line`` reads
    files of JSON lines with one page per line, ``page_file`` then carrying the
    line's place so the order stays page order. A line's place depends on how
    the scan split the files, so the lines are stored once with it, in the
    shared checkpoint folder; later reads see the same places whatever the
    cluster's size.
    """
    if page_per_line:
        # (file, split start, position in task) orders lines even when a file
        # is split and its splits are packed into tasks out of byte order.
        raw = spark.read.text(path).select(
            F.col("_metadata.file_path").alias("_f"),
            F.col("_metadata.file_block_start").alias("_b"), "value")
        checkpoint_dir(spark)
        return raw.select(F.format_string("%s#%015d#%019d", "_f", "_b",
                                          F.monotonically_increasing_id()).alias("page_file"),
                          "value").checkpoint()
    return spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("page_file"), F.col("value"))


def single_studies(pages: DataFrame, text_col: str = "value", keep: Sequence[str] = ("page_file",),
                   enums: Mapping[str, Sequence[str]] = SCOPE_ENUMS) -> DataFrame:
    """Page texts to one row per study: (keep..., pos, study, problem).

    A page's list is read as VARIANT values, which hold any JSON, and each is
    checked by itself, so a bad study costs its own row and not its page. A page
    that is no JSON object, has no list, or has unknown fields is one row without
    a study.
    """
    outer = F.from_json(text_col, "studies array<variant>")
    listed = pages.select(*keep, F.col(text_col).alias("_text"), F.json_object_keys(text_col).alias("_keys"),
                          F.posexplode_outer(outer["studies"]).alias("pos", "_one"))
    extra = F.size(F.array_except("_keys", F.array(*[F.lit(k) for k in PAGE_KEYS])))
    whole = (F.when(F.col("_keys").isNull(), F.lit("malformed page or wrong type"))
              .when(~F.array_contains("_keys", "studies") | F.col("pos").isNull()
                    & (F.get_json_object("_text", "$.studies") != "[]"), F.lit("page has no studies"))
              .when(extra > 0, F.lit("unknown page field")))
    rows = listed.withColumn("_page", whole).where("pos IS NOT NULL OR _page IS NOT NULL")
    one = F.concat(F.lit('{"studies":['), F.to_json(F.col("_one")), F.lit("]}"))
    names = [*keep, "pos", "_page"]
    checked = parse_pages(rows.select(*names, one.alias("value")), keep=names, enums=enums)
    return checked.select(
        *keep, "pos", F.when(F.col("problem").isNull() & F.col("_page").isNull(),
                             F.get(F.col("page.studies"), F.lit(0))).alias("study"),
        F.coalesce("_page", "problem").alias("problem"))


def read_study_pages(spark: SparkSession, path: str, on_invalid: str = "fail",
                     page_per_line: bool = False,
                     enums: Mapping[str, Sequence[str]] = SCOPE_ENUMS) -> DataFrame:
    """All studies of all pages in page then list order: (page_file, pos, study).

    ``on_invalid="fail"`` (the reference's rule) fails the job on the first bad
    page through ``raise_error`` inside the plan, with no extra pass;
    ``"quarantine"`` drops bad pages here, ``"quarantine_study"`` bad studies
    only (see ``rejected_pages``).
    """
    if on_invalid == "quarantine_study":
        found = single_studies(page_texts(spark, path, page_per_line), enums=enums)
        return found.where("problem IS NULL").select("page_file", "pos", "study")
    return studies_of(read_page_files(spark, path, page_per_line, enums), on_invalid)


def studies_of(pages: DataFrame, on_invalid: str = "fail",
               keep: Sequence[str] = ("page_file",)) -> DataFrame:
    """Studies of parsed pages in list order: (keep..., pos, study)."""
    if on_invalid == "fail":
        pages = pages.where(F.when(F.col("problem").isNotNull(), F.raise_error(
            F.concat(F.lit("invalid registry page "), F.col(keep[0]).cast("string"), F.lit(": "),
                     F.col("problem")))).otherwise(F.lit(True)))
    elif on_invalid == "quarantine":
        pages = pages.where(F.col("problem").isNull())
    else:
        raise ValueError("on_invalid must be 'fail' or 'quarantine'")
    return pages.select(*keep, F.posexplode("page.studies").alias("pos", "study"))


def rejected_pages(spark: SparkSession, path: str, page_per_line: bool = False,
                   enums: Mapping[str, Sequence[str]] = SCOPE_ENUMS, by_study: bool = False) -> DataFrame:
    """What a quarantine set aside and why: pages, or with ``by_study`` single studies (``pos``)."""
    if by_study:
        found = single_studies(page_texts(spark, path, page_per_line), enums=enums)
        return found.where("problem IS NOT NULL").select("page_file", "pos", "problem")
    return (read_page_files(spark, path, page_per_line, enums).where(F.col("problem").isNotNull())
            .select("page_file", "problem"))


def page_counts(spark: SparkSession, path: str) -> DataFrame:
    """Scope size without rows: total of ``totalCount`` if given, else studies counted."""
    pages = read_page_files(spark, path)
    return pages.agg(F.coalesce(F.max("page.totalCount"),
                                F.sum(list_size("page.studies"))).alias("total_count"))
