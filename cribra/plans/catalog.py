"""Registered queries: each operator run over stand-in views of whole tables.

Keys follow the operator inventory. Every callable takes ``(spark, sf_dir)``
and returns a lazy DataFrame; computed columns carry the same names as their
DuckDB twins in ``cribra.plans.oracles``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cribra.functions import dates as D
from cribra.functions.ids import is_valid_nct, nct_from_number, padded
from cribra.functions.json_fns import content_signature, json_path
from cribra.functions.text import is_throttled, list_size, retry_budget, token_budget
from cribra.operators import bronze as B
from cribra.operators import extract as E
from cribra.operators import intervals as I
from cribra.operators import ordering as O
from cribra.operators import pending as PD
from cribra.operators import predicates as P
from cribra.operators import rules, silver
from cribra.operators import stats as ST
from cribra.operators import tallies as TL
from cribra.plans.runs import status_of
from cribra.schemas import ELIGIBILITY_JSON_PATH
from cribra.session import checkpoint_dir
from cribra.sources import keyed as K
from cribra.sources import pages as PG
from cribra.sources import standins as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the registered queries (ours).
POINT_ID = "NCT00000042"
SINCE = "2024-01-20"
SCOPE_TERM, SCOPE_TYPE, SCOPE_STATUSES = "the", "en", ("src1", "src3", "src5", "src7")
SCAN_LIMIT = 500
PENDING_LIMIT = 100
STOP_BATCH_SIZE = 2
REPLACE_LANG = "de"
REPLACE_BATCH = "silver-20260816T000000Z-0000"
STATUS_FILTER = ("O", "P")
ID_REQUEST = ("nct00000007", " NCT000000042 ", "NCT1", "nct 5", "NCT00000100", "X123")
GEO_CENTER, GEO_DISTANCE, GEO_UNIT = (10.0, 20.0), 1500.0, "km"
AGE_LO, AGE_HI = "18 Years", "30 Years"
DATE_FROM, DATE_TO = "1995-03-01", "1995-06-30"
RANGE_DAYS = 32
PROJECTION = ("protocolSection.identificationModule", "protocolSection.statusModule.overallStatus")


def register(name: str) -> Callable[[Query], Query]:
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# ---- flagship: built-in extraction ------------------------------------------

@register("rule_criteria")
def q_rule_criteria(spark: SparkSession, d: str) -> DataFrame:
    return rules.rule_criteria(S.bronze_docs(spark, d))


@register("kind_distribution")
def q_kind_distribution(spark: SparkSession, d: str) -> DataFrame:
    return silver.kind_distribution(rules.rule_criteria(S.bronze_docs(spark, d)))


# ---- Bronze -------------------------------------------------------------------

def _bronze_first(spark: SparkSession, d: str) -> DataFrame:
    return B.dedupe_latest(S.landing_first(spark, d), ["nct_id"], ["seq"]).select(
        "nct_id", "last_update_posted", "raw", "status")


def _merged(spark: SparkSession, d: str) -> DataFrame:
    # The second landing is about as large as the first, the shape of a full
    # pass: one full outer join (the keyed form suits small incremental batches).
    return B.merge_upsert(_bronze_first(spark, d), S.landing_second(spark, d), ["nct_id"], ["seq"],
                          strategy="full_outer")


@register("bronze_dedupe_latest")
def q_bronze_dedupe_latest(spark: SparkSession, d: str) -> DataFrame:
    return B.dedupe_latest(S.study_updates(spark, d), ["nct_id"], ["seq"]).select(
        "nct_id", "seq", "last_update_posted", "raw", "status")


# ---- Registry pages -----------------------------------------------------------------

@register("page_studies")
def q_page_studies(spark: SparkSession, d: str) -> DataFrame:
    pages = PG.parse_pages(S.registry_pages(spark, d), keep=("page_no",))
    return PG.studies_of(pages, "quarantine", keep=("page_no",)).select(
        "page_no", F.col("pos").cast("long").alias("pos"),
        F.col("study.protocolSection.identificationModule.nctId").alias("nct_id"))


@register("study_columns")
def q_study_columns(spark: SparkSession, d: str) -> DataFrame:
    pages = PG.parse_pages(S.registry_pages(spark, d), keep=("page_no",))
    studies = PG.studies_of(pages, "quarantine", keep=("page_no",))
    return B.study_columns(studies, keep=("page_no",)).select(
        "page_no", "nct_id", "last_update_posted", "overall_status", "eligibility",
        (F.get_json_object("raw", ELIGIBILITY_JSON_PATH) == F.col("eligibility")).alias("raw_agrees"))


@register("page_problems")
def q_page_problems(spark: SparkSession, d: str) -> DataFrame:
    return PG.parse_pages(S.registry_pages(spark, d), keep=("page_no",)).select("page_no", "problem")


@register("bronze_merge")
def q_bronze_merge(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)


@register("bronze_merge_counts")
def q_bronze_merge_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.merge_counts(_merged(spark, d))


@register("bronze_change_feed")
def q_bronze_change_feed(spark: SparkSession, d: str) -> DataFrame:
    cols = ["last_update_posted", "raw", "status"]
    return B.change_feed(_bronze_first(spark, d), _merged(spark, d), ["nct_id"], cols)


# ---- Bronze as a keyed table: three landings, merged by three runs --------------

MERGE_SCHEMA = T.StructType([T.StructField("nct_id", T.StringType()), T.StructField("last_update_posted", T.DateType()),
                             T.StructField("raw", T.StringType()), T.StructField("status", T.StringType())])
MERGE_SPLIT = "2024-01-24 00:00:00"    # the second landing is merged in two parts
MERGE_FIELDS = (TL.Field("status", "status"), TL.Field("last_update_posted", "last_update_posted"),
                TL.Field("bytes", "raw", "bytes"))


def _new_table(spark: SparkSession, schema: T.StructType, buckets: int = 8) -> K.KeyedTable:
    root = f"{checkpoint_dir(spark).rstrip('/')}/keyed-{uuid.uuid4().hex}"
    return K.KeyedTable(root, schema, "nct_id", buckets)


def _three_merges(spark: SparkSession, d: str) -> K.KeyedTable:
    table = _new_table(spark, MERGE_SCHEMA)
    second, late = S.landing_second(spark, d), F.col("ts") >= F.lit(MERGE_SPLIT).cast("timestamp_ntz")
    for landing in (S.landing_first(spark, d), second.where(~late), second.where(late)):
        K.merge(spark, table, landing, ["seq"])
    return table


@register("bronze_keyed_merge")
def q_bronze_keyed_merge(spark: SparkSession, d: str) -> DataFrame:
    return K.read(spark, _three_merges(spark, d))


@register("bronze_version_changes")
def q_bronze_version_changes(spark: SparkSession, d: str) -> DataFrame:
    table = _three_merges(spark, d)
    return K.net_changes(K.changes(spark, table, after=1), "nct_id", table.values)


@register("bronze_tallies")
def q_bronze_tallies(spark: SparkSession, d: str) -> DataFrame:
    """Tallies after each of the three merges, from the changes."""
    table = _new_table(spark, MERGE_SCHEMA)
    for landing in (S.landing_first(spark, d), S.landing_second(spark, d)):
        K.merge(spark, table, landing, ["seq"])
        out = K.refresh_tallies(spark, table, MERGE_FIELDS)
    return out


@register("bronze_footer_stats")
def q_bronze_footer_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows and newest update of Bronze after three merges, from the files' footers."""
    return K.footer_stats(spark, _three_merges(spark, d), "last_update_posted")


@register("bronze_point_read")
def q_bronze_point_read(spark: SparkSession, d: str) -> DataFrame:
    """One study of all documents as a keyed table: its bucket's files alone are opened."""
    docs = S.bronze_docs(spark, d).select("nct_id", "eligibility", "lang", "source")
    table = _new_table(spark, docs.schema)
    K.merge(spark, table, docs)
    return K.read_key(spark, table, POINT_ID)


@register("study_problems")
def q_study_problems(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose bad studies are set aside one by one."""
    found = PG.single_studies(S.registry_pages(spark, d), keep=("page_no",))
    return found.select("page_no", F.col("pos").cast("long").alias("pos"),
                        F.col("study.protocolSection.identificationModule.nctId").alias("nct_id"), "problem")


@register("bronze_count")
def q_bronze_count(spark: SparkSession, d: str) -> DataFrame:
    return B.bronze_count(B.dedupe_latest(S.study_updates(spark, d), ["nct_id"], ["seq"]))


@register("bronze_max_update")
def q_bronze_max_update(spark: SparkSession, d: str) -> DataFrame:
    return B.bronze_max_update(B.dedupe_latest(S.study_updates(spark, d), ["nct_id"], ["seq"]))


@register("bronze_skipped_rows")
def q_bronze_skipped_rows(spark: SparkSession, d: str) -> DataFrame:
    # An error event carries no study: its id is missing on the page.
    u = S.study_updates(spark, d)
    page = u.select(F.when(F.col("status") != "error", F.col("nct_id")).alias("nct_id"))
    return B.id_presence_counts(page)


@register("limited_scan")
def q_limited_scan(spark: SparkSession, d: str) -> DataFrame:
    return O.first_n(S.study_updates(spark, d), ["seq"], SCAN_LIMIT).select("nct_id", "seq", "status")


@register("study_by_id")
def q_study_by_id(spark: SparkSession, d: str) -> DataFrame:
    return B.fetch_study(S.bronze_docs(spark, d), POINT_ID).select("nct_id", "eligibility", "lang", "source")


@register("json_path_value")
def q_json_path_value(spark: SparkSession, d: str) -> DataFrame:
    raw = S.bronze_raw(spark, d)
    return raw.select("nct_id", json_path("raw", ELIGIBILITY_JSON_PATH).alias("eligibility"))


@register("scope_filter")
def q_scope_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = S.bronze_docs(spark, d).withColumn("terms", F.split("eligibility", " ", -1))
    return P.scope_filter(docs, "terms", "lang", "source", term=SCOPE_TERM, study_type=SCOPE_TYPE,
                          statuses=SCOPE_STATUSES, ancestor_field=None).select(
        "nct_id", "lang", "source")


@register("scope_count")
def q_scope_count(spark: SparkSession, d: str) -> DataFrame:
    return P.scope_count(q_scope_filter(spark, d))


@register("updated_since")
def q_updated_since(spark: SparkSession, d: str) -> DataFrame:
    return P.updated_since(S.study_updates(spark, d), "last_update_posted", SINCE).select(
        "nct_id", "seq", "last_update_posted")


@register("custom_predicate")
def q_custom_predicate(spark: SparkSession, d: str) -> DataFrame:
    pred = F.col("n_chars").between(500, 2000) & (F.col("lang") == "de")
    return P.custom_filter(S.bronze_docs(spark, d), pred).select("nct_id", "n_chars")


@register("valid_ids")
def q_valid_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents")
    cand = (F.when(F.col("lang") == "en", nct_from_number("doc_id"))
             .when(F.col("lang") == "fr", F.concat(F.lit("NCT"), F.col("doc_id").cast("string")))
             .when(F.col("lang") == "de", F.concat(F.lit("nct"), padded(F.col("doc_id"), 8)))
             .otherwise(F.concat(F.lit("NCT"), padded(F.col("doc_id"), 9))))
    return docs.select("doc_id", cand.alias("candidate")).withColumn("valid", is_valid_nct("candidate"))


@register("strict_date")
def q_strict_date(spark: SparkSession, d: str) -> DataFrame:
    ev = S.table(spark, d, "events")
    text = (F.when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd"))
             .when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM"))
             .when(F.col("event_type") == "signup", F.lit("not-a-date"))
             .when(F.col("event_type") == "purchase",
                   F.concat(F.lit("2024-02-"), F.lpad(F.dayofmonth("ts").cast("string"), 2, "0")))
             .otherwise(F.lit("")))
    return ev.select("event_id", text.alias("date_text")).withColumn(
        "parsed", D.strict_date("date_text"))


# ---- run ledger ------------------------------------------------------------------

@register("safe_watermark")
def q_safe_watermark(spark: SparkSession, d: str) -> DataFrame:
    return B.safe_watermark(S.runs_ledger(spark, d))


@register("run_watermark")
def q_run_watermark(spark: SparkSession, d: str) -> DataFrame:
    return S.runs_ledger(spark, d).select("run_id", "mode", "studies_written", "watermark", "complete")


# ---- Silver and pending ------------------------------------------------------------

@register("silver_criteria_rows")
def q_silver_criteria_rows(spark: SparkSession, d: str) -> DataFrame:
    log = S.attempt_log(spark, d)
    outcomes = log.select("nct_id", F.when(F.col("error").isNull(), rules.extract_criteria(
        F.col("eligibility"))).alias("criteria"))
    return silver.outcomes_to_rows(outcomes, S.CURRENT_SIGNATURE)


@register("signature_scope")
def q_signature_scope(spark: SparkSession, d: str) -> DataFrame:
    cur = S.silver_table(spark, d).where(F.col("signature") == S.CURRENT_SIGNATURE)
    return cur.groupBy("nct_id").agg(F.count(F.lit(1)).alias("criteria"))


@register("distinct_trials")
def q_distinct_trials(spark: SparkSession, d: str) -> DataFrame:
    return S.silver_current(spark, d).select("nct_id").distinct()


@register("batch_assignment")
def q_batch_assignment(spark: SparkSession, d: str) -> DataFrame:
    return S.outcomes(spark, d, with_batch=True).select("nct_id", "batch_index", "batch")


@register("batch_counts")
def q_batch_counts(spark: SparkSession, d: str) -> DataFrame:
    return silver.batch_counts(S.silver_current(spark, d, with_batch=True))


@register("staging_strings")
def q_staging_strings(spark: SparkSession, d: str) -> DataFrame:
    rows = rules.rule_criteria(S.bronze_docs(spark, d)).select(
        "nct_id", "ordinal", "is_exclusion")
    staged = silver.to_staging_strings(rows).select(
        "nct_id", F.col("ordinal").alias("ordinal_text"), F.col("is_exclusion").alias("is_exclusion_text"),
        "ordinal", "is_exclusion")
    typed = silver.from_staging_strings(staged)
    return typed.withColumnsRenamed({"ordinal": "ordinal_int", "is_exclusion": "is_exclusion_bool"})


def _pending(spark: SparkSession, d: str, retry_failed: bool) -> DataFrame:
    return PD.pending_trials(S.bronze_docs(spark, d), S.done_trials(spark, d),
                             S.failures_cleared(spark, d), S.CURRENT_SIGNATURE,
                             retry_failed=retry_failed)


@register("pending_trials")
def q_pending_trials(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d, False).select("nct_id")


@register("pending_retry_failed")
def q_pending_retry_failed(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d, True).select("nct_id")


@register("pending_limited")
def q_pending_limited(spark: SparkSession, d: str) -> DataFrame:
    return PD.pending_limited(_pending(spark, d, False), PENDING_LIMIT).select("nct_id")


@register("silver_replace")
def q_silver_replace(spark: SparkSession, d: str) -> DataFrame:
    docs = S.bronze_docs(spark, d).where(F.col("lang") == REPLACE_LANG)
    batch = rules.rule_criteria(docs).select(
        "nct_id", F.lit(S.CURRENT_SIGNATURE).alias("signature"), "ordinal", "criterion_id",
        "text", "kind", "is_exclusion", F.lit(REPLACE_BATCH).alias("batch"))
    return silver.replace_by_key(S.silver_table(spark, d, with_batch=True), batch,
                                 ["nct_id", "signature"]).select(
        "nct_id", "signature", "ordinal", "kind", "is_exclusion", "batch")


@register("failures_accumulate")
def q_failures_accumulate(spark: SparkSession, d: str) -> DataFrame:
    return S.failures_after(spark, d)


@register("failures_cleared")
def q_failures_cleared(spark: SparkSession, d: str) -> DataFrame:
    return S.failures_cleared(spark, d)


@register("outcome_classes")
def q_outcome_classes(spark: SparkSession, d: str) -> DataFrame:
    parsed = E.parse_replies(S.replies(spark, d), keep=("conv_id", "turn"))
    return parsed.select("conv_id", "turn", "outcome",
                         list_size("criteria").alias("n_criteria"),
                         is_throttled("error").alias("throttled"))


@register("run_counters")
def q_run_counters(spark: SparkSession, d: str) -> DataFrame:
    return silver.run_counters(S.attempt_log(spark, d))


@register("silver_stats")
def q_silver_stats(spark: SparkSession, d: str) -> DataFrame:
    return silver.silver_stats(S.silver_table(spark, d), S.failures_cleared(spark, d),
                               S.bronze_docs(spark, d), S.CURRENT_SIGNATURE)


@register("run_result")
def q_run_result(spark: SparkSession, d: str) -> DataFrame:
    # Criteria written by the run = the Silver rows under its signature.
    st = silver.silver_stats(S.silver_table(spark, d), S.failures_cleared(spark, d),
                             S.bronze_docs(spark, d), S.CURRENT_SIGNATURE)
    return silver.run_result(silver.run_counters(S.attempt_log(spark, d)), st, S.CURRENT_SIGNATURE)


@register("status")
def q_status(spark: SparkSession, d: str) -> DataFrame:
    return status_of(B.dedupe_latest(S.study_updates(spark, d), ["nct_id"], ["seq"]), S.bronze_docs(spark, d),
                     S.silver_table(spark, d), S.failures_cleared(spark, d), S.runs_ledger(spark, d),
                     S.CURRENT_SIGNATURE).drop("signature")


@register("throttle_stop")
def q_throttle_stop(spark: SparkSession, d: str) -> DataFrame:
    log = O.chunk_index(S.attempt_log(spark, d).select("nct_id", "error"), ["nct_id"], STOP_BATCH_SIZE)
    return E.throttle_stop(log)


# ---- requests and replies ---------------------------------------------------------------

@register("extraction_requests")
def q_extraction_requests(spark: SparkSession, d: str) -> DataFrame:
    return E.build_requests(_pending(spark, d, False))


@register("reply_text")
def q_reply_text(spark: SparkSession, d: str) -> DataFrame:
    r = S.replies(spark, d)
    return r.select("conv_id", "turn", E.reply_text(F.col("envelope")).alias("r")).select(
        "conv_id", "turn", F.col("r.text").alias("reply_text"), F.col("r.error").alias("error"))


@register("truncation_retries")
def q_truncation_retries(spark: SparkSession, d: str) -> DataFrame:
    # Only a reply that stopped on length can be truncated: parse those alone.
    replies = S.replies(spark, d).where(E.finish_reason(F.col("envelope")) == "length")
    parsed = E.parse_replies(replies, keep=("conv_id", "turn"))
    trunc = parsed.where(F.col("outcome") == "truncated").join(
        S.request_texts(spark, d), ["conv_id", "turn"])
    trunc = trunc.select("conv_id", "turn", token_budget("request_text").alias("max_tokens"))
    return E.truncation_retries(trunc)


@register("blank_results")
def q_blank_results(spark: SparkSession, d: str) -> DataFrame:
    return E.blank_results(S.bronze_docs(spark, d))


@register("token_budget")
def q_token_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = S.bronze_docs(spark, d).select("nct_id", token_budget("eligibility").alias("max_tokens"))
    r = retry_budget("max_tokens")
    return docs.withColumn("retry_tokens", F.when(r > F.col("max_tokens"), r))


@register("content_signature")
def q_content_signature(spark: SparkSession, d: str) -> DataFrame:
    docs = S.bronze_docs(spark, d)
    return docs.select("nct_id", content_signature("eligibility", "lang", "source").alias("signature"))


# ---- contract statistics ------------------------------------------------------------------

@register("stats_enum")
def q_stats_enum(spark: SparkSession, d: str) -> DataFrame:
    return ST.enum_stats(S.table(spark, d, "customer"), "c_custkey", "c_mktsegment")


@register("stats_string")
def q_stats_string(spark: SparkSession, d: str) -> DataFrame:
    return ST.string_stats(S.table(spark, d, "part"), "p_partkey", "p_type")


@register("stats_date")
def q_stats_date(spark: SparkSession, d: str) -> DataFrame:
    return ST.date_stats(S.registry_studies(spark, d), "start_text")


@register("stats_numeric")
def q_stats_numeric(spark: SparkSession, d: str) -> DataFrame:
    a = ST.numeric_stats(S.table(spark, d, "orders"), "o_totalprice")
    b = ST.numeric_stats(S.table(spark, d, "part"), "p_size")
    return a.unionByName(b)


@register("stats_boolean")
def q_stats_boolean(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents").select("doc_id")
    lab = S.table(spark, d, "labels")
    j = docs.join(lab, "doc_id", "left").select(
        (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic"))
    return ST.boolean_stats(j, ["quality", "toxic"])


@register("list_sizes")
def q_list_sizes(spark: SparkSession, d: str) -> DataFrame:
    # A list per order: its line items. The size is a count per key (partial
    # aggregation map-side), so a huge list is never materialised as an array.
    sizes = S.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("size"))
    return ST.list_size_stats(sizes)


@register("size_stats")
def q_size_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = S.bronze_docs(spark, d).select(
        "nct_id", F.octet_length("eligibility").cast("long").alias("bytes"))
    return ST.size_stats(docs, "nct_id")


# ---- contract filters, sort and projection ----------------------------------------------

@register("filter_status")
def q_filter_status(spark: SparkSession, d: str) -> DataFrame:
    return P.filter_status(S.registry_studies(spark, d), "overall_status", STATUS_FILTER).select(
        "nct_id", "overall_status")


@register("filter_ids")
def q_filter_ids(spark: SparkSession, d: str) -> DataFrame:
    return P.filter_ids(S.registry_studies(spark, d), "nct_id", "aliases", ID_REQUEST).select("nct_id")


@register("filter_geo")
def q_filter_geo(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = GEO_CENTER
    return P.filter_geo(S.points(spark, d), "locations", lat, lon, GEO_DISTANCE, GEO_UNIT).select("vec_id")


@register("geo_index")
def q_geo_index(spark: SparkSession, d: str) -> DataFrame:
    """The same search over all locations indexed by grid cell."""
    lat, lon = GEO_CENTER
    path = f"{checkpoint_dir(spark).rstrip('/')}/cells-{uuid.uuid4().hex}"
    cells = P.location_cells(S.points(spark, d), "vec_id", "locations")
    P.write_location_cells(cells, path)
    return P.near_by_cells(spark.read.schema(cells.schema).parquet(path), "vec_id", lat, lon, GEO_DISTANCE, GEO_UNIT)


@register("filter_age")
def q_filter_age(spark: SparkSession, d: str) -> DataFrame:
    return P.filter_age(S.part_ages(spark, d), "minimum_age", "maximum_age", AGE_LO, AGE_HI).select(
        "p_partkey", "minimum_age", "maximum_age")


@register("filter_partial_date")
def q_filter_partial_date(spark: SparkSession, d: str) -> DataFrame:
    s = S.registry_studies(spark, d).select(
        "nct_id", "start_text", D.partial_date_lo("start_text").alias("start_lo"),
        D.partial_date_hi("start_text").alias("start_hi"))
    return P.filter_partial_date(s, "start_lo", "start_hi", DATE_FROM, DATE_TO)


@register("sort_studies")
def q_sort_studies(spark: SparkSession, d: str) -> DataFrame:
    s = S.registry_studies(spark, d)
    return O.sort_page(s, [("start_date", None), ("enrollment", None)], "nct_id", 100).select(
        "nct_id", "start_date", "enrollment", "position")


@register("sort_pages")
def q_sort_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first three pages, each found from the last token of the one before."""
    s = S.registry_studies(spark, d).withColumn(
        "enrollment", F.when(F.col("priority") != "5-LOW", F.col("enrollment")))
    return O.pages(s, [("overall_status", "desc"), ("enrollment", None)], "nct_id", 100, upto=3).select(
        "page", "nct_id", "overall_status", "enrollment")


@register("date_range_matches")
def q_date_range_matches(spark: SparkSession, d: str) -> DataFrame:
    """How many studies' partial start dates meet the days from each ship to each receipt date."""
    lo, hi = I.partial_date_days("start_text")
    studies = S.registry_studies(spark, d).select("nct_id", lo.alias("lo"), hi.alias("hi")).where("lo IS NOT NULL")
    day = [F.unix_date(F.col(c).cast("date")).cast("long") for c in ("s", "e")]
    asked = S.date_requests(spark, d).select("request", day[0].alias("from"), day[1].alias("to"))
    return (I.overlap_join(studies, asked, RANGE_DAYS, count="studies").groupBy("request")
            .agg(F.sum("studies").alias("studies")))


@register("age_range_matches")
def q_age_range_matches(spark: SparkSession, d: str) -> DataFrame:
    """How many studies are open to some age of each requested range; bounds may be missing."""
    ages = S.part_ages(spark, d).select("p_partkey", I.age_minutes("minimum_age").alias("lo"),
                                        I.age_minutes("maximum_age").alias("hi"))
    asked = S.age_requests(spark, d).select("request", I.age_minutes("lo_text").alias("from"),
                                            I.age_minutes("hi_text").alias("to"))
    return (I.overlap_join(ages, asked, 5 * 525_960, count="studies").groupBy("request")
            .agg(F.sum("studies").alias("studies")))


@register("project_fields")
def q_project_fields(spark: SparkSession, d: str) -> DataFrame:
    s = S.registry_studies(spark, d)
    nested = s.select(F.struct(
        F.struct(F.col("nct_id").alias("nctId"),
                 F.col("aliases").getItem(0).alias("orgStudyId")).alias("identificationModule"),
        F.struct(F.col("overall_status").alias("overallStatus"),
                 F.col("start_text").alias("startDate")).alias("statusModule"),
        F.struct(F.col("enrollment").alias("enrollmentCount")).alias("designModule"),
    ).alias("protocolSection"))
    return O.project_fields(nested, PROJECTION, flatten=True)
