"""Driver tables viewed in the shape of the trial tables.

The driver's parquet holds no trial data, so every registered query runs the
same operators over these views (each is a projection or a join of whole
tables; nothing is sampled or capped). The DuckDB twins of these views live
in ``cribra.plans.oracles`` so both sides read identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cribra.functions.ids import nct_from_number
from cribra.functions.json_fns import config_signature
from cribra.operators.rules import EXTRACTOR_MATERIAL

# Signatures of the built-in extractor now, and of an older taxonomy whose rows
# still sit in Silver and must count as absent.
CURRENT_SIGNATURE = config_signature(EXTRACTOR_MATERIAL)
LEGACY_SIGNATURE = config_signature({**EXTRACTOR_MATERIAL, "version": 0, "taxonomy": "nine kinds"})

# Parameters of the stand-in runs (ours).
RUN_TOKEN = "20260815T000000Z"
SPLIT_TS = "2024-01-16 00:00:00"   # events before: the first landing; after: the second
BATCH_SIZE = 100                    # extraction batch size (reference default)
THROTTLE_MSG = "HTTP 429"
SCHEMA_MSG = "reply:criteria"


_TABLES: dict[tuple[int, str], DataFrame] = {}
_VIEWS: dict[tuple, DataFrame] = {}


def _view(fn):  # noqa: ANN001, ANN202 - decorator
    """Build a stand-in view once per session, path and arguments.

    Only the lazy plan is shared (no data is cached): every action still reads
    and computes everything, but a query that uses a view in several branches
    does not rebuild and re-analyse it each time.
    """
    import functools

    @functools.wraps(fn)
    def wrapper(spark: SparkSession, sf_dir: str, *args, **kwargs):  # noqa: ANN202
        key = (id(spark), sf_dir, fn.__name__, args, tuple(sorted(kwargs.items())))
        df = _VIEWS.get(key)
        if df is None or df.sparkSession is not spark:
            df = fn(spark, sf_dir, *args, **kwargs)
            _VIEWS[key] = df
        return df
    return wrapper


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table as a DataFrame, resolved once per session and path.

    A DataFrame is an immutable plan, so the stand-ins share one scan
    definition instead of listing files and reading parquet footers again for
    every branch of a query.
    """
    path = f"{sf_dir}/{name}.parquet"
    key = (id(spark), path)
    df = _TABLES.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _TABLES[key] = df
    return df


@_view
def bronze_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze with prose: one study per document, eligibility = text."""
    return table(spark, sf_dir, "documents").select(
        nct_from_number("doc_id").alias("nct_id"),
        F.col("doc_id"),
        F.col("text").alias("eligibility"),
        F.col("lang"),
        F.col("source"),
        F.col("n_chars"),
    )


PAGE_STUDIES = 4  # ours: studies of a stand-in page


@_view
def registry_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry pages as JSON text: ``PAGE_STUDIES`` documents each, by id.

    A few documents stand for faults: Spanish ones from src1 have an unknown
    status, French ones from src2 a date that is none, German ones from src3 a
    short trial id, English ones from src4 a wrong type.
    """
    def fault(lang: str, source: str):  # noqa: ANN202
        return (F.col("lang") == lang) & (F.col("source") == source)

    ident = F.when(fault("de", "src3"), F.lit("NCT1")).otherwise(F.col("nct_id"))
    status = F.when(fault("es", "src1"), F.lit("MAYBE")).when(
        F.col("doc_id") % 3 == 0, F.lit("COMPLETED")).otherwise(F.lit("RECRUITING"))
    posted = F.when(fault("fr", "src2"), F.lit("garbage")).when(
        F.col("doc_id") % 5 != 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"),
                                                           (F.col("doc_id") % 700).cast("int")), "yyyy-MM-dd"))
    study = F.to_json(F.struct(F.struct(
        F.struct(ident.alias("nctId")).alias("identificationModule"),
        F.struct(status.alias("overallStatus"),
                 F.when(posted.isNotNull(), F.struct(posted.alias("date"))).alias("lastUpdatePostDateStruct"),
                 ).alias("statusModule"),
        F.struct(F.col("eligibility").alias("eligibilityCriteria")).alias("eligibilityModule"),
    ).alias("protocolSection")))
    study = F.when(fault("en", "src4"), F.lit('{"protocolSection":5}')).otherwise(study)
    rows = bronze_docs(spark, sf_dir).select(
        F.floor(F.col("doc_id") / F.lit(PAGE_STUDIES)).cast("long").alias("page_no"), "doc_id", study.alias("s"))
    # A page gathers at most PAGE_STUDIES documents.
    listed = rows.groupBy("page_no").agg(F.sort_array(F.collect_list(F.struct("doc_id", "s"))).alias("l"))
    return listed.select("page_no", F.concat(F.lit('{"studies":['), F.array_join(
        F.transform("l", lambda x: x["s"]), ","), F.lit("]}")).alias("value"))


@_view
def study_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry page stream with repeated keys: one event = one study version.

    Arrival order is ``event_id``; the payload is the ``props`` JSON.
    """
    return table(spark, sf_dir, "events").select(
        nct_from_number("user_id").alias("nct_id"),
        F.col("event_id").alias("seq"),
        F.col("ts"),
        F.col("ts").cast("date").alias("last_update_posted"),
        F.col("props").alias("raw"),
        F.col("event_type").alias("status"),
    )


@_view
def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extraction attempt per labelled document.

    toxic = 1 stands for a throttled call, quality = 1 for a success, the rest
    for a schema-invalid reply.
    """
    labels = table(spark, sf_dir, "labels")
    docs = bronze_docs(spark, sf_dir)
    return docs.join(labels, "doc_id").select(
        "nct_id", "doc_id", "eligibility", "lang",
        F.when(F.col("toxic") == 1, F.lit(THROTTLE_MSG))
         .when(F.col("quality") == 1, F.lit(None).cast("string"))
         .otherwise(F.lit(SCHEMA_MSG)).alias("error"),
    )


@_view
def error_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated failures: every ``error`` event is one failed attempt of a trial."""
    return table(spark, sf_dir, "events").where(F.col("event_type") == "error").select(
        nct_from_number("user_id").alias("nct_id"),
        F.col("event_id").alias("seq"),
        F.col("ts"),
        F.concat(F.lit("upstream error "), F.col("props")).alias("error"),
    )


# ---- Bronze side ------------------------------------------------------------

@_view
def bronze_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze rows with the study document as JSON text (``raw``)."""
    docs = bronze_docs(spark, sf_dir)
    study = F.struct(F.struct(
        F.struct(F.col("nct_id").alias("nctId")).alias("identificationModule"),
        F.struct(F.col("eligibility").alias("eligibilityCriteria")).alias("eligibilityModule"),
    ).alias("protocolSection"))
    return docs.select("nct_id", F.to_json(study).alias("raw"))


@_view
def landing_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study_updates(spark, sf_dir).where(F.col("ts") < F.lit(SPLIT_TS).cast("timestamp_ntz"))


@_view
def landing_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study_updates(spark, sf_dir).where(F.col("ts") >= F.lit(SPLIT_TS).cast("timestamp_ntz"))


@_view
def runs_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run ledger: one backfill run per landing day.

    A run is complete when its last event is not an error; a complete run's
    watermark is the newest date in Bronze when it finished. The ledger has one
    row per run, so the running windows below work on a small table.
    """
    from pyspark.sql import Window

    from cribra.operators.bronze import finish_rows

    u = study_updates(spark, sf_dir)
    days = u.groupBy(F.col("last_update_posted").alias("day")).agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("finished_at"),
        F.count(F.lit(1)).alias("studies_written"),
        F.max("last_update_posted").alias("_max_date"),
        F.max_by("status", "seq").alias("_last_status"),
    )
    complete = F.col("_last_status") != "error"
    upto = Window.orderBy("started_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("started_at").rowsBetween(Window.unboundedPreceding, -1)
    prior_complete = F.max(F.when(complete, F.lit(1))).over(before)
    started = days.select(
        F.concat(F.lit("backfill-"), F.date_format("day", "yyyyMMdd")).alias("run_id"),
        F.when(prior_complete == 1, F.lit("incremental")).otherwise(F.lit("full")).alias("mode"),
        "started_at", "finished_at", "studies_written", complete.alias("_complete"),
        F.max("_max_date").over(upto).alias("_newest"))
    return finish_rows(started, F.col("finished_at"), F.col("studies_written"), F.col("_complete"), F.col("_newest"))


# ---- Silver side ------------------------------------------------------------

def outcomes(spark: SparkSession, sf_dir: str, with_batch: bool = False) -> DataFrame:
    """Attempt log with results: ok attempts carry the built-in extractor's criteria.

    ``with_batch`` adds each attempt's batch (runs of BATCH_SIZE in id order);
    only queries that report batches pay for the exact ranking.
    """
    from cribra.functions.text import numbered
    from cribra.operators.ordering import chunk_index
    from cribra.operators.rules import extract_criteria

    log = attempt_log(spark, sf_dir)
    cols = ["nct_id", "lang", "eligibility", "error"]
    if with_batch:
        log = chunk_index(log, ["nct_id"], BATCH_SIZE, stable=True)
        log = log.withColumn("batch", numbered(F.lit(f"silver-{RUN_TOKEN}"), F.col("batch_index")))
        cols += ["batch_index", "batch"]
    return log.select(
        *cols,
        F.when(F.col("error").isNull(), extract_criteria(F.col("eligibility"))).alias("criteria"),
    )


def silver_current(spark: SparkSession, sf_dir: str, with_batch: bool = False) -> DataFrame:
    """Silver rows of the ok attempts under the current signature.

    Equal to exploding the ok outcomes' criteria; built with the exploded form
    of the extractor, whose rules run in codegen.
    """
    from cribra.operators.rules import rule_criteria

    log = attempt_log(spark, sf_dir)
    keep: tuple[str, ...] = ()
    if with_batch:
        from cribra.functions.text import numbered
        from cribra.operators.ordering import chunk_index
        log = chunk_index(log, ["nct_id"], BATCH_SIZE, stable=True)
        log = log.withColumn("batch", numbered(F.lit(f"silver-{RUN_TOKEN}"), F.col("batch_index")))
        keep = ("batch",)
    ok = log.where(F.col("error").isNull())
    rows = rule_criteria(ok, keep=keep)
    return rows.select("nct_id", F.lit(CURRENT_SIGNATURE).alias("signature"), "ordinal",
                       "criterion_id", "text", "kind", "is_exclusion", *keep)


def silver_table(spark: SparkSession, sf_dir: str, with_batch: bool = False) -> DataFrame:
    legacy = silver_legacy(spark, sf_dir)
    if not with_batch:
        legacy = legacy.drop("batch")
    return legacy.unionByName(silver_current(spark, sf_dir, with_batch))


def line_criteria(docs: DataFrame) -> DataFrame:
    """Criteria rows as non-blank lines of the prose (an older, plain extractor)."""
    from cribra.functions.text import has_text
    lines = F.filter(F.split(F.col("eligibility"), "\n", -1), lambda l: has_text(l))
    return docs.select("nct_id", F.posexplode(lines).alias("ordinal", "text")).select(
        "nct_id", F.col("ordinal").cast("int").alias("ordinal"),
        F.concat(F.lit("c-"), F.col("ordinal").cast("string")).alias("criterion_id"),
        "text", F.lit("other").alias("kind"), F.lit(False).alias("is_exclusion"))


@_view
def silver_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an earlier full pass by the plain line extractor (another signature)."""
    rows = line_criteria(bronze_docs(spark, sf_dir))
    return rows.select("nct_id", F.lit(LEGACY_SIGNATURE).alias("signature"), "ordinal",
                       "criterion_id", "text", "kind", "is_exclusion",
                       F.lit("legacy-0000").alias("batch"))


@_view
def failures_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure counters after the error events (several attempts per trial)."""
    from cribra.operators.silver import accumulate_failures
    return accumulate_failures(None, error_outcomes(spark, sf_dir), CURRENT_SIGNATURE,
                               order_col="seq")


@_view
def failures_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters after the labelled batch: schema errors count, throttling does not."""
    from cribra.operators.silver import accumulate_failures
    return accumulate_failures(failures_before(spark, sf_dir), attempt_log(spark, sf_dir),
                               CURRENT_SIGNATURE)


@_view
def failures_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cribra.operators.silver import clear_failures
    return clear_failures(failures_after(spark, sf_dir), attempt_log(spark, sf_dir),
                          CURRENT_SIGNATURE)


@_view
def done_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials with a successful attempt under the current signature."""
    return (attempt_log(spark, sf_dir).where(F.col("error").isNull())
            .select("nct_id", F.lit(CURRENT_SIGNATURE).alias("signature")))


# ---- Model replies ----------------------------------------------------------

REPLY_SHAPES = 6  # string content, typed parts, truncated, prose, number, no choices


@_view
def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns wrapped as model reply envelopes of six shapes."""
    from cribra.functions.text import has_text

    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda l: has_text(l))
    crit = F.to_json(F.struct(F.transform(lines, lambda l, i: F.struct(
        F.concat(F.lit("c-"), i.cast("string")).alias("criterion_id"),
        l.alias("text"), F.lit("other").alias("kind"),
        F.lit(False).alias("is_exclusion"))).alias("criteria")))
    shape = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(REPLY_SHAPES))
    msg = lambda content: F.to_json(F.struct(F.array(F.struct(
        F.struct(F.lit("assistant").alias("role"), content.alias("content")).alias("message"),
        F.lit("stop").alias("finish_reason"))).alias("choices")))
    parts = F.array(F.struct(F.lit("reasoning").alias("type"), F.lit("thinking").alias("text")),
                    F.struct(F.lit("text").alias("type"), crit.alias("text")))
    truncated = F.to_json(F.struct(F.array(F.struct(
        F.struct(F.lit("{").alias("content")).alias("message"),
        F.lit("length").alias("finish_reason"))).alias("choices")))
    env = (F.when(shape == 0, msg(crit))
            .when(shape == 1, msg(parts))
            .when(shape == 2, truncated)
            .when(shape == 3, msg(F.col("text")))
            .when(shape == 4, msg(F.lit(42)))
            .otherwise(F.lit('{"nope":true}')))
    return c.select("conv_id", "turn", env.alias("envelope"))


@_view
def request_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user turn each assistant turn answered (the request prose)."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("request_text"))


# ---- Registry fields for the contract filters and statistics ---------------

@_view
def registry_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as studies: status, priority, start date (full and partial), size."""
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("date")
    start_text = (F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(start, "yyyy"))
                   .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(start, "yyyy-MM"))
                   .otherwise(F.date_format(start, "yyyy-MM-dd")))
    return o.select(
        nct_from_number("o_orderkey").alias("nct_id"),
        F.col("o_orderkey"),
        F.col("o_orderstatus").alias("overall_status"),
        F.col("o_orderpriority").alias("priority"),
        start.alias("start_date"),
        start_text.alias("start_text"),
        F.col("o_totalprice").alias("enrollment"),
        F.array(nct_from_number("o_custkey")).alias("aliases"),
    )


@_view
def part_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as studies with minimum and maximum age texts."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    min_age = F.when(F.pmod("p_size", F.lit(3)) == 0, F.concat(size, F.lit(" Months"))) \
               .otherwise(F.concat(size, F.lit(" Years")))
    max_age = F.when(F.col("p_brand").endswith("1"), F.lit(None).cast("string")) \
               .otherwise(F.concat((F.col("p_size") + 30).cast("string"), F.lit(" Years")))
    return p.select("p_partkey", min_age.alias("minimum_age"), max_age.alias("maximum_age"))


@_view
def date_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as requests for a range of days, some without an end."""
    k = F.col("s_suppkey")
    start = F.date_add(F.lit("1992-01-01").cast("date"), (k * 37 % 2400).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        k.alias("request"), start.alias("s"),
        F.when(k % 10 != 0, F.date_add(start, (k % 45).cast("int"))).alias("e"))


@_view
def age_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as requests for a range of ages, some open at one end."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("request"),
        F.when(k % 7 != 0, F.concat((k % 60).cast("string"), F.lit(" Years"))).alias("lo_text"),
        F.when(k % 5 != 0, F.concat((k % 60 + k % 9).cast("string"), F.lit(" Years"))).alias("hi_text"))


@_view
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as studies with locations: consecutive dimension pairs as (lat, lon)."""
    from cribra.functions.text import list_size
    e = table(spark, sf_dir, "embeddings")
    n = F.floor(list_size("embedding") / 2).cast("int")
    idx = F.sequence(F.lit(0), n - 1)
    locs = F.transform(idx, lambda i: F.struct(
        (F.col("embedding")[i * 2].cast("double") * 90.0).alias("lat"),
        (F.col("embedding")[i * 2 + 1].cast("double") * 180.0).alias("lon")))
    return e.select("vec_id", locs.alias("locations"))
