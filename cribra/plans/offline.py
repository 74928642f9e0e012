"""Offline batch inference: requests out as a table, replies in as a table.

Instead of one HTTP call per trial from a thread pool, the pending trials are
written as JSON-lines requests (``custom_id`` = trial id), a batch-inference
service answers them outside Spark, and its reply file is read back, parsed
and committed to the attempt log in one append. Truncated replies yield a
retry file at twice the budget. Every step is a distributed job.

Reply lines are ``{"custom_id": ..., "response": <chat reply envelope>}``; the
envelope may also sit under ``response.body`` or be given as a JSON string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cribra.functions.text import is_throttled, list_size, validate_name
from cribra.operators import extract as E
from cribra.operators import pending as PD
from cribra.operators.bronze import dedupe_latest
from cribra.sources import tables as TB
from cribra.sources.tables import Warehouse


def pending_for(spark: SparkSession, wh: Warehouse, signature: str, limit: int | None = None,
                retry_failed: bool = False) -> DataFrame:
    TB.ensure_tables(spark, wh)
    attempts = TB.read_attempts(spark, wh)
    bronze = TB.read_bronze(spark, wh).select("nct_id", "eligibility")
    pending = PD.pending_trials(bronze, TB.done_view(attempts), TB.failures_view(attempts),
                                signature, retry_failed=retry_failed)
    return PD.pending_limited(pending, limit) if limit is not None else pending


def export_requests(spark: SparkSession, wh: Warehouse, signature: str, out_path: str, *,
                    batch: str, limit: int | None = None, retry_failed: bool = False) -> int:
    """Write one request line per pending trial; returns the number written.

    Whitespace-only prose needs no call: those trials are committed right away
    as ok, empty results under ``batch``.
    """
    validate_name(batch)
    pending = pending_for(spark, wh, signature, limit, retry_failed)
    blank = pending.where(~F.col("eligibility").rlike(r"\S"))
    TB.write_attempts(blank.select(
        "nct_id", F.lit(signature).alias("signature"), F.lit(batch).alias("batch"),
        F.monotonically_increasing_id().alias("seq"),
        F.array().cast(f"{E.CRITERIA_DDL}").alias("criteria"),
        F.lit(None).cast("string").alias("error"), F.current_timestamp().alias("at")), wh, batch)
    reqs = E.build_requests(pending.where(F.col("eligibility").rlike(r"\S")))
    lines = reqs.select(F.col("nct_id").alias("custom_id"), "max_tokens",
                        F.parse_json("request").alias("body"))
    lines.select(F.to_json(F.struct("custom_id", "max_tokens", "body")).alias("value")) \
         .write.mode("overwrite").option("compression", "gzip").text(out_path)
    return spark.read.text(out_path).count()


@dataclass(frozen=True)
class ImportResult:
    batch: str
    succeeded: int
    failed: int
    rate_limited: int
    truncated: int
    retries_written: int
    criteria: int


def _replies(spark: SparkSession, path: str) -> DataFrame:
    return reply_envelopes(spark.read.text(path))


def reply_envelopes(raw: DataFrame) -> DataFrame:
    """Reply lines (a ``value`` text column) to (nct_id, envelope)."""
    resp = F.coalesce(F.get_json_object("value", "$.response.body"),
                      F.get_json_object("value", "$.response"))
    # A response given as a JSON string holds the envelope as text.
    unquoted = F.when(F.try_parse_json(resp).isNotNull()
                      & (F.schema_of_variant(F.try_parse_json(resp)) == "STRING"),
                      F.try_variant_get(F.try_parse_json(resp), "$", "string")).otherwise(resp)
    return raw.select(F.get_json_object("value", "$.custom_id").alias("nct_id"),
                      unquoted.alias("envelope"))


def latest_replies(replies: DataFrame) -> DataFrame:
    """One reply per trial: the one created last, by the envelope's ``created`` time;
    replies of one time go by their text, so the choice never depends on the layout."""
    created = F.coalesce(F.get_json_object("envelope", "$.created").try_cast("long"), F.lit(0).cast("long"))
    rows = replies.where(F.col("nct_id").isNotNull()).withColumn("_created", created)
    return dedupe_latest(rows, ["nct_id"], ["_created", "envelope"]).drop("_created")


def due_retries(replies: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests of truncated replies that a further call at twice the budget may mend."""
    trunc = replies.where(F.col("error") == E.ERR_TRUNCATED).select(F.col("nct_id").alias("custom_id"))
    return E.truncation_retries(requests.join(trunc, "custom_id"))


def import_replies(spark: SparkSession, wh: Warehouse, signature: str, replies_path: str,
                   requests_path: str, *, batch: str, retry_path: str | None = None) -> ImportResult:
    """Parse a reply file into outcomes and commit them as one batch of the log.

    With ``retry_path`` the requests of truncated replies are written again with
    twice the budget (none when already at the ceiling). Such a call is not
    finished: it adds no attempt, and only the reply to its retry does. Without
    a retry path, or at the ceiling, a truncated reply is a failed attempt. The
    commit replaces the batch if it is imported again.
    """
    validate_name(batch)
    TB.ensure_tables(spark, wh)
    parsed = E.parse_replies(latest_replies(_replies(spark, replies_path)), keep=("nct_id",))
    again, retries = None, 0
    if retry_path is not None:
        reqs = spark.read.schema("custom_id string, max_tokens long, body string").json(requests_path)
        again = due_retries(parsed, reqs)
        parsed = parsed.join(again.select(F.col("custom_id").alias("nct_id")), "nct_id", "left_anti")
    log = parsed.select(
        "nct_id", F.lit(signature).alias("signature"), F.lit(batch).alias("batch"),
        F.monotonically_increasing_id().alias("seq"), "criteria",
        F.substring("error", 1, 500).alias("error"), F.current_timestamp().alias("at"))
    TB.write_attempts(log, wh, batch)

    committed = TB.read_attempts(spark, wh).where(
        (F.col("signature") == signature) & (F.col("batch") == batch))
    c = committed.agg(
        F.count_if(F.col("error").isNull()).alias("ok"),
        F.count_if(F.col("error").isNotNull()).alias("bad"),
        F.count_if(is_throttled("error") & F.col("error").isNotNull()).alias("thr"),
        F.count_if(F.col("error") == E.ERR_TRUNCATED).alias("trunc"),
        F.coalesce(F.sum(list_size("criteria")), F.lit(0)).alias("rows")).first()

    if again is not None:
        body = F.regexp_replace("body", r'"max_tokens":[0-9]+', F.concat(
            F.lit('"max_tokens":'), F.col("retry_tokens").cast("string")))
        again.select(F.to_json(F.struct("custom_id", F.col("retry_tokens").alias("max_tokens"),
                                        F.parse_json(body).alias("body"))).alias("value")) \
             .write.mode("overwrite").option("compression", "gzip").text(retry_path)
        retries = spark.read.text(retry_path).count()
    return ImportResult(batch, c["ok"], c["bad"], c["thr"], c["trunc"], retries, int(c["rows"]))
