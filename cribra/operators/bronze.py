"""Bronze: study columns, last-wins dedupe, idempotent upsert, change feed, run ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cribra.functions.dates import strict_date
from cribra.schemas import ELIGIBILITY_JSON_PATH, ELIGIBILITY_PATH, LAST_UPDATE_PATH

ACTION_COL = "merge_action"


def study_columns(studies: DataFrame, study_col: str = "study",
                  keep: Sequence[str] = ()) -> DataFrame:
    """Trial id, strict last-update date and the schema-normalised document.

    ``to_json`` drops NULL fields, and parsing with the fixed schema dropped
    unknown ones, so ``raw`` is the re-serialised study. The scope fields are
    kept as their own columns beside ``raw`` so later filters reach parquet
    instead of re-parsing JSON.
    """
    s = F.col(study_col)
    return studies.select(
        s.getField("protocolSection").getField("identificationModule")
         .getField("nctId").alias("nct_id"),
        strict_date(F.col(f"{study_col}.{LAST_UPDATE_PATH}")).alias("last_update_posted"),
        F.to_json(s).alias("raw"),
        F.col(f"{study_col}.protocolSection.statusModule.overallStatus").alias("overall_status"),
        F.col(f"{study_col}.protocolSection.designModule.studyType").alias("study_type"),
        F.col(f"{study_col}.derivedSection.conditionBrowseModule.ancestors").alias("ancestors"),
        F.col(f"{study_col}.{ELIGIBILITY_PATH}").alias("eligibility"),
        *keep,
    )



def columns_of_raw() -> list[Column]:
    """The typed columns beside ``raw``, for a reader that has only the document text."""
    def at(path: str) -> Column:
        return F.get_json_object("raw", path)

    return [
        at(ELIGIBILITY_JSON_PATH).alias("eligibility"),
        at("$.protocolSection.statusModule.overallStatus").alias("overall_status"),
        at("$.protocolSection.designModule.studyType").alias("study_type"),
        F.from_json(at("$.derivedSection.conditionBrowseModule.ancestors"),
                    "array<struct<id:string,term:string>>").alias("ancestors"),
    ]


def fetch_study(bronze: DataFrame, nct_id: str, id_col: str = "nct_id") -> DataFrame:
    """One study by trial id: an equality filter that reaches the parquet scan."""
    return bronze.where(F.col(id_col) == nct_id)


def drop_missing_ids(df: DataFrame, id_col: str = "nct_id") -> DataFrame:
    return df.where(F.col(id_col).isNotNull())


def id_presence_counts(df: DataFrame, id_col: str = "nct_id") -> DataFrame:
    """kept and skipped row counts of a batch (skipped = no id)."""
    return df.agg(F.count_if(F.col(id_col).isNotNull()).alias("kept_rows"),
                  F.count_if(F.col(id_col).isNull()).alias("skipped_rows"))


def dedupe_latest(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """One row per key: the last by arrival order (not by date).

    ``row_number() = 1`` lets Spark put a per-partition group limit before the
    shuffle, so a hot key sends one row per map task, not all its versions.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order_cols])
    return (df.withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") == 1).drop("_rn"))


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str],
                 order_cols: Sequence[str] = (), stamp_col: str | None = None,
                 strategy: str = "keyed", unique: bool = False, small: bool = False) -> DataFrame:
    """MERGE by key: matched rows take every source column, new keys are inserted.

    The source is deduplicated first (last by ``order_cols`` wins), so a key
    repeated in a batch can neither fail the merge nor insert twice. Without
    ``order_cols`` the largest row (by its other columns) wins. Running
    the same batch again yields the same table. Adds ``merge_action`` in
    (insert, update, keep); ``stamp_col`` gets the current time on written rows.

    Written as joins against the source's keys rather than one full outer
    join: the untouched target rows are a left anti join and the matched keys a
    left semi join, both with the (deduplicated) batch on the build side. When
    the batch is small, as in an incremental run, AQE broadcasts it and the
    target is scanned and written without being shuffled; a large batch falls
    back to sort-merge joins. ``strategy="full_outer"`` is one full outer join
    instead, the cheaper form when the batch is about as large as the target
    (a full pass). Both give the same rows. ``unique`` says that the source has
    one row per key, ``small`` that the caller has counted it and its keys may
    be broadcast.
    """
    if not order_cols:
        # No arrival order: the largest row of a key wins, so none is inserted twice.
        order_cols = [c for c in source.columns if c not in keys]
    src = source if unique else dedupe_latest(source, keys, order_cols)
    if strategy == "full_outer":
        return _merge_full_outer(target, src, keys, stamp_col)
    if strategy != "keyed":
        raise ValueError("strategy must be 'keyed' or 'full_outer'")
    value_cols = [c for c in target.columns if c not in keys and c != ACTION_COL]
    src_cols = [c for c in value_cols if c in src.columns]
    src = src.select(*keys, *src_cols)
    src_keys = F.broadcast(src.select(*keys)) if small else src.select(*keys)
    tgt = target.select(*keys, *value_cols)

    kept = tgt.join(src_keys, list(keys), "left_anti").withColumn(ACTION_COL, F.lit("keep"))
    missing = [c for c in value_cols if c not in src_cols]
    matched = tgt.join(src_keys, list(keys), "left_semi").select(
        *keys, *missing, F.lit(True).alias("_matched"))
    written = src.join(matched, list(keys), "left")
    out = []
    for c in value_cols:
        if stamp_col and c == stamp_col:
            out.append(F.current_timestamp().cast(target.schema[c].dataType).alias(c))
        else:
            out.append(F.col(c).alias(c))
    written = written.select(
        *keys, *out,
        F.when(F.col("_matched"), F.lit("update")).otherwise(F.lit("insert")).alias(ACTION_COL))
    return kept.unionByName(written)


def _merge_full_outer(target: DataFrame, src: DataFrame, keys: Sequence[str],
                      stamp_col: str | None) -> DataFrame:
    value_cols = [c for c in target.columns if c not in keys and c != ACTION_COL]
    src_cols = [c for c in value_cols if c in src.columns]
    t = target.select(*keys, *value_cols).withColumn("_in_t", F.lit(True)).alias("t")
    s = src.select(*keys, *src_cols).withColumn("_in_s", F.lit(True)).alias("s")
    j = t.join(s, list(keys), "full_outer")
    hit = F.col("s._in_s").isNotNull()
    out = []
    for c in value_cols:
        if stamp_col and c == stamp_col:
            stamp = F.current_timestamp().cast(target.schema[c].dataType)
            out.append(F.when(hit, stamp).otherwise(F.col(f"t.{c}")).alias(c))
        elif c in src_cols:
            out.append(F.when(hit, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            out.append(F.col(f"t.{c}").alias(c))
    action = (F.when(~hit, F.lit("keep"))
               .when(F.col("t._in_t").isNull(), F.lit("insert"))
               .otherwise(F.lit("update")))
    return j.select(*keys, *out, action.alias(ACTION_COL))


def merge_counts(merged: DataFrame) -> DataFrame:
    """rows before and after, rows written, net new (added) and updated."""
    a = F.col(ACTION_COL)
    return merged.agg(
        F.count_if(a != "insert").alias("rows_before"),
        F.count_if(a != "keep").alias("written"),
        F.count(F.lit(1)).alias("rows_after"),
        F.count_if(a == "insert").alias("added"),
        F.count_if(a == "update").alias("updated"),
    )


def change_feed(before: DataFrame, after: DataFrame, keys: Sequence[str],
                value_cols: Sequence[str]) -> DataFrame:
    """Row-level changes between two versions of a keyed table.

    One full outer join; each joined row yields 0, 1 or 2 change rows
    (insert, delete, or update_preimage + update_postimage when any value
    differs, NULL-safe). Unchanged rows yield nothing.
    """
    b = before.select(*keys, *value_cols).withColumn("_b", F.lit(True)).alias("b")
    a = after.select(*keys, *value_cols).withColumn("_a", F.lit(True)).alias("a")
    j = b.join(a, list(keys), "full_outer")
    in_b, in_a = F.col("b._b").isNotNull(), F.col("a._a").isNotNull()
    differs = F.lit(False)
    for c in value_cols:
        differs = differs | ~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))

    def image(side: str, kind: str) -> Column:
        return F.struct(*[F.col(f"{side}.{c}").alias(c) for c in value_cols],
                        F.lit(kind).alias("change_type"))

    changes = (F.when(in_a & ~in_b, F.array(image("a", "insert")))
                .when(in_b & ~in_a, F.array(image("b", "delete")))
                .when(differs, F.array(image("b", "update_preimage"), image("a", "update_postimage"))))
    return j.select(*keys, F.explode(changes).alias("_c")).select(*keys, "_c.*")


def bronze_count(bronze: DataFrame) -> DataFrame:
    return bronze.agg(F.count(F.lit(1)).alias("bronze_rows"))


def bronze_max_update(bronze: DataFrame, date_col: str = "last_update_posted") -> DataFrame:
    """Newest last-update date in Bronze; a diagnostic, never a resume point."""
    return bronze.agg(F.max(date_col).alias("max_update"))


# ---- run ledger -------------------------------------------------------------

def safe_watermark(runs: DataFrame) -> DataFrame:
    """Watermark of the latest finished complete run that has one; NULL means full pass."""
    ok = runs.where(F.col("complete") & F.col("watermark").isNotNull())
    return ok.agg(F.max_by("watermark", "finished_at").alias("watermark"))


def start_run(spark: SparkSession, run_id: str, mode: str) -> DataFrame:
    """The ledger row appended before any write: started and incomplete.

    The start time is fixed once, here, so the finish row (built from this
    one) carries the same ``started_at`` however often the plan is evaluated.
    """
    from datetime import datetime, timezone

    from cribra.functions.text import validate_name
    from cribra.schemas import RUNS_SCHEMA
    validate_name(run_id)
    now = datetime.now(timezone.utc)
    row = spark.createDataFrame([(run_id, mode, now, None, None, None, False)],
                                "run_id string, mode string, started_at timestamp, "
                                "finished_at timestamp, studies_written bigint, "
                                "watermark date, complete boolean")
    return row.select(*[F.col(f.name).cast(f.dataType) for f in RUNS_SCHEMA.fields])


def finish_run(started: DataFrame, bronze: DataFrame, written: int, complete: bool,
               date_col: str = "last_update_posted") -> DataFrame:
    """The ledger row of a finished run; only a complete run publishes a watermark.

    The watermark is ``max(last_update_posted)`` over Bronze, computed as a
    scalar subquery (a distributed aggregate, one value back).
    """
    newest = bronze.select(F.max(date_col)).scalar() if complete else F.lit(None).cast("date")
    return finish_rows(started, F.current_timestamp(), F.lit(int(written)), F.lit(bool(complete)), newest)


def finish_rows(started: DataFrame, finished_at: Column, written: Column, complete: Column,
                newest: Column) -> DataFrame:
    """Ledger rows of finished runs: ``newest`` is the watermark of those that are complete."""
    return started.select(
        "run_id", "mode", "started_at", finished_at.alias("finished_at"),
        written.cast("long").alias("studies_written"), F.when(complete, newest).alias("watermark"),
        complete.alias("complete"))


def ledger_latest(runs: DataFrame) -> DataFrame:
    """Latest ledger row per run id (the ledger is append-only: start, then finish)."""
    order = F.coalesce(F.col("finished_at"), F.col("started_at"))
    return (runs.withColumn("_o", order)
                .withColumn("_rn", F.row_number().over(
                    Window.partitionBy("run_id").orderBy(F.col("_o").desc(),
                                                         F.col("complete").desc())))
                .where("_rn = 1").drop("_rn", "_o"))
