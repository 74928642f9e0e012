"""Where state lives: a warehouse folder of plain parquet tables.

Row-level MERGE / DELETE are not available on plain parquet, so state is kept
append-only and read as views:

* ``bronze`` - a keyed table in hash buckets (``sources.keyed``): a merge writes
  the buckets its batch touches and the change rows, and publishes a version;
  ``vacuum_bronze`` drops old versions.
* ``runs`` - the run ledger, one appended row at start and one at finish.
* ``attempts/signature=S/batch=B`` - the extraction log; a rerun batch
  replaces its own folder. Silver and the failure counters are views over it.
* ``landing/run=R/batch=B`` - gzip JSON lines per backfill batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cribra.functions.text import is_throttled
from cribra.schemas import ATTEMPTS_SCHEMA, BRONZE_SCHEMA, RUNS_SCHEMA
from cribra.operators import tallies as TL
from cribra.sources import keyed as K


def _fs(spark: SparkSession, path: str):  # noqa: ANN202 - JVM objects
    jvm = spark.sparkContext._jvm  # type: ignore[attr-defined]
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p  # type: ignore[attr-defined]


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


@dataclass(frozen=True)
class Warehouse:
    """``buckets``: of Bronze, fixed when it is first written. About the table's size over 128 MB."""
    root: str
    buckets: int = 16

    @property
    def bronze(self) -> str:
        return f"{self.root}/bronze"

    @property
    def runs(self) -> str:
        return f"{self.root}/runs"

    @property
    def attempts(self) -> str:
        return f"{self.root}/attempts"

    @property
    def landing(self) -> str:
        return f"{self.root}/landing"

    @property
    def checkpoints(self) -> str:
        return f"{self.root}/_checkpoints"


def ensure_tables(spark: SparkSession, wh: Warehouse) -> None:
    """Idempotent setup: empty tables with their schemas where none exist yet."""
    if not path_exists(spark, wh.runs):
        spark.createDataFrame([], RUNS_SCHEMA).write.mode("append").parquet(wh.runs)
    K.create(spark, bronze_table(wh))
    if not path_exists(spark, wh.attempts):
        spark.createDataFrame([], ATTEMPTS_SCHEMA).write.partitionBy(
            "signature", "run").parquet(wh.attempts)


def bronze_table(wh: Warehouse) -> K.KeyedTable:
    return K.KeyedTable(wh.bronze, BRONZE_SCHEMA, "nct_id", wh.buckets, stamp="ingested_at")


def bronze_versions(spark: SparkSession, wh: Warehouse) -> list[int]:
    return K.versions(spark, bronze_table(wh))


def read_bronze(spark: SparkSession, wh: Warehouse, version: int | None = None) -> DataFrame:
    return K.read(spark, bronze_table(wh), version)


def read_study(spark: SparkSession, wh: Warehouse, nct_id: str) -> DataFrame:
    """One study: the files of its bucket, sorted by id, are all that is opened."""
    return K.read_key(spark, bronze_table(wh), nct_id)


def merge_bronze(spark: SparkSession, wh: Warehouse, source: DataFrame, order_cols: Sequence[str]) -> K.Commit:
    """Merge studies into Bronze: the next version and its change rows, safe beside other writers."""
    return K.merge(spark, bronze_table(wh), source, order_cols)


def bronze_changes(spark: SparkSession, wh: Warehouse, after: int, upto: int | None = None,
                   net: bool = True) -> DataFrame:
    """Changes between two versions of Bronze from the change rows, not from the versions."""
    rows = K.changes(spark, bronze_table(wh), after, upto)
    return K.net_changes(rows, "nct_id", bronze_table(wh).values) if net else rows


#: Statistics of Bronze that follow its changes.
BRONZE_FIELDS = (
    TL.Field("last_update_posted", "last_update_posted"), TL.Field("overall_status", "overall_status"),
    TL.Field("study_type", "study_type"), TL.Field("ancestor_terms", "ancestors.term", "list"),
    TL.Field("ancestors", "ancestors", "size"), TL.Field("bytes", "raw", "bytes"))


def bronze_tallies(spark: SparkSession, wh: Warehouse) -> DataFrame:
    """Tallies of the newest Bronze, brought up to date from the changes since they were stored."""
    return K.refresh_tallies(spark, bronze_table(wh), BRONZE_FIELDS)


def vacuum_bronze(spark: SparkSession, wh: Warehouse, keep: int = 2) -> list[int]:
    """Drop all but the newest ``keep`` versions of Bronze; returns the removed version numbers.
    Call it when no reader holds an older version."""
    return K.vacuum(spark, bronze_table(wh), keep)


def read_runs(spark: SparkSession, wh: Warehouse) -> DataFrame:
    from cribra.operators.bronze import ledger_latest
    raw = spark.read.schema(RUNS_SCHEMA).parquet(wh.runs)
    return ledger_latest(raw)


def append_run_row(row: DataFrame, wh: Warehouse) -> None:
    row.select(*[F.col(f.name).cast(f.dataType) for f in RUNS_SCHEMA.fields]).write.mode(
        "append").parquet(wh.runs)


def read_attempts(spark: SparkSession, wh: Warehouse) -> DataFrame:
    return spark.read.schema(ATTEMPTS_SCHEMA).parquet(wh.attempts)


def write_attempts(df: DataFrame, wh: Warehouse, run: str, append: bool = False) -> None:
    """Commit outcomes of one run to the log.

    A folder per signature and run, whatever the number of rows; the batch is a
    column. A run of the same name is replaced, unless ``append`` adds a further
    part of it.
    """
    full = df.withColumn("run", F.lit(run))
    cols = [F.col(f.name).cast(f.dataType) for f in ATTEMPTS_SCHEMA.fields]
    (full.select(*cols).write.mode("append" if append else "overwrite")
         .option("partitionOverwriteMode", "dynamic")
         .partitionBy("signature", "run").parquet(wh.attempts))


def _attempt_order() -> list:
    return [F.col("at").desc(), F.col("batch").desc(), F.col("seq").desc()]


def silver_view(attempts: DataFrame) -> DataFrame:
    """Silver = the latest successful attempt per (trial, signature), one row per criterion.

    An ok but empty re-extraction wins too, so it removes older rows.
    """
    ok = attempts.where(F.col("error").isNull())
    w = Window.partitionBy("nct_id", "signature").orderBy(*_attempt_order())
    latest = ok.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    rows = latest.select("nct_id", "signature", "criteria", "at", "batch")
    exploded = rows.select("nct_id", "signature", "at", "batch",
                           F.posexplode("criteria").alias("ordinal", "c"))
    return exploded.select(
        "nct_id", "signature", F.col("ordinal").cast("int").alias("ordinal"),
        F.col("c.criterion_id").alias("criterion_id"), F.col("c.text").alias("text"),
        F.col("c.kind").alias("kind"), F.col("c.is_exclusion").alias("is_exclusion"),
        F.col("at").alias("extracted_at"), "batch")


def done_view(attempts: DataFrame) -> DataFrame:
    """Trials with a successful attempt, per signature (even if it found no criteria)."""
    return attempts.where(F.col("error").isNull()).select("nct_id", "signature").distinct()


def failures_view(attempts: DataFrame) -> DataFrame:
    """Genuine failures since the latest success, per (trial, signature).

    Throttled attempts never count. Output: nct_id, signature, error (last,
    cut to 400), attempts, last_failed_at.
    """
    from cribra.functions.text import cut_error
    last_ok = attempts.where(F.col("error").isNull()).groupBy("nct_id", "signature").agg(
        F.max("at").alias("_ok_at"))
    failed = attempts.where(F.col("error").isNotNull() & ~is_throttled("error"))
    since = failed.join(last_ok, ["nct_id", "signature"], "left").where(
        F.col("_ok_at").isNull() | (F.col("at") > F.col("_ok_at")))
    return since.groupBy("nct_id", "signature").agg(
        cut_error(F.max_by("error", F.struct("at", "batch", "seq"))).alias("error"),
        F.count(F.lit(1)).cast("int").alias("attempts"),
        F.max("at").alias("last_failed_at"))


def register_views(spark: SparkSession, wh: Warehouse, signature: str | None = None) -> list[str]:
    """Expose the warehouse to Spark SQL as temporary views.

    bronze_studies, bronze_runs, extraction_attempts, silver_criteria and
    silver_failures; with ``signature``, the Silver views keep that signature
    only (other signatures count as absent).
    """
    ensure_tables(spark, wh)
    attempts = read_attempts(spark, wh)
    silver = silver_view(attempts)
    failures = failures_view(attempts)
    if signature is not None:
        silver = silver.where(F.col("signature") == signature)
        failures = failures.where(F.col("signature") == signature)
    views = {
        "bronze_studies": read_bronze(spark, wh),
        "bronze_runs": read_runs(spark, wh),
        "extraction_attempts": attempts,
        "silver_criteria": silver,
        "silver_failures": failures,
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return sorted(views)
