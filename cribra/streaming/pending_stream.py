"""Changes of Bronze flow into extraction.

The stream reads Bronze's commit files in version order; each micro-batch takes the
change rows of its versions. Only studies that a change inserted or altered become
pending work (anti joins against the attempt log under the signature), are extracted
by the caller's extractor in tasks that follow their number, and are committed as one
batch of the attempt log. A study that lands again unchanged has no change row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cribra.operators import extract as E
from cribra.operators import pending as PD
from cribra.sources import keyed as K
from cribra.sources import tables as TB
from cribra.sources.tables import Warehouse
from cribra.streaming.landing_stream import landing_to_bronze


def latest_images(rows: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """The newest state of every key that change rows leave in place, with ``columns``."""
    last = rows.where(F.col("change_type") != "update_preimage").groupBy(key).agg(
        F.max_by(F.struct("change_type", *columns), "version").alias("_c"))
    return last.where(F.col("_c.change_type") != "delete").select(key, *[f"_c.{c}" for c in columns])


def changes_to_attempts(spark: SparkSession, wh: Warehouse, extractor: E.Extractor, signature: str,
                        workers: int = 1, checkpoint: str | None = None) -> StreamingQuery:
    TB.ensure_tables(spark, wh)
    table = TB.bronze_table(wh)
    commits = (spark.readStream.schema(K.COMMIT_SCHEMA).option("maxFilesPerTrigger", 1000)
               .json(table.commits))

    def extract_batch(batch: DataFrame, epoch: int) -> None:
        # One row per commit file, at most maxFilesPerTrigger.
        found = [(r.version, r.write, r.inserts) for r in batch.orderBy("version").collect()]
        studies = latest_images(K.changes_of(spark, table, found), "nct_id", ("eligibility",))
        attempts = TB.read_attempts(spark, wh)
        todo = PD.pending_trials(studies, TB.done_view(attempts), TB.failures_view(attempts),
                                 signature)
        todo = todo.persist()
        outcomes = E.extract_with(todo, extractor, E.tasks_for(todo.count(), workers))
        name = f"stream-{epoch:08d}"
        TB.write_attempts(outcomes.select(
            "nct_id", F.lit(signature).alias("signature"), F.lit(name).alias("batch"),
            F.monotonically_increasing_id().alias("seq"), "criteria",
            F.substring("error", 1, 500).alias("error"), F.current_timestamp().alias("at")), wh, name)
        todo.unpersist()

    return (commits.writeStream.foreachBatch(extract_batch)
            .option("checkpointLocation", checkpoint or f"{wh.checkpoints}/changes_to_attempts")
            .trigger(availableNow=True).start())


def landed_to_attempts(spark: SparkSession, wh: Warehouse, landing_root: str,
                       extractor: E.Extractor, signature: str, workers: int = 1,
                       checkpoint: str | None = None) -> StreamingQuery:
    """Landed studies into Bronze, and what that changed there into extraction."""
    landing_to_bronze(spark, wh, landing_root).awaitTermination()
    return changes_to_attempts(spark, wh, extractor, signature, workers, checkpoint)
