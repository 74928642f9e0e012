"""Reply files of a batch-inference service, committed as they arrive.

Each micro-batch of reply lines is parsed into outcomes and written to the
attempt log as one batch named after the epoch, so a replayed epoch (after a
restart) replaces its own batch instead of counting attempts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cribra.operators import extract as E
from cribra.sources import tables as TB
from cribra.sources.tables import Warehouse


def replies_to_attempts(spark: SparkSession, wh: Warehouse, replies_root: str, signature: str,
                        checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    from cribra.plans.offline import latest_replies, reply_envelopes

    TB.ensure_tables(spark, wh)
    lines = spark.readStream.format("text").load(replies_root)

    def commit(batch: DataFrame, epoch: int) -> None:
        name = f"replies-{epoch:08d}"
        parsed = E.parse_replies(latest_replies(reply_envelopes(batch)), keep=("nct_id",))
        TB.write_attempts(parsed.select(
            "nct_id", F.lit(signature).alias("signature"),
            F.lit(name).alias("batch"),
            F.monotonically_increasing_id().alias("seq"), "criteria",
            F.substring("error", 1, 500).alias("error"), F.current_timestamp().alias("at")), wh, name)

    writer = lines.writeStream.foreachBatch(commit).option(
        "checkpointLocation", checkpoint or f"{wh.checkpoints}/replies_to_attempts")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="1 minute")
    return writer.start()
