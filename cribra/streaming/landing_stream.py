"""Incremental landing into Bronze as a file-source stream.

New landing folders are picked up by Structured Streaming; each micro-batch is
merged into Bronze inside ``foreachBatch``, which rewrites the buckets it touches. The stream's
checkpoint makes a restart resume after the last committed micro-batch, and
``availableNow`` processes what is there and stops (a scheduled run).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cribra.operators import bronze as B
from cribra.schemas import BRONZE_LANDING_SCHEMA, LANDING_ORDER
from cribra.sources import tables as TB
from cribra.sources.tables import Warehouse


#: Arrival order of landed lines: run and batch folders by name (a number at the end
#: counts as one), then page and position. Lines of one folder that carry neither go by
#: file; those of one file have no order of their own, and the largest document wins.
ARRIVAL = ["_folder", "_number", "page_file", "pos", "_file", "raw"]


def landed_lines(reader, landing_root: str) -> DataFrame:  # noqa: ANN001 - stream or batch reader
    """Landed lines (every column text on disk) with the columns of ``ARRIVAL``."""
    fields = [*BRONZE_LANDING_SCHEMA.fields, *LANDING_ORDER, T.StructField("batch", T.StringType())]
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, "^(.*)/", 1)
    number = F.regexp_extract(folder, "([0-9]{1,18})$", 1)
    return reader.schema(text).json(landing_root).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields],
        F.regexp_replace(folder, "[0-9]{1,18}$", "").alias("_folder"),
        F.coalesce(number.try_cast("long"), F.lit(-1).cast("long")).alias("_number"),
        path.alias("_file"))


def landing_to_bronze(spark: SparkSession, wh: Warehouse, landing_root: str,
                      checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    TB.ensure_tables(spark, wh)
    stream = landed_lines(spark.readStream.option("maxFilesPerTrigger", 1000), landing_root)

    def merge_batch(batch: DataFrame, epoch: int) -> None:
        source = batch.select(
            "nct_id", F.col("last_update_posted").try_cast("date").alias("last_update_posted"),
            "raw", *B.columns_of_raw(), *[c for c in ARRIVAL if c != "raw"])
        TB.merge_bronze(spark, wh, B.drop_missing_ids(source), ARRIVAL)

    writer = stream.writeStream.foreachBatch(merge_batch).option(
        "checkpointLocation", checkpoint or f"{wh.checkpoints}/landing_to_bronze")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="1 minute")
    return writer.start()
