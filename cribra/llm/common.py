"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cribra.session import checkpoint_dir

# Rows and bytes of text that one Arrow batch may hold: bounds a Python worker's memory.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
# Bytes of whitespace as the contracts write it: [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Lower the session's limits of an Arrow batch to ``rows`` and ``size`` bytes; never raises them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).removesuffix("B").removesuffix("b")
        if not now.isdigit() or int(now) > most or int(now) == 0:
            spark.conf.set(key, str(most))


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in a folder of its own in the shared checkpoint folder.

    Unlike a checkpoint it keeps columns apart, so readers prune and know its size.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def fold(id_col: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(folds)


def sample_labels(labels: DataFrame, id_col: str, label_col: str, folds: int, held: int,
                  bound: int) -> DataFrame:
    """At most ``bound`` labelled ids of the folds that may be learned from.

    One row per id: ``__id`` and ``__label`` (the smaller label where an id has
    several). Ids are taken in the order of their hash, so the sample does not
    depend on the layout of the table.
    """
    rows = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
            .where(fold(id_col, folds) != held)
            .groupBy(F.col(id_col).cast("long").alias("__id"))
            .agg(F.min(F.col(label_col).cast("int")).alias("__label")))
    return rows.orderBy(F.xxhash64("__id"), "__id").limit(bound)
