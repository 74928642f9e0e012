"""Landing: one gzip JSON-lines directory per batch, every column text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cribra.functions.text import validate_name


def write_landing(df: DataFrame, root: str, batch: str) -> str:
    """Write one batch as gzip JSON lines; rerunning a batch name replaces it."""
    validate_name(batch)
    path = f"{root}/batch={batch}"
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    text.write.mode("overwrite").option("compression", "gzip").json(path)
    return path


def write_landing_run(df: DataFrame, path: str) -> None:
    """Write a run's batches in one job into one directory, the batch name as a column.

    A run of the same name is replaced whole, so no batch of an earlier try stays.
    """
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    text.write.mode("overwrite").option("compression", "gzip").json(path)


def read_landing(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All landed lines with all columns as text; the batch name comes from the folder.

    Always a full reload: the schema is fixed, so no inference pass is made.
    """
    full = T.StructType(list(schema.fields) + [T.StructField("batch", T.StringType())])
    return spark.read.schema(full).json(root)
