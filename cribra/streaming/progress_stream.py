"""Progress of every trial as keyed streaming state: done, and failures since the last success.

The stream reads the attempt log as it grows. The state of a (trial, signature) is its
latest success and the genuine failures behind it, one for each batch, so a batch that
is written again (a replayed epoch) replaces its own attempt. Each micro-batch merges the
trials it met into a keyed table, of which pending work reads only the buckets of its
trials: neither step reads the log or the table whole. Restarted anywhere, the table is
that of the batch run, since state and offsets are committed together and the merge is
an upsert.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cribra.functions.text import ERROR_CUT, is_throttled
from cribra.schemas import ATTEMPTS_SCHEMA
from cribra.sources import keyed as K
from cribra.sources import tables as TB
from cribra.sources.tables import Warehouse

PROGRESS_SCHEMA = T.StructType([
    T.StructField("trial", T.StringType()), T.StructField("nct_id", T.StringType()),
    T.StructField("signature", T.StringType()), T.StructField("done", T.BooleanType()),
    T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType()),
    T.StructField("last_failed_at", T.TimestampType())])
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def progress_table(wh: Warehouse) -> K.KeyedTable:
    return K.KeyedTable(f"{wh.root}/progress", PROGRESS_SCHEMA, "trial", wh.buckets)


class Progress(StatefulProcessor):
    """State: the time of the latest success, and (at, batch, seq, error) of later failures."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ok = handle.getValueState("ok", "at timestamp")
        self.failed = handle.getMapState("failed", "batch string", "at timestamp, seq long, error string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        ok_at = self.ok.get()[0] if self.ok.exists() else None
        for frame in rows:
            for r in frame.itertuples(index=False):
                if not r.failed:
                    ok_at = r.at if ok_at is None else max(ok_at, r.at)
                elif not r.throttled:
                    self.failed.updateValue((r.batch,), (r.at, int(r.seq), r.error))
        held = [(v[0], k[0], v[1], v[2]) for k, v in self.failed.iterator()]
        if ok_at is not None:
            self.ok.update((ok_at,))
            for x in [x for x in held if x[0] <= ok_at]:
                self.failed.removeKey((x[1],))
            held = [x for x in held if x[0] > ok_at]
        last = max(held, key=lambda x: x[:3], default=None)
        yield pd.DataFrame({
            "nct_id": [key[0]], "signature": [key[1]], "done": [ok_at is not None], "attempts": [len(held)],
            "error": [last and last[3][:ERROR_CUT]], "last_failed_at": [last and last[0]]})

    def close(self) -> None:
        pass


def attempts_to_progress(spark: SparkSession, wh: Warehouse, checkpoint: str | None = None) -> StreamingQuery:
    """Bring the progress table up to date with the attempt log, and stop."""
    TB.ensure_tables(spark, wh)
    # The state's store is a setting of the session; the caller's stays as it is.
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    log = own.readStream.schema(ATTEMPTS_SCHEMA).parquet(wh.attempts).select(
        "nct_id", "signature", "batch", "seq", "at", "error", F.col("error").isNotNull().alias("failed"),
        is_throttled("error").alias("throttled"))
    out = T.StructType([f for f in PROGRESS_SCHEMA.fields if f.name != "trial"])
    counted = log.groupBy("nct_id", "signature").transformWithStateInPandas(
        Progress(), out, outputMode="Update", timeMode="None")

    def merge(batch: DataFrame, epoch: int) -> None:
        K.merge(batch.sparkSession, progress_table(wh), batch.withColumn(
            "trial", trial_key(F.col("nct_id"), F.col("signature"))))

    return (counted.writeStream.outputMode("update").foreachBatch(merge)
            .option("checkpointLocation", checkpoint or f"{wh.checkpoints}/attempts_to_progress")
            .trigger(availableNow=True).start())


def trial_key(nct_id, signature):  # noqa: ANN001, ANN201 - Columns
    return F.concat_ws("/", signature, nct_id)


def read_progress(spark: SparkSession, wh: Warehouse, signature: str) -> DataFrame:
    """As ``done_view`` and ``failures_view`` together: done, attempts since, and the last error."""
    return K.read(spark, progress_table(wh)).where(F.col("signature") == signature).drop("trial")
