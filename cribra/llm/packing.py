"""Conflict-constrained best-fit packing.

Documents become pieces of at most ``capacity`` words; pieces are dealt at random
(by hash) over shards of about ``SHARD_ROWS`` pieces, each packed on its own: longest
first, into bins ordered by residual capacity. A bin carries a bitmap of the sources
and a bitmap of the duplicate clusters it holds; the search starts at the tightest
bin that fits and continues to its successors until one shares neither. Without such
a bin a new one opens, so no piece is dropped and no bin is capped.

A hot source cannot overload a shard: shards take pieces by hash of id and place,
whatever their source. ``source_col=None`` or ``cluster_col=None`` lifts that constraint.

Defined cases: a document without words has no piece and is in no bin; a null source
or cluster conflicts with nothing; a document longer than ``capacity`` gives full pieces
and a remainder, which count as one cluster, so they never share a bin when clusters
are kept apart; a row that occurs twice is packed twice (in other bins, its texts being
equal); an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribra.llm.common import small_batches, stored, texts
from cribra.llm.simhash import fingerprint, fingerprint_classes

CAPACITY = 2048
SHARD_ROWS = 4096


class Bins:
    """Open bins of one shard, ordered by residual capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.slots: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int, int]:
        """Bin, slot and residual after placing a piece; ``source`` and ``cluster`` are bits."""
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            residual, k = self.order[at]
            if not (self.sources[k] & source or self.clusters[k] & cluster):
                del self.order[at]
                break
            at += 1
        else:
            residual, k = self.capacity, len(self.slots)
            self.sources.append(0)
            self.clusters.append(0)
            self.slots.append(0)
        self.sources[k] |= source
        self.clusters[k] |= cluster
        self.slots[k] += 1
        if residual > size:
            insort(self.order, (residual - size, k))
        return k, self.slots[k] - 1, residual - size


def pack(pieces: list[tuple], capacity: int) -> list[tuple[int, int, int]]:
    """Places of ``(size, source, cluster)`` pieces given longest first."""
    bins, bits = Bins(capacity), ({}, {})

    def bit(k: int, value) -> int:
        return 0 if value is None else 1 << bits[k].setdefault(value, len(bits[k]))

    return [bins.put(size, bit(0, s), bit(1, c)) for size, s, c in pieces]


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              source_col: str | None = "source", cluster_col: str | None = None,
              capacity: int = CAPACITY, near: bool = False) -> DataFrame:
    """``id``, ``piece``, ``start``, ``n_words``, ``source``, ``cluster`` of every piece.

    Without ``cluster_col`` the cluster is the hash of the text's lower-cased words, or
    with ``near`` the text's SimHash fingerprint.
    """
    small_batches(docs.sparkSession)
    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.lit(None).cast("string")
    kind = docs.schema[id_col].dataType.simpleString()
    own = cluster_col is None

    def run(batches):
        for b in batches:
            ids, sources, given = (b.column(k).to_pylist() for k in (1, 2, 3))
            rows: list[tuple] = []
            for t, i, s, c in zip(texts(b.column(0)), ids, sources, given, strict=True):
                words = t.lower().split()
                if own and near:
                    c = str(np.uint64(fingerprint(t)).view(np.int64))
                elif own:
                    c = xxhash.xxh3_128_hexdigest(b" ".join(words))
                for k, at in enumerate(range(0, len(words), capacity)):
                    rows.append((i, k, at, min(capacity, len(words) - at), s, c))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [b.schema.field(1).type, pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(cols, kinds, strict=True)],
                names=["id", "piece", "start", "n_words", "source", "cluster"])

    return docs.select(text_col, id_col, source.alias("__s"), cluster.alias("__c")).mapInArrow(
        run, f"id {kind}, piece int, start long, n_words int, source string, cluster string")


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str | None = "source", cluster_col: str | None = None,
             capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, near: bool = False) -> DataFrame:
    """One row per piece: ``bin_id``, ``slot``, the id, ``piece``, ``start_word``, ``n_words``, ``residual``.

    ``bin_id`` is shard and bin number; ``residual`` is what was left in the bin
    after the piece. Texts do not shuffle, only the pieces' sizes and keys. With ``near``
    and no ``cluster_col`` the SimHash components are the clusters.
    """
    pieces = stored(pieces_of(docs, id_col, text_col, source_col, cluster_col, capacity, near))
    if near and cluster_col is None:
        prints = pieces.withColumn("fp", F.col("cluster").cast("long")).drop("cluster")
        classes = fingerprint_classes(prints, "id").select("fp", F.col("root").cast("string").alias("cluster"))
        pieces = stored(prints.join(classes, "fp").drop("fp"))
    shards = max(1, -(-pieces.count() // shard_rows))
    kind = docs.schema[id_col].dataType.simpleString()
    # Rows that repeat an id and place spread over shards by their place in the task.
    spread = F.pmod(F.xxhash64("id", "piece", "cluster", F.monotonically_increasing_id()), F.lit(shards))
    dealt = (pieces.withColumn("shard", spread).repartition("shard")
             .sortWithinPartitions("shard", F.desc("n_words"), "id", "piece", "cluster"))

    def flush(shard: int, rows: list[tuple]) -> pa.RecordBatch:
        put = pack([(r[3], r[4], r[5]) for r in rows], capacity)
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{shard}-{k}" for k, _, _ in put]), pa.array([s for _, s, _ in put], pa.int32()),
             pa.array([r[0] for r in rows], made), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int32()),
             pa.array([x for _, _, x in put], pa.int32())],
            names=["bin_id", "slot", "id", "piece", "start_word", "n_words", "residual"])

    made = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    if made == pa.string():
        dealt = dealt.withColumn("id", F.col("id").cast("string"))
        kind = "string"

    def run(batches):
        shard, held = None, []
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for row in zip(*cols, strict=True):
                if row[6] != shard:
                    if held:
                        yield flush(shard, held)
                    shard, held = row[6], []
                held.append(row)
        if held:
            yield flush(shard, held)

    packed = dealt.select("id", "piece", "start", "n_words", "source", "cluster", "shard").mapInArrow(
        run, f"bin_id string, slot int, id {kind}, piece int, start_word long, n_words int, residual int")
    return packed.withColumnRenamed("id", id_col)
