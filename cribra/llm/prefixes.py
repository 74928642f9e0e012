"""Prefix trie of conversations by truncation peeling.

A conversation is the sequence of its turns. A turn is a cell of 40 bytes: SHA-256 of
its role and text (the role's length first), then the text's UTF-8 length. A sequence of
``d`` turns is a binary of ``40 d`` bytes, so the prefix tree needs no texts: stripping turns
cuts bytes, and equal prefixes are equal binaries.

The descent goes from the greatest depth to the root and stops where paths can merge:
the depths at which two different sequences part or one ends inside another. These are
the common lengths of neighbours in sorted order. At such a depth the nodes left from
below and the conversations that ended meanwhile are stripped of their last turns and
regrouped with those that end here: one grouping discovers the depth's nodes and sums
their members, children, leaves and saved tokens, and is written. What lies between two
stops has one member set and one child, so it is spelled out from the node below it.
Rounds thus follow the depths at which conversations part, not their lengths. Equal
conversations are one row before the descent, and map-side sums keep a prefix that a
third of all share at one row per task.

A node's ending members may be too many for one value. They are sorted over ranges of
(sequence, id), so a hot sequence spans many tasks, which cut its ids into chunk rows; a
node's digest then streams its chunks in order.

Defined cases: rows without a conversation id take no part; turns are ordered null
first, equal turn numbers by the cell; a null role or text is empty; repeated rows are
turns of their own; a conversation without turns ends at the root; an empty table has
no nodes. One conversation is one row (40 bytes a turn). Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribra.llm.common import small_batches, written

CELL = 40
CHUNK_BYTES = 1 << 20
ROWS = 20_000    # rows of an Arrow batch of nodes, and those of one more head
_NOTHING = hashlib.sha256(b"").hexdigest()


def turn_cell(role: Column, text: Column) -> Column:
    """40 bytes of a turn: digest of role and text, length of the text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))


def _first(seq: Column, turns: Column) -> Column:
    return F.substring(seq, F.lit(1), turns * CELL)


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
              role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id`` and ``seq``, the cells of its turns in order."""
    cells = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        turn_cell(F.col(role_col), F.col(text_col)).alias("cell"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "cell")))
    joined = F.unhex(F.array_join(F.transform(ordered, lambda x: F.hex(x["cell"])), ""))
    return cells.groupBy("conv_id").agg(joined.alias("seq"))


def rebuilt(convs: DataFrame, group: int = 5, folds: int = 9) -> DataFrame:
    """Every conversation begins with turns of its group's first one.

    With ``h`` the unsigned crc32 of the decimal id modulo ``folds``: the first ``h`` turns of
    conversation ``c - c % group`` (all if fewer, none if absent), then its own after ``h``. The
    remainder of a negative id is SQL's, which has its sign.
    """
    heads = convs.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("_base"), _first(F.col("seq"), F.lit(folds - 1)).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % folds).cast("int")
    return (convs.join(heads, F.col("conv_id") - F.col("conv_id") % group == F.col("_base"), "left")
            .select("conv_id", F.concat(_first(F.coalesce("_head", F.lit(b"")), h),
                                        F.substring("seq", h * CELL + 1, F.greatest(
                                            F.octet_length("seq") - h * CELL, F.lit(0)))).alias("seq")))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, conv_id) in order to rows (key, first id, ids as text), cut at CHUNK_BYTES."""
    key, first, ids, size, out = None, 0, [], 0, []

    def flush() -> None:
        if ids:
            out.append({"key": key, "first": first, "ids": ",".join(ids)})

    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key or size >= CHUNK_BYTES:
                flush()
                key, first, ids, size = k, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if out:
            yield pa.RecordBatch.from_pylist(out, _CHUNK)
            out = []
    flush()
    if out:
        yield pa.RecordBatch.from_pylist(out, _CHUNK)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows in order to one row (key, digest) for each key."""
    key, state, out = None, None, []
    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if state is not None and k == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                out.append({"key": key, "ends_sha256": state.hexdigest()})
            key, state = k, hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, _DIGEST)
            out = []
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": state.hexdigest()}], _DIGEST)


_CHUNK = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_DIGEST = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])


def _key(seq: Column) -> Column:
    return F.unhex(F.sha2(seq, 256))


def ends_digest(convs: DataFrame) -> DataFrame:
    """``key`` of a sequence and ``ends_sha256``, over the ascending ids of the conversations that are it."""
    chunks = (convs.select(_key(F.col("seq")).alias("key"), "conv_id").repartitionByRange("key", "conv_id")
              .sortWithinPartitions("key", "conv_id")
              .mapInArrow(_chunks, "key binary, first long, ids string"))
    return (chunks.repartition("key").sortWithinPartitions("key", "first").select("key", "ids")
            .mapInArrow(_digests, "key binary, ends_sha256 string"))


def _common(a: bytes, b: bytes) -> int:
    """Leading cells that two sequences share."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return (int(differ[0]) if len(differ) else n) // CELL


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (first seq, last seq) to one row: the first and the last of all, and the depths
    at which one row's last and the next row's first part."""
    first = last = None
    depths: set[int] = set()
    for batch in batches:
        for a, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if last is not None:
                depths.add(_common(last, a))
            first, last = (a if first is None else first), z
    if first is not None:
        yield pa.RecordBatch.from_pylist([{"first": first, "last": last, "depths": sorted(depths)}], _PARTING)


_PARTING = pa.schema([("first", pa.binary()), ("last", pa.binary()), ("depths", pa.list_(pa.int64()))])
_PARTING_DDL = "first binary, last binary, depths array<long>"


def parting_depths(ended: DataFrame) -> list[int]:
    """Depths at which different sequences (``seq``, one row each) part, deepest first, and 0.

    In sorted order any two sequences share what the least of the neighbours between them
    share. Ranges give their own depths and their ends; the ends of all ranges, one row
    each, are compared once more.
    """
    ranges = written(
        ended.select("seq").repartitionByRange("seq").sortWithinPartitions("seq")
        .select(F.col("seq").alias("a"), F.col("seq").alias("z")).mapInArrow(_neighbours, _PARTING_DDL),
        "trie-ranges")
    across = ranges.coalesce(1).sortWithinPartitions("first").select("first", "last").mapInArrow(
        _neighbours, _PARTING_DDL)
    found = ranges.unionByName(across).select(F.explode("depths").alias("d")).distinct().collect()
    return sorted({0, *(r["d"] for r in found)}, reverse=True)


def _bytes(turn: Column) -> Column:
    """Text length of the ``turn``-th cell (from 1)."""
    return F.conv(F.hex(F.substring(F.col("seq"), turn * CELL - 7, F.lit(8))), 16, 10).cast("long")


def peel(ended: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie's stops over ``ended`` (``seq``, ``conv_id``, ``n_convs``, one row a sequence).

    Returns the nodes at stops (``seq``, ``depth``, ``conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``), and the heads: every such node below the root and every
    sequence that ends between two stops, with ``stop``, the depth it is stripped to.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    length = F.floor(F.octet_length("seq") / CELL).cast("long")
    ended = ended.withColumn("depth", length)
    copies = F.col("n_convs") - 1
    stops, heads, above = [], [], None
    for stop in parting_depths(ended):
        between = F.col("depth") > stop if above is None else (F.col("depth") > stop) & (F.col("depth") < above)
        head = ended.where(between).select(
            "seq", "depth", "conv_id", "n_convs", zero.alias("n_children"), one.alias("n_leaves"),
            (copies * _bytes(F.col("depth"))).alias("saved_tokens"))
        if stops:
            head = head.unionByName(stops[-1])
        heads.append(head.withColumn("stop", F.lit(stop).cast("long")))
        passed = F.when(F.col("depth") > stop + 1, F.aggregate(
            F.sequence(F.lit(stop + 1).cast("long"), F.col("depth") - 1), zero,
            lambda a, j: a + _bytes(j.cast("int")))).otherwise(zero)
        # A column of its own first: in the select below ``seq`` is also the name of a new column.
        arriving = head.withColumn("passed", passed).select(
            _first(F.col("seq"), F.lit(stop)).alias("seq"), "conv_id", "n_convs", one.alias("n_children"),
            "n_leaves", (F.col("saved_tokens") + copies * F.col("passed")).alias("saved_tokens"))
        ending = ended.where(F.col("depth") == stop).select(
            "seq", "conv_id", "n_convs", zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
        own = copies * _bytes(F.lit(stop)) if stop else zero
        stops.append(written(
            arriving.unionByName(ending).groupBy("seq").agg(
                F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
                F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
                F.sum("saved_tokens").alias("saved_tokens"))
            .select("seq", F.lit(stop).cast("long").alias("depth"), "conv_id", "n_convs", "n_children",
                    F.greatest("n_leaves", one).alias("n_leaves"),
                    (F.col("saved_tokens") + own).alias("saved_tokens")), f"trie-depth{stop}"))
        above = stop
    return reduce(DataFrame.unionByName, stops), reduce(DataFrame.unionByName, heads)


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each head to its own node and those above it down to its stop, which it shares with nobody."""
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in _NODE}
        for r in batch.to_pylist():
            n, conv = r["depth"] - r["stop"], r["conv_id"]
            cells = np.frombuffer(r["cells"], np.uint8).reshape(n, CELL)
            sizes = np.ascontiguousarray(cells[:, 32:]).view(">i8").ravel().astype(np.int64)
            # Sum of the text lengths from each node down to the one above the head.
            below = np.concatenate([np.cumsum(sizes[:-1][::-1])[::-1], [0]]) if n > 1 else np.zeros(1, np.int64)
            out["conv_id"] += [conv] * n
            out["depth"] += range(r["stop"] + 1, r["depth"] + 1)
            out["parent_conv_id"] += [r["parent"], *[conv] * (n - 1)]
            out["n_convs"] += [r["n_convs"]] * n
            out["n_children"] += [*[1] * (n - 1), r["n_children"]]
            out["n_leaves"] += [r["n_leaves"]] * n
            out["saved_tokens"] += (r["saved_tokens"] + (r["n_convs"] - 1) * below).tolist()
            out["ends_sha256"] += [*[_NOTHING] * (n - 1), r["ends_sha256"]]
            if len(out["depth"]) >= ROWS:
                yield pa.RecordBatch.from_pydict(out, _NODE)
                out = {f.name: [] for f in _NODE}
        if out["depth"]:
            yield pa.RecordBatch.from_pydict(out, _NODE)


_NODE = pa.schema([(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                                             "n_leaves", "saved_tokens")] + [("ends_sha256", pa.string())])
_NODE_DDL = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long,"
             " n_leaves long, saved_tokens long, ends_sha256 string")


def trie(convs: DataFrame) -> DataFrame:
    """All nodes of the trie over ``convs`` (``conv_id``, ``seq``), one row each."""
    small_batches(convs.sparkSession)
    convs = written(convs, "trie-sequences")
    ended = written(convs.groupBy("seq").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")),
                    "trie-ended")
    if ended.isEmpty():
        return convs.sparkSession.createDataFrame([], _NODE_DDL)
    stops, heads = peel(ended)
    ends = F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256")
    digests = ends_digest(convs).withColumnRenamed("key", "_key")
    up = stops.select(F.col("seq").alias("_seq"), F.col("depth").alias("_depth"), F.col("conv_id").alias("parent"))
    hung = heads.join(up, (F.col("stop") == F.col("_depth"))
                      & (_first(F.col("seq"), F.col("stop").cast("int")) == F.col("_seq")))
    hung = hung.join(digests, _key(F.col("seq")) == F.col("_key"), "left").select(
        F.substring("seq", (F.col("stop") * CELL + 1).cast("int"),
                    ((F.col("depth") - F.col("stop")) * CELL).cast("int")).alias("cells"),
        "stop", "depth", "conv_id", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)
    root = (stops.where("depth = 0").join(digests, _key(F.col("seq")) == F.col("_key"), "left")
            .select("conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
                    "n_leaves", "saved_tokens", ends))
    return hung.mapInArrow(_spell, _NODE_DDL).unionByName(root)
