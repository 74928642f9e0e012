"""Line dedup with two Bloom filters.

A first scan sets, for each line key of each document, one block of bits in a
filter of keys seen once or, if they were set before, in a filter of keys seen
twice. Partial filters of tasks merge as once = a | b, twice = t | u | (a & b), so
every key of two documents is in the second filter. A second scan sends only the
keys found there (suspected repeats) through a shuffle that counts documents
exactly and finds the first occurrence. A third scan drops the lines.

Bounds: the filters take at most ``max_bytes`` each. Past that size more keys are
suspected and shuffled; the result stays the same. The exact set of repeated keys is
broadcast in blocks of ``BLOCK_KEYS``, with a stored table between blocks.

Defined cases: a null or empty text is one empty line; an empty key never
repeats; each row of the input is a document of its own, so a row that occurs
twice counts twice; a line repeated inside one document counts once there. Other
columns pass through as they are, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cribra.llm.common import SPACE, small_batches, stored, texts

#: Most bytes of one filter, bits for each expected line, bits of a key in its block.
MAX_BYTES = 64 << 20
BITS_PER_LINE = 12
BITS_PER_KEY = 5
#: 64-bit words of a segment, the unit in which partial filters travel.
SEGMENT = 1 << 13
#: Repeated keys that one pass broadcasts (16 bytes each).
BLOCK_KEYS = 1 << 20


def keys_of(text: bytes) -> list[bytes]:
    """The key of each line: stripped of white space, A-Z lower-cased."""
    return [x.strip(SPACE).lower() for x in text.split(b"\n")]


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def places(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and bit pattern of each hash: a key's bits share one 64-bit word."""
    at = (h >> np.uint64(32)).astype(np.int64) % words
    bits = np.zeros(len(h), np.uint64)
    for k in range(BITS_PER_KEY):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return at, bits


def seen(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    at, bits = places(h, len(words))
    return (words[at] & bits) == bits


def add(once: np.ndarray, twice: np.ndarray, h: np.ndarray) -> None:
    """Put distinct hashes of one document in the filters."""
    at, bits = places(h, len(once))
    old = once[at]
    both = (old & bits) == bits
    np.bitwise_or.at(twice, at[both], bits[both])
    np.bitwise_or.at(once, at, bits)


def _filter_parts(docs: DataFrame, text_col: str, min_len: int, words: int) -> DataFrame:
    """Partial filters of every task by segment, compressed; segments without bits are left out."""
    def run(batches):
        once, twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for b in batches:
            for t in texts(b.column(0)):
                h = hashes(sorted({k for k in keys_of(t) if _long(k, min_len)}))
                # Equal words inside one document must not read as a repeat.
                add(once, twice, h)
        for s in range(0, words, SEGMENT):
            o, t = once[s:s + SEGMENT], twice[s:s + SEGMENT]
            if o.any():
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([s // SEGMENT], pa.int32()),
                    "once": pa.array([zlib.compress(o.tobytes(), 1)]),
                    "twice": pa.array([zlib.compress(t.tobytes(), 1)])})

    return docs.select(text_col).mapInArrow(run, "segment int, once binary, twice binary")


def merged(parts: DataFrame, once_seen: bool = False) -> DataFrame:
    """One row per segment with the bits of the twice-seen (or the once-seen) filter."""
    def run(batches):
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for s, o, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                o = np.frombuffer(zlib.decompress(o), np.uint64)
                t = np.frombuffer(zlib.decompress(t), np.uint64)
                if s in kept:
                    a, u = kept[s]
                    kept[s] = (a | o, u | t | (a & o))
                else:
                    kept[s] = (o, t)
        for s, found in kept.items():
            bits = found[0 if once_seen else 1]
            if bits.any():
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([s], pa.int32()),
                    "bits": pa.array([zlib.compress(bits.tobytes(), 1)])})

    return parts.repartition("segment").mapInArrow(run, "segment int, bits binary")


def words_for(keys: int, max_bytes: int) -> int:
    """64-bit words of a filter for so many keys, at most ``max_bytes``."""
    words = SEGMENT
    while words * 64 < keys * BITS_PER_LINE and words * 8 < max_bytes:
        words *= 2
    return words


def loaded(segments: DataFrame, words: int) -> np.ndarray:
    """The filter on the driver, segment by segment."""
    bits = np.zeros(words, np.uint64)
    for row in segments.toLocalIterator():
        part = np.frombuffer(zlib.decompress(row["bits"]), np.uint64)
        bits[row["segment"] * SEGMENT:][:len(part)] = part
    return bits


def id_hashes(ids: np.ndarray) -> np.ndarray:
    x = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def id_filter(ids: DataFrame, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """A Bloom filter of the longs in the first column of ``ids``, of bounded size."""
    words = words_for(ids.count(), max_bytes)

    def run(batches):
        once, none = np.zeros(words, np.uint64), zlib.compress(bytes(8 * SEGMENT), 1)
        for b in batches:
            at, bits = places(id_hashes(b.column(0).to_numpy()), words)
            np.bitwise_or.at(once, at, bits)
        for s in range(0, words, SEGMENT):
            if once[s:s + SEGMENT].any():
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([s // SEGMENT], pa.int32()),
                    "once": pa.array([zlib.compress(once[s:s + SEGMENT].tobytes(), 1)]),
                    "twice": pa.array([none])})

    parts = ids.select(ids.columns[0]).mapInArrow(run, "segment int, once binary, twice binary")
    return loaded(merged(parts, once_seen=True), words)


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8", "replace")) >= least)


def twice_seen(docs: DataFrame, text_col: str = "text", min_len: int = 1,
               max_bytes: int = MAX_BYTES) -> np.ndarray:
    """The filter of keys that occur in two documents (a superset of them).

    Its size follows the number of lines, up to ``max_bytes``, so what is
    broadcast has a proven bound.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = docs.select(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
                    .alias("n")).first()["n"] or 0
    words = words_for(n, max_bytes)
    return loaded(merged(_filter_parts(docs, text_col, min_len, words)), words)


def repeated_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_len: int = 1,
                   order_col: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Keys found in at least ``min_docs`` documents: ``key``, ``n_docs``, ``first``.

    ``first`` is the smallest ``order_col`` of a document with the key (null
    without one). Only keys in the twice-seen filter shuffle; each task counts its
    own documents first, so a key of a third of all documents is one row a task.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(twice_seen(docs, text_col, min_len, max_bytes))

    def run(batches):
        for b in batches:
            count: dict[bytes, int] = {}
            first: dict[bytes, object] = {}
            for t, o in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                own = sorted({k for k in keys_of(t) if _long(k, min_len)})
                if not own:
                    continue
                for i in np.flatnonzero(seen(bits.value, hashes(own))):
                    k = own[i]
                    count[k] = count.get(k, 0) + 1
                    if o is not None and (first.get(k) is None or o < first[k]):
                        first[k] = o
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(count), pa.binary()).cast(pa.string()),
                 pa.array(list(count.values()), pa.int64()),
                 pa.array([first.get(k) for k in count], kind)],
                names=["key", "n_docs", "first"])

    order = F.col(order_col).cast("long") if order_col else F.lit(None).cast("long")
    kind = pa.int64()
    return (docs.select(text_col, order.alias("__order"))
            .mapInArrow(run, "key string, n_docs long, first long")
            .groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.min("first").alias("first"))
            .where(F.col("n_docs") >= min_docs))


def _blocks(keys: DataFrame, block: int) -> Iterator[dict[bytes, int | None]]:
    """Repeated keys as 128-bit digests, in blocks of about ``block`` keys."""
    n = keys.count()
    rounds = max(1, -(-n // block))
    hashed = keys.select(F.expr("unhex(md5(cast(key as binary)))").alias("digest"), "first")
    for r in range(rounds):
        part = hashed.where(F.pmod(F.xxhash64("digest"), F.lit(rounds)) == r)
        yield {bytes(x["digest"]): x["first"] for x in part.toLocalIterator()}


def drop_lines(docs: DataFrame, keys: DataFrame, text_col: str = "text",
               n_lines: str = "n_lines", n_dropped: str = "n_dropped", keep_first: str | None = None,
               counts: bool = True, block: int = BLOCK_KEYS) -> DataFrame:
    """Texts without the lines whose key is in ``keys``; other lines joined by a newline.

    ``keep_first`` names the id column whose document keeps its first line of a
    key (``first`` of ``repeated_lines``). With ``counts`` two columns are added:
    lines before, and lines dropped. A scan only: nothing is shuffled.
    """
    import hashlib

    spark = docs.sparkSession
    small_batches(spark)
    out, base = docs, docs.schema
    # Counters travel in their own columns, under names that no input column has.
    total, gone = (_free(docs.columns, x) for x in ("__lines", "__gone"))
    out = out.withColumns({total: F.lit(0).cast("long"), gone: F.lit(0).cast("long")})
    schema = T.StructType([*base.fields, T.StructField(total, T.LongType()),
                           T.StructField(gone, T.LongType())])
    at = docs.columns.index(text_col)
    own = docs.columns.index(keep_first) if keep_first else None

    def step(table, is_first):
        def run(batches):
            for b in batches:
                new, lines_in, cut = [], [], []
                ids = b.column(own).to_pylist() if own is not None else [None] * len(b)
                for t, me in zip(texts(b.column(at)), ids, strict=True):
                    rows = t.split(b"\n")
                    kept, spared = [], set()
                    for x, k in zip(rows, keys_of(t), strict=True):
                        d = hashlib.md5(k, usedforsecurity=False).digest() if k else None
                        hit = d is not None and d in table.value
                        if hit and me is not None and table.value[d] == me and d not in spared:
                            spared.add(d)
                            hit = False
                        if not hit:
                            kept.append(x)
                    new.append(b"\n".join(kept))
                    lines_in.append(len(rows))
                    cut.append(len(rows) - len(kept))
                cols = list(b.columns)
                was = cols[-2].to_pylist()
                # A text without any line dropped keeps its value, null included.
                olds = b.column(at).cast(pa.binary()).to_pylist()
                cols[at] = pa.array([o if not c else x for o, x, c in zip(olds, new, cut, strict=True)],
                                    pa.binary()).cast(pa.string())
                cols[-2] = pa.array(lines_in if is_first else was, pa.int64())
                cols[-1] = pa.array([a + c for a, c in zip(cols[-1].to_pylist(), cut, strict=True)],
                                    pa.int64())
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)
        return run

    for i, table in enumerate(_blocks(stored(keys.select("key", "first")), block)):
        if i:
            out = stored(out)  # one broadcast at a time
        out = out.mapInArrow(step(spark.sparkContext.broadcast(table), i == 0), schema)
    if not counts:
        return out.drop(total, gone)
    for name in (n_lines, n_dropped):
        if name in docs.columns:
            out = out.drop(name)
    return out.withColumnsRenamed({total: n_lines, gone: n_dropped})


def _free(taken: list[str], name: str) -> str:
    while name in taken:
        name += "_"
    return name


def dedup_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_len: int = 1,
                id_col: str | None = None, keep: str = "none", counts: bool = True,
                max_bytes: int = MAX_BYTES) -> DataFrame:
    """Drop every line whose key is in ``min_docs`` documents or more.

    ``keep="none"`` drops all of them, ``keep="first"`` leaves the one in the
    document with the smallest ``id_col``.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    first = id_col if keep == "first" else None
    keys = repeated_lines(docs, text_col, min_docs, min_len, first, max_bytes)
    return drop_lines(docs, keys, text_col, keep_first=first, counts=counts)
