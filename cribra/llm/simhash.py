"""SimHash near-dedup with a Gray-order hierarchical index.

Each text gets a 64-bit fingerprint of its word shingles. Equal fingerprints fold
into one row first, so copies cost nothing further. Two fingerprints within ``d`` bits
agree on ``c - d`` of any ``c`` blocks of bits: every fingerprint goes to one bucket
for each choice of that many blocks, and each bucket is searched by an index that
sorts fingerprints by Gray rank, keeps in upper nodes the bit pattern that a run of
fingerprints shares (with the mask of bits on which all agree) and prunes whole node
pairs whose accumulated differences exceed ``d``. A bucket returns a spanning
forest of its links, not its pairs. Components are joined over all buckets.

A bucket over ``BUCKET_ROWS`` fingerprints is not searched as it stands: its members go
on to the next, finer choice of blocks, where each of their pairs meets again. The
number of blocks follows the number of distinct fingerprints; the result is exact
at each size.

Defined cases: null, empty and white-space texts have fingerprint zero and link
like any other; a row that occurs twice is returned twice; a null id takes part, and
a component of null ids only has a null id; an empty table gives an empty result.
Only the id and text columns are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribra.llm.common import small_batches, stored, texts
from cribra.llm.components import components

SHINGLE, BITS = 4, 4
SEED = 42
#: Fingerprints that one bucket may hold before it is split further.
BUCKET_ROWS = 20_000
#: Children of an index node.
FAN = 16
#: Node pairs compared at once.
CHUNK = 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of the shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    h = np.fromiter((xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in
                     zip(starts[:n].tolist(), ends[shingle - 1:].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):  # unpacked bits of a bounded number of shingles at a time
        part = h[i:i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, *more: F.Column) -> DataFrame:
    """``id_col``, ``fp`` (the 64 bits as a signed long) and any further narrow columns."""
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(text_col).alias("__t"), id_col, *more)
    rest = picked.drop("__t").schema

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in texts(b.column(0))), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), *b.columns[1:]],
                                             names=["fp", *b.schema.names[1:]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return picked.mapInArrow(run, f"fp long, {fields}")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the binary-reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def index(fps: np.ndarray, fan: int = FAN) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of (pattern, mask) over fingerprints in Gray order, leaves first.

    The mask of a node holds the bits on which its whole run agrees.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    pattern, mask = fps, np.full(len(fps), full)
    levels = [(pattern, mask)]
    while len(pattern) > 1:
        cut = np.arange(0, len(pattern), fan)
        one = np.bitwise_and.reduceat(pattern & mask, cut)
        zero = np.bitwise_and.reduceat(~pattern & mask, cut)
        pattern, mask = one, one | zero
        levels.append((pattern, mask))
    return levels


class Forest:
    """Labels of a bucket's fingerprints: the smallest index linked so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.label[a], self.label[b]
        new = x != y
        if not new.any():
            return
        pairs = np.unique(np.stack([np.minimum(x, y)[new], np.maximum(x, y)[new]], axis=1), axis=0)
        root: dict[int, int] = {}

        def find(i: int) -> int:
            top = i
            while top in root:
                top = root[top]
            while i in root:
                root[i], i = top, root[i]
            return top

        for p, q in pairs.tolist():
            p, q = find(p), find(q)
            if p != q:
                p, q = min(p, q), max(p, q)
                root[q] = p
                self.links.append((p, q))
        moved = np.arange(len(self.label))
        for q in root:
            moved[q] = find(q)
        self.label = moved[self.label]


def bucket_links(fps: np.ndarray, bits: int = BITS, fan: int = FAN) -> np.ndarray:
    """Links that span the components of distinct fingerprints within ``bits`` bits."""
    fps = fps[np.argsort(gray_rank(fps), kind="stable")]
    if len(fps) < 2:
        return np.empty((0, 2), np.uint64)
    levels, forest = index(fps, fan), Forest(len(fps))
    step = max(1, CHUNK // (fan * fan))
    runs: dict[int, tuple[int, np.ndarray]] = {}  # by level: links so far, each node's label or -1

    def linked(level: int) -> np.ndarray:
        if level not in runs or runs[level][0] != len(forest.links):
            cut = np.arange(0, len(fps), fan ** level)
            low, high = (f.reduceat(forest.label, cut) for f in (np.minimum, np.maximum))
            runs[level] = len(forest.links), np.where(low == high, low, -1)
        return runs[level][1]

    # Depth first over chunks of node pairs, so that few pairs wait at a time and later
    # ones can be skipped where all their leaves are in one component already.
    wait = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while wait:
        level, i, j = wait.pop()
        most = step if level else CHUNK
        if len(i) > most:
            wait.append((level, i[most:], j[most:]))
            i, j = i[:most], j[:most]
        label = linked(level)
        apart = (label[i] != label[j]) | (label[i] < 0)
        i, j = i[apart], j[apart]
        pattern, mask = levels[level]
        near = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= bits
        i, j = i[near], j[near]
        if not len(i):
            continue
        if level == 0:
            forest.link(i, j)
            continue
        below = len(levels[level - 1][0])
        kid = np.arange(fan)
        a, b = np.broadcast_arrays(i[:, None, None] * fan + kid[None, :, None],
                                   j[:, None, None] * fan + kid[None, None, :])
        ok = (a < below) & (b < below) & (a <= b)
        wait.append((level - 1, a[ok], b[ok]))
    links = np.array(forest.links, np.int64).reshape(-1, 2)
    return fps[links]


def block_masks(blocks: int, agree: int) -> list[int]:
    """One mask for each choice of ``agree`` of ``blocks`` nearly equal runs of 64 bits."""
    edge = [round(64 * k / blocks) for k in range(blocks + 1)]
    runs = [((1 << b) - (1 << a)) for a, b in zip(edge, edge[1:], strict=False)]
    return [sum(c) for c in combinations(runs, agree)]


def _schemes(n: int, bits: int) -> list[list[int]]:
    """Choices of blocks from the coarsest whose buckets are small for ``n`` even rows."""
    found = [block_masks(bits + a, a) for a in range(1, 9)]
    first = next((k for k, m in enumerate(found)
                  if n / 2 ** min(x.bit_count() for x in m) <= BUCKET_ROWS / 8), len(found) - 1)
    return found[first:]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _search(fps: DataFrame, masks: list[int], bits: int, limit: int | None) -> DataFrame:
    """Links of every bucket; members of a bucket over ``limit`` come back with ``b`` null."""
    keys = F.explode(F.array(*[
        F.struct(F.lit(k).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part"))
        for k, m in enumerate(masks)]))
    rows = (fps.select("fp", keys.alias("k")).select("k.c", "k.part", "fp")
            .repartition("c", "part").sortWithinPartitions("c", "part"))

    def out(pairs: np.ndarray) -> pa.RecordBatch:
        p = pairs.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    def over(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.nulls(len(x), pa.int64())],
                                          names=["a", "b"])

    def run(batches):
        key, held, size, large = None, [], 0, False
        for b in batches:
            c, part = b.column(0).to_numpy(), b.column(1).to_numpy()
            fp = b.column(2).to_numpy().view(np.uint64)
            cut = np.flatnonzero((c[1:] != c[:-1]) | (part[1:] != part[:-1])) + 1
            edges = [0, *cut.tolist(), len(fp)]
            links = []
            for s, e in zip(edges, edges[1:], strict=False):
                if s == e:
                    continue
                if (c[s], part[s]) != key:
                    if size > 1 and not large:
                        links.append(bucket_links(np.concatenate(held), bits))
                    key, held, size, large = (c[s], part[s]), [], 0, False
                held.append(fp[s:e])
                size += e - s
                if limit is not None and size > limit:
                    yield over(np.concatenate(held))
                    held, large = [], True
            links = [x for x in links if len(x)]
            if links:
                yield out(np.concatenate(links))
        if size > 1 and not large:
            yield out(bucket_links(np.concatenate(held), bits))

    return rows.mapInArrow(run, "a long, b long")


def near_links(fps: DataFrame, bits: int = BITS, limit: int = BUCKET_ROWS) -> DataFrame:
    """Links ``a``, ``b`` spanning the components of distinct fingerprints (column ``fp``)."""
    schemes = _schemes(fps.count(), bits)
    found = None
    for k, masks in enumerate(schemes):
        last = k == len(schemes) - 1
        made = stored(_search(fps, masks, bits, None if last else limit))
        links = made.where("b is not null")
        found = links if found is None else found.union(links)
        over = made.where("b is null")
        if last or over.isEmpty():
            return found
        fps = stored(over.select(F.col("a").alias("fp")).distinct())
    return found


def fingerprint_classes(prints: DataFrame, id_col: str = "doc_id", bits: int = BITS) -> DataFrame:
    """``fp``, ``component_id`` (smallest id of the component) for each distinct fingerprint.

    ``prints`` has ``fp`` and the id, and should be stored: it is read twice.
    """
    reps = stored(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    # Node order is that of signed longs: any total order serves.
    roots = components(near_links(reps.select("fp"), bits), "a", "b")
    placed = (reps.join(roots, reps["fp"] == roots["node"], "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    linked = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(linked, "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per document: id, ``fingerprint`` (hex) and ``component_id``."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle))
    classes = fingerprint_classes(prints, id_col, bits)
    return prints.join(classes, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One document of each component, all columns as they are.

    The document with the smallest id stays (of rows with that id, the one whose
    text has the smallest hash; of rows equal in both, one). Ids and hashes of all
    documents shuffle; texts shuffle once, to meet the decision.
    """
    named = F.xxhash64(F.col(text_col)).alias("__h")
    prints = stored(fingerprints(docs, id_col, text_col, shingle, named))
    classes = fingerprint_classes(prints, id_col, bits)
    rows = prints.join(classes, "fp").groupBy("root", F.col(id_col).alias("__id"), "__h").agg(
        F.count("*").alias("__n"))
    best = rows.groupBy("root").agg(F.min_by(
        F.struct("__id", "__h", "__n"), F.struct(F.col("__id").isNull(), "__id", "__h")).alias("k"))
    kept = stored(best.select("k.*"))

    def pick(keys: DataFrame) -> DataFrame:
        return docs.alias("d").join(
            keys.alias("k"), F.col(f"d.{id_col}").eqNullSafe(F.col("k.__id"))
            & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("k.__h")), "left_semi")

    out, twice = pick(kept), kept.where("__n > 1")
    if twice.isEmpty():
        return out
    return pick(kept.where("__n = 1")).union(pick(twice).dropDuplicates([id_col, text_col]))
