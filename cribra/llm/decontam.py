"""Benchmark decontamination: a broadcast set of test n-grams over training windows.

Benchmark texts become windows of ``n`` consecutive normalised words (a shorter
text is one window). The distinct windows go to the executors as a hash set; each
document is cut into words, words outside the benchmark's vocabulary break it into
runs, and only windows inside such runs are looked up by a rolling hash. A hash hit
is verified word by word before it counts. A word inside any occurring window is hit.

The set is broadcast only while it holds at most ``block`` window words; a larger
benchmark is dealt by item into several blocks, and the documents are scanned once a
block, hit spans being merged per document at the end. So what is broadcast has a
fixed bound.

Defined cases: null and empty texts have no words and no hits; a benchmark item
without words has no window; items with equal text each count; benchmark rows that
repeat an item id are one item with the windows of all its rows; null item ids are
left out; a document row that occurs twice is returned twice; an empty benchmark
hits nothing. Only id and text columns are read, other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cribra.llm.common import small_batches, stored, texts

WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
ONE_IN = 20
#: Words over all windows that one broadcast set may hold.
BLOCK_WORDS = 4_000_000
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so its powers have inverses modulo 2**64


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of digits, letters and all non-ASCII characters."""
    return text.translate(_WORD).split()


@dataclass
class Windows:
    """The benchmark's windows: vocabulary, windows by length, and their items."""
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    items: dict[tuple[int, ...], dict[str, None]] = field(default_factory=dict)
    hashes: dict[int, np.ndarray] = field(default_factory=dict)

    def add(self, item: str, text: bytes, n: int) -> None:
        words = words_of(text)
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
        for i in range(max(1, len(ids) - n + 1) if ids else 0):
            self.items.setdefault(tuple(ids[i:i + n]), {})[item] = None

    def close(self) -> Windows:
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for w in self.items:
            by_length.setdefault(len(w), []).append(w)
        self.hashes = {k: np.unique(_rolling(np.array(v, np.uint64).ravel(), k)[::k])
                       for k, v in by_length.items()}
        return self


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = (ids + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every ``k`` consecutive ids."""
    x, out = _mixed(ids), np.zeros(max(0, len(ids) - k + 1), np.uint64)
    for j in range(k):
        out = out * _BASE + x[j:j + len(out)]
    return out


def hits_of(ids: np.ndarray, windows: Windows) -> tuple[np.ndarray, list[int], list[str]]:
    """Starts and lengths of the verified windows in one document, and their items."""
    runs = np.flatnonzero(np.diff(np.concatenate(([0], ids > 0, [0]))))
    starts, lengths, items = [], [], set()
    for s, e in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True):
        for k, known in windows.hashes.items():
            if e - s < k:
                continue
            h = _rolling(ids[s:e], k)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for i in np.flatnonzero(known[at] == h).tolist():
                found = windows.items.get(tuple(ids[s + i:s + i + k].tolist()))
                if found is not None:
                    starts.append(s + i)
                    lengths.append(k)
                    items.update(found)
    return np.array(starts, np.int64), lengths, sorted(items)


def spans_of(starts: np.ndarray, lengths: list[int]) -> list[tuple[int, int]]:
    """Disjoint word spans [start, end) covered by the windows."""
    spans: list[tuple[int, int]] = []
    for s, k in sorted(zip(starts.tolist(), lengths, strict=True)):
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], s + k))
        else:
            spans.append((s, s + k))
    return spans


def _shortest(windows: Windows) -> int:
    return min(windows.hashes, default=0)


def scan(text: bytes, windows: Windows) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Words, hit spans and items of one text."""
    words = words_of(text)
    if len(words) < _shortest(windows) or not windows.hashes:
        return len(words), [], []
    get = windows.vocabulary.get
    ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
    starts, lengths, items = hits_of(ids, windows)
    return len(words), spans_of(starts, lengths), items


def benchmark_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text",
                     n: int = WINDOW, block: int = BLOCK_WORDS) -> list[DataFrame]:
    """The items dealt into parts whose windows hold about ``block`` words at most."""
    rows = benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    # A text of L characters has at most L / 2 + 1 words, each in at most n windows.
    parts = max(1, -(-size * n // (2 * block)))
    return [rows.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == p) if parts > 1 else rows
            for p in range(parts)]


def load_windows(part: DataFrame, n: int = WINDOW) -> Windows:
    """The set of one block, built row by row on the driver."""
    made = Windows()
    for row in part.toLocalIterator():
        made.add(row["item"], (row["text"] or "").encode(), n)
    return made.close()


def _merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return spans_of(np.array([s for s, _ in spans], np.int64), [e - s for s, e in spans])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType()))]


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", n: int = WINDOW, block: int = BLOCK_WORDS) -> DataFrame:
    """The input's columns as ``c0, c1, ...`` and ``n_words``, ``spans``, ``items``; a scan a block.

    Columns go by place, so no name of the input can clash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    at, width = docs.columns.index(text_col), len(docs.columns)
    out = docs.toDF(*[f"c{k}" for k in range(width)])
    schema = T.StructType([*out.schema.fields, *_FOUND])
    for p, part in enumerate(benchmark_blocks(benchmark, item_col, item_text, n, block)):
        made = load_windows(part, n)
        # Plain containers: a broadcast value is unpickled without this package.
        sent = spark.sparkContext.broadcast((made.vocabulary, made.items, made.hashes))

        def run(batches, sent=sent, p=p):
            windows = Windows(*sent.value)
            for b in batches:
                found = [scan(t, windows) for t in texts(b.column(at))]
                spans, items = [x[1] for x in found], [x[2] for x in found]
                if p:
                    old_spans, old_items = (b.column(width + k).to_pylist() for k in (1, 2))
                    spans = [_merge_spans([(s["start"], s["end"]) for s in o] + x)
                             for o, x in zip(old_spans, spans, strict=True)]
                    items = [sorted({*o, *x}) for o, x in zip(old_items, items, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:width], pa.array([x[0] for x in found], pa.int64()),
                     pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _SPANS),
                     pa.array(items, pa.list_(pa.string()))], names=schema.names)

        if p:
            out = stored(out)  # one set in memory at a time
        out = out.mapInArrow(run, schema)
    return out


def _hit() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def _contaminated(one_in: int) -> F.Column:
    return (_hit() > 0) & (_hit() * one_in >= F.col("n_words"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                       n: int = WINDOW, one_in: int = ONE_IN, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit``, ``items``, ``spans``, ``contaminated``.

    ``items`` are the ids (as sorted strings) of items with an occurring window,
    ``spans`` the hit word ranges [start, end).
    """
    tagged = mark(docs.select(id_col, text_col), benchmark, text_col, item_col, item_text, n, block)
    return tagged.select(F.col("c0").alias(id_col), "n_words", _hit().alias("n_hit"), "items",
                         "spans", _contaminated(one_in).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                     item_col: str = "item_id", item_text: str = "text", n: int = WINDOW,
                     one_in: int = ONE_IN, block: int = BLOCK_WORDS) -> DataFrame:
    """The documents that are not contaminated, all columns as they are."""
    tagged = mark(docs, benchmark, text_col, item_col, item_text, n, block)
    return tagged.where(~_contaminated(one_in)).select(
        *[F.col(f"c{k}").alias(name) for k, name in enumerate(docs.columns)])


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of each span."""
    if not spans:
        return text
    kept = np.frombuffer(text.translate(_WORD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], kept, [0]))))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:starts[s]])
        at = int(ends[e - 1])
    return b"".join([*out, text[at:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", n: int = WINDOW,
                 block: int = BLOCK_WORDS) -> DataFrame:
    """All documents and columns, the text without its hit spans."""
    tagged = mark(docs, benchmark, text_col, item_col, item_text, n, block)
    at, width, names = docs.columns.index(text_col), len(docs.columns), docs.columns

    def run(batches):
        for b in batches:
            cols = list(b.columns[:width])
            spans = b.column(width + 1).to_pylist()
            new = [cut_spans(t, [(s["start"], s["end"]) for s in x]) if x else o
                   for t, x, o in zip(texts(cols[at]), spans, cols[at].cast(pa.binary()).to_pylist(),
                                      strict=True)]
            cols[at] = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return tagged.mapInArrow(run, docs.schema)
