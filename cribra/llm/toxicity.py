"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses. A lexicon gives each word a class (insult, threat,
target, negation, report, other) and a weight. Three transducers rewrite the class
sequence of a clause: negation turns an insult or threat within its reach into a
negated one, reported speech turns it into a reported one, target adds a mark where a
target and an insult or threat meet in one clause. They are composed into one
automaton once; its arcs multiply a word's weight, and the weight of a clause is the
sum along its path. The score of a text is a logistic curve of its clauses' weights.

Insult words are learned: a bounded sample of labelled documents gives each word and
word beginning its log-odds; entries over a threshold join the seed lists. The curve
is fitted to the same sample.

Defined cases: a null or empty text has no clause and gets the score of weight
zero; a null id is scored but never learned from; an id with several labels counts
with the smaller; a row that occurs twice is returned twice; without labels of both
classes the seed lists and a fixed curve are used. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribra.llm.common import fold, sample_labels, small_batches, stored, texts
from cribra.llm.quality import fit_curve

#: Labelled rows that the lexicon and the curve are learned from at most (the stated bound).
SAMPLE_ROWS = 30_000
THRESHOLD = 0.3
#: Least documents of label 1 with an entry, smoothing of its log-odds, least log-odds.
LEAST_DOCS, SMOOTH, LEAST_WEIGHT = 4, 2.0, 2.5
#: Lengths (bytes) of word beginnings that may become entries.
STEMS = (4, 5, 6, 7, 8)
SEED_WEIGHT, MOST_WEIGHT = 3.0, 6.0

# Seed lists (English); everything else is learned from labels.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb imbecile".split()
THREATS = "kill hurt destroy stab shoot strangle burn beat crush".split()
TARGETS = "you your yourself u they them he she him her people everyone".split()
NEGATIONS = "not never no don't isn't aren't wasn't won't nobody neither nor".split()
REPORTS = "said says claimed reported quoted wrote called according alleged".split()

_WORD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".!?;:\n" else
              c if c == 39 or 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = "o", "i", "t", "p", "n", "r", "#"
CLASSES = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END)


@dataclass(frozen=True)
class Transducer:
    """Arcs ``(state, input) -> (output, factor, next state)``; a missing arc copies its input."""
    start: str
    arcs: dict[tuple[str, str], tuple[str, float, str]]

    def step(self, state: str, symbol: str) -> tuple[str, float, str]:
        return self.arcs.get((state, symbol), (symbol, 1.0, state))

    def then(self, other: Transducer) -> Transducer:
        """Composition: the output of this one is the input of the other."""
        start, arcs = (self.start, other.start), {}
        todo, seen = [start], {start}
        while todo:
            a, b = state = todo.pop()
            for symbol in CLASSES:
                mid, f, a2 = self.step(a, symbol)
                out, g, b2 = other.step(b, mid)
                arcs[state, symbol] = (out, f * g, (a2, b2))
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return Transducer(start, arcs)


def negation(reach: int = 3, factor: float = 0.3) -> Transducer:
    """A negation weakens an insult or threat in the next ``reach`` words."""
    arcs = {}
    for k in range(reach + 1):
        arcs[f"n{k}", NEGATION] = (NEGATION, 1.0, f"n{reach}")
        arcs[f"n{k}", END] = (END, 1.0, "n0")
        for s in (OTHER, TARGET, REPORT):
            arcs[f"n{k}", s] = (s, 1.0, f"n{max(0, k - 1)}")
        for s in (INSULT, THREAT):
            arcs[f"n{k}", s] = (s, factor if k else 1.0, f"n{max(0, k - 1)}")
    return Transducer("n0", arcs)


def reported(factor: float = 0.6) -> Transducer:
    """A word of reporting weakens insults and threats in the rest of the clause."""
    arcs = {("plain", REPORT): (REPORT, 1.0, "told"), ("told", END): (END, 1.0, "plain")}
    for s in (INSULT, THREAT):
        arcs["told", s] = (s, factor, "told")
    return Transducer("plain", arcs)


def targeted(factor: float = 1.5, threat: float = 0.2) -> Transducer:
    """After a target insults and threats weigh more; a threat without one, little."""
    arcs = {("none", TARGET): (TARGET, 1.0, "target"), ("target", END): (END, 1.0, "none"),
            ("target", INSULT): (INSULT, factor, "target"), ("target", THREAT): (THREAT, factor, "target"),
            ("none", THREAT): (THREAT, threat, "none")}
    return Transducer("none", arcs)


def grammar() -> dict[tuple, tuple[float, int]]:
    """The composed automaton: numbered states, ``(state, class) -> (factor, next state)``."""
    made = negation().then(reported()).then(targeted())
    number = {made.start: 0}
    for _, _, target in made.arcs.values():
        number.setdefault(target, len(number))
    return {(number[s], c): (f, number[t]) for (s, c), (_, f, t) in made.arcs.items()}


@dataclass
class Model:
    """Entries by word and by word beginning, the automaton, and the logistic curve."""
    words: dict[bytes, tuple[str, float]] = field(default_factory=dict)
    stems: dict[bytes, float] = field(default_factory=dict)
    arcs: dict[tuple, tuple[float, int]] = field(default_factory=grammar)
    slope: float = 1.2
    shift: float = -2.2

    def lookup(self, word: bytes) -> tuple[str, float] | None:
        found = self.words.get(word)
        if found is None or found[0] == INSULT:
            weight = found[1] if found else 0.0
            for n in STEMS:
                if len(word) > n:
                    weight = max(weight, self.stems.get(word[:n], 0.0))
            found = (INSULT, weight) if weight else None
        return found

    def weight(self, text: bytes) -> float:
        """Log of the clauses' weights: the heaviest counts in full, the rest by their log."""
        total = most = 0.0
        memo = self.__dict__.setdefault("memo", {})
        if len(memo) > 200_000:
            memo.clear()
        for clause in text.translate(_WORD).split(b"\n"):
            path, hot = [], False
            for w in clause.split():
                if w not in memo:
                    memo[w] = self.lookup(w)
                got = memo[w]
                path.append(got)
                hot = hot or (got is not None and got[0] in (INSULT, THREAT))
            if not hot:
                continue  # only insults and threats have weight
            state, sum_ = 0, 0.0
            for got in path:
                kind, weight = got or (OTHER, 0.0)
                factor, state = self.arcs[state, kind]
                if kind in (INSULT, THREAT):
                    sum_ += factor * weight
            total += sum_
            most = max(most, sum_)
        return most + float(np.log1p(total - most)) if total else 0.0

    def score(self, weights: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * weights + self.shift, -50, 50)))


def seed_model() -> Model:
    words = {}
    for kind, listed in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS)):
        words |= {w.encode(): (kind, 0.0) for w in listed}
    for kind, listed in ((THREAT, THREATS), (INSULT, INSULTS)):
        words |= {w.encode(): (kind, SEED_WEIGHT) for w in listed}
    return Model(words)


def entries_of(text: bytes) -> set[bytes]:
    """Words of a text and, marked by ``*``, the beginnings of its longer words."""
    words = set(text.translate(_WORD).split())
    return words | {w[:n] + b"*" for n in STEMS for w in words if len(w) > n}


def copy_key(text: bytes) -> int:
    """Smallest hash of the word pairs: near copies mostly share it."""
    words = text.lower().split()
    if len(words) < 2:
        return xxhash.xxh3_64_intdigest(b" ".join(words))
    return min(xxhash.xxh3_64_intdigest(a + b" " + b) for a, b in zip(words, words[1:], strict=False))


def _picked(docs, labels, id_col, text_col, label_col, folds, held, bound) -> DataFrame:
    """Texts and labels of the sample, one of each group of near copies with one label.

    Copies would lend their chance words the counts of real evidence.
    """
    sample = sample_labels(labels, id_col, label_col, folds, held, bound)
    named = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))

    def run(batches):
        for b in batches:
            key = np.array([copy_key(t) for t in texts(b.column(0))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(1), b.column(2)],
                                             names=["key", "id", "label"])

    keys = (named.join(F.broadcast(sample), "__id").select("__text", "__id", "__label")
            .mapInArrow(run, "key long, id long, label int"))
    kept = stored(keys.groupBy("key", "label").agg(F.min("id").alias("__id"))
                  .select("__id", F.col("label").alias("__label")))
    return named.join(F.broadcast(kept), "__id").select("__text", "__label")


def _counts(rows: DataFrame, allowed=None) -> DataFrame:
    """Documents with each entry; each task counts before the shuffle."""
    def run(batches):
        # Bytes that are no whole characters (a cut beginning) travel as binary.
        for b in batches:
            count: Counter[bytes] = Counter()
            for t in texts(b.column(0)):
                found = entries_of(t)
                count.update(found if allowed is None else found & allowed.value)
            if count:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())],
                    names=["entry", "n"])

    return rows.select("__text").mapInArrow(run, "entry binary, n long").groupBy("entry").agg(
        F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", folds: int = 4, held: int = 2, bound: int = SAMPLE_ROWS) -> Model:
    """Learn lexicon and curve from at most ``bound`` labelled documents outside fold ``held``.

    Entries that come to the driver occur in ``LEAST_DOCS`` sampled documents of
    label 1, so their number is bounded by the sample.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = seed_model()
    rows = _picked(docs, labels, id_col, text_col, label_col, folds, held, bound)
    size = {r["__label"]: r["count"] for r in rows.groupBy("__label").count().collect()}
    if len(size) < 2:
        return model
    toxic = {bytes(r["entry"]): r["n"] for r in
             _counts(rows.where("__label = 1")).where(F.col("n") >= LEAST_DOCS).toLocalIterator()}
    allowed = spark.sparkContext.broadcast(set(toxic))
    clean = {bytes(r["entry"]): r["n"] for r in
             _counts(rows.where("__label = 0"), allowed).toLocalIterator()}
    share = size[1] / (size[0] + size[1])
    for entry, n in toxic.items():
        odds = np.log((n + SMOOTH * share) / (clean.get(entry, 0) + SMOOTH * (1 - share)))
        weight = min(float(odds - np.log(share / (1 - share))), MOST_WEIGHT)
        if weight < LEAST_WEIGHT:
            continue
        if entry.endswith(b"*"):
            model.stems[entry[:-1]] = weight
        elif model.words.get(entry, (INSULT,))[0] == INSULT:
            model.words[entry] = (INSULT, max(weight, model.words.get(entry, (INSULT, 0.0))[1]))
    sent = spark.sparkContext.broadcast((model.words, model.stems))

    def weigh(batches):
        m = Model(*sent.value)
        for b in batches:
            w = np.array([m.weight(t) for t in texts(b.column(0))], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(w), b.column(1)], names=["w", "label"])

    got = rows.mapInArrow(weigh, "w double, label int").toArrow()
    w, y = got.column("w").to_numpy(), got.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((y, w))
    model.slope, model.shift = fit_curve(w[order], y[order])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, ``weight``, ``score`` (0-1, higher is more toxic), ``predicted``."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((model.words, model.stems))
    slope, shift = model.slope, model.shift

    def run(batches):
        m = Model(*sent.value, slope=slope, shift=shift)
        for b in batches:
            w = np.array([m.weight(t) for t in texts(b.column(1))], dtype=np.float64)
            s = m.score(w)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(w), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=[id_col, "weight", "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, weight double, score double, predicted int")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "toxic", folds: int = 4,
                    held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """Fit and score: id, ``held_out``, ``score``, ``predicted``."""
    model = fit(docs, labels, id_col, text_col, label_col, folds, held)
    return score(docs, model, id_col, text_col, threshold).select(
        id_col, F.coalesce(fold(id_col, folds) == held, F.lit(False)).alias("held_out"),
        "score", "predicted")
