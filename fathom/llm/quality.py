"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is read as its distinct chunks between white space; a chunk gives its word, the word's
beginnings and its marks as features, so a chunk's weight is remembered, and a feature counts the
distinct chunks that have it. Coarse shares of shapes and of repetition come on top.

Grades: 0 poor, 1 well-formed but toxic, 2 good; the lowest of a document's labels counts, and
labels with a null id or no quality are left out (a null toxic counts as 0). One score, the sum of
shared weights over the hashed features of a text, meets ordered thresholds:
P(grade <= j) = sigmoid(threshold_j - score). The expected grade ranks documents and the tail
probability P(grade >= 2) selects them.

The model is fitted on at most FIT_ROWS labelled documents, those with the lowest hash of the id. Which
features tell the grades apart is counted by Spark, and only those of each document reach the driver. Every document is then scored whole, in one narrow
pass with the weights (1 MB) broadcast.

A null or empty text has no features and gets the intercept's grade. With no labels at all, the
weights are zero and everything is kept. Ties, repeated rows and empty tables are plain cases;
columns that bear an output's name are replaced.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import cut, ready

FIT_ROWS = 8000
DIMENSIONS = 1 << 18
#: Features seen in fewer fitted documents carry no weight, nor do those whose share above each
#: threshold is within so many standard errors of the overall one: 0.42 log2(documents), and this at most.
LEAST_SEEN, MOST_TELLING = 5, 5.5
GRADES = 3
KEEP = 0.6
STEPS, RATE, DECAY = 600, 0.05, 1e-5
#: Chunks whose features a worker remembers; it starts anew beyond that.
REMEMBERED = 300_000
#: Lengths of word beginnings that are features too: inflected words share them.
STEMS = (4, 5, 6)

# What is stripped from a chunk's ends to find its word.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’…–—¡¿"
_SHARES = (0.02, 0.1, 0.25, 0.5, 0.8)
_SHAPES = ("upper", "title", "marks", "digits", "plain")


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % DIMENSIONS


def chunk_features(chunk: str) -> tuple[list[str], int]:
    """The features of a run without white space, and the number of its shape."""
    word = chunk.strip(MARKS)
    out = []
    if len(word) < len(chunk):
        out.append((chunk[len(word) :] if chunk.startswith(word) else chunk.replace(word, " ", 1))[:8] if word else chunk[:8])
    if not word:
        return out, 2
    low = word.lower()
    out.append(f"{low}-")
    out += [low[:k] for k in STEMS if len(low) > k]
    doubled = len(chunk) - len(word) > 1
    return out, 3 if word[0].isdigit() else 0 if len(word) > 1 and word.isupper() else 2 if doubled else 1 if word[0].isupper() else 4


def text_features(shapes: np.ndarray, n: int, distinct: int, top: int) -> list[str]:
    """Coarse features of a whole text: the shares of chunk shapes, repetition, and length."""
    shares = [*(shapes / n).tolist(), 1 - distinct / n, top / n]
    return [*(f"\x00{i}:{sum(s >= x for x in _SHARES)}" for i, s in enumerate(shares)), f"\x00n{n.bit_length()}"]


class Reader:
    """Turns texts into slots with counts, or into scores; remembers what it knows of chunks."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights
        self.known: dict[str, int] = {}
        self.slots: list[list[int]] = []
        self.values = array("d")
        self.shapes = array("b")

    def _learn(self, chunk: str) -> None:
        found, shape = chunk_features(chunk)
        slots = [slot(f) for f in found]
        self.known[chunk] = len(self.shapes)
        self.shapes.append(shape)
        if self.weights is None:
            self.slots.append(slots)
        else:
            self.values.append(float(sum(self.weights[i] for i in slots)))

    def _chunks(self, text: str) -> tuple[np.ndarray, list[int]]:
        """The numbers of the distinct chunks, and the slots of the whole text's features."""
        if len(self.known) > REMEMBERED:
            self.__init__(self.weights)
        counts = Counter(text.split())
        if not counts:
            return np.zeros(0, dtype=np.int64), []
        for c in [c for c in counts if c not in self.known]:
            self._learn(c)
        at = np.fromiter(map(self.known.__getitem__, counts), dtype=np.int64, count=len(counts))
        times = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
        n = int(times.sum())
        shapes = np.bincount(np.frombuffer(self.shapes, dtype=np.int8)[at], weights=times, minlength=len(_SHAPES))
        return at, [slot(f) for f in text_features(shapes, n, len(counts), int(times.max()))]

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(slots, counts): in how many distinct chunks of the text each feature occurs."""
        at, whole = self._chunks(text or "")
        return np.unique(np.array([*(i for c in at.tolist() for i in self.slots[c]), *whole], dtype=np.int32), return_counts=True)

    def score(self, text: str | None) -> float:
        at, whole = self._chunks(text or "")
        # Sorted, so that a text's score doesn't depend on what was read before.
        return float(np.sort(np.frombuffer(self.values, dtype=np.float64)[at]).sum() + sum(self.weights[i] for i in whole)) if len(at) else 0.0


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..., one column each."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Full-batch Adam on the log-likelihood of the cumulative logits; thresholds stay ordered."""
    weights, cuts = np.zeros(DIMENSIONS), np.array([-1.0, 0.0])
    if not rows:
        return Model(weights.astype(np.float32), np.array([-10.0, -10.0]))
    sizes = np.array([len(f) for f, _, _ in rows])
    # Slots and counts are kept in 32 bits until the few features that tell something are chosen.
    at = np.concatenate([np.asarray(f, dtype=np.int32) for f, _, _ in rows])
    times = np.concatenate([np.asarray(n, dtype=np.float32) for _, n, _ in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    y = np.array([g for _, _, g in rows])
    seen = np.bincount(at, minlength=DIMENSIONS)
    told = np.zeros(DIMENSIONS)
    for j in range(1, GRADES):
        high = (y >= j).astype(float)
        z = np.bincount(at, weights=(high - high.mean())[row], minlength=DIMENSIONS) / np.sqrt(np.maximum(seen, 1)) / max(high.std(), 1e-9)
        told = np.maximum(told, np.abs(z))
    limit = min(MOST_TELLING, 0.42 * np.log2(len(rows) + 1))
    used = ((seen >= LEAST_SEEN) & (told >= limit))[at]
    at, row, times = at[used].astype(np.int64), row[used].astype(np.int64), times[used].astype(np.float64)
    kept, at = np.unique(at, return_inverse=True)
    w = np.zeros(len(kept))
    cuts = np.array([-1.0, 0.0])  # the first threshold, and the log of the step to the second
    m, v = np.zeros(len(w) + 2), np.zeros(len(w) + 2)

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))

    for t in range(1, STEPS + 1):
        s = np.bincount(row, weights=w[at] * times, minlength=len(rows))
        low, gap = cuts[0], np.exp(cuts[1])
        a, b = sigmoid(low - s), sigmoid(low + gap - s)
        p = np.select([y == 0, y == 1], [a, b - a], 1 - b) + 1e-9
        da = np.select([y == 0, y == 1], [a * (1 - a), -a * (1 - a)], 0.0) / p
        db = np.select([y == 1, y == 2], [b * (1 - b), -b * (1 - b)], 0.0) / p
        ds = (da + db) / len(rows)  # of the loss by the score
        g = np.concatenate([np.bincount(at, weights=ds[row] * times, minlength=len(w)) + DECAY * w, [-(da + db).sum() / len(rows), -(db * gap).sum() / len(rows)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-2]
        cuts -= step[-2:]
    weights[kept] = w
    return Model(weights.astype(np.float32), np.array([cuts[0], cuts[0] + np.exp(cuts[1])]))


def graded(labels: DataFrame) -> DataFrame:
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def telling(found: DataFrame) -> list[int]:
    """The slots of found (grade, slots) that fit() gives a weight."""
    highs = [F.sum((F.col("grade") >= j).cast("long")) for j in range(1, GRADES)]
    whole = found.agg(F.count(F.lit(1)), *highs).first()
    rows = whole[0]
    if not rows:
        return []
    z = F.lit(0.0)
    for j in range(1, GRADES):
        mean = (whole[j] or 0) / rows
        z = F.greatest(z, F.abs(F.col(f"high{j}") - F.col("seen") * mean) / F.sqrt("seen") / max((mean * (1 - mean)) ** 0.5, 1e-9))
    limit = min(MOST_TELLING, 0.42 * float(np.log2(rows + 1)))
    counted = found.select("grade", F.explode("slots").alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("seen"), *[h.alias(f"high{j}") for j, h in enumerate(highs, 1)])
    return [r["slot"] for r in counted.where((F.col("seen") >= LEAST_SEEN) & (z >= limit * (1 - 1e-9))).select("slot").collect()]  # DIMENSIONS at most


def fit_on(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in batches:
            found = [reader.features(t) for t in b.column(1).to_pylist()]
            made = [pa.array([f[k] for f in found], type=pa.list_(pa.int32())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made, b.column(2)], names=["doc_id", "slots", "times", "grade"])

    # At most `most` ids, so this side is small whatever the tables' sizes.
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, slots array<int>, times array<int>, grade int")
    found = cut(rows.groupBy("doc_id").agg(F.max(F.struct("slots", "times")).alias("of"), F.first("grade").alias("grade")).select("doc_id", "of.*", "grade"))
    mask = np.zeros(DIMENSIONS, dtype=bool)
    mask[telling(found)] = True

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [(s[mask[s]], n[mask[s]]) for s, n in zip(*([np.asarray(x, dtype="<i4") for x in b.column(c).to_pylist()] for c in ("slots", "times")))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s.tobytes() + n.tobytes() for s, n in both], type=pa.binary()), b.column("grade")], names=["doc_id", "of", "grade"])

    kept = found.mapInArrow(told, "doc_id long, of binary, grade int").collect()
    return fit([(*np.frombuffer(r["of"], dtype="<i4").reshape(2, -1), r["grade"]) for r in sorted(kept, key=lambda r: r["doc_id"])])


OUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("keep", T.BooleanType())])


def rate(docs: DataFrame, model: Model, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """docs with score, expected_grade, tail_probability and keep."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop(*OUT.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value.weights)
        for b in batches:
            scores = np.array([reader.score(t) for t in b.column(text_col).to_pylist()], dtype=np.float64)
            tails = shared.value.tails(scores)
            made = [scores, tails.sum(axis=1), tails[:, -1], tails[:, -1] >= keep]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, made)], names=[*b.schema.names, *OUT.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *OUT.fields]))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return rate(docs.select("doc_id", "text"), fit_on(docs, labels)).drop("text")
