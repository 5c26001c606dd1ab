"""Quality of texts: naive Bayes support vectors over n-gram indicators.

Words are taken by their shape, so that the model holds for words it never saw: letters become a or A, digits
0, runs of one kind one sign, and a word equal to the one before it is marked. Features are the 1- to 3-grams of
shapes in SIZE buckets. A text is the indicator vector of its features, divided by its length; each feature is
scaled by its class log-count ratio, a linear hinge-loss model is fitted by dual coordinate descent, and the
margin becomes a score between 0 and 1 by a logistic curve that is fitted on margins of the other half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.llm import words

#: Buckets of n-grams, and the longest n-gram.
SIZE, LONGEST = 1 << 17, 3
#: Labelled rows that a model is fitted on, at most; those of the smallest hashes of their id are taken.
FIT_ROWS = 6000
#: A score from which a text is taken as good.
GOOD = 0.3

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_SAME = np.uint64(0xA24BAED4963EE407)


@dataclass(frozen=True)
class Model:
    """Weight of each bucket with the ratio in it, bias, and the curve from margins to scores."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all texts behind each other, repeats included, and len + 1 offsets."""
    data, offsets = words.text_bytes(column)
    hashes, first = words.hashes_of(data, offsets)
    kinds = _CLASS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (kinds[1:] != kinds[:-1]) | words.BLANK[data[1:]]
    inner = offsets[:-1]
    keep[inner[inner < len(data)]] = True
    shapes, _ = words.hashes_of(kinds[keep], np.append(0, np.cumsum(keep))[offsets], lower=words.AS_IS)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][first[:-1] < len(hashes)]] = False
    shapes = np.where(same, shapes ^ _SAME, shapes)
    parts, owners = [], []
    owner = np.repeat(np.arange(len(column)), np.diff(first))
    for n in range(1, LONGEST + 1):
        inside = words.within(first, n, len(shapes))
        parts.append((words.shingles(shapes, n, n)[inside] % np.uint64(SIZE)).astype(np.int64))
        owners.append(owner[:len(inside)][inside])
    owner, part = np.concatenate(owners), np.concatenate(parts)
    order = np.argsort(owner, kind="stable")
    return part[order], np.searchsorted(owner[order], np.arange(len(column) + 1))


def _distinct(part: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    stamp[part] = np.arange(len(part))
    return part[stamp[part] == np.arange(len(part))]


def _fit(rows: list[np.ndarray], good: np.ndarray, rounds: int = 12, cost: float = 1.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights with the ratios in them, and the bias, by dual coordinate descent over the hinge loss."""
    counts = np.ones((2, SIZE))
    for row, label in zip(rows, good, strict=True):
        counts[int(label), row] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = [ratio[row] / np.sqrt(max(len(row), 1)) for row in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    signs, duals = np.where(good, 1.0, -1.0), np.zeros(len(rows))
    weights, bias, random = np.zeros(SIZE), 0.0, np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(rows)):
            row, value = rows[i], values[i]
            slack = 1.0 - signs[i] * (weights[row] @ value + bias)
            dual = min(max(duals[i] + slack / norms[i], 0.0), cost)
            if (step := (dual - duals[i]) * signs[i]) != 0.0:
                weights[row] += step * value
                bias += step
                duals[i] = dual
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return weights * ratio, bias


def _curve(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Logistic curve through the margins by Newton steps, with smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -35, 35)))
        miss, weight = target - p, p * (1 - p) + 1e-9
        a, b, c = (weight * margins * margins).sum() + 1e-6, (weight * margins).sum(), weight.sum() + 1e-6
        x, y = (miss * margins).sum() - 1e-6 * slope, miss.sum()
        det = a * c - b * b
        if det <= 0:
            break
        dx, dy = (c * x - b * y) / det, (a * y - b * x) / det
        slope, shift = slope + dx, shift + dy
        if abs(dx) + abs(dy) < 1e-8:
            break
    return (slope, shift) if slope > 0 and np.isfinite(slope + shift) else (1.0, 0.0)


def train(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """Model of distinct feature rows. Without rows of both labels every text gets the share of good rows."""
    share = (good.sum() + 1) / (len(good) + 2)
    if good.all() or not good.any():
        return Model(np.zeros(SIZE), 0.0, 1.0, float(np.log(share / (1 - share))))
    margin = lambda weights, bias, row: weights[row].sum() / np.sqrt(max(len(row), 1)) + bias
    margins, half = np.zeros(len(rows)), np.arange(len(rows)) % 2 == 0
    for part in (half, ~half):
        if good[part].all() or not good[part].any():
            part = np.ones(len(rows), bool)
        fit = _fit([rows[i] for i in np.flatnonzero(part)], good[part])
        for i in np.flatnonzero(~part if not part.all() else part):
            margins[i] = margin(*fit, rows[i])
    weights, bias = _fit(rows, good)
    return Model(weights, bias, *_curve(margins, good))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fits on docs(doc_id, text) and labels(doc_id, quality); labels must hold training rows only.

    At most `rows` labelled ids are used. Ids labelled more than once count as good if half of their labels are;
    null ids or labels take no part, a null text is empty. Features are made where the texts are; only their
    buckets and then one model of fixed size move.
    """
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stamp = np.zeros(SIZE, np.int64)
        for batch in batches:
            part, offsets = features(batch.column(2))
            found = [_distinct(part[a:b], stamp) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "good", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(((row["doc_id"], row["good"], row["features"]) for batch in batches for row in batch.to_pylist()))
        made = train([np.array(x[2], np.int64) for x in held], np.array([x[1] for x in held], bool))
        yield pa.RecordBatch.from_pydict({"weights": [made.weights.astype("<f8").tobytes()], "bias": [made.bias],
                                          "slope": [made.slope], "shift": [made.shift]})

    chosen = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
              .agg((F.avg("quality") >= 0.5).alias("good"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "good", "text")
    found = known.mapInArrow(extract, "doc_id long, good boolean, features array<int>")
    row = (found.repartition(1).mapInArrow(learn, "weights binary, bias double, slope double, shift double")).first()
    if row is None:
        return train([], np.zeros(0, bool))
    return Model(np.frombuffer(bytes(row["weights"]), "<f8"), row["bias"], row["slope"], row["shift"])


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of docs, and the score of each whole text; a null text is scored as an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [*docs.columns, score]
    if score in docs.columns:
        raise ValueError(f"there is a column {score} already")
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, stamp = held.value, np.zeros(SIZE, np.int64)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for begin in range(0, batch.num_rows, 256):
                part, offsets = features(batch.column(place).slice(begin, 256))
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    row = _distinct(part[a:b], stamp)
                    scores[begin + i] = model.weights[row].sum() / np.sqrt(max(len(row), 1)) + model.bias
            scores = 1 / (1 + np.exp(-np.clip(model.slope * scores + model.shift, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names)

    kind = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, kind)


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows that may be learnt from: those whose crc32 of the id as text does not divide by 5."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def keep_good(docs: DataFrame, model: Model, least: float = GOOD) -> DataFrame:
    """The rows of docs whose texts score at least `least`, with the columns of docs."""
    name = "score"
    while name in docs.columns:
        name = "_" + name
    return scored(docs, model, score=name).where(F.col(name) >= least).drop(name)
