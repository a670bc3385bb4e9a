"""Quality classifier from positive and unlabelled texts.

A linear model over binned counts of each whole text is fitted by minimising the non-negative unbiased risk: trusted
positives estimate the risk on good texts, all unlabelled texts minus the positives' share estimate the risk on bad ones,
and that estimate is kept from falling below zero. The class prior is estimated from values of positives and unlabelled
texts alone: where few unlabelled texts but good ones reach, the shares of both that do have its ratio.

Counts are taken where texts are read, once, byte by byte in vectorised passes, and stored. Labelled rows, of which at
most ``FIT_ROWS`` of each kind are used, give the bins, a first fit and the scale that turns a value into a probability.
Every unlabelled row takes part in each further step and in the prior, by sums over tasks.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Labelled rows of each kind (positive, any) that a fit uses at most: those of the smallest hashes of their ids.
FIT_ROWS = 8_000
BINS = 12
#: Rounds of the fit: in each a prior is estimated, and steps are taken, each of them a pass over the binned counts.
ROUNDS, STEPS, RATE, DECAY = 2, 12, 0.05, 1e-4
#: Steps of the first fit, on labelled rows alone.
FIRST_STEPS, FIRST_RATE = 50, 0.05
#: Cells of the histogram of values by which the prior is estimated, over values from -REACH to REACH.
CELLS, REACH = 2000, 40.0
#: The prior's error bounds hold with a probability of 1 - DELTA.
DELTA = 0.1
#: The share of the positives' risk that the estimate for bad texts may fall below zero before it is pushed back.
SLACK = 0.0
FOLDS, HELD_OUT = 4, 2

# Classes of bytes; a continuation byte belongs to no character of its own.
SPACE, NEWLINE, DIGIT, UPPER, LOWER, STOP, SYMBOL, OTHER_MARK, FOREIGN, INNER = range(10)
#: Names of the features, in order.
FEATURES = (
    "log_words", "word_length", "upper", "digit", "stop", "symbol", "mark", "foreign", "line_length",
    "distinct_words", "top_word", "distinct_lines", "adjacent_repeats", "pipe", "capital_words", "short_words",
)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER_MARK, np.uint8)
    out[[32, 9, 11, 12, 13]], out[10] = SPACE, NEWLINE
    out[48:58], out[65:91], out[97:123] = DIGIT, UPPER, LOWER
    out[[ord(c) for c in ".,;:?'-"]] = STOP
    out[[ord(c) for c in "#*$%&<>|@~^=_\\{}[]"]] = SYMBOL
    out[128:192], out[192:] = INNER, FOREIGN
    return out


CLASSES = _classes()


def text_features(text: bytes) -> list[float]:
    """Shares and means of one whole text, the same for a text of any length."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(CLASSES[np.frombuffer(text, np.uint8)], minlength=10)
    chars = len(text) - counts[INNER]
    solid = max(1, chars - counts[SPACE] - counts[NEWLINE])
    lines = [x for x in text.split(b"\n") if x.strip()]
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    capitals = sum(map(bytes.isupper, words))
    short = sum(len(w) < 4 for w in words)
    return [
        float(np.log1p(n)), solid / n, counts[UPPER] / solid, counts[DIGIT] / solid, counts[STOP] / solid, counts[SYMBOL] / solid,
        counts[OTHER_MARK] / solid, counts[FOREIGN] / solid, n / len(lines), len(kinds) / n, max(kinds.values()) / n,
        len(set(lines)) / len(lines), repeats / n, text.count(b"|") / n, capitals / n, short / n,
    ]


@dataclass
class Model:
    edges: np.ndarray  # (features, bins - 1)
    weights: np.ndarray  # (features * bins + 1)
    scale: float
    shift: float
    prior: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        """The number of the bin of each feature, counted over all features."""
        bins = self.edges.shape[1] + 1
        return np.stack([np.searchsorted(e, x[:, k], "right") + bins * k for k, e in enumerate(self.edges)], axis=1)

    def value(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.binned(x)].sum(1) + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * self.value(x) + self.shift)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -60, 60)))


@dataclass
class Sums:
    """What a pass over unlabelled rows gives: how many there are, sums of the loss and of slopes by bin, values by cell."""

    rows: float
    loss: float
    slopes: np.ndarray
    cells: np.ndarray

    @staticmethod
    def of(bins: np.ndarray, w: np.ndarray) -> Sums:
        v = w[bins].sum(1) + w[-1]
        q = _sigmoid(v)
        slopes = np.bincount(bins.ravel(), np.repeat(q * (1 - q), bins.shape[1]), len(w))
        slopes[-1] = (q * (1 - q)).sum()
        return Sums(float(len(bins)), float(q.sum()), slopes, np.bincount(_cells(v), minlength=CELLS).astype(float))


def _cells(values: np.ndarray) -> np.ndarray:
    return np.clip((values + REACH) * (CELLS / (2 * REACH)), 0, CELLS - 1).astype(np.int64)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of good texts among unlabelled ones, from counts of values by cell.

    If good texts are spread among the unlabelled as the positives are, the share of unlabelled texts from a value on
    is at least the prior times that of the positives. The value where the bound, with the error of both shares, is
    least gives the estimate.
    """
    n, m = positive.sum(), unlabelled.sum()
    if not n or not m:
        return 0.5
    p, u = positive[::-1].cumsum() / n, unlabelled[::-1].cumsum() / m
    slack = np.sqrt(np.log(4 / DELTA) / 2) * (1 / np.sqrt(n) + 1 / np.sqrt(m))
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(p > 0, (u + slack) / p, np.inf)
    best = int(bound.argmin())
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def risk_gradient(positive: Sums, unlabelled: Sums, prior: float) -> np.ndarray:
    """The gradient of the non-negative risk, by the sigmoid loss; of the bad texts' part alone, upwards, where that is below zero."""
    good, every = (s.slopes / s.rows for s in (positive, unlabelled))
    bad = unlabelled.loss / unlabelled.rows - prior * positive.loss / positive.rows
    bad_gradient = every - prior * good
    return -prior * good + bad_gradient if bad >= -SLACK else -bad_gradient


class _Descent:
    """Steps of Adam on the weights."""

    def __init__(self, w: np.ndarray, rate: float):
        self.w, self.rate, self.step = w, rate, 0
        self.first, self.second = np.zeros_like(w), np.zeros_like(w)

    def go(self, positive: Sums, unlabelled: Sums, prior: float) -> None:
        g = risk_gradient(positive, unlabelled, prior) + DECAY * self.w
        self.step += 1
        self.first = 0.9 * self.first + 0.1 * g
        self.second = 0.999 * self.second + 0.001 * g * g
        self.w -= self.rate * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8)


def fit(positive: np.ndarray, labelled: np.ndarray, labels: np.ndarray, sums) -> Model:
    """A model from features of positive and labelled texts, and of unlabelled ones by ``sums`` (model to Sums).

    Without positive or unlabelled texts all texts score alike: by the share of good ones among the labelled.
    """
    share = float(np.clip((labels.sum() + 1) / (len(labels) + 2), 0.01, 0.99))
    both = np.concatenate([positive, labelled]) if len(positive) + len(labelled) else np.zeros((1, len(FEATURES)))
    # half of the bins part all texts evenly, half part the values that few texts have
    even, tails = np.linspace(0, 1, BINS // 2 + 1)[1:-1], np.array([0.005, 0.02, 0.05, 0.95, 0.98, 0.995])
    edges = np.quantile(both, np.sort(np.r_[even, tails]), axis=0).T
    model = Model(edges, np.zeros(len(FEATURES) * (edges.shape[1] + 1) + 1), 1.0, 0.0, share)
    w = model.weights
    if not len(positive) or not sums(model).rows:
        model.scale, model.shift = 0.0, float(np.log(share / (1 - share)))
        return model
    p, known = model.binned(positive), model.binned(labelled)
    first = _Descent(w, FIRST_RATE)
    for _ in range(FIRST_STEPS):
        first.go(Sums.of(p, w), Sums.of(known, w), share)
    for _ in range(ROUNDS):
        model.prior = estimated_prior(Sums.of(p, w).cells, sums(model).cells)
        descent = _Descent(w, RATE)
        for _ in range(STEPS):
            descent.go(Sums.of(p, w), sums(model), model.prior)
    _calibrate(model, model.value(labelled), labels)
    return model


def _calibrate(model: Model, value: np.ndarray, labels: np.ndarray) -> None:
    """Scale and shift by logistic regression of the labels on the value, with a small pull to scale 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = _sigmoid(a * value + b)
        r, s = q - labels, q * (1 - q) + 1e-6
        g = np.array([(r * value).sum() + 0.1 * (a - 1), r.sum() + 0.1 * b])
        h = np.array([[(s * value * value).sum() + 0.1, (s * value).sum()], [(s * value).sum(), s.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.scale, model.shift = max(float(a), 1e-3), float(b)


def fold_of(doc_id) -> int:
    """The fold of a document: its id as text, by crc32. A null id is in fold 0."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS if doc_id is not None else 0


def fold_column(name: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(name).cast("string"), "UTF-8")), F.lit(FOLDS)), F.lit(0))


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model of ``labels.quality`` over ``docs`` (doc_id, text), from folds other than ``HELD_OUT``."""
    return learn_from(measure(docs), labels, rows)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for each row of ``docs`` (doc_id, text): the features of its text, stored."""
    return stored(_measured(docs, ["doc_id"]), "features")


def learn_from(features: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """``learn`` from what ``measure`` gives.

    Positives are rows labelled 1 and not toxic; these and the labelled ones are bounded samples, chosen by id. Unlabelled are
    all rows without a label, outside of the held-out fold. A sum for each task reaches the driver in each step.
    """
    open_labels = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold_column() != HELD_OUT))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    )
    near = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = open_labels.orderBy(*near).limit(rows).withColumn("kind", F.lit("known"))
    trusted = open_labels.where("quality = 1 and toxic = 0").orderBy(*near).limit(rows).withColumn("kind", F.lit("trusted"))
    chosen = F.broadcast(known.union(trusted).select("doc_id", "quality", "kind"))  # 2 x rows at most
    found = features.where("doc_id is not null").join(chosen, "doc_id").orderBy("kind", *near, "x").collect()
    take = lambda kind: np.array([r["x"] for r in found if r["kind"] == kind], float).reshape(-1, len(FEATURES))
    marked = labels.where("doc_id is not null").select("doc_id").distinct()
    free = features.where(F.col("doc_id").isNotNull() & (fold_column() != HELD_OUT)).join(marked, "doc_id", "left_anti")
    binned = None

    def sums(model: Model) -> Sums:
        nonlocal binned
        if binned is None:
            binned = stored(_binned(free, model), "binned")
        return _summed(binned, model)

    labels_known = np.array([r["quality"] for r in found if r["kind"] == "known"], float)
    return fit(take("trusted"), take("known"), labels_known, sums)


def _binned(features: DataFrame, model: Model) -> DataFrame:
    """The bins of each row's features, two bytes each, many rows in one."""

    def work(batches):
        for batch in batches:
            if len(batch):
                bins = model.binned(_matrix(batch.column("x")))
                yield pa.RecordBatch.from_arrays([pa.array([bins.astype("<u2").tobytes()], pa.binary())], ["bins"])

    return features.select("x").mapInArrow(work, "bins binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(FEATURES))


def _summed(binned: DataFrame, model: Model) -> Sums:
    w = model.weights

    def work(batches):
        total = None
        for batch in batches:
            for raw in batch.column("bins").to_pylist():
                s = Sums.of(np.frombuffer(raw, "<u2").reshape(-1, len(FEATURES)).astype(np.int64), w)
                flat = np.r_[s.rows, s.loss, s.slopes, s.cells]
                total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    n = len(w)
    parts = sorted(r["sums"] for r in binned.mapInArrow(work, "sums binary").collect())  # a row a task, in one order
    flat = sum((np.frombuffer(bytes(p), float) for p in parts), np.zeros(2 + n + CELLS))
    return Sums(flat[0], flat[1], flat[2 : 2 + n], flat[2 + n :])


def _measured(docs: DataFrame, rest: list[str]) -> DataFrame:
    small_batches(docs.sparkSession)

    def work(batches):
        for batch in batches:
            x = [text_features(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(x, pa.list_(pa.float64()))], [*rest, "x"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.select(*rest, "text").mapInArrow(work, f"{kinds}, x array<double>")


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs`` (doc_id, text, any others).

    The score depends on the text alone, so copies and repeated rows score alike. A null text scores as an empty one,
    whose features are all 0. A null id is not held out. An empty table gives an empty table.
    """
    return score_features(_measured(docs, ["doc_id"]), model, threshold)


def score_features(features: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``score_quality`` from what ``measure`` gives."""
    kind = dict(features.dtypes)["doc_id"]

    def work(batches):
        for batch in batches:
            score = model.score(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = features.select("doc_id", "x").mapInArrow(work, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold_column() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
