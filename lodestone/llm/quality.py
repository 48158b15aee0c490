"""Operator 5: quality classifier learned from trusted positives and unlabelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, lean, materialise, slices, utf8

#: Bound of the trusted positives, the first by hash of the id; the unlabelled side is all documents.
POSITIVES = 8_000
NAMES = ("symbols", "marks", "upper", "digits", "spaces", "doubled", "word_length", "length", "newlines", "stops", "repeats")

# Classes of bytes; letters are whatever is not ASCII, too.
_CLASS = np.zeros(256, np.uint8)
for _c, _bytes in enumerate((b"", b"#$%&*+/<=>@\\^_`{|}~[]", b"!?", bytes(range(65, 91)), b"0123456789", b" \t\r", b".,;:'\"()-", b"\n"), 0):
    _CLASS[list(_bytes)] = _c
_MIXED = np.random.default_rng(7).integers(1 << 20, 1 << 40, 256)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of len(NAMES) numbers for each text, from its UTF-8 bytes: shares of classes of bytes, doubled marks, words said twice in a row, mean word length and log length."""
    n = len(offsets) - 1
    sizes = np.maximum(np.diff(offsets), 1).astype(float)
    kinds = _CLASS[data]

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    symbols, marks, upper, digits, stops = (count(kinds == k) for k in (1, 2, 3, 4, 6))
    white, lines = kinds == 5, count(kinds == 7)
    gap = white | (kinds == 7)
    starts = ~gap
    starts[1:] &= gap[:-1]
    if len(starts):
        starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = ~gap[offsets[:-1][offsets[:-1] < offsets[1:]]]
    twice = np.zeros(len(kinds), bool)
    if len(kinds) > 1:
        twice[1:] = ((kinds[1:] == 1) | (kinds[1:] == 2)) & (data[1:] == data[:-1])
        twice[offsets[:-1][offsets[:-1] < len(data)]] = False  # not across texts
    words = np.maximum(count(starts), 1)
    again = np.zeros(len(kinds), bool)
    first = np.flatnonzero(starts)
    if len(first) > 1:  # a word's bytes, each as a pseudo-random number, summed: the same for the same word as the word before
        total = np.concatenate(([0], np.cumsum(np.where(gap, 0, _MIXED[data]), dtype=np.int64)))
        sums = np.diff(total[np.append(first, len(data))])
        row = np.searchsorted(offsets, first, side="right")
        again[first[1:]] = (sums[1:] == sums[:-1]) & (row[1:] == row[:-1])
    solid = np.maximum(sizes - count(gap), 1)
    out = np.empty((n, len(NAMES)))
    for k, column in enumerate((symbols / words, marks / words, upper / solid, digits / solid, count(white) / sizes, count(twice) / words, np.log1p(solid / words), np.log1p(sizes), lines / words, stops / words, count(again) / words)):
        out[:, k] = column
    return out


@dataclass
class Model:
    """A linear scorer over standardised features; a text is kept if its score is at least 0."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _minimise(value, size: int, steps: int, tolerance: float = 1e-7) -> np.ndarray:
    """Newton's method from zero within a trust region, with curvature taken as positive; value(w) gives value, gradient and Hessian, and is all that costs."""
    w, radius = np.zeros(size), 1.0
    now, gradient, hessian = value(w)
    for _ in range(steps):
        lengths, axes = np.linalg.eigh(hessian)
        lengths, along = np.abs(lengths), axes.T @ gradient
        low, high = 0.0, np.linalg.norm(gradient) / radius + 1e-12
        move = lambda damping: -along / np.maximum(lengths + damping, 1e-12)
        if np.linalg.norm(move(0.0)) > radius:
            for _ in range(50):
                low, high = (m, high) if np.linalg.norm(move(m := (low + high) / 2)) > radius else (low, m)
            step = move(high)
        else:
            step = move(0.0)
        hoped = -(along @ step + 0.5 * lengths @ step**2)
        if hoped < tolerance:
            break
        then, g, h = value(w + axes @ step)
        if then < now:
            radius *= 2 if now - then > 0.5 * hoped else 1
            w, now, gradient, hessian = w + axes @ step, then, g, h
        else:
            radius = min(radius, np.linalg.norm(step)) / 4
    return w


def _mean_sigmoid(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over rows of sigmoid(x @ w), its gradient and its Hessian, in one vector."""
    s = _sigmoid(x @ w)
    d = s * (1 - s)
    return np.concatenate(([s.sum()], x.T @ d, (x.T @ (x * (d * (1 - 2 * s))[:, None])).ravel()))


def _logistic(x: np.ndarray, w: np.ndarray, y: int) -> np.ndarray:
    """Sums over rows of the logistic loss, its gradient and its Hessian, in one vector."""
    z = x @ w
    s = _sigmoid(z)
    return np.concatenate(([(np.logaddexp(0, z) - y * z).sum()], x.T @ (s - y), (x.T @ (x * (s * (1 - s))[:, None])).ravel()))


def _apart(v: np.ndarray, size: int) -> tuple[float, np.ndarray, np.ndarray]:
    return v[0], v[1 : size + 1], v[size + 1 :].reshape(size, size)


def estimate_prior(positive: np.ndarray, total, steps: int = 30, confidence: float = 0.1) -> float:
    """Share of positives among the unlabelled rows; total(f) is the sum of f(rows with a last column of ones, half) over all of these, half being 0 or 1.

    A logistic model tells positives from unlabelled rows on one half of each; on the other half, among the rows that score highest, the share of
    unlabelled rows over the share of positives bounds the prior from above. The halves change places and shares are averaged, so every row counts.
    The least such bound, with a margin for the number of rows, is the estimate.
    """
    halves = positive[::2], positive[1::2]
    n = total(lambda x, half: np.array([(half == 0).sum(), (half == 1).sum()], float))
    if not len(halves[1]) or not n.all():
        return 0.5
    size = positive.shape[1]
    qp, qu = [], []
    for a, b in ((0, 1), (1, 0)):

        def value(w: np.ndarray) -> tuple:
            sums = 0.5 * _logistic(halves[a], w, 1) / len(halves[a]) + 0.5 * total(lambda x, half: _logistic(x[half == a], w, 0)) / n[a]
            v, g, h = _apart(sums, size)
            return v + 0.5e-4 * w @ w, g + 1e-4 * w, h + 1e-4 * np.eye(size)

        w = _minimise(value, size, steps)
        p = np.sort(halves[b] @ w)
        cuts = np.quantile(p, np.linspace(0, 0.95, 96))
        qp.append(1 - np.searchsorted(p, cuts) / len(p))
        qu.append(1 - total(lambda x, half: np.searchsorted(np.sort(x[half == b] @ w), cuts).astype(float)) / n[b])
    qp, qu = np.mean(qp, 0), np.mean(qu, 0)
    margin = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(halves[1])) + 1 / np.sqrt(n.min()))
    best = np.argmin((qu + margin) / np.maximum(qp, 1e-9))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """fit_sums() over rows in memory."""
    half = np.arange(len(unlabelled)) % 2
    return fit_sums(positive, lambda f: f(unlabelled, half), prior)


def fit_sums(positive: np.ndarray, total, prior: float | None = None, steps: int = 60, decay: float = 1e-4, soft: float = 2e-3) -> Model:
    """Minimise the non-negative unbiased risk  pi R_P(+) + max(0, R_U(-) - pi R_P(-))  with the sigmoid loss.

    The unlabelled rows are seen through total(f) alone, the sum of f(x, half) over all of them, so they may lie anywhere. The maximum is rounded
    off over ``soft``, so that it has derivatives. ``prior`` is estimated if it isn't given. Without positives or without unlabelled rows, all are kept.
    """
    width = positive.shape[1]
    middle = positive.mean(0) if len(positive) else np.zeros(width)
    sums = total(lambda x, half: np.concatenate(([len(x)], (x - middle).sum(0), ((x - middle) ** 2).sum(0))))
    n = sums[0]
    if not len(positive) or not n:
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 1.0, 1.0)
    spread = np.sqrt(np.maximum(sums[width + 1 :] / n - (sums[1 : width + 1] / n) ** 2, 0))
    scale = np.maximum(positive.std(0), 1e-3 + 0.05 * spread)
    ready = lambda x: np.hstack((np.clip((x - middle) / scale, -6, 6), np.ones((len(x), 1))))
    p, scaled = ready(positive), lambda f: total(lambda x, half: f(ready(x), half))
    pi = estimate_prior(p, scaled) if prior is None else prior
    ridge = decay * np.r_[np.ones(width), 0]

    def value(w: np.ndarray) -> tuple:
        vp, gp, hp = _apart(_mean_sigmoid(p, w) / len(p), width + 1)  # the loss of a score z is sigmoid(-z) as a positive, sigmoid(z) as a negative
        vu, gu, hu = _apart(scaled(lambda x, half: _mean_sigmoid(x, w)) / n, width + 1)
        rest, g, h = vu - pi * vp, gu - pi * gp, hu - pi * hp
        on = float(_sigmoid(np.array(rest / soft)))
        risk = pi * (1 - vp) + soft * np.logaddexp(0, rest / soft) + 0.5 * ridge @ w**2
        return risk, -pi * gp + on * g + ridge * w, -pi * hp + on * h + on * (1 - on) / soft * np.outer(g, g) + np.diag(ridge)

    w = _minimise(value, width + 1, steps)
    return Model(middle, scale, w[:-1], float(w[-1]), pi)


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features(*utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, prior: float | None = None) -> Model:
    """Fit on at most ``positives`` documents that labels call good, the first by hash of doc_id, and on all documents as the unlabelled rows.

    Features of all documents are written once; each step of the fit is a pass over them that brings a few sums a task to the driver. Where labels of
    a document differ, it isn't trusted. Null ids, texts and labels are no examples; of an id with several texts the one with the least features counts.
    """
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    rows = materialise(_featured(texts).groupBy("doc_id").agg(F.min("x").alias("x")).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")), "features")
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    known = good.sort(F.xxhash64("doc_id"), "doc_id").limit(positives)
    trusted = rows.join(F.broadcast(known) if positives <= 100_000 else known, "doc_id", "left_semi").sort("doc_id").select("x").collect()

    def total(f) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = None
            for batch in batches:
                if batch.num_rows:
                    sums = f(batch.column(0).flatten().to_numpy().reshape(-1, len(NAMES)), batch.column(1).to_numpy())
                    own = sums if own is None else own + sums
            if own is not None:
                yield pa.RecordBatch.from_arrays([pa.array([own.tolist()], pa.list_(pa.float64()))], ["sums"])

        parts = [r.sums for r in rows.select("x", "half").mapInArrow(lean(run), "sums array<double>").collect()]
        return np.sum(np.array(sorted(parts)), axis=0) if parts else f(np.zeros((0, len(NAMES))), np.zeros(0, int))

    model = fit_sums(np.array([r.x for r in trusted], float).reshape(-1, len(NAMES)), total, prior)
    discard(rows)
    return model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, keep) of every row, in one pass without a shuffle.

    keep is score >= 0. A null text has a null score and isn't kept; an empty text is scored by its features, like any other. Texts are measured whole.
    Repeated rows give repeated rows, a null id stays, an empty table gives none; further columns are ignored.
    """
    mean, scale, weights, bias = model.mean, model.scale, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(mean, scale, weights, bias, 0)
        for batch in slices(batches):
            score = own.score(features(*utf8(batch.column(1))))
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, mask=null), pa.array((score >= 0) & ~null)], ["doc_id", "score", "keep"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, score double, keep boolean")


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns, in one pass.

    A null text goes, an empty one stays or goes by its score, like any other; rows with a null id are judged like any other, repeated rows stay or go together, and an empty table gives none.
    """
    mean, scale, weights, bias = model.mean, model.scale, model.weights, model.bias
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(mean, scale, weights, bias, 0)
        for batch in slices(batches):
            text = batch.column(at_text)
            good = (own.score(features(*utf8(text))) >= 0) & ~text.is_null().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(lean(run), docs.schema)
