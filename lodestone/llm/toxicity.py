"""Operator 7: toxicity categories by a chain of linear classifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, lean, materialise, slices

WORD = re.compile(r"[^\W\d_]+")
#: Bound of training: labelled documents, the first by hash of the id. Kinds into which the toxic ones among them are split.
LABELLED, KINDS = 8_000, 2
#: A word is tried if, were all its documents toxic, chance would do that at most so often; shares of the chosen words that may be expected to be there by chance, of which the one with the least out-of-fold loss is taken.
TRIED, FALSE_SHARES = 1e-3, (0.05, 0.1, 0.2, 0.5)
FOLDS, THRESHOLD, PENALTY = 5, 0.5, 0.1


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Words:
    """Which words (columns) documents (rows) have, as pairs in order of rows."""

    row: np.ndarray
    column: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, x: np.ndarray) -> Words:
        return cls(*np.nonzero(x), x.shape)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.shape[0])

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, v[self.row], self.shape[1])

    def rows(self, chosen: np.ndarray) -> Words:
        here, number = chosen[self.row], np.cumsum(chosen) - 1
        return Words(number[self.row[here]], self.column[here], (int(chosen.sum()), self.shape[1]))


def logistic(x: Words, more: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 50) -> np.ndarray:
    """Weights of the words, then of the columns of more, then the bias, of a penalised logistic regression: Newton's method with conjugate gradients, so no matrix over all words is made."""
    more = np.hstack((more, np.ones((len(y), 1))))
    width = x.shape[1]
    ridge = np.full(width + more.shape[1], penalty)
    ridge[-1] = 1e-3
    times = lambda w: x.times(w[:width]) + more @ w[width:]
    back = lambda v: np.concatenate((x.back(v), more.T @ v))
    loss = lambda w: (np.logaddexp(0, z := times(w)) - y * z).sum() + 0.5 * ridge @ w**2
    w = np.zeros(len(ridge))
    now = loss(w)
    for _ in range(steps):
        p = _sigmoid(times(w))
        gradient, d = back(p - y) + ridge * w, np.maximum(p * (1 - p), 1e-9)
        scale = 1 / (ridge + np.concatenate((x.back(d), (more**2).T @ d)))
        step, left = np.zeros_like(w), -gradient
        aim, size = scale * left, left @ (scale * left)
        enough = 1e-16 * size
        for _ in range(2 * len(w) + 20):
            if size <= enough:
                break
            turned = back(d * times(aim)) + ridge * aim
            far = size / (aim @ turned)
            step, left = step + far * aim, left - far * turned
            ready = scale * left
            aim, size = ready + (left @ ready) / size * aim, left @ ready
        length = 1.0
        while (then := loss(w + length * step)) > now and length > 1e-6:
            length /= 2
        w, gain, now = w + length * step, now - then, then
        if gain < 1e-9 * (1 + abs(now)):
            break
    return w


@dataclass
class Chain:
    """Per category: weights of the vocabulary's words, then of the earlier categories' probabilities, then the bias."""

    categories: list[str]
    vocabulary: list[str]
    weights: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.hstack((out, _sigmoid(np.hstack((x, out)) @ w[:-1] + w[-1])[:, None]))
        return out


def fit(x: Words, y: np.ndarray, categories: list[str], vocabulary: list[str], folds: int = FOLDS, penalty: float = PENALTY) -> Chain:
    """Train the chain: each category's model gets the earlier categories' out-of-fold probabilities, so it learns how far to trust them.

    x has a row a document, y a column a category. Rows fall into folds by their position.
    """
    fold = np.arange(x.shape[0]) % folds
    earlier, weights = np.zeros((x.shape[0], 0)), []
    for k in range(y.shape[1]):
        weights.append(logistic(x, earlier, y[:, k], penalty))
        held_out = np.zeros(x.shape[0])
        for f in range(folds):
            test = fold == f
            if test.any():
                w = logistic(x.rows(~test), earlier[~test], y[~test, k], penalty)
                own = x.rows(test)
                held_out[test] = _sigmoid(own.times(w[: x.shape[1]]) + earlier[test] @ w[x.shape[1] : -1] + w[-1])
        earlier = np.hstack((earlier, held_out[:, None]))
    return Chain(list(categories), list(vocabulary), weights)


def kinds(x: Words, toxic: np.ndarray, most: int = KINDS) -> np.ndarray:
    """A kind for each toxic row, -1 for the others: k-means by cosine over the words, from documents with and without the words that most of them have."""
    own = x.rows(toxic)
    norm = np.sqrt(np.maximum(np.bincount(own.row, minlength=own.shape[0]), 1))
    kind, frequent = np.full(own.shape[0], most - 1), np.argsort(-np.bincount(own.column, minlength=x.shape[1]), kind="stable")
    for k in range(most - 2, -1, -1):
        if k < len(frequent):
            kind[own.row[own.column == frequent[k]]] = k
    for _ in range(50):
        middles = [np.bincount(own.column, (kind == k)[own.row] / norm[own.row], x.shape[1]) for k in range(most)]
        near = np.array([own.times(m / max(np.linalg.norm(m), 1e-12)) for m in middles]).argmax(0) if len(kind) else kind
        if (near == kind).all():
            break
        kind = near
    out = np.full(x.shape[0], -1)
    out[toxic] = kind
    return out


def significant(counts: list[tuple[str, int, int]], p: float, tried: int, false_share: float) -> list[str]:
    """Of words (word, toxic documents, documents), which toxic documents have more often than chance, those that stand out among the number that was tried: the false discovery rate is held by the step-up rule of Benjamini and Hochberg."""
    chance = {}
    for word, a, b in counts:
        if a > b * p:
            chance[word] = -(a * np.log(a / (b * p)) + ((b - a) * np.log((b - a) / (b * (1 - p))) if a < b else 0.0))
    ranked = sorted(chance, key=lambda w: (chance[w], w))
    last = max((k for k, w in enumerate(ranked, 1) if chance[w] <= np.log(false_share * k / max(tried, 1)) + 1e-9), default=0)
    return ranked[:last]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", labelled: int = LABELLED, most: int = KINDS) -> Chain:
    """Fit on at most ``labelled`` labelled documents, the first by hash of doc_id.

    The vocabulary is the words that significantly many toxic documents of the sample have, however many these are, counted there in full; how sure that must be is chosen by the loss on folds
    that had no part in choosing words or weights. The categories are learned, too: toxic documents are
    split into ``most`` kinds by the words they share, and the chain goes from kind to kind to the label itself. A document with
    differing labels counts as toxic; of an id with several texts the least counts; null ids, texts and labels are no examples. Without examples of both sorts the chain gives every text a probability of 0.
    """
    names = [*(f"kind_{k + 1}" for k in range(most)), label]
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    marks = marks.sort(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    marks = F.broadcast(marks) if labelled <= 100_000 else marks  # rows of 12 bytes
    texts = docs.select("doc_id", "text").where("text is not null").join(marks, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(words(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["doc_id", "label", "words"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, words array<string>"
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    sets = materialise(texts.mapInArrow(split, schema).select("doc_id", "label", "words", fold), "labelled-words")
    sizes = {r.fold: (int(r.n1), r.n) for r in sets.groupBy("fold").agg(F.sum("label").alias("n1"), F.count("label").alias("n")).collect()}
    n1, n = (sum(x) for x in zip(*sizes.values())) if sizes else (0, 0)
    if not 0 < n1 < n:
        return Chain(names, [], [np.array([0.0] * k + [-40.0]) for k in range(len(names))])
    least = int(np.ceil(np.log(TRIED) / np.log(n1 / n)))
    by_fold = [F.sum(F.when(F.col("fold") == f, v).otherwise(0)).alias(f"{c}{f}") for f in range(FOLDS) for c, v in (("a", F.col("label")), ("b", F.lit(1)))]
    counts = sets.select("fold", "label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("a"), F.count("label").alias("b"), *by_fold).where(F.col("b") >= least)
    counts = materialise(counts, "word-counts")
    tried = counts.agg(F.count("*").alias("all"), *(F.sum((F.col("b") - F.col(f"b{f}") >= least).cast("int")).alias(str(f)) for f in range(FOLDS))).first()
    over = counts.where(F.col("a") > F.col("b") * (n1 / n)).collect()

    def choose(share: float, without: int | None = None) -> list[str]:
        if without is None:
            return significant([(r.word, r.a, r.b) for r in over], n1 / n, tried["all"], share)
        m1, m = (x - y for x, y in zip((n1, n), sizes.get(without, (0, 0))))
        left = [(r.word, r.a - r[f"a{without}"], b) for r in over if (b := r.b - r[f"b{without}"]) >= least]
        return significant(left, m1 / m, int(tried[str(without)] or 0), share) if 0 < m1 < m else []

    by_share = {share: [choose(share, f) for f in range(FOLDS)] for share in FALSE_SHARES}
    whole = {share: choose(share) for share in FALSE_SHARES}
    wanted = frozenset(w for folds in by_share.values() for f in folds for w in f) | frozenset(w for f in whole.values() for w in f)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[w for w in ws if w in wanted] for ws in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string())), batch.column(3)], ["doc_id", "label", "words", "fold"])

    rows = sets.select("doc_id", "label", "words", "fold").mapInArrow(keep, schema + ", fold int").sort("doc_id").collect()
    discard(sets, counts)
    toxic, folds = np.array([r.label for r in rows], bool), np.array([r.fold for r in rows])

    def matrix(chosen: list[str]) -> Words:
        number = {w: i for i, w in enumerate(chosen)}
        at = [(i, number[w]) for i, row in enumerate(rows) for w in row.words if w in number]
        return Words(np.array([i for i, _ in at], int), np.array([w for _, w in at], int), (len(rows), len(chosen)))

    def loss(share: float) -> float:
        total, none = 0.0, np.zeros((len(rows), 0))
        for f, chosen in enumerate(by_share[share]):
            test, x = folds == f, matrix(chosen)
            if test.any() and not test.all():
                w = logistic(x.rows(~test), none[~test], toxic[~test].astype(float))
                z = x.rows(test).times(w[:-1]) + w[-1]
                total += float((np.logaddexp(0, z) - toxic[test] * z).sum())
        return total

    chosen = whole[min(FALSE_SHARES, key=loss)]
    x = matrix(chosen)
    kind = kinds(x, toxic, most)
    return fit(x, np.column_stack([*(kind == k for k in range(most)), toxic]).astype(float), names, chosen)


def _score(texts: list[str | None], chain: Chain, number: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(number)))
    known = number.keys()
    for i, text in enumerate(texts):
        if text:
            x[i, [number[w] for w in words(text) & known]] = 1
    return chain.probabilities(x)


def classify(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, a probability p_<category> for each category, is_toxic) of every row, in one pass without a shuffle.

    is_toxic: the last category's probability is at least ``threshold``. A null text has null probabilities and isn't toxic; an empty one gets the
    models' biases. Words are taken from whole texts. Repeated rows give repeated rows, a null id stays, an empty table gives none; further
    columns are ignored.
    """
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(chain.vocabulary)}
        for batch in slices(batches):
            p = _score(batch.column(1).to_pylist(), chain, number)
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, mask=null) for c in p.T.copy()), pa.array((p[:, -1] >= threshold) & ~null)], ["doc_id", *names, "is_toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, {', '.join(f'{n} double' for n in names)}, is_toxic boolean")


def clean(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that classify() doesn't call toxic, with all their columns, in one pass.

    Null texts stay, as do empty ones unless the biases alone call them toxic; rows with a null id are judged like any other, repeated rows stay or go together, an empty table gives none.
    """
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(chain.vocabulary)}
        for batch in slices(batches):
            text = batch.column(at_text)
            toxic = (_score(text.to_pylist(), chain, number)[:, -1] >= threshold) & ~text.is_null().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(~toxic))

    return docs.mapInArrow(lean(run), docs.schema)
