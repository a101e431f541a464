"""Logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs of letters and digits or runs of punctuation, as written.  Features are words and word
pairs, hashed into a fixed number of weights; a pair of equal words is one feature for all words.  A
text's value for a feature is its count over the root of the text's number of features, so long and
short texts have scores of one scale.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from assayer.llm import words

SAME = np.uint64(0x5D8A3C2E91B7F641)


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (with repeats) of texts one after another, and where each text's begin."""
    word, first = words.word_hashes(data, offsets, fold=False, by_kind=True)
    pair = words.mix(word[:-1] * words.PLACES[0] + word[1:] * words.PLACES[1]) if len(word) else word
    pair[word[:-1] == word[1:]] = SAME
    both = np.empty(2 * len(word), dtype=np.uint64)
    both[0::2] = word
    both[1:-1:2] = pair
    keep = np.ones(len(both), dtype=bool)
    last = first[1:][first[1:] > first[:-1]] - 1
    keep[2 * last + 1] = False  # no pair from one text's last word to the next text
    starts = 2 * first - np.searchsorted(last, first)
    return (both[keep] >> np.uint64(64 - bits)).astype(np.int64), starts


def margins(weights: np.ndarray, found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sparse dot products; ``weights`` has the bias behind its last feature."""
    total = np.concatenate([[0.0], np.cumsum(weights[found].astype(np.float64))])
    counts = np.diff(starts)
    return (total[starts[1:]] - total[starts[:-1]]) / np.sqrt(np.maximum(counts, 1)) + weights[-1]


def probabilities(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))


def score(texts: pa.Array, weights: np.ndarray, bits: int) -> np.ndarray:
    """The probability of label 1 for each text; null and empty texts get that of the bias."""
    out = [np.zeros(0)]
    for _, data, offsets in words.slices(texts):
        out.append(probabilities(margins(weights, *features(data, offsets, bits))))
    return np.concatenate(out)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with L1 and L2 terms, one example at a time.

    Several models that see the same examples in the same order, each with labels of its own, are one table.
    """

    def __init__(self, size: int, models: int = 1, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-3):
        self.z, self.n = np.zeros((size, models)), np.zeros((size, models))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, value: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        w, n = self.weights(at), self.n[at]
        g = value[:, None] * (weight * (probabilities(value @ w) - label))
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train_many(found: list[np.ndarray], labels: np.ndarray, bits: int, passes: int = 4, seed: int = 5) -> np.ndarray:
    """:func:`train_sparse` from feature numbers with repeats; a value is a count over the root of all."""
    rows = []
    for f in found:
        at, count = np.unique(f, return_counts=True)
        rows.append((at, count / np.sqrt(max(1, len(f)))))
    return train_sparse(rows, labels, bits, passes, seed)


def train_sparse(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int, passes: int = 4, seed: int = 5) -> np.ndarray:
    """Weights (bias last), a column a model, from distinct feature numbers with values, and labels (rows by models).

    The examples are a bounded sample.  The rarer label's examples weigh more, up to fourfold, so that it is
    not drowned.
    """
    size = 1 << bits
    model = Ftrl(size + 1, labels.shape[1])
    rows = [(np.append(at, size).astype(np.int32), np.append(value, 1.0).astype(np.float32)) for at, value in rows]
    ones = labels.sum(axis=0)
    few, many = np.minimum(ones, len(rows) - ones), np.maximum(ones, len(rows) - ones)
    weight = np.where(labels == (ones < len(rows) - ones), np.minimum(4.0, np.maximum(many, 1) / np.maximum(few, 1)), 1.0)
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            model.learn(*rows[i], labels[i], weight[i])
    return model.weights()


def train(examples: list[tuple[np.ndarray, int]], bits: int, passes: int = 4, seed: int = 5) -> np.ndarray:
    """Weights (bias last) of one model from ``(feature numbers with repeats, label)``."""
    labels = np.array([label for _, label in examples], dtype=np.int64).reshape(-1, 1)
    return train_many([found for found, _ in examples], labels, bits, passes, seed)[:, 0]
