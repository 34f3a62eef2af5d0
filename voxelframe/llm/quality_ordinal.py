"""Quality: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold[k] - s) with ordered thresholds and one
score s for all of them: the mean, over a text's words, of shared weights of
hashed features (the word, the shape of its ends, whether it repeats the word
before).  Fitted in numpy by Adam with a ridge penalty.  A text's result is
its expected grade and the probability of reaching the selected grade.

Learning takes a bounded sample (``rows``, ``max_words``).  Defined results:
null and empty texts have no words and get tail probability 0, expected grade
the lowest.  With fewer than two grades in the sample every text gets that
grade.  Repeated rows each give a row; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytetext as B
from .labelled import sample
from .shared import lean, pack_columns

BITS = 18
SIZE = 1 << BITS
GAIN = np.float32(10.0)
_SHAPE = B.LUT.copy()
_SHAPE[ord("a") : ord("z") + 1] = _SHAPE[128:] = B.LUT[ord("a")]
_SHAPE[ord("A") : ord("Z") + 1] = B.LUT[ord("A")]
_SHAPE[ord("0") : ord("9") + 1] = B.LUT[ord("0")]
KINDS = 3


def features(b: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """KINDS hashes for each word, and the first of them of each document."""
    starts, ends, first = b.words()
    words = b.hashes(starts, ends, B.LUT_LOWER)
    tail = np.maximum(starts, ends - 3)
    shape = b.hashes(tail, ends, _SHAPE) + B.mix(_SHAPE[b.data[starts]] + np.uint64(7)) if len(starts) else words
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[first[:-1][first[:-1] < len(words)]] = False
    pair = B.mix(again.astype(np.uint64) + np.uint64(99))
    return np.stack([words, B.mix(shape), pair], 1).ravel(), first * KINDS


def _cells(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(13)) & np.uint64(SIZE - 1)).astype(np.int64)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Ordinal:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one row for each document."""
        n = np.diff(first)
        total = np.concatenate([[0.0], np.cumsum(self.weights[_cells(h)], dtype=np.float64)])
        s = GAIN * (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
        p = _logistic(s[:, None] - self.thresholds[None, :])
        p[n == 0] = 0.0
        return p


def train(h: np.ndarray, first: np.ndarray, y: np.ndarray, grades: list[int], weight: np.ndarray | None = None, steps: int = 80, rate: float = 0.05, ridge: float = 1e-3) -> Ordinal:
    """y: place of each row's grade in grades; weight: for how many rows each stands."""
    k, n = len(grades), len(y)
    weight = np.ones(n) if weight is None else weight / weight.mean()
    lens = np.diff(first)
    cells, doc = _cells(h).astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), lens)
    share = (GAIN / np.maximum(lens, 1)).astype(np.float64)
    w = np.zeros(SIZE)
    upto = np.clip(np.cumsum(np.bincount(y, weight, minlength=k))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(upto / (1 - upto))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    mw, vw, mt, vt = np.zeros(SIZE), np.zeros(SIZE), np.zeros(k - 1), np.zeros(k - 1)
    for step in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        s = np.bincount(doc, w[cells], n) * share
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = _logistic(edge[y + 1] - s), _logistic(edge[y] - s)
        hi[y == k - 1], lo[y == 0] = 1.0, 0.0
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        gs = weight * (dhi - dlo) / p / n  # of the negative log-likelihood
        gt = np.zeros(k + 1)
        np.add.at(gt, y + 1, -weight * dhi / p / n)
        np.add.at(gt, y, weight * dlo / p / n)
        gt = np.cumsum(gt[1:k][::-1])[::-1]  # each free value moves all later thresholds
        gt[1:] *= np.exp(free[1:])
        gw = np.bincount(cells, (gs * share)[doc], SIZE) + ridge * w / n
        mw += 0.1 * (gw - mw)
        vw += 0.01 * (gw * gw - vw)
        mt += 0.1 * (gt - mt)
        vt += 0.01 * (gt * gt - vt)
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (mw / a) / (np.sqrt(vw / b) + 1e-6)
        free -= rate * (mt / a) / (np.sqrt(vt / b) + 1e-6)
    theta = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
    return Ordinal(grades, w.astype(np.float32), theta)


def fit(docs: DataFrame, ratings: DataFrame, rows: int = 6000, max_words: int = 1500, **options) -> Ordinal:
    """ratings: doc_id and label, the integer grade.  rows, max_words: bounds of the sample."""
    h, first, y, _, weight = sample(docs, ratings, features, rows, max_words * KINDS)
    grades = sorted(set(y.tolist()))
    if len(grades) < 2:
        return Ordinal(grades or [0], np.zeros(SIZE, np.float32), np.zeros(0))
    return train(h, first, np.searchsorted(grades, y), grades, weight, **options)


def _grade_batches(model: Ordinal, least: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = np.diff(model.grades)
        k = int(np.searchsorted(model.grades, least)) - 1  # P(grade >= least) = P(grade > k)
        for batch in batches:
            expected, tail = np.full(batch.num_rows, float(model.grades[0])), np.zeros(batch.num_rows)
            for b in B.blocks(batch.column(1)):
                above = model.above(*features(b))
                expected[b.rows()] += above @ gaps
                tail[b.rows()] = 1.0 if k < 0 else above[:, k] if k < above.shape[1] else 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(expected, 9)), pa.array(np.round(tail, 9))], ["doc_id", "expected_grade", "tail_probability"])

    return run


def predict(docs: DataFrame, model: Ordinal, least: int) -> DataFrame:
    """doc_id, expected_grade and tail_probability (of grade >= least) of every row."""
    return pack_columns(docs, "doc_id", "text").mapInArrow(_grade_batches(model, least), "doc_id bigint, expected_grade double, tail_probability double")
