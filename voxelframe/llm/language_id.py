"""Language identification with a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows, each
filter's greatest response in a window is kept, and a softmax layer turns
these into language probabilities.  A window's first layer is the sum of one
table row per byte and place in the filter (an embedding and a filter weight
multiplied out), so training and scoring are table lookups in numpy.

A text is scored whole: windows follow each other to its end, and the text's
log-probabilities are the means over its windows, weighted by their bytes.

``fit`` learns from a bounded sample: at most ``sample`` windows, those with
the least hashes, of the rows it is given.  Windows are cut before sampling,
so neither the number of rows nor long texts change what reaches the driver.

Defined results: null texts and texts without a letter give ``und`` with score
0.  Without any labelled text every prediction is ``und``.  Equal probabilities
go to the language that sorts first.  Repeated rows each give a row; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .shared import lean, pack_columns

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 12, 128
NEVER = np.float32(-1e4)


@dataclass
class ByteNet:
    labels: list[str]
    tables: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    dense: np.ndarray
    bias: np.ndarray

    def pooled(self, x: np.ndarray, places: bool = False):
        """Greatest responses of windows x (n, WINDOW); places: also where."""
        out, at = [], []
        for table in self.tables:
            w = len(table)
            y = table[0][x[:, : WINDOW - w + 1]]
            for k in range(1, w):
                y = y + table[k][x[:, k : WINDOW - w + 1 + k]]
            if places:
                at.append(y.argmax(1))
            out.append(y.max(1))
        z = np.concatenate(out, 1)
        return (z, at) if places else z

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        y = np.maximum(self.pooled(x), 0) @ self.dense + self.bias
        y = y - y.max(1, keepdims=True)
        return y - np.log(np.exp(y).sum(1, keepdims=True))


def train(windows: np.ndarray, target: np.ndarray, labels: list[str], epochs: int = 8, batch: int = 128, rate: float = 0.01, seed: int = 7) -> ByteNet:
    """Adam on the cross entropy; classes weigh by the root of their inverse frequency."""
    rng = np.random.default_rng(seed)
    net = ByteNet(labels, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))
    for t in net.tables:
        t[:, 0] = NEVER
    weight = np.bincount(target, minlength=len(labels)).astype(np.float32) ** -0.5
    weight = weight[target] / weight[target].mean()
    params = [*net.tables, net.dense, net.bias]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            x, n = windows[rows], len(rows)
            z, at = net.pooled(x, True)
            a = np.maximum(z, 0)
            y = a @ net.dense + net.bias
            y = np.exp(y - y.max(1, keepdims=True))
            y /= y.sum(1, keepdims=True)
            y[np.arange(n), target[rows]] -= 1
            y *= weight[rows][:, None] / n
            back = (y @ net.dense.T) * (z > 0)
            grads, col = [], np.arange(FILTERS)[None, :]
            for j, (table, p) in enumerate(zip(net.tables, at)):
                g, b = np.zeros_like(table), back[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(len(table)):
                    np.add.at(g[k], (x[np.arange(n)[:, None], p + k], np.broadcast_to(col, p.shape)), b)
                g[:, 0] = 0
                grads.append(g)
            grads += [a.T @ y, y.sum(0)]
            t += 1
            for j, (p, g) in enumerate(zip(params, grads)):
                m[j] += 0.1 * (g - m[j])
                v[j] += 0.001 * (g * g - v[j])
                p -= rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return net


def cut(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a block's texts, zero after a text's end, and the first window of each text (n + 1 places).  A text has one window at least."""
    lens = np.diff(off)
    count = np.maximum(1, -(-lens // WINDOW))
    first = np.concatenate([[0], np.cumsum(count)])
    x = np.zeros(int(first[-1]) * WINDOW, np.uint8)
    x[np.arange(len(data)) + np.repeat(first[:-1] * WINDOW - off[:-1], lens)] = data
    return x.reshape(-1, WINDOW), first


def _sample_batches(per_text: int):
    """Some windows of each text, spread by a hash of place and content, and their hashes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, data, hashes = [], [], []
            names = batch.column(1).to_pylist()
            for b in B.blocks(batch.column(0)):
                x, first = cut(b.data, b.off)
                if not b.n:
                    continue
                h = B.mix(B.windows(B.LUT[x].ravel(), WINDOW)[::WINDOW] + B.mix(np.arange(len(x), dtype=np.uint64)))
                doc = np.repeat(np.arange(b.n), np.diff(first))
                order = np.lexsort((h, doc))
                keep = order[(np.arange(len(order)) - first[doc[order]]) < per_text]
                lang += [names[b.first + d] for d in doc[keep]]
                data += [w.tobytes() for w in x[keep]]
                hashes.append(h[keep].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(data, pa.binary()), pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64))], ["lang", "window", "h"])

    return run


def fit(rows: DataFrame, sample: int = 6000, per_text: int = 4, **options) -> ByteNet:
    """Learn from the columns text and lang; sample: the most windows that are fetched; per_text: the most of one text. Equal windows of a language count once, so a group of copies has no more weight than one text."""
    rows = rows.select("text", "lang").where("text is not null and lang is not null and text rlike '\\\\p{L}'")
    windows = rows.mapInArrow(_sample_batches(per_text), "lang string, window binary, h bigint")
    # every text gives a window at least: twice the share that is needed is enough, and keeps what tasks send to the driver small
    share = min(1.0, 2 * sample / max(1, rows.select("lang").where("lang is not null").count()))
    got = windows.where(F.col("h") <= min(2**63 - 1, int(-(2**63) + share * 2**64)))
    got = got.groupBy("lang", "window").agg(F.min("h").alias("h")).orderBy("h", "lang", "window").limit(sample).toPandas()
    labels = sorted(set(got["lang"]))
    if not labels:
        return ByteNet([], [], np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    x = np.frombuffer(b"".join(map(bytes, got["window"])), np.uint8).reshape(-1, WINDOW)
    return train(x, np.searchsorted(labels, got["lang"].to_numpy()), labels, **options)


def _predict_batches(net: ByteNet):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letter = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            n = len(letter)
            best, score = np.full(n, -1), np.zeros(n)
            if net.labels:
                for b in B.blocks(batch.column(1), 1 << 17):
                    x, first = cut(b.data, b.off)
                    weight = np.maximum(1, (x != 0).sum(1)).astype(np.float64)
                    total = np.concatenate([np.zeros((1, len(net.labels))), np.cumsum(net.log_probabilities(x) * weight[:, None], 0)])
                    mean = (total[first[1:]] - total[first[:-1]]) / np.add.reduceat(weight, first[:-1])[:, None]
                    p = np.exp(mean - mean.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best[b.rows()], score[b.rows()] = p.argmax(1), p.max(1)
            best[~letter] = -1
            lang = np.array([*net.labels, "und"], object)[best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.where(best < 0, 0.0, score))], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: ByteNet) -> DataFrame:
    """doc_id, lang_pred and score of every row; reads doc_id and text only."""
    rows = pack_columns(docs, "doc_id", "text").withColumn("letter", F.expr("coalesce(text rlike '\\\\p{L}', false)"))
    return rows.mapInArrow(_predict_batches(net), "doc_id bigint, lang_pred string, score double")
