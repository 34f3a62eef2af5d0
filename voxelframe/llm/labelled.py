"""A bounded sample of labelled documents, as arrays of word hashes on the driver."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .shared import lean


def hashed(features: Callable[[B.Block], tuple[np.ndarray, np.ndarray]], max_words: int):
    """For mapInArrow: label, lang and the packed feature hashes of each text that has at most max_words of them."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, lang, packed = batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
            ids = batch.column(3).to_pylist()
            rows = []
            for b in B.blocks(batch.column(0)):
                h, first = features(b)
                for d in range(b.n):
                    if first[d + 1] - first[d] <= max_words:
                        rows.append(b.first + d)
                        packed.append(h[first[d] : first[d + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in rows], pa.int64()), pa.array([label[i] for i in rows], pa.int32()), pa.array([lang[i] for i in rows], pa.string()), pa.array(packed, pa.binary())], ["doc_id", "label", "lang", "h"])

    return run


def sample(docs: DataFrame, labels: DataFrame, features, rows: int, max_words: int):
    """The labelled texts with the least hashes of doc_id: ``rows`` at most, dealt evenly over the labels.

    labels: doc_id and label.  The ids are drawn first; that table has at most
    ``rows`` rows, so the join sends it to every executor; of what the join
    finds, again ``rows`` rows at most are fetched (where a doc_id repeats they
    could be more).  Repeated labels count once.  Texts over
    ``max_words`` features are not learned from, which bounds what is fetched.

    Gives hashes, the first place of each text, labels, languages, and for how
    many rows of the whole each text stands.
    """
    ids = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("doc_id is not null and label is not null").distinct()
    counts = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).limit(1000).collect()}
    quota = max(1, rows // max(1, len(counts)))
    parts = []
    for label, n in sorted(counts.items()):
        share = min(1.0, 2 * quota / n)  # twice what is needed, so that tasks send little to the driver
        mine = ids.where(F.col("label") == label).withColumn("k", F.xxhash64("doc_id"))
        parts.append(mine.where(F.col("k") <= min(2**63 - 1, int(-(2**63) + share * 2**64))).orderBy("k", "doc_id").limit(quota).drop("k"))
    drawn = functools.reduce(DataFrame.union, parts, ids.limit(0))
    lang = "lang" if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    got = docs.select("doc_id", "text", lang).join(F.broadcast(drawn), "doc_id").select("text", "label", "lang", "doc_id")
    made = got.mapInArrow(hashed(features, max_words), "doc_id bigint, label int, lang string, h binary")
    out = made.orderBy(F.xxhash64("doc_id", "h"), "doc_id", "label").limit(rows).toPandas()  # a doc_id that repeats brings all its rows
    out = out.sort_values(["doc_id", "label"], kind="stable")
    y, lang = out["label"].to_numpy(), out["lang"].to_numpy()
    first = np.concatenate([[0], np.cumsum([len(x) // 8 for x in out["h"]])]).astype(np.int64)
    h = np.frombuffer(b"".join(out.pop("h")), np.uint64)
    weight = np.array([counts[k] / max(1, (y == k).sum()) for k in y])
    return h, first, y, lang, weight
