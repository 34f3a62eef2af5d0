"""Quality rules: base statistics of every text, and robust multivariate outliers.

``text_statistics`` counts, for whole texts, words, their code points, symbol
characters, repeated lines and words in repeated 3-word windows.
``robust_outliers`` fits, for every group (language and source), a minimum
covariance determinant estimate of transformed statistics and gives each row's
squared Mahalanobis distance from it.

Each group has several starts: medians with median deviations, and moments of
small random subsets.  A concentration step keeps the share ``h`` of a group with the least distances
and takes mean and covariance of those.  After two steps the start with the
least determinant goes on, until the determinant no longer falls.  Quantiles come from counts of
binned values and moments from sums per bin (the bin in which the share ends
counts in part, so that the share is exact), so a group of any size is
aggregated in parts before the shuffle and no task holds more than a group's bins.  A floor on
the variances keeps statistics that are constant in a group from having
infinite weight.

Defined results: null text counts as empty (0 words, base_failed).  Null lang
or source is a group of its own.  Groups with fewer than ``min_group`` rows
that pass the base rules are judged by the estimate of their language over all
sources, and where that has too few as well by the one of all rows, whatever
their number; so every row that passes the base rules has a distance.
Repeated rows each give a row.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .shared import Scratch, lean, pack_columns

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

#: Transformed statistics, each with the least standard deviation that counts.
FEATURES = {
    "length": ("ln(word_chars / nullif(n_words, 0))", 0.10),
    "symbols": ("ln(1 + 20 * n_symbols / nullif(word_chars, 0))", 0.12),
    "dup_lines": ("ln(1 + 100 * n_dup_lines / nullif(n_words, 0))", 0.25),
    "repeats": ("ln(1 + 10 * n_repeat_words / nullif(n_words, 0))", 0.25),
    "words": ("ln(nullif(n_words, 0))", 0.50),
}
#: Widths of the bins that are counted, of a statistic and of a log distance.
BIN, LOG_BIN = 0.01, 0.05


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that occur more than once, and of those that have an equal value before them."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    return np.concatenate([order[1:][same], order[:-1][same]]), order[1:][same]


def block_statistics(b: B.Block) -> tuple[np.ndarray, ...]:
    starts, ends, first = b.words()
    words, n = b.hashes(starts, ends), len(starts)
    char = (b.data & 0xC0) != 0x80
    chars = B.sums(char & ~B.SEPARATOR[b.data], b.off)
    symbols = B.sums(_SYMBOL[b.data], b.off)
    ls, le, lf = b.spans(B.NEWLINE)
    full = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    line_doc = np.repeat(np.arange(b.n), np.diff(lf))[full]
    key = B.mix(b.hashes(ls, le)[full] + B.mix(line_doc.astype(np.uint64)))
    dup = np.bincount(line_doc[_repeated(key)[1]], minlength=b.n)
    doc = np.repeat(np.arange(b.n), np.diff(first))
    covered = np.zeros(n, bool)
    if n >= 3:
        at = np.flatnonzero(B.inside(first, n, 3))
        key = B.mix(B.windows(words, 3)[at] + B.mix(doc[at].astype(np.uint64)))
        hit = at[_repeated(key)[0]]
        for k in range(3):
            covered[hit + k] = True
    return np.diff(first), chars, symbols, dup, B.sums(covered, first)


@lean
def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [block_statistics(b) for b in B.blocks(batch.column(3))]
        cols = [pa.array(np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)) for i in range(5)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *cols], ["doc_id", "lang", "source", *STATS])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five counts of every row's whole text."""
    return pack_columns(docs, "doc_id", "lang", "source", "text").mapInArrow(_stat_batches, _SCHEMA)


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def _distance(names: list[str]) -> Column:
    """Squared distance under the columns mean and inverse."""
    p, terms = len(names), []
    d = [F.col(x) - F.col("mean")[i] for i, x in enumerate(names)]
    for i in range(p):
        for j in range(i, p):
            terms.append(d[i] * d[j] * F.col("inverse")[i * p + j] * (1.0 if i == j else 2.0))
    return sum(terms[1:], terms[0])


def _weighted_median(x: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    upto = np.cumsum(n[order])
    return float(x[order][np.searchsorted(upto, upto[-1] / 2)])


_FIT = "g string, s int, mean array<double>, inverse array<double>, logdet double, scale double"


def _fit_row(pdf: pd.DataFrame, mean: np.ndarray, cov: np.ndarray, scale: float) -> pd.DataFrame:
    return pd.DataFrame({"g": [pdf["g"].iloc[0]], "s": [pdf["s"].iloc[0] if "s" in pdf else 0], "mean": [mean], "inverse": [np.linalg.inv(cov).ravel()], "logdet": [float(np.linalg.slogdet(cov)[1])], "scale": [scale]})


def _medians(p: int, floors: np.ndarray):
    """For one group's counted bins of each statistic: medians and median deviations, as a first estimate."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, var = np.zeros(p), np.zeros(p)
        for i, part in pdf.groupby("i"):
            x, n = part["bin"].to_numpy() * BIN, part["n"].to_numpy()
            mean[i] = _weighted_median(x, n)
            var[i] = (1.4826 * _weighted_median(np.abs(x - mean[i]), n)) ** 2
        return _fit_row(pdf, mean, np.diag(var + floors**2), 1.0)

    return run


def _concentrated(p: int, floors: np.ndarray, h: float):
    """For counts and moments by bin of distance of one group and start: mean and covariance of the nearest share h, and the scale of the estimate that the distances are from."""
    upper = [(i, j) for i in range(p) for j in range(i, p)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", kind="stable")
        n = pdf["n"].to_numpy(float)
        part = np.clip((h * n.sum() - (np.cumsum(n) - n)) / n, 0, 1)  # of each bin; all before, none behind the one in which the share ends
        total = lambda c: float((pdf[c].to_numpy() * part).sum()) / (h * n.sum())
        mean = np.array([total(f"s{i}") for i in range(p)])
        cov = np.zeros((p, p))
        for i, j in upper:
            cov[i, j] = cov[j, i] = total(f"s{i}_{j}") - mean[i] * mean[j]
        middle = np.exp(_weighted_median(pdf["bin"].to_numpy() * LOG_BIN, n))
        return _fit_row(pdf, mean, cov + np.diag(floors**2), max(1.0, middle / chi_square(p, 0.0)))

    return run


def _pools(data: DataFrame, min_group: int, scratch: Scratch) -> DataFrame:
    """For each group g the pool that judges it (itself, its language or all), and the pools that its rows are part of."""
    sizes = data.where("use").groupBy("g", F.concat(F.lit("lang "), F.to_json(F.struct("lang"))).alias("wide")).agg(F.count("*").alias("n"))
    sizes = scratch.keep(sizes, "sizes")
    wide = sizes.groupBy("wide").agg(F.sum("n").alias("wide_n"), (F.min("n") < min_group).alias("asked"))
    every = bool(wide.agg(F.min("wide_n") < min_group).first()[0])
    small, few = F.col("n") < min_group, F.col("wide_n") < min_group
    pool = F.when(~small, F.col("g")).when(~few, F.col("wide")).otherwise("all")
    feeds = F.array(F.when(~small, F.col("g")), F.when(F.col("asked") & ~few, F.col("wide")), F.lit("all" if every else None).cast("string"))
    return scratch.keep(sizes.join(wide, "wide").select("g", "n", pool.alias("pool"), F.array_compact(feeds).alias("feeds")), "pools")


def robust_outliers(stats: DataFrame, h: float = 0.75, starts: int = 4, steps: int = 12, tolerance: float = 1e-6, min_group: int = 50, features: dict = FEATURES, scratch: Scratch | None = None) -> DataFrame:
    """Rows of stats with g (group), d2, the squared robust distance scaled so that its group median is at most that of a chi-square (null for rows that fail the base rules), and logdet of the estimate it is from.

    starts: of each group; steps: the most that are taken; tolerance: fall of the log determinant that still counts.
    """
    names, p = list(features), len(features)
    floors = np.array([floor for _, floor in features.values()])
    scratch = scratch or Scratch(stats.sparkSession, "mcd")
    data = scratch.keep(stats.withColumn("g", F.to_json(F.struct("lang", "source"))).withColumn("use", ~base_failed()).withColumns({k: F.coalesce(F.expr(e), F.lit(0.0)) for k, (e, _) in features.items()}), "data")
    pools = _pools(data, min_group, scratch)
    sizes = pools.select(F.explode("feeds").alias("g"), "n").groupBy("g").agg(F.sum("n").alias("size"))
    used = data.where("use").join(pools.select("g", "feeds"), "g").select(F.explode("feeds").alias("g"), "doc_id", *names)
    moments = [F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(names)], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]]

    bins = used.select("g", F.posexplode(F.array(*[F.round(F.col(x) / BIN).cast("int") for x in names])).alias("i", "bin")).groupBy("g", "i", "bin").agg(F.count("*").alias("n"))
    fit = bins.groupBy("g").applyInPandas(_medians(p, floors), _FIT)
    if starts > 1:  # random subsets of about 8 (p + 1) rows
        drawn = used.join(scratch.keep(sizes, "pool_sizes"), "g").withColumn("s", F.explode(F.array(*[F.lit(i) for i in range(1, starts)])))
        drawn = drawn.where((F.xxhash64("doc_id", "s", *names) / 2.0**64 + 0.5) * F.col("size") < 8 * (p + 1))
        fit = fit.union(drawn.groupBy("g", "s", F.lit(0).alias("bin")).agg(*moments).groupBy("g", "s").applyInPandas(_concentrated(p, floors, 1.0), _FIT))
    fit = scratch.keep(fit, "fit0")

    def stepped(fit: DataFrame) -> DataFrame:
        near = used.join(fit.drop("scale", "logdet"), "g").groupBy("g", "s", F.round(F.ln(_distance(names) + 1e-6) / LOG_BIN).cast("int").alias("bin")).agg(*moments)
        return near.groupBy("g", "s").applyInPandas(_concentrated(p, floors, h), _FIT)

    for step in range(1, steps + 1):
        new = stepped(fit)
        if step == 2:  # of each group the start with the least determinant
            best = F.min_by(F.struct("s", "mean", "inverse", "logdet", "scale"), F.struct("logdet", "s"))
            new = new.groupBy("g").agg(best.alias("b")).select("g", "b.*")
        if step > 3:  # a step that does not lower the determinant is not taken
            old = fit.select("g", *[F.col(c).alias(f"old_{c}") for c in ("mean", "inverse", "logdet")])
            better = F.col("logdet") < F.col("old_logdet")
            new = new.join(old, "g").select("g", "s", *[F.when(better, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in ("mean", "inverse", "logdet")], "scale", (F.col("old_logdet") - F.col("logdet")).alias("fall"))
        kept = scratch.keep(new, f"fit{step}")
        fit, fell = kept.drop("fall"), kept.agg(F.max("fall")).first()[0] if step > 3 else 1.0
        if fell is None or fell <= tolerance:
            break
    scale = scratch.keep(stepped(fit).select("g", "scale"), "scale")
    fit = fit.drop("scale", "s").join(scale, "g").withColumnRenamed("g", "pool")
    return data.join(pools.select("g", "pool"), "g", "left").join(fit, "pool", "left").withColumn("d2", F.when(F.col("use"), _distance(names) / F.col("scale"))).select("g", "doc_id", *STATS, "d2", "logdet")


def chi_square(p: int, z: float) -> float:
    """Quantile of the chi-square with p degrees of freedom at a normal quantile z (Wilson and Hilferty)."""
    return p * (1 - 2 / (9 * p) + z * (2 / (9 * p)) ** 0.5) ** 3


def quality_rules(docs: DataFrame, z: float = 6.0, **options) -> DataFrame:
    """doc_id, the counts, base_failed and kept.  z: normal quantile of the distance beyond which a row is rejected."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = robust_outliers(text_statistics(docs), scratch=scratch, **options)
    failed = base_failed()
    kept = ~failed & F.coalesce(F.col("d2") <= chi_square(len(FEATURES), z), F.lit(True))
    return rows.select("doc_id", *STATS, failed.alias("base_failed"), kept.alias("kept"), F.round("d2", 6).alias("distance2"))
