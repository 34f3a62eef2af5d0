"""Streams of frames and points.

Array frames come as rows, so stateless operators work on streams as they are.
Here is what keeps state: windowed statistics with late rows dropped by a
watermark, and the recursive filter along time for each series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, time: str, value: str, by: list[str], width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """count, mean, minimum and maximum by time window and key; rows later than the watermark are dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "mean", "low", "high")


def sessions(events: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows per session: runs of events of a key with gaps below the limit."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def kalman(series: DataFrame, key: str, order: str, value: str, gain: float = 0.8) -> DataFrame:
    """The recursive filter of each series on a stream: key, order, value and estimate.

    The state of a series is its step and estimate; rows of one batch are taken
    in order, rows that come in a later batch count as later.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, est = state.get if state.exists else (0, 0.0)
        for pdf in frames:
            pdf = pdf.sort_values(order, kind="stable")
            out = np.empty(len(pdf))
            for i, v in enumerate(pdf[value].to_numpy(float)):
                est = v if step == 0 else gain * est + (1 - gain) * v + (v - est) / (step + 1)
                step += 1
                out[i] = est
            yield pd.DataFrame({key: k[0], order: pdf[order].to_numpy(), value: pdf[value].to_numpy(float), "estimate": out})
        state.update((step, float(est)))

    types = dict(series.dtypes)
    schema = f"{key} {types[key]}, {order} {types[order]}, {value} double, estimate double"
    return series.select(key, order, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(run, schema, "step long, estimate double", "append", GroupStateTimeout.NoTimeout)
