"""Periodic values: wrapped into [a, b), averaged on the circle, natively."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import ArrayFrame
from ..functions import filters


class PhaseFrame:
    """An array frame with a period; arithmetic wraps around."""

    def __init__(self, frame: ArrayFrame, border: tuple[float, float] = (-math.pi, math.pi), unit: str = "rad") -> None:
        self.border, self.unit = (float(border[0]), float(border[1])), unit
        low, period = self.border[0], self.period
        self.frame = frame.each(lambda v: F.pmod(v - low, F.lit(period)) + low, "float64")

    @property
    def period(self) -> float:
        return self.border[1] - self.border[0]

    @property
    def _turn(self) -> float:
        return 2 * math.pi / self.period

    def __add__(self, other) -> PhaseFrame:
        return PhaseFrame(self.frame + (other.frame if isinstance(other, PhaseFrame) else other), self.border, self.unit)

    def __sub__(self, other) -> PhaseFrame:
        return PhaseFrame(self.frame - (other.frame if isinstance(other, PhaseFrame) else other), self.border, self.unit)

    def __mul__(self, other) -> PhaseFrame:
        return PhaseFrame(self.frame * other, self.border, self.unit)

    def __truediv__(self, other) -> PhaseFrame:
        return PhaseFrame(self.frame / other, self.border, self.unit)

    def set_border(self, low: float, high: float) -> PhaseFrame:
        if abs((high - low) - self.period) > 1e-9:
            raise ValueError("the period must stay")
        return PhaseFrame(self.frame, (low, high), self.unit)

    def deg2rad(self) -> PhaseFrame:
        if self.unit == "rad":
            raise ValueError("the unit is rad already")
        return PhaseFrame(self.frame * (math.pi / 180), tuple(math.radians(b) for b in self.border), "rad")

    def rad2deg(self) -> PhaseFrame:
        if self.unit == "deg":
            raise ValueError("the unit is deg already")
        return PhaseFrame(self.frame * (180 / math.pi), tuple(math.degrees(b) for b in self.border), "deg")

    def as_exp(self) -> tuple[ArrayFrame, ArrayFrame]:
        """Real and imaginary part of exp(2 pi i v / period)."""
        t = self._turn
        return self.frame.each(lambda v: F.cos(v * t)), self.frame.each(lambda v: F.sin(v * t))

    def _kernel(self, f) -> PhaseFrame:
        t = self._turn
        return PhaseFrame(self.frame.map(lambda x: np.arctan2(f(np.sin(x * t)), f(np.cos(x * t))) / t), self.border, self.unit)

    def mean_filter(self, radius: float = 1) -> PhaseFrame:
        foot = filters.ball(radius, len(self.frame.shape))
        return self._kernel(lambda x: filters.mean(x, foot))

    def binning(self, size: int = 2) -> PhaseFrame:
        c, s = (p.binning(size, "sum") for p in self.as_exp())
        t = self._turn
        return PhaseFrame(s._binary(c, lambda a, b: F.atan2(a, b) / t), self.border, self.unit)

    def regionprops(self, labels: ArrayFrame) -> DataFrame:
        """Circular mean and deviation per label: N, phase_mean, phase_std."""
        t, keys = self._turn, self.frame.batch.names
        px = self.frame.pixels("v").join(labels.pixels("n").where("n > 0"), [a for a in labels.axes.names if a in self.frame.axes])
        c, s = F.avg(F.cos(F.col("v") * t)), F.avg(F.sin(F.col("v") * t))
        out = px.groupBy(*keys, "n").agg(c.alias("c"), s.alias("s"))
        length = F.least(F.sqrt(F.col("c") ** 2 + F.col("s") ** 2), F.lit(1.0))
        return out.select(*keys, (F.col("n") - 1).cast("bigint").alias("N"), (F.atan2("s", "c") / t).alias("phase_mean"), (F.sqrt(F.greatest(-2 * F.ln(length), F.lit(0.0))) / t).alias("phase_std"))
