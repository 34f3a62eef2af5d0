"""Operators; importing this package gives array frames their methods."""

from .. import chunks, covariates
from . import correlation, image, points, segment, sweep, temporal

__all__ = ["chunks", "covariates", "correlation", "image", "points", "segment", "sweep", "temporal"]
