"""Labelled n-dimensional arrays as Spark DataFrames.

The names below are imported on first use, so that workers which need one
module only do not load the others.
"""

import importlib

_HOME = {"ArrayFrame": "operators.image", "Axes": "axes", "Axis": "axes", "AxesError": "axes", "slicer": "axes"}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(name)
    importlib.import_module(f"{__name__}.operators")
    return getattr(importlib.import_module(f"{__name__}.{_HOME[name]}"), name)
