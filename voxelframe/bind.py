"""User functions as methods of array frames, and collections of frames."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np

from .frame import ArrayFrame


def bind(f: Callable, name: str | None = None, *, kind: str = "image", dtype: str | None = None):
    """Make a numpy function a method.

    image: array to array of the same shape; property: array to a number (a
    DataFrame with a column value); label: array to labels; mask: array to
    True or False.  The function sees one array of the spatial axes at a time.
    """
    name = name or f.__name__
    if hasattr(ArrayFrame, name):
        raise AttributeError(f"array frames have {name!r} already")
    if kind not in ("image", "property", "label", "mask"):
        raise ValueError(f"unknown kind {kind!r}")

    def method(self: ArrayFrame, *args, **kwargs):
        if kind == "property":
            return self.table(lambda x: {"value": [float(f(a, *args, **kwargs)) for a in x]}, "value double")
        kinds = {"label": "int64", "mask": "bool"}
        return self.map(lambda x: np.stack([f(a, *args, **kwargs) for a in x]), dtype or kinds.get(kind))

    method.__name__, method.__doc__ = name, f.__doc__
    setattr(ArrayFrame, name, method)
    return f


def unbind(name: str) -> None:
    delattr(ArrayFrame, name)


@contextlib.contextmanager
def bound(f: Callable, name: str | None = None, **options) -> Iterator[None]:
    bind(f, name, **options)
    try:
        yield
    finally:
        unbind(name or f.__name__)


class DataList(list):
    """Frames of one kind; methods are called on each."""

    def __init__(self, items: Sequence = ()) -> None:
        super().__init__(items)
        if len({type(i) for i in self}) > 1:
            raise TypeError("all items must have one type")

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        found = [getattr(i, name) for i in self]
        return (lambda *a, **k: DataList([f(*a, **k) for f in found])) if found and callable(found[0]) else DataList(found)

    def apply(self, f: Callable, *args, **kwargs) -> DataList:
        return DataList([f(i, *args, **kwargs) for i in self])

    def agg(self, functions: Mapping[str, Callable]) -> DataDict:
        return DataDict({k: self.apply(f) for k, f in functions.items()})

    def __add__(self, other) -> DataList:
        return DataList([*self, *other])


class DataDict(dict):
    """Named frames; methods are called on each."""

    def __getattr__(self, name: str):
        if name in self:
            return self[name]
        if name.startswith("__"):
            raise AttributeError(name)
        found = {k: getattr(v, name) for k, v in self.items()}
        return (lambda *a, **k: DataDict({n: f(*a, **k) for n, f in found.items()})) if found and callable(next(iter(found.values()))) else DataDict(found)

    def apply(self, f: Callable, *args, **kwargs) -> DataDict:
        return DataDict({k: f(v, *args, **kwargs) for k, v in self.items()})
