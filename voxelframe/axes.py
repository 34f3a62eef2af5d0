"""Named axes: scale, unit and labels, slicing and broadcasting by name.

Plain Python without Spark; an array frame keeps its axes here and only its
coordinates in columns.
"""

from __future__ import annotations

import ast
import math
import operator
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

ORDER = "ptzcyx"


class AxesError(ValueError):
    """Axes that do not fit."""


@dataclass(frozen=True)
class Axis:
    name: str
    scale: float = 1.0
    unit: str = ""
    labels: tuple = ()

    def __post_init__(self) -> None:
        if not self.scale > 0:
            raise ValueError(f"scale of axis {self.name!r} must be positive, not {self.scale}")

    def __str__(self) -> str:
        return self.name

    @property
    def undefined(self) -> bool:
        return self.name == "#"

    def same(self, other: Axis) -> bool:
        """Equal names; an undefined axis is like no other."""
        return not self.undefined and self.name == other.name

    def index(self, label) -> int:
        found = [i for i, x in enumerate(self.labels) if x == label]
        if len(found) > 1:
            raise ValueError(f"label {label!r} is not unique on axis {self.name!r}")
        if not found:
            raise KeyError(f"axis {self.name!r} has no label {label!r}")
        return found[0]

    def label_slice(self, s: slice) -> slice:
        """Positions of a slice of labels; the stop is exclusive."""
        return slice(None if s.start is None else self.index(s.start), None if s.stop is None else self.index(s.stop), s.step)

    def sliced(self, key) -> Axis | None:
        """The axis after indexing with an integer (None), a slice or a list."""
        if isinstance(key, slice):
            return replace(self, scale=self.scale * abs(key.step or 1), labels=self.labels[key])
        if isinstance(key, (list, tuple, range)):
            return Axis(self.name, 1.0, self.unit, tuple(self.labels[i] for i in key) if self.labels else ())
        return None


@dataclass(frozen=True)
class Axes:
    items: tuple[Axis, ...] = ()

    @classmethod
    def of(cls, axes: str | Iterable[str | Axis] | Axes) -> Axes:
        if isinstance(axes, Axes):
            return axes
        return cls(tuple(a if isinstance(a, Axis) else Axis(a) for a in axes))

    @classmethod
    def default(cls, ndim: int) -> Axes:
        """Axes of an array of which only the number of dimensions is known."""
        if ndim > 6:
            raise AxesError(f"no default axes for {ndim} dimensions")
        return cls.of({5: "tzcyx"}.get(ndim, "ptzcyx"[-ndim:] if ndim > 5 else ("tzyx"[-ndim:] if ndim else "")))

    def __post_init__(self) -> None:
        names = [a.name for a in self.items if not a.undefined]
        if len(set(names)) < len(names):
            raise AxesError(f"axes must be unique: {''.join(names)}")

    def __iter__(self) -> Iterator[Axis]:
        return iter(self.items)

    def __len__(self) -> int:
        return len(self.items)

    def __str__(self) -> str:
        return "".join(a.name for a in self.items)

    def __contains__(self, name: str | Axis) -> bool:
        return str(name) in self.names

    def __getitem__(self, key: int | str) -> Axis:
        return self.items[key if isinstance(key, int) else self.find(key)]

    @property
    def names(self) -> list[str]:
        return [a.name for a in self.items]

    @property
    def scale(self) -> dict[str, float]:
        return {a.name: a.scale for a in self.items}

    def find(self, name: str | Axis, *default: int) -> int:
        if str(name) in self.names:
            return self.names.index(str(name))
        if default:
            return default[0]
        raise AxesError(f"axis {name!s} is not among {self}")

    def sorted(self) -> Axes:
        return Axes(tuple(self.items[i] for i in self.argsort()))

    def argsort(self) -> list[int]:
        """Canonical order; unknown names come first."""
        return sorted(range(len(self)), key=lambda i: ORDER.find(self.items[i].name))

    def is_sorted(self) -> bool:
        return self.argsort() == list(range(len(self)))

    def drop(self, names: Iterable[str | Axis]) -> Axes:
        gone = {str(n) for n in names}
        return Axes(tuple(a for a in self.items if a.name not in gone))

    def replaced(self, old: str, new: str | Axis) -> Axes:
        axis = new if isinstance(new, Axis) else replace(self[old], name=new)
        return Axes(tuple(axis if a.name == str(old) else a for a in self.items))

    def inserted(self, at: int, axis: str | Axis) -> Axes:
        items = list(self.items)
        items.insert(at if at >= 0 else len(items) + 1 + at, axis if isinstance(axis, Axis) else Axis(axis))
        return Axes(tuple(items))

    def extended(self, axes: str | Iterable[str | Axis]) -> Axes:
        return Axes((*self.items, *Axes.of(axes).items))

    def scaled(self, other: Mapping[str, float] | None = None, **kwargs: float) -> Axes:
        """New scales; a key of several names sets each of them."""
        wanted = {}
        for key, value in {**(other or {}), **kwargs}.items():
            for name in key:
                self.find(name)
                wanted[name] = float(value)
        return Axes(tuple(replace(a, scale=wanted.get(a.name, a.scale)) for a in self.items))

    def labelled(self, **kwargs: Sequence) -> Axes:
        return Axes(tuple(replace(a, labels=tuple(kwargs[a.name])) if a.name in kwargs else a for a in self.items))


def spatial(axes: Axes, dims: int | str | Iterable[str] | None) -> list[str]:
    """The axes an operation takes together: all of zyx present, the last k of those, or as given."""
    present = [a for a in "zyx" if a in axes]
    if dims is None:
        chosen = present
    elif isinstance(dims, int):
        chosen = present[-dims:]
    else:
        chosen = list(dims)
    if not 1 <= len(chosen) <= 3:
        raise AxesError(f"one to three spatial axes are needed, not {chosen}")
    for a in chosen:
        axes.find(a)
    return chosen


def broadcast(*many: Axes) -> Axes:
    """The union of axes in an order that keeps each one's own; canonical order decides between the rest."""
    out: list[Axis] = []
    for axes in many:
        at = 0
        for axis in axes:
            known = next((i for i, a in enumerate(out) if a.same(axis)), None)
            if known is None:
                while at < len(out) and not axis.undefined and ORDER.find(out[at].name) < ORDER.find(axis.name) and not any(out[at].same(b) for b in axes):
                    at += 1
                out.insert(at, axis)
                at += 1
            else:
                at = known + 1
    return Axes(tuple(out))


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.FloorDiv: operator.floordiv, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: operator.pow}
_FUNCTIONS = {"ceil": math.ceil, "floor": math.floor, "round": round}


def _number(text: str, size: int | None) -> int:
    """An integer expression in N, the axis' size."""

    def walk(node: ast.AST) -> float:
        match node:
            case ast.Expression(body=body):
                return walk(body)
            case ast.Constant(value=int() | float()):
                return node.value
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -walk(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _OPERATORS:
                return _OPERATORS[type(op)](walk(a), walk(b))
            case ast.Name(id="N") if size is not None:
                return size
            case ast.Call(func=ast.Name(id=f), args=[x], keywords=[]) if f in _FUNCTIONS:
                return _FUNCTIONS[f](walk(x))
        raise ValueError(f"not an index: {text!r}")

    try:
        value = walk(ast.parse(text.strip(), mode="eval"))
    except SyntaxError as error:
        raise ValueError(f"not an index: {text!r}") from error
    if value != int(value):
        raise ValueError(f"not an integer: {text!r}")
    return int(value)


def _key(text: str, size: int | None):
    if ":" not in text:
        return _number(text, size)
    parts = text.split(":")
    if len(parts) > 3:
        raise ValueError(f"not a slice: {text!r}")
    return slice(*(_number(p, size) if p.strip() else None for p in parts))


def parse(text: str, sizes: Mapping[str, int]) -> dict[str, object]:
    """``"t=4;y=2:10:2;x=1,3,5;z=N//2"`` as a key for each axis."""
    out: dict[str, object] = {}
    for part in text.replace(" ", "").split(";"):
        found = re.fullmatch(r"([^=]+)=([^=]+)", part)
        if not found:
            raise ValueError(f"not an axis and an index: {part!r}")
        name, body = found.groups()
        if name in out:
            raise ValueError(f"axis {name!r} occurs twice")
        if name not in sizes:
            raise AxesError(f"axis {name!r} is not among {''.join(sizes)}")
        keys = [_key(k, sizes[name]) for k in body.split(",")]
        if len(keys) == 1:
            out[name] = keys[0]
        else:
            out[name] = [i for k in keys for i in (range(sizes[name])[k] if isinstance(k, slice) else [k])]
    return out


class Slicer:
    """``slicer.t[4].y[2:10]`` as a key for each axis."""

    def __init__(self, keys: Mapping[str, object] | None = None, axis: str | None = None) -> None:
        self.keys, self._axis = dict(keys or {}), axis

    def __getattr__(self, name: str) -> Slicer:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in self.keys:
            raise ValueError(f"axis {name!r} occurs twice")
        return Slicer(self.keys, name)

    def __getitem__(self, key) -> Slicer:
        if self._axis is None:
            raise TypeError("name an axis before the index")
        return Slicer({**self.keys, self._axis: key})

    def formatter(self, axes: str):
        """A function from one index per axis to a slicer."""
        return lambda *index: Slicer({**self.keys, **dict(zip(axes, index, strict=True))})


slicer = Slicer()
