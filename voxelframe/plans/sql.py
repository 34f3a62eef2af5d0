"""SQL over the test tables for the queries of the catalog.

``embeddings`` holds vectors of 64 values, read as 8 by 8 images; values are
rounded to thousandths and taken as whole numbers, so that sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterable

N = 8
PX = "px AS (SELECT vec_id AS p, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, round(embedding[i]::DOUBLE * 1000) AS v, label FROM (SELECT vec_id, embedding, label, unnest(range(1, 65)) AS i FROM embeddings))"


def query(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{', '.join([PX, *ctes])} {body}"


def each(expression: str, kind: str = "DOUBLE") -> str:
    return query(f"SELECT p, y, x, round(({expression})::{kind}, 6) + 0.0 AS value FROM px")


def fold(i: str, mode: str, n: int = N) -> str:
    """An index mapped inside by a padding mode; null where there is none."""
    if mode == "reflect":
        m = f"((({i}) % {2 * n} + {2 * n}) % {2 * n})"
        return f"(CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 1} - {m} END)"
    if mode == "mirror":
        k = 2 * n - 2
        m = f"((({i}) % {k} + {k}) % {k})"
        return f"(CASE WHEN {m} < {n} THEN {m} ELSE {k} - {m} END)"
    if mode == "nearest":
        return f"least(greatest({i}, 0), {n - 1})"
    if mode == "wrap":
        return f"((({i}) % {n} + {n}) % {n})"
    return f"(CASE WHEN ({i}) BETWEEN 0 AND {n - 1} THEN ({i}) END)"


def offsets(values: Iterable[tuple[int, int, float]], name: str = "o") -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(f'({a}, {b}, {w!r}::DOUBLE)' for a, b, w in values)}) AS t(dy, dx, w))"


def gather(source: str, table: str, offs: str, aggregate: str, mode: str = "reflect", cval: float = 0.0) -> str:
    """A table (p, y, x, v): the aggregate of s.v and o.w over the neighbourhood of each pixel of the source."""
    v = f"coalesce(s.v, {cval}::DOUBLE)"
    return (
        f"{table} AS (SELECT c.p, c.y, c.x, {aggregate.replace('s.v', v)} AS v FROM {source} c CROSS JOIN {offs} o "
        f"LEFT JOIN {source} s ON s.p = c.p AND s.y = {fold('c.y + o.dy', mode)} AND s.x = {fold('c.x + o.dx', mode)} GROUP BY c.p, c.y, c.x)"
    )


def out(table: str = "r", value: str = "v") -> str:
    return f"SELECT p, y, x, round(({value})::DOUBLE, 6) + 0.0 AS value FROM {table}"


def ball(radius: int) -> list[tuple[int, int, float]]:
    return [(a, b, 1.0) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]


def weights(kernel) -> list[tuple[int, int, float]]:
    """Offsets of an odd correlation kernel."""
    h, w = len(kernel) // 2, len(kernel[0]) // 2
    return [(i - h, j - w, float(k)) for i, row in enumerate(kernel) for j, k in enumerate(row) if k]


def neighbourhood(offs, aggregate: str, mode: str = "reflect", cval: float = 0.0) -> str:
    return query(out(), offsets(offs), gather("px", "r", "o", aggregate, mode, cval))
