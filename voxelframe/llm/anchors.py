"""Metric trees by the anchors hierarchy (Moore 2000), as arrays, and assignment of their points to the nearest of a few entries.

Points are rows of integers.  About sqrt(n) anchors are made first: each new
one is the point farthest from its anchor and takes over what is nearer to it;
points closer to their anchor than half the anchors' distance cannot change
hands and are not looked at.  Anchors that are still large become trees of
their own in the same way, and from this middle anchors are merged upwards,
the pair with the smallest ball first.  Every ball is a run of the tree's order
of points, with its centre, radius, and the sum of its points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Points of a ball that is not divided any more.
LEAF = 48


@dataclass
class Tree:
    order: np.ndarray  # places of the points
    first: np.ndarray  # of each ball in the order; ball 0 is the root, children follow their parents
    last: np.ndarray
    left: np.ndarray  # number of a child, or -1
    right: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    KINDS = ("<i4", "<i4", "<i4", "<i4", "<i4", "<f4", "<f4", "<i8")

    def arrays(self) -> list[np.ndarray]:
        parts = (self.order, self.first, self.last, self.left, self.right, self.center.ravel(), self.radius, self.sums.ravel())
        return [np.asarray(a).astype(k) for a, k in zip(parts, self.KINDS)]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> Tree:
        *rest, center, radius, sums = arrays
        balls = len(radius)
        return cls(*rest, center.reshape(balls, -1), radius, sums.reshape(balls, -1))


def _anchors(x: np.ndarray) -> np.ndarray:
    """The number of each point's anchor."""
    owner, distance = np.zeros(len(x), np.int64), np.linalg.norm(x - x[0], axis=1)
    pivots = x[:1]
    for k in range(1, int(np.ceil(np.sqrt(len(x))))):
        far = int(distance.argmax())
        if distance[far] == 0:
            break
        between = np.linalg.norm(pivots - x[far], axis=1)
        may = np.flatnonzero(distance > between[owner] / 2)
        new = np.linalg.norm(x[may] - x[far], axis=1)
        taken = may[new < distance[may]]
        distance[taken], owner[taken] = new[new < distance[may]], k
        pivots = np.concatenate([pivots, x[far : far + 1]])
    return owner


def _merged(balls: list[tuple]) -> tuple:
    """Balls (points, center, radius, children) merged two by two; the pair with the smallest ball around both comes first."""
    n = len(balls)
    size = np.array([len(b[0]) for b in balls], float)
    center, radius = np.stack([b[1] for b in balls]), np.array([b[2] for b in balls])
    balls = list(balls)

    def around(i: int) -> np.ndarray:
        apart = np.linalg.norm(center - center[i], axis=1)
        out = np.maximum((apart + radius + radius[i]) / 2, np.maximum(radius, radius[i]))
        out[i] = np.inf
        out[size == 0] = np.inf
        return out

    cost = np.stack([around(i) for i in range(n)])
    for _ in range(n - 1):
        i, j = divmod(int(cost.argmin()), n)
        points = np.concatenate([balls[i][0], balls[j][0]])
        total = size[i] + size[j]
        middle = (center[i] * size[i] + center[j] * size[j]) / total
        reach = max(np.linalg.norm(middle - center[i]) + radius[i], np.linalg.norm(middle - center[j]) + radius[j])
        balls[i] = (points, middle, reach, (balls[i], balls[j]))
        center[i], radius[i], size[i], size[j] = middle, reach, total, 0
        cost[j], cost[:, j] = np.inf, np.inf
        cost[i] = cost[:, i] = around(i)
    return balls[i if n > 1 else 0]


def _ball(x: np.ndarray, points: np.ndarray) -> tuple:
    here = x[points]
    center = here.mean(axis=0)
    radius = float(np.linalg.norm(here - center, axis=1).max())
    if len(points) > LEAF and radius > 0:
        owner = _anchors(here)
        if owner.any():
            return _merged([_ball(x, points[owner == k]) for k in np.unique(owner)])
    return points, center, radius, ()


def build(x: np.ndarray) -> Tree:
    """The tree over the rows of an integer array (one at least)."""
    x = x.astype(float)
    order, balls, stack = [], [], [(_ball(x, np.arange(len(x))), -1, 0)]
    links: list[list[int]] = []
    at = 0
    while stack:  # children after their parent, the left one with all below it first
        (points, _, _, children), parent, side = stack.pop()
        if parent >= 0:
            links[parent][side] = len(balls)
        links.append([-1, -1])
        balls.append((at, len(points)))
        if children:
            stack += [(children[1], len(balls) - 1, 1), (children[0], len(balls) - 1, 0)]
        else:
            order.append(points)
            at += len(points)
    order = np.concatenate(order)
    first, sizes = np.array(balls).T
    x = x[order]
    run = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
    sums = run[first + sizes] - run[first]  # whole numbers: exact
    center = (sums / sizes[:, None]).astype("<f4").astype(float)
    radius = np.array([np.sqrt(((x[a : a + n] - c) ** 2).sum(axis=1).max()) for a, n, c in zip(first, sizes, center)])
    links = np.array(links)
    return Tree(order, first, first + sizes, links[:, 0], links[:, 1], center, radius * (1 + 1e-6), sums)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries less the rows' own squares: whole numbers, exact."""
    kind = float if 4 * x.shape[1] * max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) ** 2 < 2**53 else np.int64
    x, entries = x.astype(kind), entries.astype(kind)
    return (entries**2).sum(axis=1) - 2 * (x @ entries.T)


def assign(tree: Tree, x: np.ndarray, entries: np.ndarray):
    """Which entry each point belongs to: wholly owned balls and their entries, and points and their entries in the leaves that none owns.

    A ball inherits the list of entries that can be nearest to some point of its
    parent, and leaves out those farther from its centre than the nearest one by over two radii: they are
    nearest to none of its points.  Balls of one depth are done together, their lists as rows of a table; below a ball that is
    owned nothing is done.  Of equal entries only the first counts.
    """
    alive = np.zeros((len(tree.radius), len(entries)), bool)
    alive[0, np.unique(entries, axis=0, return_index=True)[1]] = True
    points, wide = entries.astype(float), 1e-5 * (1 + np.abs(entries).max(initial=0))
    parent = np.zeros(len(tree.radius), np.int64)
    for child in (tree.left, tree.right):
        parent[child[child >= 0]] = np.flatnonzero(child >= 0)
    owned, leaves, level = [], [], np.zeros(1, np.int64)
    while len(level):
        center = tree.center[level].astype(float)
        d = np.sqrt(np.maximum((center**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * (center @ points.T), 0))
        d[~alive[parent[level]]] = np.inf
        alive[level] = d <= (d.min(axis=1) + 2 * tree.radius[level] + wide)[:, None]
        one = alive[level].sum(axis=1) == 1
        leaf = tree.left[level] < 0
        owned.append(level[one])
        leaves.append(level[leaf & ~one])
        rest = level[~leaf & ~one]
        level = np.concatenate([tree.left[rest], tree.right[rest]])
    owned, leaves = np.concatenate(owned), np.sort(np.concatenate(leaves))
    sizes = (tree.last - tree.first)[leaves]
    places = tree.order[np.repeat(tree.first[leaves] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
    d = _squares(x[places], entries)
    d[~np.repeat(alive[leaves], sizes, axis=0)] = np.iinfo(np.int64).max // 2
    return owned, alive[owned].argmax(axis=1), places, d.argmin(axis=1)


def add_up(tree: Tree, x: np.ndarray, entries: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
    """Add the points' numbers and sums to those of their entries."""
    ball, entry, places, chosen = assign(tree, x, entries)
    np.add.at(counts, entry, (tree.last - tree.first)[ball])
    np.add.at(sums, entry, tree.sums[ball])
    np.add.at(counts, chosen, 1)
    np.add.at(sums, chosen, x[places])


def labels(tree: Tree, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entry of each point."""
    owned, of, places, chosen = assign(tree, x, entries)
    out = np.zeros(len(x), np.int64)
    for ball, entry in zip(owned, of):
        out[tree.order[tree.first[ball] : tree.last[ball]]] = entry
    out[places] = chosen
    return out
