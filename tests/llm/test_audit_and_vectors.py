"""The filter audit and the operators on embeddings against brute force on small tables with awkward rows."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.llm import anchors, embedding_dedup, filter_audit, vector_codes

DOCS = "doc_id bigint, text string, source string, part string, n bigint"
LABELS = "doc_id bigint, quality int, toxic int, mask int"
VECTORS = "vec_id bigint, embedding array<float>, label int, node string, N string"


def texts(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(["a", "b", "Cc", "DDDD", "e#", "f$", "g", *map(str, range(60))]) for _ in range(rng.choice([0, 3, 49, 50, 51, 120]))]
        text = rng.choice([None, "", " \n\t ", " ".join(words), " ".join(words), "\n".join(words), "x" * 30000 + " | Z"])
        if i % 5 == 0 and out:
            text = rng.choice(out)[1]
        out.append((rng.choice([None, i, i, i, 7]), text, rng.choice(["s", "s", "t", "", None]), "clash", i))
    return out + out[:3]


def audit_by_hand(docs: list[tuple], labels: list[tuple]) -> set[tuple]:
    firsts: dict[str, int] = {}
    for i, t, *_ in docs:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)
    good, toxic = {r[0] for r in labels if r[1] == 1}, {r[0] for r in labels if r[2] == 1}
    rows = []
    for i, t, s, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > firsts[t]}
        rows.append((s or "", failed, i is not None and i in good, i is not None and i in toxic))
    out, shapley = [], {}
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            whole = left
            for k, f in enumerate(order):
                gone, left = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                fails = sum(r[1][f] for r in whole)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in whole)
                out.append((part, "".join(order), k + 1, len(left), len(gone), fails - len(gone), unique, sum(r[2] for r in gone), sum(r[3] for r in gone), f))
    return {(*r[:-1], shapley[r[0], r[-1]]) for r in out}


def test_filter_audit(spark):
    docs = texts(1, 90)
    labels = [(i, random.Random(i).choice([0, 1, None]), random.Random(-i).choice([0, 1]), 3) for i in range(60)] + [(7, 1, 1, 3), (7, 0, 0, 3), (None, 1, 1, 3)]
    got = filter_audit.filter_audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    assert {tuple(r) for r in got} == audit_by_hand(docs, labels) and len(got) == 600 * 3
    none = filter_audit.filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert none.count() == 0 and none.columns == [c.split(" ")[0] for c in filter_audit.RESULT.split(", ")]


def test_filter_audit_own_filters(spark):
    docs = spark.createDataFrame([(1, "aa", "s", "", 0), (2, "ab", "s", "", 0), (3, "b", "s", "", 0), (4, None, "s", "", 0)], DOCS)
    labels = spark.createDataFrame([(1, 1, 0, 0)], LABELS)
    rows = filter_audit.filter_audit(docs, labels, {"x": F.col("text").contains("a"), "y": F.col("text").contains("b"), "z": F.lit(None).cast("boolean")}, copies=None).collect()
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in rows}
    assert len(got) == 18 and got["xyz", 1] == (2, 2, 0, 1, 1, 9) and got["xyz", 2] == (1, 1, 1, 1, 0, 9) and got["xyz", 3] == (1, 0, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        filter_audit.filter_audit(docs, labels, {c: F.lit(True) for c in "abcdefgh"})


@pytest.mark.parametrize("filters", [1, 2, 3, 4, 6])
def test_diagram_swaps(filters):
    rng = random.Random(filters)
    cells = {m: (rng.randint(1, 4), rng.randint(0, 1), 0) for m in range(1 << filters) if rng.random() < 0.6}
    orders = [list(range(filters))]
    diagram = filter_audit.Diagram(cells, filters)
    for k in filter_audit.swaps(filters):
        diagram.swap(k)
        orders.append(list(diagram.order))
        left = dict(cells)
        for f, kept, gone in diagram.steps():
            out = {m: w for m, w in left.items() if m >> f & 1}
            left = {m: w for m, w in left.items() if not m >> f & 1}
            assert kept == tuple(map(sum, zip((0, 0, 0), *left.values()))) and gone == tuple(map(sum, zip((0, 0, 0), *out.values())))
    assert len({tuple(o) for o in orders}) == len(orders) == math.factorial(filters)


def vectors(seed: int, n: int, width: int = 24) -> list[tuple]:
    """Clusters around the threshold, copies, scaled copies, and odd rows."""
    rng = np.random.default_rng(seed)
    rows = []
    centers = rng.normal(size=(max(1, n // 15), width))
    for i in range(n):
        c = centers[rng.integers(len(centers))]
        x = c + rng.normal(size=width) * rng.choice([0, 0.1, 0.25, 0.35, 2])
        rows.append((i * 7 % n, (x * rng.choice([1, 1, 0.01, 300])).astype(np.float32).tolist(), rng.choice([0, 1, None])))
    odd = [None, [], [0.0] * width, [None, *[1.0] * (width - 1)], [float("nan")] * width, [float("inf")] * width, [1.0] * 5, [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 2.0, 2.0, 2.0, 2.0]]
    rows += [(1000 + i, v, 5) for i, v in enumerate(odd)] + [(2000 + i, rows[0][1], None) for i in range(40)] + [rows[1], rows[1], (None, rows[0][1], 1)]
    return [(*r, "clash", "clash") for r in rows]


def links_by_hand(rows: list[tuple], threshold: float) -> list[tuple]:
    sound = [i for i, (k, v, *_) in enumerate(rows) if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    n = [0] * len(rows)
    for i, j in itertools.combinations(sound, 2):
        a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
        if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
            n[i], n[j], root[find(i)] = n[i] + 1, n[j] + 1, find(j)
    least: dict[int, int] = {}
    for i in sound:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    out = [(r[0], n[i], least.get(find(i), r[0])) for i, r in enumerate(rows)]
    return sorted(((k, n, c, k == c) for k, n, c in out), key=repr)


@pytest.mark.parametrize("places", [None, (6, 3)])
def test_near_duplicates(spark, places):
    rows = vectors(3, 300)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(4), places=places)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == links_by_hand(rows, 0.9)
    doubles = spark.createDataFrame([r[:2] for r in rows[:50]], "vec_id bigint, embedding array<double>")
    assert sorted((tuple(r) for r in embedding_dedup.near_duplicates(doubles, 0.8, places=places).collect()), key=repr) == links_by_hand(rows[:50], 0.8)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_near_duplicates_of_frequent_keys(spark, monkeypatch):
    """Keys and cells over the size of a block lose no pair."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=16) + rng.normal(size=(150, 16)) * 0.3
    df = spark.createDataFrame(rows := [(i, v.astype(np.float32).tolist(), None, None, None) for i, v in enumerate(x)], VECTORS)
    whole = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect())
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    monkeypatch.setattr(embedding_dedup, "CELL", 16)
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect()) == whole
    found, there = (sum(r[1] for r in rows) for rows in (whole, links_by_hand(rows, 0.9)))
    assert 0.99 * there <= found <= there


@pytest.mark.parametrize("width", [16, 64, 200])
@pytest.mark.parametrize("places", [(4, 2), (6, 3)])
def test_estimates_and_recall(width, places):
    """At the threshold the estimate is unbiased with the deviation that is stated (less in vectors shorter than their codes), and pairs meet."""
    rng = np.random.default_rng(width)
    a, e = rng.normal(size=(2, 3000, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    e -= (a * e).sum(axis=1, keepdims=True) * a
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    plan = embedding_dedup.Plan(0.9, *places, 4.5, 7)
    (left, k), (right, m) = embedding_dedup.encode(a, plan), embedding_dedup.encode(0.9 * a + np.sqrt(0.19) * e, plan)
    codes = embedding_dedup.Codes.of(np.concatenate([left, right]), width, plan)
    value = np.concatenate([np.diag(codes.cosines(slice(s, s + 500), slice(s + 3000, s + 3500))) for s in range(0, 3000, 500)])
    spread = codes.spread(np.arange(3000), np.arange(3000, 6000), 0.9)
    assert abs(value.mean() - 0.9) < 0.01 and (0.7 if width < 64 else 0.85) < value.std() / spread.mean() < 1.15
    assert (value + 4.5 * spread >= 0.9).all()
    assert plan.width(int(k[0, 0]), left.dtype.itemsize) == width
    assert (k[:, :, None] == m[:, None, :]).any(axis=(1, 2)).mean() > 0.97


def codes_by_hand(rows: list[tuple], entries: int = 256, rounds: int = 4) -> list[tuple]:
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = sorted((r for r in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    fill = [0] * (-width % 4)
    x = np.array([[min(max(math.floor(1024 * c), -(1 << 24)), 1 << 24) for c in r[1]] + fill for r in kept], dtype=object).reshape(len(kept), 4, -1)
    books = [[list(v) for v in x[:entries, p]] for p in range(4)]

    def nearest(v, book):
        d = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(4):
            owned: dict[int, list] = {}
            for v in x[:, p]:
                owned.setdefault(nearest(v, books[p])[0], []).append(v)
            for e, of in owned.items():
                books[p][e] = [sum(c) // len(of) for c in zip(*of)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    found = [[nearest(v[p], books[p]) for p in range(4)] for v in x]
    error = [sum(f[1] for f in fs) for fs in found]
    by_label: dict = {}
    for r, e in zip(kept, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{f[0]:02x}" for f in fs), e, by_label[r[2]], digest) for r, fs, e in zip(kept, found, error)), key=repr)


@pytest.mark.parametrize("n,width,entries", [(300, 8, 16), (40, 6, 256), (30, 2, 4)])
def test_vector_codes(spark, n, width, entries):
    rows = vectors(n, n, width)
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = vector_codes.vector_codes(df, entries=entries)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == codes_by_hand(rows, entries)


def test_vector_codes_odd(spark):
    huge = [(1, [1e30, -1e30, 0.5, 0.25], None), (2, [1.0, 2.0, -3.0, 1e-9], 1), (3, [-1e-9, 2.0, 3.0, 9e9], 1)]
    df = spark.createDataFrame(huge, "vec_id bigint, embedding array<double>, label int")
    assert sorted((tuple(r) for r in vector_codes.vector_codes(df, entries=2).collect()), key=repr) == codes_by_hand(huge, 2)
    assert vector_codes.vector_codes(spark.createDataFrame([], VECTORS)).count() == 0
    nothing = vector_codes.vector_codes(spark.createDataFrame([(1, [], 2, "", "")], VECTORS)).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in nothing] == [(1, "00000000", 0, 0)]


@pytest.mark.parametrize("kind", ["even", "clustered", "copies", "one", "line"])
def test_anchors(kind):
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(700, 5)) * 100).astype(np.int64)
    if kind == "clustered":
        x = x[rng.integers(0, 9, 700)] + rng.integers(-3, 3, size=(700, 5))
    if kind == "copies":
        x[:500] = x[0]
    if kind == "one":
        x = x[:1]
    if kind == "line":
        x[:, 1:] = 0
    tree = anchors.Tree.of(anchors.build(x).arrays())
    assert sorted(tree.order) == list(range(len(x)))
    for b in range(len(tree.radius)):
        inside = x[tree.order[tree.first[b] : tree.last[b]]]
        assert (inside.sum(axis=0) == tree.sums[b]).all() and np.linalg.norm(inside - tree.center[b], axis=1).max() <= tree.radius[b] + 1e-3
        if tree.left[b] >= 0:
            assert (tree.first[b], tree.last[b]) == (tree.first[tree.left[b]], tree.last[tree.right[b]]) and tree.last[tree.left[b]] == tree.first[tree.right[b]]
    entries = np.concatenate([x[:40], x[:1], [[999, 0, 0, 0, 0]]])
    d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (anchors.labels(tree, x, entries) == d.argmin(axis=1)).all()
    counts, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    anchors.add_up(tree, x, entries, counts, sums)
    assert (counts == np.bincount(d.argmin(axis=1), minlength=len(entries))).all()
    assert all((sums[e] == x[d.argmin(axis=1) == e].sum(axis=0)).all() for e in range(len(entries)))
    if kind == "clustered":
        assert len(anchors.assign(tree, x, x[:9])[0]) > 0  # balls that one entry owns
