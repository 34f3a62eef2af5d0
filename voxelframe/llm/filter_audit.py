"""How filters interact: what each one removes, alone and behind others, in every order of them.

Every document becomes a mask of the filters that it fails.  Equal masks of a
part (a source, say) are counted in Spark, so a part is at most
4 * 2 ** filters cells whatever its size.  The cells of a part become a
decision diagram: a level for each filter, a node's low edge for documents
that pass and its high edge for those that fail, equal nodes shared, every node with
the weights (documents, good ones, toxic ones) below it.  All orders of the
filters are visited by swaps of two adjacent levels, each of which rebuilds
these two levels and leaves all others alone.  Under any order the path of low edges from
the root is what is left after each step, and the high edge at each of its nodes what the
step removes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, lean, numbered

WORD = r"[^\x20\x09-\x0D]+"
Weights = tuple[int, ...]


class Diagram:
    """A reduced, ordered decision diagram of masks with a vector of counts under each node.

    A node is (low, high) at some level, known by its number; level k tests
    ``order[k]``.  Node 0 is the empty set at every level, so that levels below
    it need no nodes.  Nodes of one level with equal children are one node.
    """

    def __init__(self, cells: Mapping[int, Weights], filters: int) -> None:
        self.order = list(range(filters))
        width = len(next(iter(cells.values()), (0, 0, 0)))
        self.weights: list[Weights] = [(0,) * width]
        self.children: list[tuple[int, int]] = [(0, 0)]
        self.known: list[dict[tuple, int]] = [{} for _ in range(filters + 1)]
        nodes = {mask: self._leaf(w) for mask, w in cells.items()}
        for level in reversed(range(filters)):  # the masks' bits above the level tell the nodes of it apart
            low = (1 << level) - 1
            nodes = {mask: self._node(level, nodes.get(mask, 0), nodes.get(mask | 1 << level, 0)) for mask in {m & low for m in nodes}}
        self.root = nodes.get(0, 0)

    def _leaf(self, weights: Weights) -> int:
        return self._new(len(self.order), weights, (0, 0), weights) if any(weights) else 0

    def _node(self, level: int, low: int, high: int) -> int:
        if not (low or high):
            return 0
        return self._new(level, (low, high), (low, high), tuple(a + b for a, b in zip(self.weights[low], self.weights[high])))

    def _new(self, level: int, key: tuple, children: tuple[int, int], weights: Weights) -> int:
        if (found := self.known[level].get(key)) is not None:
            return found
        self.children.append(children)
        self.weights.append(weights)
        self.known[level][key] = len(self.weights) - 1
        return self.known[level][key]

    def swap(self, level: int) -> None:
        """Exchange the filters of this level and the next.  Nodes of the upper level stay the same sets of masks, so they keep their numbers and only their children change."""
        upper, self.known[level], self.known[level + 1] = self.known[level], {}, {}
        for node in upper.values():
            (a, b), (c, d) = (self.children[x] for x in self.children[node])
            self.children[node] = pair = self._node(level + 1, a, c), self._node(level + 1, b, d)
            self.known[level][pair] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, Weights, Weights]]:
        """Along the path that passes all filters: filter, weights left after it, weights it removes."""
        node, out = self.root, []
        for f in self.order:
            low, high = self.children[node]
            out.append((f, self.weights[low], self.weights[high]))
            node = low
        return out


def swaps(n: int) -> Iterator[int]:
    """Adjacent swaps that lead through all n! orders (Johnson 1963, Trotter 1962)."""
    if n < 2:
        return
    inner = swaps(n - 1)
    while True:
        yield from reversed(range(n - 1))  # the last element goes down
        if (k := next(inner, None)) is None:
            return
        yield k + 1
        yield from range(n - 1)  # and up
        if (k := next(inner, None)) is None:
            return
        yield k


def audit_part(cells: Mapping[int, Weights], letters: str) -> list[tuple]:
    """Rows (order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part."""
    n = len(letters)
    diagram = Diagram(cells, n)
    fails, unique, total, out = {}, {}, dict.fromkeys(range(n), 0), []
    for turn in itertools.chain([None], swaps(n)):
        if turn is not None:
            diagram.swap(turn)
        path = diagram.steps()
        fails[path[0][0]] = path[0][2][0]  # the first filter meets all documents,
        unique[path[-1][0]] = path[-1][2][0]  # the last one those that pass all others
        for f, _, gone in path:
            total[f] += gone[0]
        out.append(path)
    return [
        ("".join(letters[f] for f, _, _ in path), k + 1, left[0], gone[0], fails[f] - gone[0], unique[f], gone[1], gone[2], total[f])
        for path in out for k, (f, left, gone) in enumerate(path)
    ]


RESULT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def _audits(letters: str):
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums: dict[int, Weights] = {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in cells}
                rows = [(part, *r) for r in audit_part(sums, letters)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def five_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text (not null): short, repetitive, shouting, symbols."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def filter_audit(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column] | None = None, copies: str | None = "E") -> DataFrame:
    """For every part (source), order of the filters and step: counts of what is kept, removed and lost.

    ``failures`` maps a letter to a condition over column ``text`` (null texts
    are empty there); by default those of ``five_filters``.  ``copies`` is the letter of a further filter that
    fails texts equal to the text of a smaller doc_id anywhere in docs (None: no such
    filter).  labels: doc_id, quality, toxic; a document is good (toxic) if any
    of its rows there has quality (toxic) 1, others are neither.

    Null and empty sources are one part, ''.  Rows that share a doc_id count
    each; they are no copies of one another.  A null doc_id has no label, is
    no copy and has none.  Conditions that are null do not fail.  Empty docs give no rows.  More than
    seven filters are an error, as their orders are all returned.
    """
    spark = docs.sparkSession
    text, source = F.coalesce("text", F.lit("")), F.coalesce(F.col("source"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), source.alias("part"))
    conditions = dict(five_filters(F.col("text")) if failures is None else failures)
    letters = "".join(conditions) + (copies or "")
    if len(letters) > 7 or len(set(letters)) < len(letters):
        raise ValueError("filters are at most seven different letters")
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions.values())), F.lit(0))
    digest = F.unhex(F.sha2(F.col("text"), 256)) if copies else F.lit(None).cast("binary")
    scratch = Scratch(spark, "filter-audit")
    seen = rows.select("doc_id", "part", mask.cast("int").alias("mask"), digest.alias("digest"))
    seen = scratch.keep(seen.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")), "seen")  # texts are read once, and repeated rows are one from here on
    known = seen.where("doc_id is not null")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic"))
    marked = known.join(marks, "doc_id", "left").select(*known.columns, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    if copies:
        # Joined by doc_id and digest, not by the digest alone: a text of many copies would be one hot key.
        first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
        marked = marked.join(first, ["doc_id", "digest"], "left").withColumn("mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << len(conditions)))
    apart = seen.where("doc_id is null").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    every = marked.select("part", "mask", "n", "good", "toxic").union(apart)
    cells = every.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2 ** filters cells at most
    return parts.mapInArrow(_audits(letters), RESULT)
