"""Classification trees with random thresholds, any number of them level by level in the same passes.

At each node some features are drawn, and for each one cut, uniformly between the smallest and the largest value that the node's
rows have; the cut with the largest gain of information is taken.  So a level is two passes over the rows for all trees: one for
the ranges of the drawn features, one for the classes on the left of their cuts.  A task returns one row for each tree, open node and drawn
feature; the driver holds trees and never rows.

All draws follow from (seed, tree, node), so trees are repeatable on any partitioning.  Missing and not-a-number values go left and
take no part in a feature's range.  Of equal gains the smaller feature counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .models import saved


@dataclass
class RandomTree:
    """Nodes in the order they were made; feature -1 marks a leaf. ``counts`` are a node's training rows by class."""

    f: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    l: list[int] = field(default_factory=lambda: [-1])  # noqa: E741
    r: list[int] = field(default_factory=lambda: [-1])
    counts: list[np.ndarray] = field(default_factory=list)

    def split(self, node: int, f: int, cut: float, left: np.ndarray) -> tuple[int, int]:
        n = len(self.f)
        self.f[node], self.cut[node], self.l[node], self.r[node] = f, cut, n, n + 1
        for c in (left, self.counts[node] - left):
            for column, x in zip((self.f, self.cut, self.l, self.r), (-1, 0.0, -1, -1)):
                column.append(x)
            self.counts.append(c)
        return n, n + 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node that each row reaches."""
        f, cut, left, right = (np.array(v) for v in (self.f, self.cut, self.l, self.r))
        at = np.zeros(len(x), np.int64)
        while (going := f[at] >= 0).any():
            over = x[np.arange(len(x)), np.maximum(f[at], 0)] > cut[at]  # false for not-a-number
            at = np.where(going, np.where(over, right[at], left[at]), at)
        return at


def drawn(seed: int, tree: int, node: int, width: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, ascending; where each one's cut lies in its range) of a node."""
    rng = np.random.default_rng([seed, tree, node])
    return np.sort(rng.choice(width, many, replace=False)), rng.random(many)


def entropy(counts: np.ndarray) -> float:
    n = counts.sum()
    p = counts[counts > 0] / max(n, 1)
    return float(-(p * np.log2(p)).sum())


def gain(parent: np.ndarray, left: np.ndarray) -> float:
    """Information that a split brings, rounded so that the order of sums doesn't matter."""
    right, n = parent - left, parent.sum()
    return round(entropy(parent) - (left.sum() * entropy(left) + right.sum() * entropy(right)) / n, 9)


def _batches(batches):
    for b in batches:
        x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
        yield b.column(1).to_numpy(zero_copy_only=False).astype(np.int64), x


def grow(df: DataFrame, columns: list[str], y: str, classes: int, trees: int = 1, depth: int = 12, features: int | None = None, least: int = 1, seed: int = 42) -> list[RandomTree]:
    """``trees`` trees on all rows; ``y`` is the class from 0, ``features`` how many are drawn at a node (the root of all), ``least`` the rows of a child."""
    width = len(columns)
    many = min(width, features or max(1, round(math.sqrt(width))))
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    rows = saved(df.select(F.lit(0).alias("key"), F.col(y).cast("int").alias("y"), F.array(*[value(c) for c in columns]).alias("x")).filter("y is not null"))
    first = np.zeros(classes, np.int64)
    for r in rows.groupBy("y").count().collect():
        first[r["y"]] = r["count"]
    made = [RandomTree(counts=[first.copy()]) for _ in range(trees)]
    good = lambda c: c.sum() >= 2 * least and (c > 0).sum() > 1
    open_ = {(t, 0) for t in range(trees) if good(first)}
    for _ in range(depth):
        if not open_:
            break
        asked = {k: drawn(seed, *k, width, many) for k in sorted(open_)}
        by_tree: dict[int, list[int]] = {}
        for t, node in asked:
            by_tree.setdefault(t, []).append(node)

        def ranges(batches):
            lo, hi = ({k: np.full(many, s * np.inf) for k in asked} for s in (1, -1))  # noqa: B023
            for _, x in _batches(batches):
                for t, nodes in by_tree.items():  # noqa: B023
                    at = made[t].leaves(x)
                    for node in nodes:
                        own = x[at == node][:, asked[t, node][0]]  # noqa: B023
                        if len(own):
                            lo[t, node] = np.fmin(lo[t, node], np.fmin.reduce(own))
                            hi[t, node] = np.fmax(hi[t, node], np.fmax.reduce(own))
            keys = list(asked)  # noqa: B023
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in keys for _ in range(many)], pa.int32()) for i in (0, 1)] + [pa.array(list(range(many)) * len(keys), pa.int32())] + [pa.array(np.concatenate([v[k] for k in keys])) for v in (lo, hi)],
                ["tree", "node", "i", "lo", "hi"],
            )

        found = rows.mapInArrow(ranges, "tree int, node int, i int, lo double, hi double").groupBy("tree", "node", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
        cuts = {k: np.full(many, np.nan) for k in asked}
        for r in found:
            if r["lo"] < r["hi"]:
                cuts[r["tree"], r["node"]][r["i"]] = r["lo"] + asked[r["tree"], r["node"]][1][r["i"]] * (r["hi"] - r["lo"])

        def lefts(batches):
            total = {k: np.zeros((many, classes), np.int64) for k in asked}  # noqa: B023
            for y_, x in _batches(batches):
                for t, nodes in by_tree.items():  # noqa: B023
                    at = made[t].leaves(x)
                    for node in nodes:
                        mine = at == node
                        under = ~(x[mine][:, asked[t, node][0]] > cuts[t, node])  # noqa: B023
                        for c in range(classes):
                            total[t, node][:, c] += under[y_[mine] == c].sum(0)
            keys = [(t, n, i, c) for t, n in asked for i in range(many) for c in range(classes)]  # noqa: B023
            yield pa.RecordBatch.from_arrays([*(pa.array([k[j] for k in keys], pa.int32()) for j in range(4)), pa.array([int(total[t, n][i, c]) for t, n, i, c in keys], pa.int64())], ["tree", "node", "i", "c", "n"])

        left = {k: np.zeros((many, classes), np.int64) for k in asked}
        for r in rows.mapInArrow(lefts, "tree int, node int, i int, c int, n bigint").groupBy("tree", "node", "i", "c").agg(F.sum("n").alias("n")).collect():
            left[r["tree"], r["node"]][r["i"], r["c"]] = r["n"]
        after = set()
        for (t, node), (chosen, _) in asked.items():
            whole, best = made[t].counts[node], None
            for i, f in enumerate(chosen.tolist()):
                some = left[t, node][i]
                if np.isnan(cuts[t, node][i]) or min(some.sum(), (whole - some).sum()) < least:
                    continue
                g = gain(whole, some)
                if g > 0 and (best is None or g > best[0]):
                    best = (g, f, float(cuts[t, node][i]), some)
            if best:
                for child in made[t].split(node, *best[1:]):
                    if good(made[t].counts[child]):
                        after.add((t, child))
        open_ = after
    return made


def predict(df: DataFrame, made: list[RandomTree], columns: list[str]) -> DataFrame:
    """``df`` with ``shares`` array<double> (mean over trees of the class shares of the leaf) and ``predicted`` (of equal shares the smaller class)."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    source = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.array(*[value(c) for c in columns]).alias("x"))

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            p = sum((np.array(t.counts) / np.maximum(np.array(t.counts).sum(1, keepdims=True), 1))[t.leaves(x)] for t in made) / len(made)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(p), pa.list_(pa.float64())), pa.array(p.round(9).argmax(1), pa.int32())], ["row", "shares", "predicted"])

    schema = T.StructType([source.schema["row"], T.StructField("shares", T.ArrayType(T.DoubleType())), T.StructField("predicted", T.IntegerType())])
    return source.mapInArrow(run, schema).select("row.*", "shares", "predicted")
