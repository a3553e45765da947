"""Deep trees, forests and boosted trees of all folds of a cross-validation, from cells.

Features are cut into at most 32 bins, the library's default, by quantiles of all rows. Rows with equal bins are one cell with
their numbers by fold and class, so what is trained on is bounded by the product of bins, however many rows there are. Cells are made by one
grouping; where they are no more than ``MOST_CELLS`` every task gets them (some 100 bytes each), and tasks grow trees that are independent of
each other: the trees of a forest, the folds, the classifiers. A task tests its trees on the cells of the fold left out and returns sums of votes by cell; no tree
leaves its task. Where there are more cells, ``models.cross_validate`` fits by the library, whose passes share the rows.

Trees are those of the library: splits between bins, entropy or Gini impurity, a split needs a gain above 0 and the smallest number of rows on both
sides, two leaves with the same answer are one leaf. Of equal gains the smaller feature counts, then the smaller bin.
A sample with replacement draws a cell's number from Poisson(its rows), one without from Binomial(its rows, share): what drawing each row gives.
All draws follow from (classifier, fold, tree).
"""

from __future__ import annotations

import time
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees

#: Cells that a task may be given.
MOST_CELLS = 1 << 20
BINS = 32
#: Trees of a forest that one task grows.
TREES_A_TASK = 5
DEEPEST = 30


@dataclass(frozen=True)
class Kind:
    """``tried``: a node tries the root of all features' number, drawn for it; ``drawn``: rows are drawn with replacement."""

    entropy: bool = True
    least: int = 1
    count: int = 1
    tried: bool = False
    drawn: bool = False


#: As in ``models.classifier``.
KINDS = {"random_tree": Kind(entropy=False, tried=True), "j48": Kind(), "rep_tree": Kind(least=2), "random_forest": Kind(entropy=False, count=100, tried=True, drawn=True)}
BOOSTED = "boosted"
NAMES = (*KINDS, BOOSTED)


def impurity(a: np.ndarray, b: np.ndarray, entropy: bool) -> np.ndarray:
    """Impurity of nodes with a and b rows of the two classes, times their rows."""
    n = np.maximum(a + b, 1e-300)
    if not entropy:
        return 2 * a * b / n
    return -(a * np.log2(np.maximum(a, 1e-300) / n) + b * np.log2(np.maximum(b, 1e-300) / n))


def grow(bins: np.ndarray, w: np.ndarray, kind: Kind, rng: np.random.Generator) -> list[tuple[np.ndarray, ...]]:
    """One tree, a level after the other: (feature or -1, bin, number of the left child in the next level, rows of class 0, of class 1) of each level's nodes.

    ``bins`` has a line for each feature, ``w`` a line for each class.
    """
    width = len(bins)
    take = int(np.ceil(np.sqrt(width))) if kind.tried else width
    some = w.sum(0) > 0
    bins, w = bins[:, some], w[:, some].astype(float)
    node, nodes, levels = np.zeros(w.shape[1], np.int64), 1, []
    for depth in range(DEEPEST + 1):
        total = np.stack([np.bincount(node, x, nodes) for x in w])
        gain, feature, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64)
        able = (total.min(0) > 0) & (total.sum(0) >= 2 * kind.least) & (depth < DEEPEST)
        tries = np.ones((width, nodes), bool) if take == width else rng.random((width, nodes)).argsort(0).argsort(0) < take
        whole = impurity(total[0], total[1], kind.entropy)
        for f in range(width):
            at = np.flatnonzero((tries[f] & able)[node])
            if not len(at):
                continue
            key = node[at] * BINS + bins[f, at]
            order = np.argsort(key)
            key, mine = key[order], at[order]
            last = np.append(key[1:] != key[:-1], True)
            ends = np.flatnonzero(last)
            sums = np.cumsum(w[:, mine], 1)[:, ends]
            of = key[ends] // BINS
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            before = np.where(first > 0, sums[:, first - 1], 0.0)
            left = sums - np.repeat(before, np.diff(np.append(first, len(of))), axis=1)
            right = total[:, of] - left
            # rounded, so that equal gains are equal
            by = np.round((whole[of] - impurity(*left, kind.entropy) - impurity(*right, kind.entropy)) / total.sum(0)[of], 12)
            by[(left.sum(0) < kind.least) | (right.sum(0) < kind.least)] = 0
            best = np.maximum.reduceat(by, first)
            hit = np.flatnonzero(by == np.repeat(best, np.diff(np.append(first, len(of)))))
            chosen = hit[np.append(True, of[hit[1:]] != of[hit[:-1]])]
            better = best > gain[of[chosen]]
            n, c = of[chosen][better], chosen[better]
            gain[n], feature[n], cut[n] = best[better], f, key[ends[c]] % BINS
        child = np.where(feature >= 0, 2 * (np.cumsum(feature >= 0) - 1), -1)
        levels.append((feature, cut, child, total[0], total[1]))
        on = np.flatnonzero(feature[node] >= 0)
        if not len(on):
            break
        bins, w, node = bins[:, on], w[:, on], node[on]
        node = child[node] + (bins[feature[node], np.arange(len(node))] > cut[node])
        nodes = 2 * int((feature >= 0).sum())
    return pruned(levels)


def pruned(levels: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """From the leaves up: two leaves with the same answer become one."""
    leaf = None
    for feature, _, child, a, b in reversed(levels):
        if leaf is not None:
            split = np.flatnonzero(feature >= 0)
            left = child[split]
            same = leaf[left] & leaf[left + 1] & (answer[left] == answer[left + 1])
            feature[split[same]] = -1
        leaf, answer = feature < 0, b > a
    return levels


def share(levels: list[tuple[np.ndarray, ...]], bins: np.ndarray) -> np.ndarray:
    """Share of class 1 in the leaf that each cell reaches."""
    out, at, node = np.zeros(bins.shape[1]), np.arange(bins.shape[1]), np.zeros(bins.shape[1], np.int64)
    for feature, cut, child, a, b in levels:
        f = feature[node]
        done = f < 0
        out[at[done]] = (b / np.maximum(a + b, 1e-300))[node[done]]
        at, node, f = at[~done], node[~done], f[~done]
        if not len(at):
            break
        node = child[node] + (bins[f, at] > cut[node])
    return out


def boost(bins: np.ndarray, w: np.ndarray, test: np.ndarray, rng: np.random.Generator, rounds: int = 50, depth: int = 6, rate: float = 0.1, rows: float = 0.8, features: float = 0.8) -> tuple[np.ndarray, float]:
    """Margins of the cells of ``test``, and the seconds spent on them: regression trees by least squares on the gradient of 2 log(1 + exp(-2 y m)), y in -1 and 1; the first one is on y itself and counts whole."""
    width, spent = len(bins), 0.0
    take = int(np.ceil(features * width))
    margin, out = np.zeros(bins.shape[1]), np.zeros(test.shape[1])
    for r in range(rounds):
        residual = [np.full(len(margin), y) if r == 0 else 4 * y / (1 + np.exp(2 * y * margin)) for y in (-1.0, 1.0)]
        n = rng.binomial(w.astype(np.int64), rows).astype(float)
        weight, s = n.sum(0), n[0] * residual[0] + n[1] * residual[1]
        node, away, value = np.zeros(len(margin), np.int64), np.zeros(len(out), np.int64), None
        able = np.ones(1, bool)
        for level in range(depth + 1):
            nodes = 1 << level
            total, sums = np.bincount(node, weight, nodes), np.bincount(node, s, nodes)
            own = sums / np.maximum(total, 1e-300)
            value = own if value is None else np.where(total > 0, own, np.repeat(value, 2))
            if level == depth:
                break
            best, feature, cut = np.full(nodes, 1e-12), np.zeros(nodes, np.int64), np.full(nodes, BINS)
            tries = np.ones((width, nodes), bool) if take >= width else rng.random((width, nodes)).argsort(0).argsort(0) < take
            for f in range(width):
                key = node * BINS + bins[f]
                lw, ls = (np.bincount(key, x, nodes * BINS).reshape(nodes, BINS).cumsum(1) for x in (weight, s))
                rw, rs = total[:, None] - lw, sums[:, None] - ls
                ok = (lw > 0) & (rw > 0.5) & (tries[f] & able)[:, None]
                gain = np.where(ok, ls**2 / np.maximum(lw, 1e-300) + rs**2 / np.maximum(rw, 0.5) - (sums**2 / np.maximum(total, 1e-300))[:, None], 0) / np.maximum(total, 1)[:, None]
                k = np.round(gain, 12).argmax(1)
                g = np.round(gain, 12)[np.arange(nodes), k]
                better = g > best
                best[better], feature[better], cut[better] = g[better], f, k[better]
            # a node without a split hands all rows to its left child, which isn't split either
            able = np.repeat(cut < BINS, 2)
            node = 2 * node + (bins[feature[node], np.arange(len(node))] > cut[node])
            began = time.perf_counter()
            away = 2 * away + (test[feature[away], np.arange(len(away))] > cut[away])
            spent += time.perf_counter() - began
        step = 1.0 if r == 0 else rate
        margin += step * value[node]
        out += step * value[away]
    return out, spent


def cells(df: DataFrame, columns: list[str], folds: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Bins of each cell, a line for each feature, and its rows by fold and class; None where there are more than MOST_CELLS."""
    data = trees.binned(df.withColumn("_key", F.lit(0)), columns, F.col("y"), "_key", F.array("fold"), bins=BINS)
    counts = [F.count_if((F.col("members")[0] == k) & (F.col("y") == y)).alias(f"n{k}_{y}") for k in range(folds) for y in (0, 1)]
    each = trees.saved(data.rows.groupBy("bins").agg(*counts, F.count_if(F.coalesce(~F.col("y").isin(0, 1), F.lit(True))).alias("other")))
    if each.agg(F.sum("other")).first()[0]:
        raise ValueError("y is 0 or 1")
    if each.count() > MOST_CELLS:
        return None
    got = each.orderBy("bins").toArrow().combine_chunks()
    flat = np.array(list(b"".join(got["bins"].to_pylist())), np.uint8).reshape(got.num_rows, len(columns))
    n = np.stack([got[f"n{k}_{y}"].to_numpy() for k in range(folds) for y in (0, 1)]).reshape(folds, 2, -1)
    return np.ascontiguousarray(flat.T), n


VOTES = "classifier string, fold int, cell int, votes double"


def validate(df: DataFrame, columns: list[str], names: list[str], folds: int) -> list[tuple] | None:
    """(classifier, fold, tp, fp, fn, tn, seconds of fitting, nanoseconds a row of testing) of those ``names`` that are NAMES; None where cells are too many.

    ``df`` has y, fold and the columns without missing values. Seconds are those of all tasks together.
    """
    made = cells(df, columns, folds)
    if made is None:
        return None
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(made)
    tasks = [(name, k, lo, min(KINDS[name].count, lo + TREES_A_TASK) if name in KINDS else 1) for name in names for k in range(folds) for lo in range(0, KINDS[name].count if name in KINDS else 1, TREES_A_TASK)]
    tasks.sort(key=lambda t: t[0] != BOOSTED)  # the longest ones begin

    def run(jobs):
        bins, n = shared.value
        for name, k, lo, hi in jobs:
            w, at = n.sum(0) - n[k], np.flatnonzero(n[k].sum(0))
            train = np.flatnonzero(w.sum(0))
            mine, w, test = bins[:, train], w[:, train], bins[:, at]
            votes, fitting, testing = np.zeros(len(at)), 0.0, 0.0
            for tree in range(lo, hi):
                rng = np.random.default_rng([42, zlib.crc32(name.encode()), k, tree])
                began = time.perf_counter()
                if name == BOOSTED:
                    margin, testing = boost(mine, w, test, rng)
                    votes = np.where(margin > 0, 1.0, 0.0)
                    fitting = time.perf_counter() - began - testing
                    continue
                levels = grow(mine, rng.poisson(w) if KINDS[name].drawn else w, KINDS[name], rng)
                grown = time.perf_counter()
                votes += share(levels, test)
                fitting, testing = fitting + grown - began, testing + time.perf_counter() - grown
            yield name, k, at, votes, fitting, testing

    def tables(batches):
        for b in batches:
            for name, k, at, votes, fitting, testing in run(zip(*(c.to_pylist() for c in b.columns))):
                # times stand behind the cells
                cell, value = np.concatenate([at, [-1, -2]]), np.concatenate([votes, [fitting, testing]])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cell)), pa.array(np.full(len(cell), k), pa.int32()), pa.array(cell, pa.int32()), pa.array(value)], ["classifier", "fold", "cell", "votes"])

    # one part a task, since each is seconds of work
    dealt = spark.createDataFrame(spark.sparkContext.parallelize(tasks, len(tasks)), "name string, fold int, lo int, hi int")
    summed = dealt.mapInArrow(tables, VOTES).groupBy("classifier", "fold", "cell").agg(F.sum("votes").alias("votes"))

    def judge(batches):
        _, n = shared.value
        for b in batches:
            classifier, fold, cell, votes = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            count = np.array([KINDS[c].count if c in KINDS else 1 for c in classifier])
            fired = np.round(votes, 9) > np.round(count / 2, 9)
            real = cell >= 0
            rows = np.where(real, n[fold, :, cell].T, 0) if len(cell) else np.zeros((2, 0), np.int64)
            out = [rows[1] * fired, rows[0] * fired, rows[1] * ~fired, rows[0] * ~fired]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array(x, pa.int64()) for x in out), pa.array(np.where(cell == -1, votes, 0.0)), pa.array(np.where(cell == -2, votes, 0.0))], ["classifier", "fold", "tp", "fp", "fn", "tn", "f", "t"])

    judged = summed.mapInArrow(judge, "classifier string, fold int, tp bigint, fp bigint, fn bigint, tn bigint, f double, t double")
    rows = judged.groupBy("classifier", "fold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "f", "t")]).collect()
    return [(r["classifier"], r["fold"], r["tp"], r["fp"], r["fn"], r["tn"], r["f"], 1e9 * r["t"] / max(1, r["tp"] + r["fp"] + r["fn"] + r["tn"])) for r in rows]
