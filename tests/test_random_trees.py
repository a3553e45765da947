"""Trees with random thresholds against the same draws on plain arrays."""

import numpy as np
from pyspark.sql import functions as F

from gridwarden.operators import random_trees as R

COLUMNS = ["a", "b", "c"]


def plain(x, y, classes, tree, depth, many, least, seed):
    """(depth-first) {node: (feature, cut, left, right, counts)} by recursion over row numbers, nodes numbered level by level."""
    counts = lambda at: np.bincount(y[at], minlength=classes)
    nodes, level = {0: [-1, 0.0, -1, -1, np.arange(len(y))]}, [0]
    for _ in range(depth):
        after = []
        for node in level:
            at = nodes[node][4]
            c = counts(at)
            if c.sum() < 2 * least or (c > 0).sum() < 2:
                continue
            chosen, u = R.drawn(seed, tree, node, x.shape[1], many)
            best = None
            for f, w in zip(chosen, u):
                v = x[at, f][~np.isnan(x[at, f])]
                if len(v) and v.min() < v.max():
                    cut = v.min() + w * (v.max() - v.min())
                    left = at[~(x[at, f] > cut)]
                    if min(len(left), len(at) - len(left)) >= least and (g := R.gain(c, counts(left))) > 0 and (best is None or g > best[0]):
                        best = (g, int(f), float(cut), left)
            if best:
                n = len(nodes)
                nodes[node][:4] = [best[1], best[2], n, n + 1]
                nodes[n], nodes[n + 1] = [-1, 0.0, -1, -1, best[3]], [-1, 0.0, -1, -1, np.setdiff1d(at, best[3])]
                after += [n, n + 1]
        level = after
    return nodes


def test_trees_on_any_partitioning(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, 3)).round(3)
    x[::17, 1] = np.nan
    y = (x[:, 0] * 2 + (np.nan_to_num(x[:, 1]) > 0.5)).astype(int)
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y int")
    made = [R.grow(df.repartition(p), COLUMNS, "y", 3, trees=3, depth=5, features=2, least=2, seed=9) for p in (1, 6)]
    for t in range(3):
        want = plain(x, y, 3, t, 5, 2, 2, 9)
        for trees in made:
            got = trees[t]
            assert len(got.f) == len(want) > 8
            for n, (f, cut, left, right, at) in want.items():
                assert (got.f[n], got.l[n], got.r[n]) == (f, left, right) and abs(got.cut[n] - cut) < 1e-12
                assert got.counts[n].tolist() == np.bincount(y[at], minlength=3).tolist()
    out = {r.id: (r.predicted, r.shares) for r in R.predict(df, made[0], COLUMNS).collect()}
    for i in range(0, 300, 7):
        p = np.mean([t.counts[k] / t.counts[k].sum() for t in made[0] for k in t.leaves(x[i : i + 1])], axis=0)
        assert np.allclose(out[i][1], p) and out[i][0] == p.round(9).argmax()
    assert np.mean([out[i][0] == y[i] for i in range(300)]) > 0.8


def test_odd_tables(spark):
    df = spark.createDataFrame([(1.0, None, 0), (1.0, None, 1), (None, None, 1)], "a double, b double, y int")
    t = R.grow(df, ["a", "b"], "y", 2)[0]
    assert t.f == [-1] and t.counts[0].tolist() == [1, 2]
    assert [r.predicted for r in R.predict(df, [t], ["a", "b"]).collect()] == [1, 1, 1]
    assert R.grow(df.filter("y = 1"), ["a"], "y", 2, trees=2)[1].f == [-1]
    assert R.grow(df.limit(0), ["a"], "y", 2)[0].counts[0].sum() == 0
    assert R.predict(df.withColumn("a.b", F.lit(1)).limit(0), [t], ["a", "b"]).count() == 0
