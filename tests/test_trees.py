"""Histogram trees against trees grown by trying every split in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwarden.operators import trees
from gridwarden.operators.models import saved

COLUMNS = ["a", "b", "c"]


def table(n=400, seed=3, classes=2):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 3)).round(2)
    score = x[:, 0] + 0.4 * x[:, 1] + 0.05 * rng.standard_normal(n)
    return x, np.minimum((score * classes / 1.4).astype(int), classes - 1), np.arange(n) % 3


@pytest.fixture(scope="module")
def rows(spark):
    x, y, client = table()
    return saved(spark.createDataFrame([(i, *map(float, v), int(t), int(c)) for i, (v, t, c) in enumerate(zip(x, y, client))], "id int, a double, b double, c double, y int, client int"))


def plain(x, y, edges, growth, classes=1, positive=1.0, intercepts=None):
    """Boosting by trying every edge of every feature in every node; (margins, losses, gains by feature)."""
    k = max(classes, 1)
    margin = np.tile(np.array(intercepts, float), (len(y), 1))
    losses, gains = [], np.zeros(x.shape[1])

    def probability(m):
        if k == 1:
            return 1 / (1 + np.exp(-m))
        e = np.exp(m - m.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for _ in range(growth.rounds):
        p, step = probability(margin), np.zeros_like(margin)
        for c in range(k):
            truth = (y == c).astype(float) if k > 1 else y.astype(float)
            w = np.where(truth > 0, positive, 1.0) if k == 1 else np.ones(len(y))
            g, h = w * (p[:, c] - truth), w * np.maximum(p[:, c] * (1 - p[:, c]), 1e-16)
            level = [np.arange(len(y))]
            for depth in range(growth.depth + 1):
                below = []
                for at in level:
                    value = -g[at].sum() / (h[at].sum() + growth.ridge)
                    step[at, c] = value
                    best = None
                    if depth < growth.depth:
                        for f in range(x.shape[1]):
                            for cut in edges[f]:
                                left = x[at, f] <= cut
                                s = [(g[at][m].sum(), h[at][m].sum()) for m in (left, ~left)]
                                if min(s[0][1], s[1][1]) < growth.least:
                                    continue
                                gain = round((sum(a * a / (b + growth.ridge) for a, b in s) - g[at].sum() ** 2 / (h[at].sum() + growth.ridge)) / 2, 9)
                                if gain > growth.gain and (best is None or gain > best[0]):
                                    best = (gain, f, left)
                    if best:
                        gains[best[1]] += best[0]
                        below += [at[best[2]], at[~best[2]]]
                level = below
        margin += growth.rate * step
        losses.append(np.mean(np.logaddexp(0, margin[:, 0]) - y * margin[:, 0]) if k == 1 else -np.mean(np.log(probability(margin)[np.arange(len(y)), y])))
    return margin, losses, gains


def test_many_models_in_one_pass(spark, rows):
    """Three clients and all of them together: four models, each as if grown alone."""
    growth = trees.Growth(rounds=3, depth=3)
    data = trees.binned(rows, COLUMNS, F.col("y"), "id", F.array("client", F.lit(3)), bins=16)
    models = trees.grow(data, growth, allowed={1: [0, 2]}, balanced=True)
    x, y, client = table()
    scores = {r.id: {s.model: s.margins[0] for s in r.scores} for r in trees.scored(rows, trees.rows_of(spark, models), COLUMNS).collect()}
    for m in range(4):
        own = client == m if m < 3 else np.ones(len(y), bool)
        weight = (y[own] == 0).sum() / (y[own] == 1).sum()
        edges = [e if m != 1 or f != 1 else [] for f, e in enumerate(data.edges)]
        margin, losses, gains = plain(x[own], y[own], edges, growth, positive=weight, intercepts=[0.0])
        assert np.allclose([scores[i][m] for i in np.flatnonzero(own)], margin[:, 0], atol=1e-9)
        assert np.allclose(models[m].losses, losses, atol=1e-9) and losses[-1] < losses[0]
        assert np.allclose(models[m].importance(3), gains / gains.sum(), atol=1e-6)


def test_softmax_boosting(spark):
    x, y, _ = table(300, 5, 3)
    df = spark.createDataFrame([(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id int, a double, b double, c double, y int").repartition(5)
    data = trees.binned(df, COLUMNS, F.col("y"), "id", F.array(F.lit(0)), bins=8)
    growth = trees.Growth(rounds=2, depth=2)
    model = trees.grow(data, growth, classes=3)[0]
    margin, losses, _ = plain(x, y, data.edges, growth, 3, intercepts=model.intercepts)
    got = {r.id: r.scores[0].margins for r in trees.scored(df, trees.rows_of(spark, {0: model}), COLUMNS).collect()}
    assert np.allclose([got[i] for i in range(len(y))], margin, atol=1e-9) and np.allclose(model.losses, losses)
    assert np.allclose(model.intercepts, np.log(np.bincount(y) / len(y))) and len(model.trees) == 6


def test_continuing_is_uninterrupted_growing(spark, rows, monkeypatch):
    data = trees.binned(rows, COLUMNS, F.col("y"), "id", F.array("client"), bins=16)
    half = trees.Growth(rounds=2, depth=2, rows=0.7, features=0.5)
    first = trees.models_of(trees.rows_of(spark, trees.grow(data, half)))
    part = trees.grow(data, half, start=first)
    monkeypatch.setattr(trees, "REFRESH", 1)  # margins written after every round
    monkeypatch.setattr(trees, "MOST_CELLS", 1)  # models one after the other
    whole = trees.grow(data, trees.Growth(rounds=4, depth=2, rows=0.7, features=0.5))
    for m in range(3):
        a, b = part[m], whole[m]
        assert [(t.f, t.cut) for t in a.trees] == [(t.f, t.cut) for t in b.trees] and np.allclose([v for t in a.trees for v in t.v], [v for t in b.trees for v in t.v])
        assert all(len({f for f in t.f if f >= 0}) <= 2 for t in a.trees)
        assert np.allclose(a.losses[-1], b.losses[-1])


def test_union_counts_a_content_once(spark, rows):
    data = trees.binned(rows, COLUMNS, F.col("y"), "id", F.array("client"), bins=8)
    one = trees.rows_of(spark, trees.grow(data, trees.Growth(rounds=1, depth=2)))
    two = one.withColumn("model", F.col("model") + 10)
    got = trees.union(two, one, two.limit(0)).orderBy("model").collect()
    assert [r.model for r in got] == [0, 1, 2] and len({r.sha256 for r in got}) == 3


def test_odd_rows(spark):
    nan = float("nan")
    data = [(1, 1.0, None, nan, 0), (2, nan, 2.0, nan, 1), (3, None, None, None, 0), (4, 5.0, 2.0, nan, 1), (5, 1.0, 1.0, nan, 0)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double, y int")
    made = trees.binned(df, COLUMNS, F.col("y"), "id", F.when(F.col("id") < 9, F.array(F.lit(0), F.lit(1))), bins=4)
    models = trees.grow(made, trees.Growth(rounds=2, depth=2))
    rows = {r.id: r.scores[0].margins[0] for r in trees.scored(df, trees.rows_of(spark, models), COLUMNS).collect()}
    assert all(math.isfinite(v) for v in rows.values()) and rows[4] > rows[5]
    alone = trees.grow(trees.binned(df.filter("y = 1"), COLUMNS, F.col("y"), "id", F.array(F.lit(0)), bins=4), trees.Growth(rounds=2))
    assert alone[0].trees == [] and alone[0].intercepts[0] > 10
    assert trees.grow(trees.binned(df.limit(0), COLUMNS, F.col("y"), "id", F.array(F.lit(0)), bins=4)) == {}
    with pytest.raises(ValueError):
        trees.binned(df, COLUMNS, F.col("y"), "id", F.array(F.lit(0)), bins=300)


def test_models_do_not_depend_on_tasks(spark, monkeypatch):
    """The same rows in other parts and orders give the same digests; copies are rows of their own for samples, but not for passes."""
    rng = np.random.default_rng(2)
    x = rng.random((3000, 2)).round(3)
    data = [(i, float(a), float(b), int(a * b + 0.1 * e > 0.25), i % 3) for i, ((a, b), e) in enumerate(zip(x, rng.standard_normal(3000)))]
    df = spark.createDataFrame(data, "id int, a double, b double, y int, client int")
    monkeypatch.setattr(trees, "ROWS_A_TASK", 200)
    for growth in (trees.Growth(rounds=2, depth=3), trees.Growth(rounds=2, depth=2, rows=0.6)):
        seen = set()
        for parts in (2, 7, 13):
            cut = trees.binned(saved(df.repartition(parts, F.rand(parts))), ["a", "b"], F.col("y"), "id", F.array("client"), bins=64)
            seen.add(tuple(m.digest() for _, m in sorted(trees.grow(cut, growth, balanced=True).items())))
        assert len(seen) == 1
    coarse = trees.binned(df, ["a", "b"], F.col("y"), "id", F.array("client"), bins=4)
    groups = coarse.groups(0.5, (1, 2)).collect()
    assert len(groups) <= 4 * 4 * 2 * 3
    keys = np.arange(3000)
    assert [sum(g.n[k] for g in groups) for k in range(3)] == [3000, *[int((trees._uniform(keys, s) < 0.5).sum()) for s in (1, 2)]]


def test_large_trees_are_followed(monkeypatch):
    rng = np.random.default_rng(4)
    t = trees.Tree(0, 1.0)
    for node in range(15):
        t.split(node, int(rng.integers(2)), float(rng.integers(8)), 1.0, float(node), float(-node))
    compact = trees._Compact(t, [np.arange(8.0)] * 2)
    b = rng.integers(0, 9, (2, 500)).astype(np.uint8)
    small = compact.node(b)
    monkeypatch.setattr(trees, "MOST_CHOICES", 0)
    assert (small == compact.node(b)).all() and len(set(small.tolist())) > 4


def test_no_list_of_grouped_rows_is_null(spark, rows):
    """A column of null lists costs each batch that is handed to Python the square of its rows."""
    data = trees.binned(rows, ["a", "b"], F.col("y"), "id", F.array("client"), bins=64)
    nulls = data.groups().select(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("members", "bins", "n", "base")]).first()
    assert nulls.asDict() == {"members": 0, "bins": 0, "n": 0, "base": 0}


def test_edges_do_not_depend_on_the_order_of_rows(spark, monkeypatch):
    """Edges are the values at k / bins of all rows, in any order, also where a bracket misses one."""
    rng = np.random.default_rng(7)
    x = np.stack([rng.normal(size=60_000), rng.integers(0, 24, 60_000).astype(float)], 1)
    df = spark.createDataFrame([(i, 0, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, y int, a double, b double").localCheckpoint()
    exact = [np.unique(np.sort(c)[[-(-k * len(c) // 16) - 1 for k in range(1, 16)]]) for c in x.T]
    edges = lambda d: trees.binned(d, ["a", "b"], F.col("y"), "id", F.array(F.lit(0)), bins=16).edges
    for d in (df, df.repartition(7).sortWithinPartitions(F.desc("a")), df.coalesce(1).sortWithinPartitions("a")):
        assert all(np.array_equal(a, b[b < c.max()]) for a, b, c in zip(edges(d), exact, x.T))
    true = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda v, shares, accuracy: F.transform(true(v, shares, accuracy), lambda q: q / 2 + 1))
    assert all(np.array_equal(a, b[b < c.max()]) for a, b, c in zip(edges(df), exact, x.T))
