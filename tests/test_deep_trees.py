"""Trees from cells against the library's."""

import numpy as np
import pytest

from gridwarden.operators import deep_trees, models

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def folded(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (1500, 3))
    y = (x[:, 0] + x[:, 1] * (x[:, 2] > 5) + rng.integers(0, 8, 1500) > 14).astype(int)
    data = [(*map(float, v), int(t), i % 2) for i, (v, t) in enumerate(zip(x, y))]
    return models.saved(spark.createDataFrame([*data, (float("nan"), 1.0, 1.0, 1, 0), (None, 1.0, 1.0, 1, 1)], "a double, b double, c double, y int, fold int"))


def counts(folded, names):
    return {(r.classifier, r.fold): (r.tp, r.fp, r.fn, r.tn) for r in models.cross_validate(folded, COLUMNS, names, 2).collect()}


def test_cells_give_the_librarys_trees(folded, monkeypatch):
    names = ["j48", "rep_tree", "boosted", "random_forest"]
    with monkeypatch.context() as m:  # no tree is fitted by passes over the rows
        m.setattr(models, "classifier", lambda *_: pytest.fail("fitted by the library"))
        got = counts(folded, names)
        assert got == counts(folded, names)
    monkeypatch.setattr(deep_trees, "MOST_CELLS", 0)
    want = counts(folded, names)
    assert got.keys() == want.keys()
    for at, w in want.items():
        g = got[at]
        assert sum(g) == sum(w) == 750 and g[0] + g[2] == w[0] + w[2]
        # trees without draws differ where gains are equal, others by their draws too
        assert abs(g[0] + g[3] - w[0] - w[3]) <= (8 if at[0] in ("j48", "rep_tree") else 25), (at, g, w)


def test_one_tree_splits_as_by_trying_everything():
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 6, (2, 40)).astype(np.uint8)
    w = rng.integers(0, 4, (2, 40))
    feature, cut, child, a, b = deep_trees.grow(bins, w, deep_trees.Kind(entropy=False), rng)[0]
    gini = lambda n: 2 * n[0] * n[1] / max(1, n.sum())
    best = min((round(gini(w[:, bins[f] <= k].sum(1)) + gini(w[:, bins[f] > k].sum(1)), 9), f, k) for f in range(2) for k in range(5))
    assert (feature[0], cut[0]) == best[1:] and (a[0], b[0]) == tuple(w.sum(1))
    shares = deep_trees.share(deep_trees.grow(bins, np.array([[3], [1]]) * np.ones((2, 40), int), deep_trees.Kind(), rng), bins)
    assert np.allclose(shares, 0.25)
