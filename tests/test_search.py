"""Search around trees, its moves and stops, against plain loops."""

import itertools

import numpy as np
import pytest

from gridwarden.operators import experiment, models, selection, trees
from gridwarden.operators.models import saved


class Counting:
    """An evaluator whose F1 is a rule; it remembers what was asked for."""

    def __init__(self, rule):
        self.rule, self.log, self.seen, self.jobs = rule, [], {}, 0

    def ahead(self, offers):
        new = [tuple(sorted(s)) for offer in offers for s in offer if tuple(sorted(s)) not in self.seen]
        self.jobs += bool(new)
        self.seen |= {k: self.rule(k) for k in new}

    def __call__(self, subsets):
        self.ahead([subsets])
        out = [self.seen[tuple(sorted(s))] for s in subsets]
        self.log += [(len(self.log) + 1 + i, f, sorted(s)) for i, (s, f) in enumerate(zip(subsets, out))]
        return out


def test_bit_flips_move_on_from_what_is_better():
    evaluate = Counting(lambda s: float(sum(s)))
    got = selection.bit_flips(selection.Found([1, 2], 3.0), list(range(1, 11)), evaluate, 0.0, np.random.default_rng(1))
    assert got.f1 > 12 and len(got.features) == 2 and len(evaluate.log) <= selection.FLIPS
    flat = Counting(lambda s: 1.0)
    assert selection.bit_flips(selection.Found([1, 2], 1.0), list(range(1, 11)), flat, 0.0, np.random.default_rng(1)) is None
    assert len(flat.log) == selection.IDLE_FLIPS and flat.jobs == 1  # all in one job
    assert selection.bit_flips(selection.Found([1, 2], 1.0), [1, 2], flat, 0.0, np.random.default_rng(1)) is None


def test_search_stops_on_time_and_unknown_methods():
    ticks = itertools.count()
    evaluate = Counting(lambda s: float(len(set(s) & {2, 5})))
    found = selection.grasp(evaluate, [1, 2, 3, 4, 5], "iwss", iterations=50, start=1, patience=99, seconds=2, clock=lambda: float(next(ticks)))
    assert found.features == [2, 5] and next(ticks) <= 5
    with pytest.raises(ValueError, match="unknown method"):
        selection.grasp(evaluate, [1, 2], "other")


def test_methods_and_their_start_lists():
    gains = {1: 0.1, 2: 0.4, 3: 0.0, 4: 0.3}
    rule = Counting(lambda s: float(10 * len(set(s) & {1, 4}) - len(s)))
    assert selection.dispatch("F-G-VND", gains, rule) == ("vnd", [1, 2, 3, 4])
    assert selection.dispatch("GR-G-RVND", gains, rule, 2) == ("rvnd", [2, 4])
    assert selection.dispatch("i-g-vnd", gains, rule) == ("vnd", [1, 4])
    assert selection.dispatch("GR-BF", gains, rule, 3) == ("bit_flip", [1, 2, 4])


def test_every_attack_is_searched_over_the_given_pool(spark, monkeypatch):
    pools = []
    monkeypatch.setattr(selection, "grasp", lambda evaluate, pool, **more: pools.append(list(pool)) or selection.Found(pool[:1], 1.0))
    rows = [(i, ("n", "k", "m")[i % 3], float(i % 7), float(i % 5), float(i % 3), 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, c string, f1 double, f2 double, f3 double, f4 double")
    found, _, union = selection.search_per_attack(df, ["f1", "f2", "f3", "f4"], "c", "n", "id", pool=[1, 2])
    assert pools == [[1, 2], [1, 2]] and set(found) == {"k", "m"} and union == [1]
    selection.search_per_attack(df, ["f1", "f2", "f3", "f4"], "c", "n", "id")
    assert pools[2:] == [[1, 2, 3, 4]] * 2


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 240)
    x = (rng.standard_normal((240, 4)) + np.outer(y, [2.0, 0, 1.5, 0])).round(2)
    return saved(spark.createDataFrame([(i, "n" if t == 0 else "k", *map(float, v)) for i, (t, v) in enumerate(zip(y, x))], "id int, c string, f1 double, f2 double, f3 double, f4 double"))


def test_tree_search_against_all_subsets(spark, labelled):
    """F1 of each subset equals that of trees grown one fold and subset at a time; the search finds the best of all."""
    names, growth = ["f1", "f2", "f3", "f4"], trees.Growth(rounds=2, depth=2)
    evaluate = selection.tree_evaluator(labelled, names, "c", "n", 3, 42, "id", growth, bins=8)
    subsets = [list(s) for k in range(1, 5) for s in itertools.combinations(range(1, 5), k)]
    scores = evaluate(subsets)
    data = evaluate.rows
    for s in ([1], [2, 4], [1, 2, 3, 4]):
        total = np.zeros(3, int)
        for fold in range(3):
            own = trees.grow(data, growth, allowed={k: [i - 1 for i in s] for k in range(3)}, balanced=True, only=[fold])
            r = trees.confusion(data, own, {fold: fold}).first()
            total += [r.tp, r.fp, r.fn]
        assert scores[subsets.index(s)] == pytest.approx(200 * total[0] / (2 * total[0] + total[1] + total[2]))
    assert evaluate([[]]) == [0.0]
    found = selection.grasp(evaluate, [1, 2, 3, 4], "vnd", iterations=3, start=2)
    assert found.f1 == pytest.approx(max(scores))
    steps = selection.ladder(evaluate, [1, 3, 2])
    assert [(k, s) for k, s, _ in steps] == [(1, [1]), (2, [1, 3]), (3, [1, 3, 2])] and steps[1][2] == scores[subsets.index([1, 3])]
    lost = {out: d for out, _, d in selection.ablation(evaluate, [1, 3])}
    assert lost[None] == 0 and lost[1] == pytest.approx(scores[subsets.index([3])] - scores[subsets.index([1, 3])])


def test_variants_are_refused_where_margins_are_shared(labelled):
    evaluate = selection.tree_evaluator(labelled, ["f1", "f2"], "c", "n", 2, 42, "id", bins=4)
    with pytest.raises(ValueError, match="variants"):
        trees.grow(evaluate.rows, trees.Growth(rounds=trees.REFRESH), variants={0: 0, 1: 0})


def test_no_tree_is_lost_on_the_way_back(spark):
    """Two heads with trees of their own in gossip rounds: the federated round goes on from both."""
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, float(a), int(a > 0.5), i % 4) for i, a in enumerate(rng.random(120).round(2))], "id int, a double, y int, client int")
    model, held = experiment.train_rounds(rows, ["a"], "client", 4, ["gossip", "gossip", "gossip", "federated"])
    # round 1: head 0 with 3 and 1, round 2: head 1 with 0 and 2, round 3: head 2 with 1 and 3
    assert len(model.trees) == len({id(t) for t in model.trees}) == 3 + 3 + 3 + 4
    one, two = models.Boosted(0.0, 0.3, ["x", "y"]), models.Boosted(0.0, 0.3, [], rates=[])
    assert experiment.united([one, two, one]).trees == ["x", "y"]
    assert all(m is model for m in held.values())
