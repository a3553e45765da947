"""Rounds that keep every model, against pools of plain sets and votes of plain trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwarden.operators import pools, trees
from gridwarden.operators.models import saved

COLUMNS = ["a", "b"]
N = 4
SMALL = trees.Growth(rounds=1, depth=2)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.random((320, 2)).round(2)
    data = [(i, float(a), float(b), int(a + 0.3 * b > 0.5 + 0.1 * (i % N)), i % N) for i, (a, b) in enumerate(x)]
    return saved(spark.createDataFrame(data, "id int, a double, b double, y int, client int"))


@pytest.fixture(scope="module")
def data(rows):
    return trees.binned(rows, COLUMNS, F.col("y"), "id", F.array("client"), bins=8)


def held(run):
    out = {}
    for r in run.pools.collect():
        out.setdefault((r.round, r.node), []).append((r.ord, r.sha256))
    return {k: [d for _, d in sorted(v)] for k, v in out.items()}


def test_pools_are_unions(spark, data):
    """Gossip, federated without node 3, gossip again: pools as plain sets."""
    modes, active = ["gossip", "gossip", "federated", "gossip"], lambda r: [0, 1, 2] if r == 3 else [0, 1, 2, 3]
    got = pools.run(spark, data, N, modes, SMALL, active=active, adopt=False)
    own = {m: k.digest() for m, k in trees.grow(data, SMALL, balanced=True).items()}
    near = lambda i: [(i - 1) % N, (i + 1) % N]
    pool = {i: {own[i]} for i in range(N)}
    want = {}
    for r in (1, 2):
        head = r - 1
        pool[head] = pool[head].union(*(pool[j] for j in near(head)))
        want |= {(r, i): set(pool[i]) for i in range(N)}
    known = set().union(*pool.values())
    want |= {(3, i): {own[j] for j in (0, 1, 2)} for i in (0, 1, 2)}
    want |= {(4, i): known | set(own.values()) for i in range(N)}  # node 3's model was retained although it was away
    assert {k: set(v) for k, v in held(got).items()} == want
    assert {r.sha256 for r in got.models.collect()} == set(own.values())


def test_nodes_go_on_from_a_single_model(spark, data):
    got = pools.run(spark, data, N, ["gossip", "gossip"], SMALL, kind="star", active=lambda r: [1, 2, 3] if r == 1 else [2, 3])
    first = trees.grow(data, SMALL, balanced=True)
    again = trees.grow(data, SMALL, start={i: first[i] for i in (2, 3)}, balanced=True, only=[2, 3])
    # the head's only neighbour, node 0, is away: pools hold what the node made
    assert held(got)[2, 2] == [first[2].digest(), again[2].digest()] and held(got)[2, 3] == [first[3].digest(), again[3].digest()]
    assert held(got)[1, 1] == [first[1].digest()] and len(again[2].trees) == 2


def test_every_node_decides_as_the_federation_in_the_end(spark, rows, data):
    fed = pools.run(spark, data, N, ["federated"], SMALL, adopt=False)
    gossip = pools.run(spark, data, N, ["gossip"] * (2 * N), SMALL, adopt=False)
    voted = saved(pools.votes(rows, gossip.models, COLUMNS, ["id", "y"]))
    pattern = pools.patterns(voted, "y")
    reference = pools.decisions(pattern, fed.pools.filter("node = 0"), gossip.models)
    by = {(r["round"], r.node): (r.n, r.differ) for r in pools.agreement(pools.decisions(pattern, gossip.pools, gossip.models), reference, "round", "node").collect()}
    assert all(by[2 * N, i] == (320, 0) for i in range(N)) and any(d > 0 for (r, _), (_, d) in by.items() if r == 1)
    # decisions by plain trees
    models = trees.models_of(gossip.models)
    order = sorted(models)
    margins = {r.id: [s.margins[0] for s in sorted(r.scores)] for r in trees.scored(rows, gossip.models, COLUMNS).collect()}
    at = {models[m].digest(): k for k, m in enumerate(order)}
    truth = {r.id: r.y for r in rows.collect()}
    for (r, node), digests in held(gossip).items():
        if r in (1, 3, 8):
            fired = {i: any(margins[i][at[d]] >= 0 for d in digests) for i in truth}
            want = sum(fired[i] and truth[i] for i in truth), sum(fired[i] and not truth[i] for i in truth)
            c = pools.counted(pools.decisions(pattern, gossip.pools.filter(f"round = {r} and node = {node}"), gossip.models), F.col("y") == 1, "node").first()
            assert (c.tp, c.fp) == want and c.tp + c.fp + c.fn + c.tn == 320


def test_nodes_drop_out(spark, rows, data):
    fed = pools.run(spark, data, N, ["federated"], SMALL)
    own = {k.digest(): m for m, k in trees.grow(data, SMALL, balanced=True).items()}
    owner = spark.createDataFrame(list(own.items()), "sha256 string, node int")
    gone = spark.createDataFrame([(s, i) for s in range(3) for i in range(s)] + [(0, -1)], "step int, node int")
    left = pools.without(fed.pools.filter("node = 0"), gone, owner).groupBy("round").count().collect()
    assert {r["round"]: r["count"] for r in left} == {0: 4, 1: 3, 2: 2}


def test_head_trains_and_others_validate(spark, rows, data):
    made = pools.roles(spark, data, N, 3, SMALL, active=lambda r: [0, 1, 2, 3] if r < 3 else [1, 2, 3])
    predicted = pools.role_predictions(rows, made, COLUMNS, "client", "id", "y")
    got = {(r["round"], r.node): (r.role, r.n, r.accuracy) for r in pools.role_accuracy(predicted, "y").collect()}
    model = {i: trees.grow(data, SMALL, only=[i])[i] for i in (0, 1)}
    model[3] = trees.grow(data, SMALL, only=[3])[3]  # the third of the active ones
    scores = {r.id: {s.model: s.margins[0] for s in r.scores} for r in trees.scored(rows, trees.rows_of(spark, model), COLUMNS).collect()}
    truth = {r.id: (r.client, r.y) for r in rows.collect()}
    right = lambda i: round(np.mean([(scores[k][i] >= 0) == (y == 1) for k, (c, y) in truth.items() if c == i]), 6)
    for r, up, head in ((1, [0, 1, 2, 3], 0), (2, [0, 1, 2, 3], 1), (3, [1, 2, 3], 3)):
        for i in up:
            trained = (i == 0 and r < 3) or (i == 1 and r >= 2) or (i == 3 and r == 3)
            assert got[r, i] == ("head" if i == head else "validator", 80, right(i) if trained else 0.0)
    assert (3, 0) not in got
