"""Joins on time and intervals against loops, with hot keys, ties and nulls."""

import random

from pyspark.sql import functions as F

from gridwarden.operators import joins, topology


def test_asof_against_a_loop(spark):
    rng = random.Random(4)
    keys = ["hot"] * 300 + [None] * 40 + [f"k{i % 7}" for i in range(100)]
    left = [(i, k, rng.choice([None, *range(60)]), "text") for i, k in enumerate(keys)]
    right = [(rng.choice(keys), rng.choice([None, *range(0, 60, 3)]), rng.randrange(1000)) for _ in range(120)] + [("hot", 5, 1), ("hot", 5, 900), ("late", 1, 1)]
    a = spark.createDataFrame(left, "id int, k string, t int, `a.b` string").repartition(5)
    b = spark.createDataFrame(right, "k string, t int, v int").repartition(3)
    for strict in (False, True):
        got = {r.id: r.asof for r in joins.asof(a, b, ["k"], "t", "t", F.col("v"), strict=strict).collect()}
        for i, k, t, _ in left:
            before = [(u, v) for q, u, v in right if q == k and u is not None and t is not None and (u < t or u == t and not strict)]
            assert got[i] == (max(before)[1] if before else None)
        assert len(got) == len(left)
    # a null value of the last row is its value, not that of an earlier one
    c = b.withColumn("v", F.when(F.col("t") < 30, F.col("v")))
    got = {r.id: r.x for r in joins.asof(a, c, ["k"], "t", "t", F.col("v"), F.col("t"), "x").collect()}
    for i, k, t, _ in left:
        last = max((u for q, u, _ in right if q == k and u is not None and t is not None and u <= t), default=None)
        assert got[i] is None or last < 30
    assert joins.asof(a.limit(0), b, ["k"], "t", "t", F.col("v")).count() == 0
    assert joins.asof(a, b.limit(0), ["k"], "t", "t", F.col("v")).filter("asof is not null").count() == 0


def test_asof_is_the_fault_history(spark):
    """The same as looking each node's last fault up in a grid."""
    faults = spark.createDataFrame([(2, 0, 0, False), (5, 0, 1, True), (5, 0, 2, False), (3, 1, 3, False)], "round int, node int, ord int, up boolean")
    rounds, nodes = spark.range(1, 9).select(F.col("id").cast("int").alias("round")), spark.range(3).select(F.col("id").cast("int").alias("node"))
    want = {(r["round"], r.node): r.up for r in topology.alive_asof(rounds, nodes, faults).collect()}
    grid = rounds.crossJoin(nodes)
    got = {(r["round"], r.node): True if r.up is None else r.up for r in joins.asof(grid, faults, ["node"], "round", "round", F.col("up"), F.col("ord"), "up").collect()}
    assert got == want


def test_intervals_against_a_loop(spark):
    rng = random.Random(5)
    spans = [(i, lo, lo + rng.choice([-1, 0, 1, 7, 1000, 10**12]), rng.choice("xy")) for i, lo in enumerate(rng.randrange(-3000, 3000) for _ in range(150))] + [(900, None, 5, "x"), (901, 1, None, "x")]
    points = [(i, rng.choice([None, *range(-3000, 3000)]), rng.choice(["x", "y", None])) for i in range(300)]
    p = spark.createDataFrame(points, "id int, t bigint, k string")
    r = spark.createDataFrame(spans, "ord int, lo bigint, hi bigint, k string")
    inside = lambda t, lo, hi: None not in (t, lo, hi) and lo <= t <= hi
    got = sorted((x.p.id, x.r.ord) for x in joins.interval_join(p, r, "t", "lo", "hi").collect())
    assert got == sorted((i, o) for i, t, _ in points for o, lo, hi, _ in spans if inside(t, lo, hi))
    first = {x.id: x.ord for x in joins.first_match(p, r, "id", "t", "lo", "hi", "ord", ["ord"], ["k"]).collect()}
    assert first == {i: min((o for o, lo, hi, q in spans if q == k and inside(t, lo, hi)), default=None) for i, t, k in points}
    assert joins.interval_join(p, r.limit(0), "t", "lo", "hi").count() == 0


def test_schedule_is_the_first_entry(spark):
    entries = topology.check_schedule([{"from": 1, "to": 4, "mode": "federated"}, {"from": 3, "to": 9, "mode": "gossip", "active_clients": [1, 2]}, {"from": 6, "to": 6, "mode": "federated"}])
    schedule = spark.createDataFrame(entries, "ord int, `from` int, `to` int, mode string, active_clients array<int>")
    rounds = spark.range(1, 12).select(F.col("id").cast("int").alias("round"))
    want = {r["round"]: (r["mode"], r.active_clients) for r in topology.schedule_lookup(rounds, schedule, "none").collect()}
    got = {r["round"]: (r["mode"] or "none", r.active_clients) for r in joins.first_match(rounds, schedule, "round", "round", "from", "to", "ord", ["mode", "active_clients"]).collect()}
    assert got == want


def test_ranges_that_hold_a_point_are_counted_without_pairs(spark):
    rng = random.Random(8)
    spans = [(i, lo, lo + rng.choice([-1, 0, 1, 2, 3, 4, 15, 16, 17, 900, 5000])) for i, lo in enumerate(rng.randrange(-2000, 2000) for _ in range(200))]
    spans += [(-1, -5, 5), (-2, -5, 5), (999, None, 3), (0, 10**15, 10**15 + 10**12)]
    points = [(i, rng.choice([None, 10**15 + 77, *range(-2500, 2500)])) for i in range(400)]
    p, r = spark.createDataFrame(points, "id int, t bigint"), spark.createDataFrame(spans, "ord int, lo bigint, hi bigint")
    got = {x["t"]: (x["first"], x["n"]) for x in joins.held(p, r, "t", "lo", "hi", F.col("ord")).collect()}
    inside = {t: [o for o, lo, hi in spans if lo is not None and lo <= t <= hi] for _, t in points if t is not None}
    assert got == {t: (min(o), len(o)) for t, o in inside.items() if o}


def test_crowds_make_no_pairs_and_nothing_is_broadcast(spark, tmp_path):
    """20,000 points inside 20,000 ranges each would be 400 million pairs; files are small, so sizes are underestimated."""
    spark.range(20_000).select("id", (F.col("id") + 20_000).alias("t"), F.col("id").alias("lo"), (F.col("id") + 40_000).alias("hi")).write.parquet(str(tmp_path / "x"))
    x = spark.read.parquet(str(tmp_path / "x"))
    found = joins.first_match(x.select("id", "t"), x.select(F.col("id").alias("ord"), "lo", "hi"), "id", "t", "lo", "hi", "ord", ["ord"])
    assert found.agg(F.sum("ord"), F.count("*")).first() == (0, 20_000)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
