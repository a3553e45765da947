"""Running sums, numbers and percentiles without one task, against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from gridwarden.functions import metrics, ordering
from gridwarden.operators import partition, topology


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "hot", "hot", None, f"k{i % 9}"]), rng.randrange(1000), rng.randrange(5)) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, k string, t int, x int").repartition(6)
    for by in ([], ["k"]):
        got = {r.id: (r.s, r.n) for r in ordering.cumulative(df, {"s": F.col("x"), "n": F.lit(1)}, [F.desc("t"), F.col("id")], by).collect()}
        for i, k, t, _ in rows:
            upto = [x for j, q, u, x in rows if (not by or q == k) and (-u, j) <= (-t, i)]
            assert got[i] == (sum(upto), len(upto))
    numbers = sorted((r.n, r.id) for r in ordering.numbered(df, "n", [F.col("t"), F.col("id")]).collect())
    assert [i for _, i in numbers] == [i for _, i in sorted((t, i) for i, _, t, _ in rows)] and [n for n, _ in numbers] == list(range(700))
    assert ordering.numbered(df.limit(0), "n", [F.col("t")]).count() == 0


def test_percentiles_of_any_group(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.integers(0, 20, 301).astype(float), "b": rng.random(1000), "one": np.array([7.0]), None: np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: (r["mean"], r["median"], r.p95) for r in metrics.percentiles(df, "v", "k").collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert np.allclose(got[k], (x.mean(), np.quantile(x, 0.5), np.quantile(x, 0.95)), atol=1e-6)
    all_ = np.concatenate(list(groups.values()))
    assert np.allclose(metrics.percentiles(df, "v").first(), (all_.mean(), np.quantile(all_, 0.5), np.quantile(all_, 0.95)), atol=1e-6)


def test_nodes_of_clients(spark):
    clients = spark.createDataFrame([(c,) for c in ("7", "1", "x", "20", "y")], "cid string")
    known = spark.createDataFrame([("y", 3)], "cid string, node int")
    got = {r.cid: r.node for r in topology.node_of_client(clients, known, 4).collect()}
    rank = {c: k for k, c in enumerate(sorted(("7", "1", "x", "20", "y")))}
    assert got == {"1": 1, "y": 3, "7": rank["7"] % 4, "20": rank["20"] % 4, "x": rank["x"] % 4}


def _shuffled_rows(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_steps_of_ranks(spark):
    """A step function of ranks is that of ranked rows; rows of one key may change places."""
    n = 6_000
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 7 == 0, "rare").otherwise("often").alias("k"))
    df = df.unionByName(spark.createDataFrame([(None, "rare")] * 5 + [(3, "rare")] * 4, "id bigint, k string")).coalesce(2).localCheckpoint()
    for by, step in (([], lambda r, m: ordering.chunk(3, r, m)), (["k"], lambda r, m: F.when(r <= F.ceil(F.lit(0.2) * m), "val").otherwise("train")), (["k"], lambda r, m: ordering.chunk(n, r, m))):
        expected = ordering.ranked(df, 1, "id", "s", *by).select("k", "id", step(F.col("_r"), F.col("_n")).alias("at"))
        got = ordering.stepped(df, 1, "id", "s", "at", step, *by)
        assert got.dtypes == [*df.dtypes, expected.dtypes[-1]]
        assert sorted(map(str, got.select("k", "id", "at").collect())) == sorted(map(str, expected.collect()))
    assert ordering.stepped(df.limit(0), 1, "id", "s", "at", lambda r, m: ordering.chunk(3, r, m)).count() == 0


def test_splits_leave_rows_where_they_are(spark):
    """Holdouts and clients shuffle counts of buckets and the rows of a few buckets, not all rows."""
    n = 200_000
    df = spark.range(0, n, 1, 2).select(F.col("id"), F.when(F.col("id") % 3 == 0, "view").otherwise("error").alias("k"))
    for split in (lambda: partition.holdout(df, 1, "id", 0.2, "k"), lambda: partition.iid(df, 4, 1, "id"), lambda: partition.attack(df, 4, 1, "id", "k", "view")):
        before = _shuffled_rows(spark)
        split().write.format("noop").mode("overwrite").save()
        assert 0 < _shuffled_rows(spark) - before < n / 4
