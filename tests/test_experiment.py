"""Models and rounds against plain computations on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwarden.functions import metrics, student
from gridwarden.operators import experiment, federation, hygiene, models, selection, topology
from gridwarden.sources import arff, trail
from gridwarden.streaming import monitor


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.random((240, 2)).round(3)
    data = [(i, float(a), float(b), int(a + 0.2 * b > 0.6), i % 3) for i, (a, b) in enumerate(x)]
    return models.saved(spark.createDataFrame(data, "id int, a double, b double, y int, client int"))


def loss(model, df):
    m = model.margin(models.assemble(df, ["a", "b"])).select("y", "margin").collect()
    return sum(math.log1p(math.exp(r.margin)) - r.y * r.margin for r in m) / len(m)


def test_continued_boosting_is_uninterrupted_boosting(rows):
    whole = models.boost(rows, ["a", "b"], 3, 2)
    part = models.boost(rows, ["a", "b"], 1, 2, start=models.boost(rows, ["a", "b"], 2, 2))
    assert np.allclose(whole.losses, part.losses) and all(x > y for x, y in zip(whole.losses, whole.losses[1:]))
    assert loss(whole, rows) == pytest.approx(whole.losses[-1])


def test_rounds(spark, rows):
    on_round, table = experiment.round_rows(spark, rows, ["a", "b"])
    model, held = experiment.train_rounds(rows, ["a", "b"], "client", 3, ["federated", "gossip", "federated"], active=lambda r: [0, 2] if r == 2 else [0, 1, 2], on_round=on_round)
    got = table().orderBy("round").collect()
    assert [(r.round, r["mode"], r.trees) for r in got] == [(1, "federated", 3), (2, "gossip", 5), (3, "federated", 8)]
    assert all(r.tp + r.fp + r.fn + r.tn == 240 for r in got) and len(model.trees) == len(model.rates) == 8 and all(m is model for m in held.values())
    margins = {r.id: r.margin for r in model.margin(models.assemble(rows, ["a", "b"])).collect()}
    truth = {r.id: r.y for r in rows.collect()}
    assert got[-1].tp == sum(margins[i] >= 0 and truth[i] for i in truth) and got[-1].fn == sum(margins[i] < 0 and truth[i] for i in truth)
    report = experiment.client_report(held, rows, ["a", "b"]).collect()
    assert [r.trees for r in report] == [8, 8, 8]
    with pytest.raises(ValueError):
        experiment.train_rounds(rows, ["a", "b"], "client", 3, ["other"])


def test_cyclic_rounds_use_one_client_each(rows):
    one = experiment.cyclic(rows, ["a", "b"], "client", 1)
    alone = models.boost(rows.filter("client = 0"), ["a", "b"], 1, 3, start=experiment.start(rows, ["a", "b"], experiment.ClientParameters()))
    assert loss(one, rows) == pytest.approx(loss(alone, rows))
    lone = experiment.local(rows.filter("y = 1"), ["a", "b"], one, experiment.ClientParameters())
    assert lone == []


def test_importance_is_a_plain_tree(spark, rows):
    """Gain of the best first split, by trying all of them."""
    df = rows.withColumn("c", F.when(F.col("a") > 0.5, "x").otherwise("n"))
    got = {r.feature: r.gain for r in models.importances(df, ["a", "b"], "c", "n", depth=1).collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_search_against_all_subsets(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 160)
    x = rng.standard_normal((160, 5)) + np.outer(y, [2.0, 0, 1.5, 0, 0])
    df = spark.createDataFrame([(i, "n" if t == 0 else "k", *map(float, v)) for i, (t, v) in enumerate(zip(y, x))], "id int, c string, f1 double, f2 double, f3 double, f4 double, f5 double")
    names = [f"f{i}" for i in range(1, 6)]
    found, skipped, union = selection.search_per_attack(df, names, "c", "n", "id", method="vnd", iterations=4, start=2)
    everything = selection.evaluator(df, names, "c", "n", 3, 42, "id")
    subsets = [[i for i in range(1, 6) if m >> (i - 1) & 1] for m in range(1, 32)]
    assert found["k"].f1 == pytest.approx(max(everything(subsets)), abs=1e-9) and union == found["k"].features and not skipped
    assert selection.search_per_attack(df, names, "c", "n", "id", least=1000)[1] == {"k": int(y.sum())}
    gains = {1: 0.5, 2: 0.0, 3: 0.3, 4: 0.2}
    assert [selection.candidates(n, gains, 2) for n in ("all", "top", "positive", "above_mean")] == [[1, 2, 3, 4], [1, 3], [1, 3, 4], [1, 3]]
    with pytest.raises(ValueError):
        selection.candidates("none", gains)


@pytest.mark.parametrize("n,t", [(2, 12.706205), (5, 2.776445), (6, 2.570582), (11, 2.228139), (40, 2.022691), (1000, 1.962341)])
def test_student(spark, n, t):
    assert student.quantile(n - 1) == pytest.approx(t, abs=2e-6)
    rng = np.random.default_rng(n)
    v = rng.standard_normal(n) + 0.3
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    r = metrics.mean_ci95(df, "v").first()
    assert r.ci95 == pytest.approx(t * v.std(ddof=1) / math.sqrt(n), rel=1e-4)
    stat = v.mean() / (v.std(ddof=1) / math.sqrt(n))
    # the density of t, summed by the trapezium rule
    z = np.linspace(0, abs(stat), 200_001)
    d = np.exp(math.lgamma(n / 2) - math.lgamma((n - 1) / 2)) / math.sqrt((n - 1) * math.pi) * (1 + z * z / (n - 1)) ** (-n / 2)
    p = 1 - 2 * float(((d[1:] + d[:-1]) / 2 * np.diff(z)).sum())
    assert metrics.paired_t(df, "v").first().p_raw == pytest.approx(p, abs=1e-7)


def test_precision_does_not_depend_on_ranges(spark):
    rng = np.random.default_rng(2)
    s, y = rng.integers(0, 50, 400) / 50, rng.random(400) < 0.3
    want, tp, n = 0.0, 0, 0
    for v in sorted(set(s), reverse=True):
        tp, n = tp + int((y & (s == v)).sum()), n + int((s == v).sum())
        want += (y & (s == v)).sum() / y.sum() * tp / n
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y)], "s double, y boolean")
    assert metrics.average_precision(df, "s", F.col("y")).first()[0] == pytest.approx(want, abs=2e-6)


def test_small_operators(spark, tmp_path):
    p = tmp_path / "long.arff"
    p.write_text("".join(f"% line {i}\n" for i in range(12_000)) + "@attribute a numeric\n@attribute c {n, k}\n@data\n1,k\n")
    assert arff.read_arff(spark, str(p)).first().label == "k"
    (tmp_path / "none.arff").write_text("@attribute a numeric\n")
    with pytest.raises(ValueError):
        arff.header(spark, str(tmp_path / "none.arff"))
    names = spark.createDataFrame([(0,), (1,), (7,)], "i int").select(arff.class_name(F.col("i"), ["n", "k"]).alias("c"))
    assert [r.c for r in names.collect()] == ["n", "k", "class_7"]
    df = spark.sql("SELECT 1 AS dur, 2 AS Timestamp, 3 AS frame_time, timestamp'2020-01-01' AS seen, 4 AS update_rate")
    assert hygiene.drop_absolute_time(df).columns == ["dur", "update_rate"]
    assert topology.resolve(None, 4) == ("ring", None) and topology.resolve("star", 4)[0] == "star" and topology.resolve("x", 4) == ("ring", None)
    with pytest.raises(ValueError):
        topology.resolve("g", 2, {0: [5]})
    votes = spark.createDataFrame([([True, True, False],), ([True, True, True],), ([False, False, False],), ([False, True, False],)], "fired array<boolean>")
    assert metrics.view_overlap(votes, [0, 1, 2]).first() == (1, 3, 2, round(1 / 3, 6))
    with pytest.raises(ValueError):
        metrics.check_variant("x", ("a",))
    edge = topology.edges(spark, "ring", 3)
    pool = spark.createDataFrame([(0, 2_000_000, "a"), (0, 5, "b"), (1, 0, "c")], "node int, ord bigint, sha256 string")
    got = federation.gossip_round(pool, spark.createDataFrame([(0, 0, "d")], pool.schema), edge, 1, [0, 1, 2]).filter("node = 0").orderBy("ord").collect()
    assert [r.sha256 for r in got] == ["b", "a", "d", "c"], "first arrival decides, whatever the numbers"


def test_redelivered_batches_are_written_once(spark, tmp_path):
    src, path = tmp_path / "src", str(tmp_path / "trail")
    src.mkdir()
    (src / "a.json").write_text('{"type": "node_failure", "round": 3, "detail": "own"}\n{"type": "node_failure", "round": 4}\n')
    stream = lambda: monitor.read_trail(spark, str(src)).select("type", "round", "detail")
    monitor.to_trail(stream(), path, str(tmp_path / "c1"), ["round"]).awaitTermination()
    monitor.to_trail(stream(), path, str(tmp_path / "c2"), ["round"]).awaitTermination()  # the same batch number again
    got = trail.read(spark, path).orderBy("seq").collect()
    assert [(r.seq, r.round, r.detail) for r in got] == [(1, 3, "own; batch=0"), (2, 4, "batch=0")]


def test_late_rows_are_left_out(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    schema = "ts timestamp, event_type string"
    put = lambda rows: spark.createDataFrame(rows, "ts string, event_type string").selectExpr("cast(ts as timestamp) ts", "event_type").coalesce(1).write.mode("append").parquet(str(folder))

    def run():
        counts = monitor.window_counts(spark.readStream.schema(schema).parquet(str(folder)), "n")
        counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    put([("2024-01-01 01:00:00", "k"), ("2024-01-01 02:00:00", "k"), ("2024-01-09 00:00:00", "k")])
    run()
    put([("2024-01-01 03:00:00", "k")])  # eight days late
    run()
    assert [(str(r.start), r.n_flags) for r in spark.read.parquet(out).collect()] == [("2024-01-01 00:00:00", 2)]


def test_scored_stream(spark, rows, tmp_path):
    rows.select("id", "a", "b").write.parquet(str(tmp_path / "in"))
    model = models.boost(rows, ["a", "b"], 1, 2)
    stream = spark.readStream.schema("id int, a double, b double").parquet(str(tmp_path / "in"))
    experiment.timed_scores(stream, model, ["a", "b"], str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "scores"))
    assert got.count() == 240 and got.filter("fired = (margin >= 0)").count() == 240
    assert spark.read.parquet(str(tmp_path / "out" / "timing")).filter("us_per_row > 0").agg(F.sum("rows")).first()[0] == 240


def by_hand(model, df):
    """tp, fp, fn, tn of a model's own margins."""
    out = [0, 0, 0, 0]
    for r in model.margin(models.assemble(df, ["a", "b"])).select("y", "margin").collect():
        out[(0 if r.y else 1) if r.margin >= 0 else (2 if r.y else 3)] += 1
    return tuple(out)


def test_reports_hold_the_counts_of_the_models(rows):
    """Each node's own model, and one central model with as many trees, on the same rows."""
    model, held = experiment.train_rounds(rows, ["a", "b"], "client", 3, ["gossip", "gossip"])
    for r in experiment.client_report(held, rows, ["a", "b"]).collect():
        assert (r.tp, r.fp, r.fn, r.tn) == by_hand(held[r.client], rows) and r.trees == len(held[r.client].trees)
        assert r.recall == pytest.approx(100 * r.tp / (r.tp + r.fn), abs=1e-5)
    got = {r.run: r for r in experiment.central_vs_distributed(rows, rows, ["a", "b"], "client", 3, 1).collect()}
    apart, _ = experiment.train_rounds(rows, ["a", "b"], "client", 3, ["federated"])
    central = models.boost(rows, ["a", "b"], len(apart.trees), 3, 0.3)
    for name, m in (("distributed", apart), ("central", central)):
        assert (got[name].tp, got[name].fp, got[name].fn, got[name].tn) == by_hand(m, rows) and got[name].trees == 3


def test_cross_validated_counts_of_naive_bayes(spark, rows):
    """Gaussian naive Bayes by hand on each fold; a row counts once, in the fold that it tests."""
    df = rows.withColumn("fold", F.col("id") % 4)
    got = {r.fold: (r.tp, r.fp, r.fn, r.tn) for r in models.cross_validate(df, ["a", "b"], ["naive_bayes"], 4).collect()}
    data = np.array([(r.id % 4, r.a, r.b, r.y) for r in rows.collect()])
    for k in range(4):
        train, test = data[data[:, 0] != k], data[data[:, 0] == k]
        score = []
        for c in (0, 1):
            x = train[train[:, 3] == c][:, 1:3]
            mean, var = x.mean(0), x.var(0)
            score.append(np.log(len(x) / len(train)) - 0.5 * (np.log(2 * np.pi * var) + (test[:, 1:3] - mean) ** 2 / var).sum(1))
        fired, truth = score[1] > score[0], test[:, 3] == 1
        assert got[k] == ((fired & truth).sum(), (fired & ~truth).sum(), (~fired & truth).sum(), (~fired & ~truth).sum())


def test_rows_are_written_once(spark, sf, monkeypatch):
    """Training rows don't carry their split along, and a fit writes only what is read again."""
    from gridwarden.operators import models
    from gridwarden.plans import learned

    for df in learned._nodes(spark, sf, 2):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    train, written = learned._nodes(spark, sf, 2)[0], []
    monkeypatch.setattr(models, "saved", lambda df, keep=models.saved: written.append(1) or keep(df))
    first = models.boost(train, learned.FEATURES, 0, 2)
    assert not written and not first.losses
    more = models.boost(train, learned.FEATURES, 2, 2, start=first)
    assert len(written) == 2 and len(more.losses) == 2 and more.losses[1] <= more.losses[0]
