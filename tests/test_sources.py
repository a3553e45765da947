import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwarden.operators import federation, hygiene, selection, topology
from gridwarden.sources import arff, files, logs, trail

ARFF = "@relation demo\n\n@attribute F1 numeric\n@attribute F2 numeric\n@attribute @class@ {normal, a, b}\n\n@data\n0.5,1,normal\n% comment\n3,2,a\n7,x,b\n1,2\n4,4,zzz\n9,9,b\n"


def test_arff(spark, tmp_path):
    p = tmp_path / "x.arff"
    p.write_text(ARFF)
    df = arff.read_arff(spark, str(p))
    assert [(r.f1, r.f2, r.y, r.label) for r in df.orderBy("row_id").collect()] == [(0.5, 1.0, 0, "normal"), (3.0, 2.0, 1, "a"), (9.0, 9.0, 2, "b")]
    assert arff.normal_class(df) == "normal"
    assert [c for c in hygiene.project(df, [2]).columns] == ["row_id", "y", "f2"]
    arff.write_arff(df, str(tmp_path / "out"), ["f1", "f2"], "label", ["normal", "a", "b"])
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out" / "rows")).collect()) == ["0.5,1,normal", "3,2,a", "9,9,b"]
    rows, counts = arff.to_numeric(spark, str(p))
    assert rows.count() == 3 and counts.first() == (3, 3)
    arff.register(spark)
    assert spark.read.format("arff_labelled").load(str(p)).count() == 3


def test_logs(spark, tmp_path):
    p = tmp_path / "run.log"
    p.write_text(
        "ROUND;1;federated;f1=96.0240;recall=99.9646;fpr=0.5999\n[x] união do head: 3 boosters\nCOMMIT gossip @round=11  reason=node_failure  nodes=[1]\n"
        "round=12  mode=gossip  q=7  active=[0, 2, 3]\n[x] ATAQUE injection (5) | y\nEV;1;98.5;[27, 44]\nEV;2;100.0;[27, 44, 46]\nEV;3;bad;[1]\nMONO\nRecall: 12.5\nRecall: 3\n"
    )
    text = logs.lines(spark, str(p))
    assert logs.parse_rounds(text).first() == (1, "federated", 96.024, 99.9646, 0.5999)
    assert logs.rounds_with_unions(text).select("boosters").first()[0] == 3
    assert logs.parse_commits(text).first() == (11, "gossip", "node_failure", [1])
    assert logs.parse_active(text).first() == (12, "gossip", 7, [0, 2, 3])
    got = logs.parse_selection(text).orderBy("line_no").collect()
    assert [(r.attack, r.eval_no, r.features) for r in got] == [("injection", 1, [27, 44]), ("injection", 2, [27, 44, 46])]
    assert logs.first_after(text, "MONO", r"Recall: ([\d.]+)").first().value == 12.5


def test_trail(spark, tmp_path):
    p = str(tmp_path / "trail")
    first = spark.createDataFrame([("node_failure", 3, [2, 1])], "type string, round int, failed_nodes array<int>")
    trail.append(p, first, ["round"])
    trail.append(p, spark.createDataFrame([("architecture_change", 4, "gossip")], "type string, round int, to_mode string"), ["round"])
    (tmp_path / "trail" / "bad.json").write_text("{not json\n")
    t = trail.read(spark, p).filter("seq is not null")
    assert sorted(r.seq for r in t.collect()) == [1, 2]
    s = trail.switches(t).first()
    assert (s.seq, s.reason, s.failed_nodes) == (2, "node_failure", [1, 2])
    assert trail.status(t).first().current_mode == "gossip"
    assert [r.seq for r in trail.since(t, 1).collect()] == [2]
    with pytest.raises(ValueError):
        trail.since(t, 0, limit=-1)


def test_files(spark, tmp_path):
    a = tmp_path / "a.csv"
    a.write_text(" x , Label\n1,BENIGN\n")
    assert files.read_csvs(spark, [str(a), str(a)]).columns == ["x", "Label"]
    m = tmp_path / "m.json"
    m.write_text(files.manifest(features=[3, 1], f1=1.0))
    assert files.read_manifest(spark, str(m)) == [1, 3]
    import hashlib

    ok = {a.name: (a.stat().st_size, hashlib.sha256(a.read_bytes()).hexdigest()), "b": (1, "x")}
    assert {r.name: r.ok for r in files.verify(spark, [str(a)], ok).collect()} == {"a.csv": True, "b": False}
    made = []
    make = lambda: made.append(1) or spark.range(3).toDF("x")
    assert files.once(spark, str(tmp_path / "t"), make).count() == files.once(spark, str(tmp_path / "t"), make).count() == 3
    assert len(made) == 1
    s = files.RunSettings.load("architecture: {manager: distributed, dwell_rounds: 5}\nclients: 4", clients=7)
    assert (s.clients, s.dwell_rounds, s.manager) == (7, 5, "distributed")
    with pytest.raises(ValueError):
        files.RunSettings.load("manager: api")
    assert files.topology_of("name: g\nnodes: 2\nadjacency: {0: [1], 1: [0]}") == ("g", 2, {0: [1], 1: [0]})


def test_strict_labels_and_schedule(spark):
    df = spark.createDataFrame([("odd",)], "l string")
    with pytest.raises(Exception, match="unknown label"):
        hygiene.map_labels(df, "l", {"a": "b"}, []).collect()
    with pytest.raises(ValueError):
        topology.check_schedule([{"from": 3, "to": 1, "mode": "gossip"}])
    assert topology.edges(spark, "star", 4).count() == 6
    nodes = topology.node_of_client(spark.createDataFrame([("7",), ("1",), ("zz",)], "cid string"), spark.createDataFrame([("7", 0)], "cid string, node int"), 3)
    assert {r.cid: r.node for r in nodes.collect()} == {"7": 0, "1": 1, "zz": 2}


def test_search_prefers_small_subsets():
    a, b = selection.Found([1, 2], 90.0), selection.Found([1], 90.0)
    assert b.beats(a, 0.0) and not a.beats(b, 0.0) and a.beats(selection.Found([], 0.0), 0.0)


def test_subsets_are_tested_on_all_rows(spark):
    df = spark.range(21_000).select("id", F.when(F.col("id") % 3 == 0, "bad").otherwise("ok").alias("c"), *[(F.col("id") % 3 + F.col("id") * k % 7).cast("double").alias(f"f{k}") for k in (1, 2)])
    evaluate = selection.evaluator(df, ["f1", "f2"], "c", "ok", 2, 7, "id")
    assert evaluate.rows.count() == 21_000
    got = evaluate([[1], [2, 1], []])
    # the same on the driver
    x, fold, truth = (np.array([r[c] for r in evaluate.rows.collect()]) for c in ("x", "fold", "truth"))
    want = []
    for s in ([0], [0, 1]):
        score = np.stack([sum(-((x[:, i] - evaluate.mean[fold, c, i]) ** 2 / evaluate.var[fold, c, i] + np.log(2 * np.pi * evaluate.var[fold, c, i])) / 2 for i in s) + evaluate.prior[fold, c] for c in (0, 1)], 1)
        alarm = score[:, 1] > score[:, 0]
        want.append(200 * (alarm & (truth == 1)).sum() / (alarm.sum() + (truth == 1).sum()))
    assert np.allclose(got, [*want, 0.0]) and len(evaluate.log) == 3
    assert selection.evaluator(df, ["f1", "f2"], "c", "ok", 2, 7, "id", 500).rows.count() == 500


def test_nearest_in_blocks(spark, sf, monkeypatch):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.filter("vec_id % 20 = 0")
    one = sorted(federation.knn1(e, q, "vec_id", "embedding", "label").collect())
    monkeypatch.setattr(federation, "MOST_BROADCAST", 7)
    assert sorted(federation.knn1(e, q, "vec_id", "embedding", "label").collect()) == one


def test_nearest_against_a_loop(spark, monkeypatch):
    """Distances that differ behind the digits kept are ties, as in the SQL; copies, gaps, and many points in numbers of a product's size."""
    rng = np.random.default_rng(9)
    x = rng.random((60, 3)).round(1).tolist()
    x += [[0.5, 0.5, 0.5 + 2e-8 * k] for k in (9, 3, 1)] + [[0.1, None, 0.3], [0.2], None, [], [0.1, None, 0.3]]
    rows = [(i, v, i % 4) for i, v in enumerate(x)]

    def distance(a, b):
        d = [(u - v) ** 2 for u, v in zip(a or [], b or []) if u is not None and v is not None]
        return round(sum(d), 6) if d else math.inf

    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    want = {i: min((distance(v, w), j) for j, w, _ in rows if j != i)[1] for i, v, _ in rows}
    for most in (20_000, 11):
        monkeypatch.setattr(federation, "MOST_POINTS", most)
        got = federation.knn1(df, df, "vec_id", "embedding", "label").collect()
        assert {r["query"]: (r.nearest, r.predicted) for r in got} == {i: (j, j % 4) for i, j in want.items()}


def test_pools_that_only_move(spark, monkeypatch):
    """Without new models a round is the same as with an empty table of them, in each pool's order; no task has a whole pool."""
    pool = spark.createDataFrame([(i, k, f"{(3 * i + k) % 7}") for i in range(5) for k in range(4)], "node int, ord bigint, sha256 string")
    edge = topology.edges(spark, "ring", 5)
    for most, rounds in ((1 << 53, 5), (10, 2)):
        monkeypatch.setattr(federation, "MOST_PLACES", most)
        old = new = pool
        for r in range(1, rounds + 1):
            old, new = federation.gossip_round(old, pool.limit(0), edge, r, [0, 1, 2, 4]), federation.gossip_round(new, None, edge, r, [0, 1, 2, 4])
            held = [[(x.node, x.sha256) for x in df.orderBy("node", "ord").collect()] for df in (old, new)]
            assert held[0] == held[1]
    assert "Window" not in federation.gossip_round(pool, None, edge, 1, [0, 1])._jdf.queryExecution().executedPlan().toString()
