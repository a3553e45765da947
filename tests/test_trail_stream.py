"""The trail's offsets: replay, restart and several readers give each event once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gridwarden.sources import trail, trail_stream


@pytest.fixture()
def events(spark, tmp_path):
    trail_stream.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()

    def add(name, rows):
        (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))

    stream = lambda: spark.readStream.schema("type string, round int, failed_nodes array<int>, ts timestamp").json(str(folder))
    return add, stream


def written(stream, path, check, **options):
    w = stream.writeStream.format("trail").option("checkpointLocation", str(check)).option("path", str(path)).option("order", "round").trigger(availableNow=True)
    for k, v in options.items():
        w = w.option(k, v)
    w.start().awaitTermination()


def read_on(spark, path, tmp_path, name):
    """One more run of a reader with a checkpoint of its own; all it has read so far."""
    out = str(tmp_path / f"out-{name}")
    spark.readStream.format("trail").load(str(path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start().awaitTermination()
    return sorted((r.seq, r.round) for r in spark.read.schema(trail.SCHEMA).parquet(out).collect())


def test_each_event_once(spark, events, tmp_path, monkeypatch):
    add, stream = events
    path = tmp_path / "trail"
    add("a.json", [{"type": "node_failure", "round": 4, "failed_nodes": [1, 2]}, {"type": "node_failure", "round": 2, "ts": "2024-01-02T03:04:05Z"}])
    written(stream(), path, tmp_path / "w1")
    assert read_on(spark, path, tmp_path, "one") == [(1, 2), (2, 4)]
    add("b.json", [{"type": "other", "round": 9}])
    written(stream(), path, tmp_path / "w1")  # a restart goes on
    written(stream(), path, tmp_path / "w2")  # the writer has lost its checkpoint: batch 0 comes again and is dropped
    assert read_on(spark, path, tmp_path, "one") == [(1, 2), (2, 4), (3, 9)]  # goes on from its offset
    assert read_on(spark, path, tmp_path, "one") == [(1, 2), (2, 4), (3, 9)]
    assert read_on(spark, path, tmp_path, "two") == [(1, 2), (2, 4), (3, 9)]  # a second reader from the start
    whole = spark.read.format("trail").load(str(path))
    rows = {r.seq: r for r in whole.collect()}
    assert rows[2].failed_nodes == [1, 2] and rows[1].ts.year == 2024 and rows[3].ts is not None and whole.schema == trail.SCHEMA
    assert [r.seq for r in trail.since(whole, 1, kind="node_failure").collect()] == [2]
    assert [r.seq for r in spark.read.format("trail").option("since", 2).load(str(path)).collect()] == [3]
    # staged files without a commit are not events
    (path / "data" / "lost.jsonl").write_text('{"type": "x", "round": 99}\n')
    assert spark.read.format("trail").load(str(path)).count() == 3
    assert sum(len(c["files"]) for c in trail_stream.commits(str(path))) == len(os.listdir(path / "data")) - 1


def test_long_files_are_several_partitions(spark, events, tmp_path, monkeypatch):
    add, stream = events
    monkeypatch.setattr(trail_stream, "LINES", 7)
    path = tmp_path / "trail"
    add("a.json", [{"type": "t", "round": i} for i in range(30)])
    written(stream(), path, tmp_path / "w")
    parts = trail_stream.pieces(str(path), 3, 28)
    assert sum(p.n for p in parts) == 25 and max(p.n for p in parts) == 7 and min(p.first for p in parts) == 4
    assert sorted(r[0] for p in parts for r in trail_stream._rows(p)) == list(range(4, 29))


def test_odd_trails(spark, events, tmp_path):
    add, stream = events
    assert spark.read.format("trail").load(str(tmp_path / "none")).count() == 0
    add("a.json", [])
    written(stream(), tmp_path / "empty", tmp_path / "w")
    assert spark.read.format("trail").load(str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="no columns"):
        written(stream().withColumn("more", F.lit(1)), tmp_path / "bad", tmp_path / "w3")
