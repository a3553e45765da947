"""Rounds closed by timers: shuffled and late reports, against the batch."""

import datetime

from pyspark.sql import functions as F

from gridwarden.operators import control
from gridwarden.streaming import rounds

DAY = 86_400_000_000
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def reports(spark, rows):
    """(day, key, node) at noon."""
    data = [(START + datetime.timedelta(days=d, hours=12), k, n) for d, k, n in rows]
    return spark.createDataFrame(data, "ts timestamp, key string, node int")


def test_late_reports_are_recorded_not_lost(spark, tmp_path):
    batches = [
        reports(spark, [(0, "a", 1), (1, "a", 2), (0, "b", 3)]),
        reports(spark, [(0, "a", 2), (0, "a", 1), (6, "a", 1)]),  # out of order, within the two days
        reports(spark, [(7, "b", 1)]),  # days 0 and 1 are closed now
        reports(spark, [(1, "a", 9), (0, "b", 4), (6, "a", 2)]),  # two of them too late
        reports(spark, [(40, "z", 0)]), reports(spark, [(80, "z", 0)]),
    ]
    schema = batches[0].schema
    out = rounds.run(lambda s: rounds.closed(s, F.col("key"), F.col("node"), DAY, "2 days"), batches, schema, f"file://{tmp_path}", spark)
    origin = int(START.timestamp()) * 1_000_000
    got = sorted(((r.key, (r.round_us - origin) // DAY, r.n, r.nodes, r.late) for r in out.collect() if r.key != "z"), key=str)
    assert got == sorted([("a", 0, 3, [1, 2], False), ("a", 1, 1, [2], False), ("a", 6, 2, [1, 2], False), ("b", 0, 1, [3], False), ("b", 7, 1, [1], False), ("a", 1, 1, [9], True), ("b", 0, 1, [4], True)], key=str)


def test_control_on_timed_rounds_is_the_batch_fold(spark, tmp_path):
    """Node 2 is silent from round 5 to 8; reports come shuffled over batches."""
    n, days = 4, 16
    rows = [(d, "f", i) for d in range(days) for i in range(n) if not (i == 2 and 4 <= d < 8)]
    settings = control.Settings(n, dwell=2, cooldown=1)
    origin = int(START.timestamp()) * 1_000_000
    late = [[r for r in rows if r[0] // 6 == k and r[2] != 3] + [r for r in rows if r[0] // 6 == k - 1 and r[2] == 3] for k in range(4)]
    batches = [reports(spark, b) for b in late if b] + [reports(spark, [(200, "z", 0)]), reports(spark, [(400, "z", 0)])]
    out = rounds.run(lambda s: rounds.commits(s, F.col("key"), F.col("node"), DAY, "13 days", settings, origin), batches, batches[0].schema, f"file://{tmp_path}", spark)
    got = sorted((r["round"], r["mode"], r.reason) for r in out.filter("scenario = 'f'").collect())
    st, want = control.begin(settings), []
    for d in range(days):
        st, c = control.step(settings, st, d + 1, control.bits(i for x, _, i in rows if x == d))
        if c:
            want.append((c.round, c.mode, c.reason))
    assert got == want and len(want) >= 2


def test_replay_is_the_batch(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    key, node = F.col("event_type"), F.col("user_id") % 8
    got = rounds.replay(e, key, node, DAY)
    assert got.filter("late").count() == 0
    want = {(r.key, r.round_us): (r.n, r.nodes) for r in rounds.batch_rounds(e.withColumn("ts", F.col("ts").cast("timestamp")), key, node, DAY).collect()}
    assert {(r.key, r.round_us): (r.n, r.nodes) for r in got.collect()} == want and len(want) > 50
