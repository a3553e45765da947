"""Rounds that are closed by timers: reports are buffered until the watermark has passed a round's end.

One key is one federation.  A report (who, when) belongs to the round that its time falls into; a round's reports
wait in a map state, and a timer at its end closes it, earlier rounds first, whatever the order of arrival and whichever batch brought what.
A report whose round was closed before it came isn't lost: it leaves as a row of its own, marked late.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.control import COMMITS, Settings, begin, bits, step
from ..session import shared_root

CLOSED = "key string, round_us bigint, n bigint, nodes array<int>, late boolean"
#: Key of the event that ends a replay.
END = "end of the recording"


class Rounds(StatefulProcessor):
    """Emits each round once, when it closes, and late reports as they come."""

    def __init__(self, width_us: int) -> None:
        self.width = width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "round_us bigint", "n bigint, nodes array<int>")
        self.closed = handle.getValueState("closed", "upto_us bigint")

    def row(self, key: str, start: int, n: int, nodes, late: bool) -> tuple:
        return key, start, n, sorted(set(int(x) for x in nodes)), late

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows))
        start = frame["at"] // self.width * self.width
        upto = self.closed.get()[0] if self.closed.exists() else None
        now = timerValues.getCurrentWatermarkInMs() * 1000
        late = []
        for first, own in frame.groupby(start):
            first = int(first)
            nodes = own["node"].tolist()
            # closed already, or about to be: its timer would lie in the past
            if upto is not None and first < upto or first + self.width <= now:
                late += [self.row(key[0], first, 1, [x], True) for x in nodes]
                continue
            if self.open.containsKey((first,)):
                n, before = self.open.getValue((first,))
                nodes = [*before, *nodes]
            else:
                n = 0
                self.handle.registerTimer(-(-(first + self.width) // 1000))
            self.open.updateValue((first,), (n + len(own), sorted(set(int(x) for x in nodes))))
        if late:
            yield pd.DataFrame(late, columns=["key", "round_us", "n", "nodes", "late"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs() * 1000
        out = []
        # of several rounds that end at once, and of timers in any order, the earlier round goes first
        for first in sorted(k[0] for k in self.open.keys()):
            if first + self.width <= end:
                n, nodes = self.open.getValue((first,))
                self.open.removeKey((first,))
                self.closed.update((first + self.width,))
                out.append(self.row(key[0], first, n, nodes, False))
        yield from self.close_rounds(key, out)

    def close_rounds(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["key", "round_us", "n", "nodes", "late"])

    def close(self) -> None:
        pass


class Control(Rounds):
    """The control plane on closed rounds: the same step function as in batch, one commit a round at most; rounds are numbered from ``origin_us``."""

    def __init__(self, width_us: int, settings: Settings, origin_us: int) -> None:
        super().__init__(width_us)
        self.settings, self.origin = settings, origin_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.plane = handle.getValueState("plane", "state binary")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for _ in super().handleInputRows(key, rows, timerValues):
            pass  # what is late has no round to take part in; ``Rounds`` shows it
        return iter(())

    def close_rounds(self, key, rows):
        s = self.settings
        st = pickle.loads(self.plane.get()[0]) if self.plane.exists() else begin(s)
        out = []
        for _, first, _, nodes, _ in rows:
            st, commit = step(s, st, (first - self.origin) // self.width + 1, bits(nodes))
            if commit:
                out.append((key[0], s.dwell, commit.round, commit.mode, commit.reason, list(commit.nodes)))
        self.plane.update((pickle.dumps(st),))
        if out:
            yield pd.DataFrame(out, columns=["scenario", "dwell", "round", "mode", "reason", "nodes"])


def _reports(stream: DataFrame, key: Column, node: Column, late: str) -> DataFrame:
    # the time goes on as a number: rows behind the watermark reach the processor, which records them
    return stream.withWatermark("ts", late).select(key.cast("string").alias("key"), F.unix_micros("ts").alias("at"), node.cast("int").alias("node")).filter("at is not null and node is not null")


def closed(stream: DataFrame, key: Column, node: Column, width_us: int, late: str) -> DataFrame:
    """(key, round_us, n, nodes, late) of a stream with ``ts``: each round when it is closed; late reports one by one."""
    return _reports(stream, key, node, late).groupBy("key").transformWithStateInPandas(Rounds(width_us), CLOSED, "append", "eventTime")


def commits(stream: DataFrame, key: Column, node: Column, width_us: int, late: str, settings: Settings, origin_us: int) -> DataFrame:
    """Commits of each key's control plane on its closed rounds."""
    return _reports(stream, key, node, late).groupBy("key").transformWithStateInPandas(Control(width_us, settings, origin_us), COMMITS, "append", "eventTime")


def batch_rounds(events: DataFrame, key: Column, node: Column, width_us: int) -> DataFrame:
    """What ``closed`` gives of a whole table, none of it late."""
    at = F.unix_micros("ts")
    start = F.floor(at / width_us) * width_us
    rows = events.select(key.cast("string").alias("key"), start.cast("bigint").alias("round_us"), node.cast("int").alias("node")).filter("round_us is not null and node is not null")
    return rows.groupBy("key", "round_us").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("node")).alias("nodes"))


#: The state store that keeps maps and timers.
_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run(stream_of, batches: list[DataFrame], schema, root: str, spark: SparkSession) -> DataFrame:
    """Write ``batches`` one after the other as a stream's input and run ``stream_of`` (stream -> stream) on all that is there, once for each; what it wrote.

    Each run goes on from the state of the one before, as after a restart.
    """
    before = {k: spark.conf.get(k, None) for k in _STORE}
    batches[0].limit(0).write.mode("append").parquet(f"{root}/in")  # the folder must be there
    stream = stream_of(spark.readStream.schema(schema).parquet(f"{root}/in"))
    try:
        for k, v in _STORE.items():
            spark.conf.set(k, v)
        for b in batches:
            b.write.mode("append").parquet(f"{root}/in")
            stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def replay(events: DataFrame, key: Column, node: Column, width_us: int, pieces: int = 3, jitter: str = "2 days") -> DataFrame:
    """Rounds of a recorded table that arrives out of order, up to ``jitter`` late, in ``pieces`` batches; a last event far ahead closes what is open."""
    spark = events.sparkSession
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), key.cast("string").alias("key"), node.cast("int").alias("node"))
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    # each row arrives after a delay of its own, by a hash, so neighbours in time come in different batches
    span = F.lit(float((last - first).total_seconds()) + 1)
    delay = F.pmod(F.xxhash64("ts", "key", "node"), F.lit(1000)) / 1000.0 * F.expr(f"cast(interval {jitter} as interval day to second)").cast("long").cast("double")
    piece = F.least(F.lit(pieces - 1), F.floor((F.col("ts").cast("double") - F.lit(first.timestamp()) + delay) / span * pieces)).cast("int")
    parts = [rows.filter(piece == k) for k in range(pieces)]
    end = spark.createDataFrame([(END, 0)], "key string, node int").select((F.lit(last) + F.expr("INTERVAL 3650 DAYS")).alias("ts"), "key", "node")
    batches = [*parts, end, end]  # the second one lets the timers see the watermark of the first
    out = run(lambda s: closed(s, F.col("key"), F.col("node"), width_us, jitter), batches, rows.schema, shared_root(spark), spark)
    return out.filter(F.col("key") != END)
