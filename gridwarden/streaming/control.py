"""The control plane as a stateful stream: one federation a key, the step function of ``operators.control``."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.control import COMMITS, Settings, begin, bits, step
from ..session import shared_root


def commits(reports: DataFrame, settings: Settings) -> DataFrame:
    """Commits from a stream of (scenario, dwell, round, reported array<int>).

    Rounds of a federation may arrive out of order within a batch; between batches they
    must not.  A round that was seen already (at-least-once delivery) is skipped.
    """

    def run(key, frames: Iterator, state):
        import dataclasses

        import pandas as pd

        s = dataclasses.replace(settings, dwell=int(key[1]))
        st, last = pickle.loads(state.get[0]) if state.exists else (begin(s), 0)
        frame = pd.concat(list(frames)).sort_values("round")
        out = []
        for r, reported in zip(frame["round"], frame["reported"]):
            if r <= last:
                continue
            st, commit = step(s, st, int(r), bits(int(i) for i in reported))
            last = int(r)
            if commit:
                out.append((key[0], s.dwell, commit.round, commit.mode, commit.reason, list(commit.nodes)))
        state.update((pickle.dumps((st, last)),))
        yield pd.DataFrame(out, columns=["scenario", "dwell", "round", "mode", "reason", "nodes"])

    return reports.groupBy("scenario", "dwell").applyInPandasWithState(run, COMMITS, "state binary", "append", "NoTimeout")


def replay(observations: DataFrame, settings: Settings, folder: str | None = None) -> DataFrame:
    """Run recorded observations through the stream, round by round in a few batches, and return the commits."""
    spark = observations.sparkSession
    root = f"{folder.rstrip('/')}/{uuid.uuid4().hex}" if folder else shared_root(spark)
    source = observations.select("scenario", "dwell", "round", "reported")
    source.repartition(1).sortWithinPartitions("round").write.parquet(f"{root}/in")  # a federation's reports: a row a round
    stream = spark.readStream.schema(source.schema).parquet(f"{root}/in")
    q = commits(stream, settings).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(COMMITS).parquet(f"{root}/out").select(*[F.col(c.split()[0]) for c in COMMITS.split(", ")])
