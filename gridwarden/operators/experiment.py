"""Rounds of federated and gossip training with real models, and what is reported about them.

A node's data are the rows of its ``client``.  The model that travels is ``models.Boosted``: a list of
regression trees with one intercept and rate, so models are continued, concatenated and summed as lists.
Every fit and every evaluation is a distributed job; the driver holds trees and one row of counts a round.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import binary_counts, derived
from . import models, partition, topology
from .models import Boosted, assemble, boost, saved

COUNTS = "tp bigint, fp bigint, fn bigint, tn bigint"


@dataclass(frozen=True)
class ClientParameters:
    """What a client trains with unless a run says otherwise."""

    trees_per_round: int = 1
    depth: int = 3
    rate: float = 0.3
    threshold: float = 0.5


def split_given(df: DataFrame, test: DataFrame | None, seed: int, key: str, share: float = 0.2, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test): a test table that comes with the data is used as it is, else a seeded holdout."""
    if test is not None:
        return df, test.select(*df.columns)
    both = saved(partition.holdout(df, seed, key, share, label))  # either side reads it, often more than once
    return both.filter("split = 'train'").drop("split"), both.filter("split = 'val'").drop("split")


def start(df: DataFrame, columns: list[str], p: ClientParameters) -> Boosted:
    """The model without trees that all nodes begin with."""
    return boost(df, columns, 0, p.depth, p.rate)


def local(df: DataFrame, columns: list[str], model: Boosted, p: ClientParameters) -> list:
    """The trees that a node adds to the model it received; none where its rows have one class."""
    if df.select("y").distinct().count() < 2:
        return []
    return boost(df, columns, p.trees_per_round, p.depth, start=model).trees[len(model.trees) :]


def bagged(model: Boosted, added: list[list]) -> Boosted:
    """All nodes' new trees behind the model's: margins are summed, each node's with its share, so that n nodes step as far as one."""
    grown = [t for trees in added for t in trees]
    rates = [model.rate / max(1, sum(map(bool, added)))] * len(grown)
    old = model.rates or [model.rate] * len(model.trees)
    return Boosted(model.intercept, model.rate, [*model.trees, *grown], list(model.losses), [*old, *rates])


def united(several: list[Boosted]) -> Boosted:
    """One model with every tree of all of them, each once, in the order in which they are met."""
    first, trees, rates = several[0], [], []
    seen: set[int] = set()
    for m in several:
        for t, rate in zip(m.trees, m.rates or [m.rate] * len(m.trees)):
            if id(t) not in seen:
                seen.add(id(t))
                trees.append(t)
                rates.append(rate)
    return Boosted(first.intercept, first.rate, trees, list(first.losses), rates)


def counts(model: Boosted, df: DataFrame, columns: list[str], threshold: float = 0.5) -> dict[str, int]:
    """tp, fp, fn, tn of the model on rows with y."""
    fired = 1 / (1 + F.exp(-F.col("margin"))) >= threshold
    return model.margin(assemble(df, columns).select("y", "features")).agg(*binary_counts(fired, F.col("y") == 1)).first().asDict()


def cyclic(df: DataFrame, columns: list[str], client: str, rounds: int, p: ClientParameters = ClientParameters(), on_round: Callable | None = None) -> Boosted:
    """Round r belongs to client (r - 1) mod n alone, in ascending order of clients: it goes on from the model received and passes it on."""
    clients = sorted(r[0] for r in df.select(client).distinct().collect())
    model = start(df, columns, p)
    for r in range(1, rounds + 1):
        c = clients[(r - 1) % len(clients)]
        model = bagged(model, [local(df.filter(F.col(client) == c), columns, model, p)])
        if on_round:
            on_round(r, "cyclic", model)
    return model


def train_rounds(
    df: DataFrame, columns: list[str], client: str, n: int, modes: list[str], p: ClientParameters = ClientParameters(),
    kind: str = "ring", active: Callable[[int], list[int]] | None = None, on_round: Callable | None = None,
) -> tuple[Boosted, dict[int, Boosted]]:
    """(the model of the last round, each node's model).

    ``modes`` names each round's: in a federated round all active nodes train on one model, which all get;
    in a gossip round the elected head is server and client at once: it and its active neighbours train,
    it unites its group's models and sums their new trees, and only it has the result.  Going back to federated, the union of
    all active nodes' models goes on, so no tree is lost.
    """
    near = topology.neighbours(kind, n)
    model = start(df, columns, p)
    held = dict.fromkeys(range(n), model)
    rows = {i: saved(df.filter(F.col(client) == i)) for i in range(n)}
    for r, mode in enumerate(modes, 1):
        up = active(r) if active else list(range(n))
        if mode == "federated":
            model = united([held[i] for i in up])
            model = bagged(model, [local(rows[i], columns, model, p) for i in up])
            held |= dict.fromkeys(up, model)
        elif mode == "gossip":
            head = up[(r - 1) % len(up)]
            group = [head, *[j for j in near[head] if j in up]]
            base = united([held[i] for i in group])
            model = held[head] = bagged(base, [local(rows[i], columns, base, p) for i in group])
        else:
            raise ValueError(f"unknown mode {mode}")
        if on_round:
            on_round(r, mode, model)
    return model, held


def round_rows(spark, test: DataFrame, columns: list[str], p: ClientParameters = ClientParameters()) -> tuple[Callable, Callable[[], DataFrame]]:
    """A callback that evaluates each round's model on ``test``, and the function that gives its rows (round, mode, trees, counts and rates)."""
    seen: list[tuple] = []
    test = saved(test)

    def on_round(r: int, mode: str, model: Boosted) -> None:
        c = counts(model, test, columns, p.threshold)
        seen.append((r, mode, len(model.trees), c["tp"], c["fp"], c["fn"], c["tn"]))

    return on_round, lambda: spark.createDataFrame(seen, f"round int, mode string, trees int, {COUNTS}").withColumns(derived())


def client_report(held: dict[int, Boosted], test: DataFrame, columns: list[str], p: ClientParameters = ClientParameters()) -> DataFrame:
    """(client, trees, counts and rates) of each node's own model on the same rows."""
    rows = [(i, len(m.trees), *(counts(m, test, columns, p.threshold)[c] for c in ("tp", "fp", "fn", "tn"))) for i, m in sorted(held.items())]
    return test.sparkSession.createDataFrame(rows, f"client int, trees int, {COUNTS}").withColumns(derived())


def central_vs_distributed(df: DataFrame, test: DataFrame, columns: list[str], client: str, n: int, rounds: int, p: ClientParameters = ClientParameters()) -> DataFrame:
    """(run, trees, counts and rates): the federation, and one model on all rows with as many trees as all nodes together made."""
    model, _ = train_rounds(df, columns, client, n, ["federated"] * rounds, p)
    one = boost(df, columns, len(model.trees), p.depth, p.rate)
    rows = [(name, len(m.trees), *(counts(m, test, columns, p.threshold)[c] for c in ("tp", "fp", "fn", "tn"))) for name, m in (("central", one), ("distributed", model))]
    return test.sparkSession.createDataFrame(rows, f"run string, trees int, {COUNTS}").withColumns(derived())


def timed_scores(stream: DataFrame, model: models.Boosted, columns: list[str], out: str, checkpoint: str, threshold: float = 0.5):
    """Score a stream of rows batch by batch into Parquet at ``out``/scores; ``out``/timing has (batch, rows, us_per_row) of each.

    A batch that is delivered again replaces what it wrote before.
    """
    import time

    def put(batch: DataFrame, number: int) -> None:
        began = time.perf_counter()
        scored = model.margin(assemble(batch, columns)).withColumn("fired", 1 / (1 + F.exp(-F.col("margin"))) >= threshold).drop("features")
        scored.write.mode("overwrite").parquet(f"{out}/scores/batch={number}")
        took = time.perf_counter() - began
        n = batch.sparkSession.read.parquet(f"{out}/scores/batch={number}").count()
        batch.sparkSession.createDataFrame([(n, 1e6 * took / max(1, n))], "rows bigint, us_per_row double").write.mode("overwrite").parquet(f"{out}/timing/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
