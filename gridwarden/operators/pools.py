"""Rounds of federated and gossip training that keep every model.

Models are rows of one table, named by the digest of their content; what a node knows is a pool, rows (node, ord, sha256).
A round trains the active nodes in one pass over all rows (``trees.grow``), then pools are united by digest:

* federated: every active node trains afresh; the round's model is the union of what they made, and it is retained;
* gossip: every active node adds what it trained to its own pool, then the round's head adds its neighbours' pools.

Going from federated to gossip, all nodes start with what was retained so far, so a node that fails later leaves
its model behind; going back, the pools' union is retained.  A node with one model in its pool goes on from it where ``adopt``
is set; else, and with more models, it trains afresh, which gives the model it had, and equal models count once.

Decisions come from a table of votes: every model judges every row once, rows with equal votes are counted together, and each
node's decision of each round is a look-up of its pool's positions among these votes.  So a run of any number of rounds and nodes is
evaluated by one pass over the rows and a table of vote patterns.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from . import federation, topology, trees
from .models import saved

POOL = "node int, ord bigint, sha256 string"


@dataclass
class Run:
    """What a run leaves behind: all models, and after each round (round, mode, head, node, ord, sha256) of what a node decides by."""

    models: DataFrame
    pools: DataFrame
    losses: dict[str, list[float]] = field(default_factory=dict)


class _Training:
    """Trains nodes and remembers what came out: the same rows and start give the same model."""

    def __init__(self, data: trees.Binned, growth: trees.Growth, balanced: bool) -> None:
        self.data, self.growth, self.balanced = data, growth, balanced
        self.by_digest: dict[str, trees.Model] = {}
        self.made: dict[tuple[int, str | None], str | None] = {}

    def __call__(self, asked: dict[int, str | None]) -> dict[int, str]:
        """node -> digest of its new model, given the digest it goes on from; nodes whose rows have one class make none."""
        todo = {n: d for n, d in asked.items() if (n, d) not in self.made}
        for going_on in (False, True):
            some = {n: d for n, d in todo.items() if (d is not None) == going_on}
            if some:
                start = {n: self.by_digest[d] for n, d in some.items()} if going_on else None
                grown = trees.grow(self.data, self.growth, start=start, balanced=self.balanced, only=some)
                for n, d in some.items():
                    m = grown.get(n)
                    self.made[n, d] = m.digest() if m and m.trees else None
                    if m and m.trees:
                        self.by_digest[m.digest()] = m
        return {n: self.made[n, d] for n, d in asked.items() if self.made[n, d]}

    def table(self, spark: SparkSession) -> DataFrame:
        return trees.rows_of(spark, {k: m for k, (_, m) in enumerate(sorted(self.by_digest.items()))})


def run(
    spark: SparkSession, data: trees.Binned, n: int, modes: list[str], growth: trees.Growth = trees.Growth(), kind: str = "ring",
    active: Callable[[int], list[int]] | None = None, adopt: bool = True, balanced: bool = True,
) -> Run:
    """Train ``n`` nodes, whose numbers are the memberships of ``data``'s rows, for one round of each of ``modes``."""
    train, edges = _Training(data, growth, balanced), topology.edges(spark, kind, n)
    everyone = spark.range(n).select(F.col("id").cast("int").alias("node"))
    pool, retained = spark.createDataFrame([], POOL), spark.createDataFrame([], "ord bigint, sha256 string")
    rounds, before = [], None
    for r, mode in enumerate(modes, 1):
        up = active(r) if active else list(range(n))
        if not up:
            raise ValueError(f"no node is active in round {r}")
        head = up[(r - 1) % len(up)]
        if mode == "federated":
            if before == "gossip":  # what the nodes know comes back as one union
                retained = federation.retain(retained, federation.union_of(pool))
            made = train(dict.fromkeys(up))
            new = spark.createDataFrame([(k, d) for k, d in enumerate(made[i] for i in up if i in made)], "ord bigint, sha256 string")
            now = federation.retain(retained.limit(0), new)
            retained = saved(federation.retain(retained, now))
            state = everyone.filter(F.col("node").isin(up)).crossJoin(now)  # a broadcast of a union of n models at most
        elif mode == "gossip":
            if before == "federated":
                pool = federation.seed_all(everyone, retained)
            own = {}
            for row in pool.filter(F.col("node").isin(up)).select("node", "sha256").collect():  # nodes x models, no rows
                own.setdefault(row["node"], []).append(row["sha256"])
            made = train({i: own[i][0] if adopt and len(own.get(i, ())) == 1 else None for i in up})
            trained = spark.createDataFrame([(i, 0, d) for i, d in made.items()], POOL)
            pool = saved(federation.gossip_round(pool, trained, edges, r, up))
            state = pool
        else:
            raise ValueError(f"unknown mode {mode}")
        rounds.append(state.select(F.lit(r).alias("round"), F.lit(mode).alias("mode"), F.lit(head).alias("head"), "node", "ord", "sha256"))
        before = mode
    pools = rounds[0]
    for x in rounds[1:]:
        pools = pools.unionByName(x)
    return Run(saved(train.table(spark)), saved(pools), {d: m.losses for d, m in train.by_digest.items()})


def votes(df: DataFrame, models: DataFrame, columns: list[str], keep: list[str], threshold: float = 0.5, depth: int = 8) -> DataFrame:
    """(keep..., fired array<boolean>): what each model, in the order of ``positions``, says of each row.

    As ``trees.scored``, a tree at a time for all rows of a batch; no tree may be deeper than ``depth``.
    """
    bar = math.log(threshold / (1 - threshold))
    made = [(m["intercepts"][0], [trees.Follow(t["rate"], t["nodes"], depth) for t in m["trees"] if t["cls"] == 0]) for m in sorted(models.collect(), key=lambda m: (m["model"], m["sha256"]))]
    kept = df.select(*keep)

    def run(batches):
        for b in batches:
            x = np.array([c.to_numpy(zero_copy_only=False) for c in b.columns[len(keep) :]], float).reshape(len(columns), b.num_rows)
            fired = np.zeros((b.num_rows, len(made)), bool)
            for i, (intercept, grown) in enumerate(made):
                margin = np.full(b.num_rows, intercept)
                for t in grown:
                    margin += t.rate * t.value(x)
                fired[:, i] = margin >= bar
            ends = pa.array(np.arange(b.num_rows + 1) * len(made), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.ListArray.from_arrays(ends, pa.array(fired.ravel()))], [*keep, "fired"])

    schema = StructType([*kept.schema.fields, StructField("fired", ArrayType(BooleanType()))])
    return df.select(*keep, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]).mapInArrow(run, schema)


def positions(models: DataFrame) -> DataFrame:
    """(sha256, at): where a model's vote stands."""
    one = models.agg(F.array_sort(F.collect_list(F.struct("model", "sha256"))).alias("m"))
    return one.select(F.posexplode("m").alias("at", "m")).select("m.sha256", "at")


def patterns(voted: DataFrame, *keys: str) -> DataFrame:
    """(keys..., fired, n): rows with equal votes, counted."""
    return voted.groupBy(*keys, "fired").agg(F.count(F.lit(1)).alias("n"))


def decisions(pattern: DataFrame, pools: DataFrame, models: DataFrame, k: int = 1) -> DataFrame:
    """``pattern`` for every (round, mode, node) with ``decided``: at least ``k`` models of the node's pool fired."""
    sets = pools.join(positions(models), "sha256").groupBy("round", "mode", "head", "node").agg(F.collect_list("at").alias("at"))
    return pattern.crossJoin(F.broadcast(sets)).withColumn("decided", F.size(F.filter("at", lambda i: F.col("fired")[i])) >= k).drop("at")


def counted(decided: DataFrame, truth: Column, *by: str) -> DataFrame:
    """(by..., tp, fp, fn, tn, recall, fpr) over vote patterns."""
    total = lambda on, c: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).alias(c)
    d = F.col("decided")
    out = decided.groupBy(*by).agg(total(d & truth, "tp"), total(d & ~truth, "fp"), total(~d & truth, "fn"), total(~d & ~truth, "tn"))
    rate = lambda a, b: F.round(100 * F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1)), 6)
    return out.withColumns({"recall": rate("tp", "fn"), "fpr": rate("fp", "tn")})


def agreement(decided: DataFrame, reference: DataFrame, *by: str) -> DataFrame:
    """(by..., n, differ): rows, and those where a decision is not that of ``reference`` (the same patterns, decided once)."""
    keys = [c for c in reference.columns if c not in ("n", "decided", "round", "mode", "head", "node")]
    other = reference.select(*keys, F.col("decided").alias("_other"))
    return decided.join(other, keys).groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("decided") != F.col("_other"), F.col("n")).otherwise(0)).alias("differ"))


def without(pools: DataFrame, gone: DataFrame, owner: DataFrame) -> DataFrame:
    """Pools after nodes have dropped out: (step, node) in ``gone`` says which are missing at a step, and each model goes with its ``owner`` (sha256, node).

    What is left at each step is aggregated again, as a round of its own.
    """
    steps = gone.select("step").distinct()
    each = pools.join(owner.withColumnRenamed("node", "_owner"), "sha256").crossJoin(F.broadcast(steps))
    missing = gone.select("step", F.col("node").alias("_owner"))
    return each.join(F.broadcast(missing), ["step", "_owner"], "left_anti").select(F.col("step").alias("round"), "mode", "head", "node", "ord", "sha256")


# ---- head and validators -------------------------------------------------------------------------------------


def roles(spark: SparkSession, data: trees.Binned, n: int, rounds: int, growth: trees.Growth = trees.Growth(), active: Callable[[int], list[int]] | None = None) -> DataFrame:
    """(round, node, role, model, sha256, intercepts, trees): each round's head goes on training from its model, all other active nodes only hold theirs.

    Nodes without a model yet have empty trees and an intercept of 0.
    """
    held: dict[int, trees.Model] = {i: trees.Model([0.0]) for i in range(n)}
    out = None
    for r in range(1, rounds + 1):
        up = active(r) if active else list(range(n))
        head = up[(r - 1) % len(up)]
        start = {head: held[head]} if held[head].trees else None
        held[head] = trees.grow(data, growth, start=start, only=[head], final_loss=False).get(head, held[head])
        now = trees.rows_of(spark, {i: held[i] for i in up}).select(F.lit(r).alias("round"), F.col("model").alias("node"), F.when(F.col("model") == head, "head").otherwise("validator").alias("role"), "*")
        out = now if out is None else out.unionByName(now)
    return out


def role_predictions(test: DataFrame, held: DataFrame, columns: list[str], client: str, key: str, truth: str, depth: int = 8) -> DataFrame:
    """(round, node, role, key, truth, predicted): every node's model judges the node's own rows, in one job; a node whose model has no tree predicts nothing (null)."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    rows = test.select(F.col(client).cast("int").alias("node"), key, truth, x.alias("_x"))
    both = rows.join(F.broadcast(held.select("round", "node", "role", "intercepts", "trees")), "node")
    margin = trees.margins(F.col("trees"), F.col("intercepts"), F.col("_x"), depth)[0]
    return both.select("round", "node", "role", key, truth, F.when(F.size("trees") > 0, (margin >= 0).cast("int")).alias("predicted"))


def role_accuracy(predictions: DataFrame, truth: str) -> DataFrame:
    """(round, node, role, n, accuracy)."""
    right = F.coalesce((F.col("predicted") == F.col(truth)).cast("double"), F.lit(0.0))
    return predictions.groupBy("round", "node", "role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 6).alias("accuracy"))
