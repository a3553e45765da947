"""Non-IID splits of labelled rows over simulated sensors, folds and holdouts.

Random permutations are seeded md5 orders, so every split is a pure function of
the data.  Counts per class decide boundaries; they come from one aggregation and are
joined back as a table of classes, which is small.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import chunk, ranked, stepped


def iid(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    return stepped(df, seed, key, "iid", "client_id", lambda r, rows: chunk(n, r, rows))


def shard(df: DataFrame, n: int, seed: int, key: str, label: str, shards: int = 2) -> DataFrame:
    """Rows sorted by label (inside a label in a seeded order) in n x shards chunks; chunks are dealt in a seeded order."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    by_label = Window.orderBy(label)  # one row for each class
    bases = sizes.select(label, F.coalesce(F.sum("_size").over(by_label.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_size").over(Window.partitionBy()).alias("_all"))
    cut = ranked(df, seed, key, "rows", label).join(F.broadcast(bases), label)
    cut = cut.withColumn("_s", chunk(n * shards, F.col("_r") + F.col("_base"), F.col("_all"))).drop("_r", "_n", "_base", "_all")
    deal = df.sparkSession.range(n * shards).select(F.col("id").cast("int").alias("_s"))
    order = [F.md5(F.concat(F.lit(f"{seed}|shard|"), F.col("_s").cast("string"))), F.col("_s")]
    deal = deal.withColumn("client_id", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / shards).cast("int"))
    return cut.join(F.broadcast(deal), "_s").drop("_s")


def unequal_sizes(total: int, n: int, kind: str) -> list[int]:
    """exponential: client i has weight 2^i; linear: weight n - i.  Sizes round half to even; client 0 takes the difference."""
    w = np.array([2.0**i if kind == "exponential" else float(n - i) for i in range(n)])
    sizes = np.round(w / w.sum() * total).astype(int)
    sizes[0] += total - sizes.sum()
    return [int(x) for x in sizes]


def unequal(df: DataFrame, n: int, seed: int, key: str, kind: str) -> DataFrame:
    upto = np.cumsum(unequal_sizes(df.count(), n, kind)).tolist()
    client = F.lit(n - 1)
    for i in range(n - 2, -1, -1):
        client = F.when(F.col("_r") <= upto[i], i).otherwise(client)
    return ranked(df, seed, key, kind).withColumn("client_id", client.cast("int")).drop("_r", "_n")


def dirichlet_shares(classes: list[str], n: int, seed: int, alpha: float = 0.5) -> list[tuple[str, int, float]]:
    """(class, client, cumulative share before the client's end), drawn on the driver: classes x clients values."""
    rng, out = np.random.default_rng(seed), []
    for c in classes:
        p = np.maximum(rng.dirichlet([alpha] * n), 1e-6)
        for i, x in enumerate(np.cumsum(p / p.sum())):
            out.append((c, i, round(float(x), 9)))
    return out


def dirichlet(df: DataFrame, n: int, seed: int, key: str, label: str, shares: list[tuple[str, int, float]]) -> DataFrame:
    """Each class's shuffled rows, cut at trunc(share x size); the last client takes the rest."""
    spark = df.sparkSession
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    ends = spark.createDataFrame(shares, f"`{label}` string, client int, share double").join(sizes, label)
    cuts = ends.filter(F.col("client") < n - 1).groupBy(label).agg(F.array_sort(F.collect_list(F.floor(F.col("share") * F.col("_n")).cast("bigint"))).alias("_cuts"))
    rows = ranked(df, seed, key, "dir", label).join(F.broadcast(cuts), label, "left")
    client = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<bigint>")), lambda c: c < F.col("_r")))
    return rows.withColumn("client_id", client.cast("int")).drop("_r", "_n", "_cuts")


def sensors(df: DataFrame, n: int, label: str, normal: str) -> DataFrame:
    """(class, rank by size, sensors, first client) of each attack class.

    With more clients than classes each class has one sensor and the largest classes get the
    extra ones in turn; otherwise class j belongs to client j mod n.
    """
    classes = df.filter(F.col(label) != normal).groupBy(label).agg(F.count("*").alias("_n"))
    by_size = Window.orderBy(F.desc("_n"), label)
    ranked = classes.withColumn("_rank", F.row_number().over(by_size) - 1).withColumn("_k", F.count("*").over(Window.partitionBy()))
    extra = F.greatest(F.lit(n) - F.col("_k"), F.lit(0))
    own = (1 + F.floor(extra / F.col("_k")) + F.when(F.col("_rank") < extra % F.col("_k"), 1).otherwise(0)).cast("int")
    placed = ranked.withColumn("sensors", own)
    before = F.coalesce(F.sum("sensors").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.when(F.col("_k") < n, before).otherwise(F.col("_rank") % n)
    return placed.withColumn("first_client", first.cast("int")).select(label, "_rank", "sensors", "first_client")


def attack(df: DataFrame, n: int, seed: int, key: str, label: str, normal: str) -> DataFrame:
    """Specialised sensors: normal rows over all clients, each attack class at its own."""
    plan = sensors(df, n, label, normal)
    normals = stepped(df.filter(F.col(label) == normal), seed, key, "attack", "client_id", lambda r, rows: chunk(n, r, rows))
    planned = df.filter(F.col(label) != normal).join(F.broadcast(plan), label)
    client = lambda r, rows: (F.col("first_client") + chunk(F.col("sensors"), r, rows)).cast("int")
    placed = stepped(planned, seed, key, "attack", "client_id", client, label, "first_client", "sensors")
    return normals.unionByName(placed.select(*normals.columns))


def matrix(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Rows of each client and class, and their share of the client's rows."""
    keys = by or ("client_id",)
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), 6))


def holdout(df: DataFrame, seed: int, key: str, share: float = 0.2, label: str | None = None) -> DataFrame:
    """``split``: 'val' for the first ceil(share x n) rows of a seeded order (of each class), else 'train'."""
    side = lambda r, rows: F.when(r <= F.ceil(F.lit(share) * rows), "val").otherwise("train")
    return stepped(df, seed, key, "holdout", "split", side, *([label] if label else []))


def kfold(df: DataFrame, k: int, seed: int, key: str, label: str) -> DataFrame:
    """``fold`` 0..k-1, stratified."""
    return ranked(df, seed, key, "fold", label).withColumn("fold", chunk(k)).drop("_r", "_n")


def stratified_sample(df: DataFrame, size: int, seed: int, key: str, label: str) -> DataFrame:
    """Exactly min(size, rows) rows; class quotas by largest remainder, then by class."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    everything = Window.partitionBy()
    exact = F.least(F.lit(size), F.sum("_n").over(everything)) * F.col("_n") / F.sum("_n").over(everything)
    quota = counts.withColumn("_x", exact).withColumn("_q", F.floor("_x"))
    spare = F.least(F.lit(size), F.sum("_n").over(everything)) - F.sum("_q").over(everything)
    order = Window.orderBy(F.desc(F.round(F.col("_x") - F.col("_q"), 9)), label)
    quota = quota.withColumn("_q", F.col("_q") + F.when(F.row_number().over(order) <= spare, 1).otherwise(0)).select(label, "_q")
    return ranked(df, seed, key, "sample", label).join(F.broadcast(quota), label).filter("_r <= _q").drop("_r", "_n", "_q")
