"""Decisions of several specialists on each row, and their fusion.

Specialists are boolean columns of one wide row (``fired``), so scoring is a
projection and fusion a sum; the counts for all k come from one aggregation over the
number of votes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import binary_counts, count_if, derived


def score(df: DataFrame, specialists: list[tuple[int, str, str]], keep: list[str]) -> DataFrame:
    """``fired``: array of booleans, one for each (node, class, SQL predicate), and ``votes``."""
    fired = F.array(*[F.coalesce(F.expr(rule), F.lit(False)) for _, _, rule in specialists])
    return df.select(*keep, fired.alias("fired")).withColumn("votes", F.size(F.filter("fired", lambda x: x)))


def fuse(votes: DataFrame, attack: Column, k_list: list[int]) -> DataFrame:
    """Counts and rates of the k-of-n decision for each k."""
    tally = votes.groupBy("votes", attack.alias("attack")).agg(F.count("*").alias("n"))
    at = tally.withColumn("k", F.explode(F.array(*[F.lit(k) for k in k_list])))
    weigh = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    on, bad = F.col("votes") >= F.col("k"), F.col("attack")
    return at.groupBy("k").agg(
        weigh(on & bad).alias("tp"), weigh(on & ~bad).alias("fp"), weigh(~on & bad).alias("fn"), weigh(~on & ~bad).alias("tn")
    ).withColumns(derived())


def or_score(columns: list[str]) -> Column:
    """The largest probability: at least 0.5 exactly if one model's is."""
    return F.greatest(*columns)


def arbitration(votes: DataFrame, attack: Column, n: int) -> DataFrame:
    """and / majority / or over n views."""
    out = None
    for name, need in (("and", n), ("majority", n // 2 + 1), ("or", 1)):
        row = votes.agg(*binary_counts(F.col("votes") >= need, attack)).withColumns(derived()).withColumn("rule", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def majority(predictions: DataFrame, row: str, label: str) -> DataFrame:
    """The most frequent label of each row; of equals the smallest."""
    counts = predictions.groupBy(row, label).agg(F.count("*").alias("_n"))
    return counts.groupBy(row).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias("voted"))


def vote_histogram(votes: DataFrame, attack: Column) -> DataFrame:
    """False alarms by number of votes."""
    return votes.filter(~attack & (F.col("votes") > 0)).groupBy(F.col("votes").cast("int").alias("votes")).agg(F.count("*").alias("n"))


def own_rates(votes: DataFrame, attack: Column, nodes: list[int]) -> DataFrame:
    """False positive rate of each specialist."""
    rates = F.array(*[F.struct(F.lit(n).alias("node"), (100 * count_if(F.col("fired")[i] & ~attack) / count_if(~attack)).alias("fpr")) for i, n in enumerate(nodes)])
    return votes.agg(rates.alias("r")).select(F.explode("r").alias("r")).select("r.node", F.round("r.fpr", 6).alias("fpr"))


def selective_or(votes: DataFrame, attack: Column, nodes: list[int], limit: float) -> DataFrame:
    """OR over the specialists whose own false positive rate is below the limit."""
    good = own_rates(votes, attack, nodes).filter(F.col("fpr") < limit).agg(F.collect_set("node").alias("good"))
    # one row, so the cross join adds a constant
    chosen = F.exists(F.zip_with("fired", F.array(*[F.lit(n) for n in nodes]), lambda f, n: f & F.array_contains("good", n)), lambda x: x)
    return votes.crossJoin(F.broadcast(good)).agg(*binary_counts(chosen, attack)).withColumns(derived())


def agreement(a: DataFrame, b: DataFrame, key: str, decision: str) -> DataFrame:
    """Share of rows on which two deciders agree, and the number on which they differ."""
    both = a.select(key, F.col(decision).alias("_a")).join(b.select(key, F.col(decision).alias("_b")), key)
    return both.agg(F.count("*").alias("n"), count_if(F.col("_a") != F.col("_b")).alias("differ"), F.round(100 * F.avg((F.col("_a") == F.col("_b")).cast("int")), 6).alias("agree"))


def node_drop(votes: DataFrame, attack: Column, n: int, k: int, least: int = 1) -> DataFrame:
    """Counts with only the first m specialists, for m = n..least."""
    counted = [F.size(F.filter(F.slice("fired", 1, m), lambda x: x)) >= k for m in range(least, n + 1)]
    parts = F.array(*[F.struct(F.lit(m).alias("n_active"), *binary_counts(c, attack)) for m, c in zip(range(least, n + 1), counted)])
    return votes.agg(parts.alias("p")).select(F.explode("p").alias("p")).select("p.*").withColumns(derived())


def best_tau(counts: DataFrame) -> DataFrame:
    """The threshold with the largest F1; of equals the smallest."""
    return counts.agg(F.min_by("tau", F.struct(-F.col("f1"), F.col("tau"))).alias("tau"), F.max("f1").alias("f1"))
