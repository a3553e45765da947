"""Joins on keys of which a few hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one SHARES-th of all rows is heavy, so there are at most SHARES heavy keys.
SHARES = 1000


def heavy(counts: DataFrame, weight: str = "n") -> tuple[DataFrame, int] | None:
    """The rows of ``counts`` (one for each key) with a heavy key, at most SHARES of them, and the weight up to which a key is light; None if there is no heavy key."""
    total, most = counts.agg(F.sum(weight), F.max(weight)).first()
    least = (total or 0) // SHARES
    return (counts.filter(F.col(weight) > least), least) if most and most > least else None


def join_counted(left: DataFrame, right: DataFrame, on: str, how: str = "inner", weight: str = "n") -> DataFrame:
    """``left`` joined (inner or left) with ``right``, which has one narrow row for each key and in ``weight`` the key's rows in ``left``.

    Rows with a heavy key meet their partner, which is broadcast (SHARES rows at most),
    where they lie; only the others are shuffled by key.
    """
    found = heavy(right, weight)
    if found is None:
        return left.join(right.drop(weight), on, how)
    hot = F.broadcast(found[0])
    light = right.filter(F.col(weight) <= found[1]).drop(weight)
    return left.join(hot.drop(weight), on).unionByName(left.join(hot.select(on), on, "left_anti").join(light, on, how))


def salted(left: DataFrame, right: DataFrame, on: str, other: str) -> DataFrame:
    """Inner join of ``left`` with a wide ``right`` (one row for each key); a heavy key's rows are spread by ``other`` over copies of its partner.

    The copies of all heavy keys together are at most 2 x SHARES, and no copy meets more than a light key's rows.
    """
    found = heavy(left.groupBy(on).agg(F.count(F.lit(1)).alias("n")))
    if found is None:
        return left.join(right, on)
    copies = F.broadcast(found[0].select(on, F.ceil(F.col("n") / max(1, found[1])).cast("int").alias("_copies")))
    spread = left.join(copies, on, "left").withColumn("_copy", F.when(F.col("_copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.col("_copies"))).cast("int")).drop("_copies")
    copied = right.join(copies, on, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return spread.join(copied, [on, "_copy"]).drop("_copy")
