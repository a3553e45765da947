"""Seeded orders that any engine can repeat: md5 of seed, salt and row key, then the key itself.

Ranks in such an order need no task that sees all rows: the first three hex digits of
the md5 are a bucket, buckets follow each other in the order, and all have about the same
number of rows.  Rows are ranked inside their bucket; what stands before a bucket comes
from a table of counts with at most 4,096 rows for each group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of all groups that are broadcast: some 60 groups have so many.
MOST_BUCKETS = 1 << 18


def shuffled(seed: int, key: str, salt: str = "") -> Column:
    """Sort key of a pseudo-random permutation of the rows with this key."""
    return F.md5(F.concat(F.lit(f"{seed}|{salt}|"), F.col(key).cast("string")))


def shuffle_order(seed: int, key: str, salt: str = "") -> list[Column]:
    return [shuffled(seed, key, salt), F.col(key)]


def ranked(df: DataFrame, seed: int, key: str, salt: str, *by: str) -> DataFrame:
    """``df`` with ``_r``, the 1-based rank of each row in the seeded order of its group, and ``_n``, the group's rows."""
    marked = df.withColumn("_h", shuffled(seed, key, salt)).withColumn("_b", F.substring("_h", 1, 3))
    counts = marked.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    # of counts only: one row for each bucket of each group
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum("_c").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(*by, "_b", F.coalesce(before, F.lit(0)).alias("_base"), F.sum("_c").over(whole).alias("_n"))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))
    joined = marked.withColumn("_i", inside).alias("l").join(bases.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "_b")])
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._i") + F.col("r._base")).alias("_r"), F.col("r._n").alias("_n"))


def stepped(df: DataFrame, seed: int, key: str, salt: str, name: str, step: Callable[[Column, Column], Column], *by: str) -> DataFrame:
    """``df`` with ``name``: ``step`` of each row's rank and its group's rows, as ``ranked`` has them.

    ``step`` must not come back to a value that it has left as ranks grow. So a bucket whose first and last row have one value gives it to all its rows,
    which stay where they are; only rows of buckets with a step inside are shuffled and ranked.
    """
    from ..operators.models import saved

    marked = df.withColumn("_h", shuffled(seed, key, salt)).withColumn("_b", F.coalesce(F.substring("_h", 1, 3), F.lit("")))  # rows without a key come first
    counts = marked.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum("_c").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    based = counts.withColumns({"_base": F.coalesce(before, F.lit(0)), "_n": F.sum("_c").over(whole)})
    ends = based.withColumns({"_at": step(F.col("_base") + 1, F.col("_n")), "_last": step(F.col("_base") + F.col("_c"), F.col("_n"))})
    buckets = saved(ends.select(*by, "_b", "_base", "_n", "_at", F.col("_at").eqNullSafe(F.col("_last")).alias("_sure")))
    few = buckets.count() <= MOST_BUCKETS

    def placed(sure: bool) -> DataFrame:
        these = buckets.filter(F.col("_sure") == sure)
        both = marked.alias("l").join((F.broadcast(these) if few else these).alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "_b")])
        return both.select("l.*", "r._base", "r._n", "r._at")

    kept = [c for c in df.columns if c != name]
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))
    near = placed(False).withColumn("_r", inside + F.col("_base"))
    return placed(True).select(*kept, F.col("_at").alias(name)).unionByName(near.select(*kept, step(F.col("_r"), F.col("_n")).alias(name)))


def chunk(n: int | Column, r: Column | None = None, size: Column | None = None) -> Column:
    """0-based number of the chunk of rank ``_r`` among ``_n`` rows in n near-equal chunks; the first (rows mod n) are one longer."""
    n = F.lit(n) if isinstance(n, int) else n
    r, size = (F.col("_r") if r is None else r) - 1, F.col("_n") if size is None else size
    q, extra = F.floor(size / n), size % n
    long = extra * (q + 1)
    return F.when(r < long, F.floor(r / (q + 1))).otherwise(extra + F.floor((r - long) / F.greatest(q, F.lit(1)))).cast("int")


def cumulative(df: DataFrame, sums: dict[str, Column], order: list[Column], by: list[str] | None = None) -> DataFrame:
    """``df`` with running sums (the row included) over all rows in this order, or over those of each key of ``by``, without a task that sees them all.

    Rows are put into ranges of the order, which are written with their numbers, so that these can't change when a task runs again. Inside a
    range a window adds up; what stands before a range comes from the totals of ranges: for keys in several ranges, two rows a range at most.
    Rows that are equal in the order follow each other in any, but one, way.
    """
    from ..operators.models import saved

    by = by or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    marked = df.withColumns({f"_s{i}": v for i, v in enumerate(sums.values())})
    ranged = saved(marked.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id()))
    names = [f"_s{i}" for i in range(len(sums))]
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("_part", *by).agg(*[F.sum(c).alias(c) for c in names])
    if by:
        several = totals.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1")
        totals = totals.alias("t").join(several.alias("k"), [F.col(f"t.{c}").eqNullSafe(F.col(f"k.{c}")) for c in by]).select("t.*")
    along = (Window.partitionBy(*by) if by else Window).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *[F.sum(c).over(along).alias(f"_b{c}") for c in names])
    on = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    placed = ranged.withColumns({f"_i{c}": F.sum(c).over(inside) for c in names}).join(F.broadcast(bases), on, "left")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"_i{c}") + F.coalesce(F.col(f"_b{c}"), F.lit(0))).alias(k) for k, c in zip(sums, names)])


def numbered(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """``df`` with each row's place in the order, from 0."""
    return cumulative(df, {name: F.lit(1).cast("bigint")}, order).withColumn(name, F.col(name) - 1)
