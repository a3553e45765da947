"""Joins on time and on intervals, without all-pairs work and without a task for a whole key.

As-of join.  Both sides are put into one order by (key, time), cut into ranges of about equal size and written; inside
a range the last value seen is carried forward by a window, and what a range's first key needs from the ranges before comes
from a table with at most two rows for each range.  So a key with a third of all rows is spread over many tasks.

Interval join.  A range of length n is an entry in the bins of the smallest power of two not below n that it touches, two at most;
a point looks in one bin for each power in use.  That is an equi-join, long ranges cost no more than short ones, and about every second candidate
is a match.

Where only the first range and the number of ranges are asked for (``held``, ``first_match``), pairs are never made: a range is cut into aligned nodes of
lengths 4^k, six of a length at most, each node keeps its first range and its count, and a point meets the one node of each length that it lies in. So the work
follows points and ranges, however many ranges hold a point.

Sides are estimated by the sizes of files, before rows are multiplied, so these joins are sorted ones: none is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import saved


def asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, value: Column, tie: Column | None = None, name: str = "asof", strict: bool = False) -> DataFrame:
    """``left`` with column ``name``: the ``value`` of the last row of ``right`` with the same key whose time isn't later (earlier, if ``strict``).

    Of rows of one key and time the one with the largest ``tie`` counts (else the largest value). Keys compare as SQL's ``IS NOT
    DISTINCT FROM``; left rows without a time, and those that nothing precedes, get null; right rows without a time are left out.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_k{i}" for i in range(len(by))]
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    named = lambda df, on, side, *more: df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(on).alias("_t"), F.lit(side).alias("_side"), *more)
    own = named(left, left_on, 0 if strict else 1, row.alias("_row"))
    other = named(right.filter(F.col(right_on).isNotNull()), right_on, 1 if strict else 0, (value if tie is None else tie).alias("_tie"), F.struct(value.alias("v")).alias("_r"))
    both = own.unionByName(other, allowMissingColumns=True)
    sort = [*keys, F.col("_t").asc_nulls_first(), "_side", F.col("_tie").asc_nulls_first()]
    # the number of a range is written with its rows, so that it can't change when a task runs again; equal rows may lie apart, a random number ends ties between ranges
    ranged = saved(both.withColumn("_any", F.rand(1)).repartitionByRange(parts, *sort, "_any").sortWithinPartitions(*sort).withColumn("_part", F.spark_partition_id()).drop("_any"))
    last = F.last("_r", ignorenulls=True)
    inside = last.over(Window.partitionBy("_part", *keys).orderBy(*sort[len(keys) :]).rowsBetween(Window.unboundedPreceding, 0))
    # what each range hands on: the last value of its last key; only ranges that begin with that key take it
    key = F.struct(*keys)
    per = ranged.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    ends = ranged.join(F.broadcast(per), "_part").filter(key.eqNullSafe(F.col("last")))
    given = ends.groupBy("_part").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", "_side", "_tie"))).alias("given"))
    table = per.join(given, "_part", "left")
    # of ranges only, so this window over all of them is small at any size of input
    along = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    handed = F.last(F.when(F.col("given").isNotNull(), F.struct(F.col("last").alias("key"), F.col("given").alias("r"))), ignorenulls=True).over(along)
    carried = table.select("_part", F.col("first"), handed.alias("c")).filter("c is not null and c.key <=> first").select("_part", F.col("first").alias("_first"), F.col("c.r").alias("_carried"))
    joined = ranged.withColumn("_inside", inside).filter("_row is not null").join(F.broadcast(carried), "_part", "left")
    found = F.coalesce("_inside", F.when(key.eqNullSafe(F.col("_first")), F.col("_carried")))
    return joined.select(*[F.col("_row").getField(c).alias(c) for c in left.columns], F.when(F.col("_t").isNotNull(), found.getField("v")).alias(name))


def _level(length: Column) -> Column:
    """The smallest power of two that isn't below the length."""
    return F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int")


def interval_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, by: list[str] | None = None) -> DataFrame:
    """All pairs of a point and a range (low and high included, whole numbers) that holds it, as structs (p, r); with ``by`` only of equal keys.

    Ranges that end before they begin, and those without an end, hold nothing.
    """
    by = by or []
    good = ranges.filter(F.col(low) <= F.col(high)).select(F.struct(*[F.col(f"`{c}`") for c in ranges.columns]).alias("r"))
    lo, hi = (F.col(f"r.{c}").cast("bigint") for c in (low, high))
    binned = good.withColumn("_level", _level(hi - lo + 1))
    at = lambda v: F.expr(f"shiftright({v}, _level)")
    entries = binned.withColumns({"_lo": lo, "_hi": hi}).withColumn("_bin", F.explode(F.array_distinct(F.array(at("_lo"), at("_hi")))))
    # powers in use: 64 at most
    levels = sorted(r[0] for r in binned.select("_level").distinct().collect())
    if not levels:
        levels = [0]
    looked = points.select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("p")).withColumn("_at", F.col(f"p.{point}").cast("bigint")).withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]))).withColumn("_bin", at("_at"))
    on = (F.col("a._level") == F.col("b._level")) & (F.col("a._bin") == F.col("b._bin"))
    for k in by:
        on = on & (F.col(f"a.p.{k}") == F.col(f"b.r.{k}"))
    hit = looked.alias("a").join(entries.alias("b").hint("merge"), on).filter((F.col("a._at") >= F.col("b._lo")) & (F.col("a._at") <= F.col("b._hi")))
    return hit.select("a.p", "b.r")


def _cut(longest: int) -> Column:
    """Aligned nodes (k, at), each [at * 4^k, (at + 1) * 4^k), that make up _lo to _hi exactly."""
    # at level k whole nodes run from l to r; those outside of whole parents, which run from c to f, are taken
    level = f"""transform(sequence(0, {longest}), k -> named_struct('k', k, 'l', -shiftright(-_lo, 2 * k), 'r', shiftright(_hi + 1L, 2 * k), 'c', 4 * -shiftright(-_lo, 2 * k + 2), 'f', 4 * shiftright(_hi + 1L, 2 * k + 2)))"""
    left = "transform(filter(sequence(0, 2), i -> x.l + i < least(x.c, x.r)), i -> named_struct('k', x.k, 'at', x.l + i))"
    right = "transform(filter(sequence(1, 3), i -> x.c <= x.f AND x.r - i >= x.f), i -> named_struct('k', x.k, 'at', x.r - i))"
    return F.expr(f"flatten(transform(filter({level}, x -> x.l < x.r), x -> concat({left}, {right})))")


def held(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, order: Column, by: list[str] | None = None) -> DataFrame:
    """(by..., point, first, n): for each distinct point that a range holds the smallest ``order`` of the ranges that hold it, and their number."""
    by = by or []
    good = ranges.filter(F.col(low) <= F.col(high)).select(*by, F.col(low).cast("bigint").alias("_lo"), F.col(high).cast("bigint").alias("_hi"), order.alias("_o"))
    once = good.groupBy(*by, "_lo", "_hi").agg(F.min("_o").alias("_o"), F.count(F.lit(1)).alias("_n"))
    longest = good.agg(F.max(F.floor(F.log2((F.col("_hi") - F.col("_lo") + 1).cast("double")) / 2))).first()[0] or 0
    nodes = once.withColumn("_x", F.explode(_cut(longest))).groupBy(*by, F.col("_x.k").alias("_k"), F.col("_x.at").alias("_at")).agg(F.min("_o").alias("_o"), F.sum("_n").alias("_n"))
    at = points.select(*by, F.col(point).alias("_t")).distinct().withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(longest)))).withColumn("_at", F.expr("shiftright(cast(_t AS bigint), 2 * _k)"))
    met = at.join(nodes.hint("merge"), [*by, "_k", "_at"])
    return met.groupBy(*by, F.col("_t").alias(point)).agg(F.min("_o").alias("first"), F.sum("_n").alias("n"))


def first_match(points: DataFrame, ranges: DataFrame, key: str, point: str, low: str, high: str, order: str, take: list[str], by: list[str] | None = None) -> DataFrame:
    """Every point (by its ``key``) with the ``take`` columns of the first range, by ``order``, that holds it; null where none does."""
    first = held(points, ranges, point, low, high, F.struct(F.col(order).isNull(), F.col(order), F.struct(*[F.col(c) for c in take]).alias("_take")), by)
    on = [*(by or []), point]
    found = first.select(*on, F.col("first._take").alias("_r"))
    return points.join(found.hint("merge"), on, "left").select(*[F.col(f"`{c}`") for c in points.columns], *[F.col(f"_r.{c}").alias(c) for c in take])
