"""Connected components by alternating large-star and small-star steps.

Each step is a groupBy and a join on tables in the shared folder; nothing of the graph
comes to the driver but one row of counts a step.  Stars grow around few nodes, so a
star's centre is one key with many rows: centres with a large part of all edges are
broadcast to their edges, at most ``skew.SHARES`` of them.  Tables of past steps are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import SHARES
from .store import discard, materialise


def _neighbours(e: DataFrame) -> DataFrame:
    """(u, m, n, parents) of every node: its smallest neighbour or itself, how many neighbours it has and how many of them are smaller."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.col("u")).alias("parents"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that an edge names; component is the smallest node reachable.

    Edges with a null end and loops join nothing.  Every edge (u, v) with u > v is kept
    as "v is a parent of u".  Large-star hangs the larger neighbours of a node to its
    smallest neighbour, small-star the smaller ones and the node itself; the edges
    become stars around the smallest nodes after a logarithmic number of rounds, which
    each node's neighbours show; they are then the result.
    """
    e = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while True:
        low = materialise(_neighbours(e))
        # stars: a node hangs to one smaller node and nothing hangs to it, or it has no smaller one
        ends, open_ = low.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if((F.col("parents") > 1) | ((F.col("parents") > 0) & (F.col("n") > F.col("parents"))))).first()
        if not open_:
            discard(e)
            out = low.select(F.col("u").alias("node"), F.col("m").alias("component"))
            out.stored_at = low.stored_at
            return out
        # each edge counts at both ends, so at most SHARES nodes have more of them than this
        many = ends // SHARES
        centres = F.broadcast(low.filter(F.col("n") > many).select(F.col("u").alias("c"), "m"))
        upper = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        at_centres = upper.join(centres, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        elsewhere = upper.join(centres.select("c"), F.col("u") == F.col("c"), "left_anti").join(low.filter(F.col("n") <= many).select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = at_centres.unionByName(elsewhere).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        new = materialise(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(e, low)
        e = new
