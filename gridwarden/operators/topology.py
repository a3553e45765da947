"""Overlay graphs, static schedules and fault histories as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import numbered


def neighbours(kind: str, n: int, adjacency: dict[int, list[int]] | None = None) -> list[list[int]]:
    """Neighbour lists, in order: star (node 0 is the centre), ring, chain, or a given adjacency; unknown names give a ring."""
    if adjacency is not None:
        return [list(adjacency.get(i, [])) for i in range(n)]
    if kind == "star":
        return [list(range(1, n))] + [[0] for _ in range(1, n)]
    if kind == "chain":
        return [[j for j in (i - 1, i + 1) if 0 <= j < n] for i in range(n)]
    return [[(i - 1) % n, (i + 1) % n] if n > 1 else [] for i in range(n)]


def resolve(name: str | None, n: int, given: dict | None = None) -> tuple[str, dict[int, list[int]] | None]:
    """(kind, adjacency) of a run: a given adjacency wins over a name, no name means a ring; neighbours outside 0..n-1 and loops are an error."""
    if not given:
        kind = (name or "ring").lower()
        return (kind if kind in ("star", "ring", "chain") else "ring"), None
    adjacency = {int(i): [int(j) for j in row] for i, row in given.items()}
    bad = [(i, j) for i, row in adjacency.items() for j in row if not (0 <= i < n and 0 <= j < n) or i == j]
    if bad:
        raise ValueError(f"edges outside the graph of {n} nodes: {bad}")
    return name or "graph", adjacency


def edges(spark: SparkSession, kind: str, n: int, adjacency: dict[int, list[int]] | None = None) -> DataFrame:
    """(src, dst, pos)."""
    node = F.col("id").cast("int")
    if adjacency is not None:
        rows = [(i, j, p) for i, row in enumerate(neighbours(kind, n, adjacency)) for p, j in enumerate(row)]
        return spark.createDataFrame(rows, "src int, dst int, pos int")
    nodes = spark.range(n).select(node.alias("src"))
    if kind == "star":
        dst = F.when(F.col("src") == 0, F.sequence(F.lit(1), F.lit(n - 1))).otherwise(F.array(F.lit(0)))
    elif kind == "chain":
        dst = F.filter(F.array(F.col("src") - 1, F.col("src") + 1), lambda x: (x >= 0) & (x < n))
    else:
        dst = F.array(F.pmod(F.col("src") - 1, F.lit(n)), F.pmod(F.col("src") + 1, F.lit(n)))
    return nodes.select("src", F.posexplode(dst)).select("src", F.col("col").alias("dst"), F.col("pos"))


def participants(edge: DataFrame, nodes: DataFrame, pool: DataFrame, head: int) -> DataFrame:
    """The head and its up neighbours, in neighbour order, that have parameters."""
    up = nodes.filter("up").select("node")
    near = edge.filter(F.col("src") == head).select(F.col("dst").alias("node"), (F.col("pos") + 1).alias("ord")).join(up, "node", "left_semi")
    own = nodes.filter(F.col("node") == head).select("node", F.lit(0).alias("ord"))
    return own.unionByName(near).join(pool, "node")


def head(round_: F.Column | int, active: F.Column):
    """Elected head of a round: active[(round - 1) mod size]."""
    r = F.lit(round_) if isinstance(round_, int) else round_
    return F.get(active, (F.pmod(r - 1, F.size(active))).cast("int"))


def check_schedule(entries: list[dict]) -> list[tuple[int, int, int, str, list[int] | None]]:
    """(ord, from, to, mode, active_clients) of a static schedule; raises on a wrong mode or range."""
    out = []
    for i, e in enumerate(entries):
        lo, hi, mode = e["from"], e["to"], e["mode"]
        if mode not in ("federated", "gossip") or not (isinstance(lo, int) and isinstance(hi, int)) or lo > hi:
            raise ValueError(f"schedule entry {i} is wrong: {e}")
        out.append((i, lo, hi, mode, e.get("active_clients")))
    return out


def schedule_lookup(rounds: DataFrame, schedule: DataFrame, default: str) -> DataFrame:
    """The first entry (by ord) whose range holds the round, else the default mode and all clients."""
    s = F.broadcast(schedule)  # a run's configuration: tens of rows
    hit = rounds.join(s, (rounds["round"] >= s["from"]) & (rounds["round"] <= s["to"]), "left")
    first = hit.groupBy("round").agg(F.min_by(F.struct("mode", "active_clients"), "ord").alias("e"))
    return first.select("round", F.coalesce("e.mode", F.lit(default)).alias("mode"), F.col("e.active_clients").alias("active_clients"))


def alive_asof(rounds: DataFrame, nodes: DataFrame, faults: DataFrame) -> DataFrame:
    """(round, node, up): the last fault event up to the round decides; without one a node is up."""
    f = F.broadcast(faults)
    grid = rounds.select("round").crossJoin(F.broadcast(nodes.select("node")))
    hit = grid.alias("g").join(f.alias("f"), (F.col("f.node") == F.col("g.node")) & (F.col("f.round") <= F.col("g.round")), "left")
    return hit.groupBy(F.col("g.round").alias("round"), F.col("g.node").alias("node")).agg(F.coalesce(F.max_by("f.up", F.struct("f.round", "f.ord")), F.lit(True)).alias("up"))


def node_of_client(clients: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """client -> node: a learned pair, else a numeric id below n, else the rank among the rest modulo n."""
    joined = clients.join(known, "cid", "left").withColumn("_num", F.expr("try_cast(cid as int)"))
    direct = F.coalesce("node", F.when((F.col("_num") >= 0) & (F.col("_num") < n), F.col("_num")))
    placed = numbered(joined.withColumn("_direct", direct).select("cid", "_direct"), "_rank", [F.col("cid")])
    return placed.select("cid", F.coalesce("_direct", F.col("_rank") % n).cast("int").alias("node"))
