"""Registered joins on time and on intervals over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins, topology
from ..session import table
from .catalogue import events, query


@query("""SELECT l.event_id, r.error_id FROM events l ASOF LEFT JOIN
  (SELECT user_id, ts, max(event_id) AS error_id FROM events WHERE event_type = 'error' GROUP BY ALL) r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_last_error(spark, d):
    """For every event the user's last error up to then."""
    e = events(spark, d)
    return joins.asof(e.select("event_id", "user_id", "ts"), e.filter("event_type = 'error'"), ["user_id"], "ts", "ts", F.col("event_id"), name="error_id").select("event_id", "error_id")


@query("""WITH day AS (SELECT event_id, date_trunc('day', ts) AS day, event_type FROM events), state AS (
  SELECT event_type AS node, day, count(*) % 2 = 0 AS up FROM day GROUP BY ALL)
SELECT d.event_type AS node, d.day, count(*) AS n, first(s.up) AS up FROM day d ASOF LEFT JOIN state s ON d.event_type = s.node AND d.day > s.day GROUP BY ALL""")
def asof_node_state(spark, d):
    """What was known of a kind of event on the day before: up where the last earlier day had an even number of them; one key has a fifth of all rows."""
    day = events(spark, d).select("event_id", F.date_trunc("day", "ts").alias("day"), F.col("event_type").alias("node"))
    state = day.groupBy("node", "day").agg((F.count("*") % 2 == 0).alias("up"))
    found = joins.asof(day, state, ["node"], "day", "day", F.col("up"), name="up", strict=True)
    return found.groupBy("node", "day").agg(F.count("*").alias("n"), F.first("up").alias("up"))


_OUTAGES = """o AS (SELECT event_id AS ord, user_id, epoch_us(ts) AS lo, epoch_us(ts) + (value * 60000000)::BIGINT AS hi FROM events WHERE event_type = 'error')"""


def _outages(spark, d):
    e = events(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    length = F.round(F.col("value") * 60_000_000).cast("bigint")
    return e, e.filter("event_type = 'error'").select(F.col("event_id").alias("ord"), "user_id", F.col("us").alias("lo"), (F.col("us") + length).alias("hi"))


@query(f"WITH {_OUTAGES} SELECT e.event_id, min(o.ord) AS ord FROM events e LEFT JOIN o ON o.user_id = e.user_id AND epoch_us(e.ts) BETWEEN o.lo AND o.hi GROUP BY e.event_id")
def outage_of_event(spark, d):
    """The first outage (an error and the minutes after it) of the same user that an event falls into."""
    e, out = _outages(spark, d)
    return joins.first_match(e.select("event_id", "user_id", "us"), out, "event_id", "us", "lo", "hi", "ord", ["ord"], ["user_id"]).select("event_id", "ord")


@query("""WITH r AS (SELECT p_partkey, p_brand, (p_partkey * 7919 % 500000) * 100 AS lo, (p_partkey * 7919 % 500000) * 100 + p_size * p_size * 1000 AS hi FROM part),
h AS (SELECT o_orderkey, min(p_partkey) AS p_partkey, count(*) AS n FROM orders JOIN r ON round(o_totalprice * 100)::BIGINT BETWEEN lo AND hi GROUP BY ALL)
SELECT p_brand AS mode, count(*) AS orders, sum(n)::BIGINT AS entries FROM h JOIN part USING (p_partkey) GROUP BY p_brand""")
def schedule_of_orders(spark, d):
    """Schedule look-up: each order's price meets the entries whose range holds it, the first entry decides; per its brand the orders, and all entries they met."""
    p = table(spark, d, "part").withColumn("lo", F.col("p_partkey") * 7919 % 500_000 * 100)
    ranges = p.select("p_partkey", "p_brand", "lo", (F.col("lo") + F.col("p_size") * F.col("p_size") * 1000).alias("hi"))
    points = table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    met = joins.held(points, ranges, "cents", "lo", "hi", F.struct("p_partkey", "p_brand"))
    first = points.join(met.hint("merge"), "cents").groupBy("o_orderkey").agg(F.min("first")["p_brand"].alias("mode"), F.sum("n").alias("n"))
    return first.groupBy("mode").agg(F.count("*").alias("orders"), F.sum("n").alias("entries"))


# ---- topology and control on the events: a round is a day, node = user_id % 14, a node is up on days on which it has an error ------------

NODES = 14
_UP = """up AS (SELECT extract(day FROM ts)::INT AS round, list_sort(list(DISTINCT (user_id % 14)::INT)) AS active FROM events WHERE event_type = 'error' AND value > 100 GROUP BY 1)"""


def _active(spark, d):
    """(round, active array<int>) of the days with any node up."""
    e = events(spark, d).filter("event_type = 'error' and value > 100")
    return e.groupBy(F.dayofmonth("ts").alias("round")).agg(F.array_sort(F.collect_set((F.col("user_id") % NODES).cast("int"))).alias("active"))


@query(f"WITH {_UP} SELECT round, len(active)::INT AS n_active, active[((round - 1) % len(active) + 1)::INT] AS head FROM up")
def head_by_day(spark, d):
    """Head of each round among the nodes that are up."""
    return _active(spark, d).select("round", F.size("active").alias("n_active"), topology.head(F.col("round"), F.col("active")).alias("head"))


@query(f"""WITH {_UP}, h AS (SELECT *, active[((round - 1) % len(active) + 1)::INT] AS head FROM up)
SELECT round, head, array_to_string(list_filter([head, (head + 13) % 14, (head + 1) % 14], lambda x: list_contains(active, x)), ',') AS participants FROM h""")
def participants_by_day(spark, d):
    """The head and its up neighbours on a ring, in the ring's order."""
    heads = _active(spark, d).withColumn("head", topology.head(F.col("round"), F.col("active")))
    ring = topology.edges(spark, "ring", NODES)
    near = ring.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("near"))
    both = heads.join(F.broadcast(near), F.col("head") == F.col("src"))
    # active nodes only; the head is one of them
    group = F.filter(F.concat(F.array("head"), "near"), lambda x: F.array_contains("active", x))
    return both.select("round", "head", F.array_join(group, ",").alias("participants"))


@query("""WITH s AS (SELECT s_suppkey::INT AS node, s_nationkey AS nation, (SELECT count(*) FROM supplier) AS n FROM supplier)
SELECT a.nation, count(*) AS edges, count(*) FILTER (WHERE a.nation = b.nation) AS inside FROM s a, (VALUES (-1), (1)) p(step) JOIN s b ON b.node = (a.node + p.step + a.n) % a.n GROUP BY a.nation""")
def ring_of_suppliers(spark, d):
    """A ring over all suppliers: edges that leave each nation's suppliers, and those that stay in the nation."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("node"), F.col("s_nationkey").alias("nation"))
    edges = topology.edges(spark, "ring", s.count())
    ends = edges.join(s.withColumnsRenamed({"node": "src", "nation": "a"}), "src").join(s.withColumnsRenamed({"node": "dst", "nation": "b"}), "dst")
    return ends.groupBy(F.col("a").alias("nation")).agg(F.count("*").alias("edges"), F.count_if(F.col("a") == F.col("b")).alias("inside"))


@query(f"""WITH {_UP}, g AS (SELECT round, n::INT AS node FROM up, range(14) t(n)), seen AS (SELECT round, unnest(active) AS node FROM up)
SELECT g.round, g.node, (g.round - coalesce(s.round, 0))::INT AS misses, g.round - coalesce(s.round, 0) > 2 AS suspected FROM g ASOF LEFT JOIN seen s ON g.node = s.node AND g.round >= s.round""")
def misses_by_day(spark, d):
    """Miss counter of each node: rounds since it was last up (since the start, if never), and whether they exceed the timeout of two."""
    active = _active(spark, d)
    grid = active.select("round", F.explode(F.sequence(F.lit(0), F.lit(NODES - 1))).alias("node"))
    seen = active.select(F.col("round").alias("at"), F.explode("active").alias("node"))
    last = joins.asof(grid, seen, ["node"], "round", "at", F.col("at"), name="last")
    misses = F.col("round") - F.coalesce("last", F.lit(0))
    return last.select("round", "node", misses.alias("misses"), (misses > 2).alias("suspected"))


@query(f"""WITH {_UP}, m AS (SELECT extract(day FROM ts)::INT AS round, count(*) AS messages, sum(value) AS mb FROM events GROUP BY 1)
SELECT round, len(active)::INT AS n, messages, (2 * ceil(len(active) / 8.0))::INT AS digest_bytes, round(100 * messages * (2 * ceil(len(active) / 8.0)) / (mb * 1048576), 9) AS unsigned,
  round(100 * messages * (2 * ceil(len(active) / 8.0) + 96) / (mb * 1048576), 9) AS signed FROM up JOIN m USING (round)""")
def overhead_by_day(spark, d):
    """What the control plane's digests add to a day's traffic, in percent: an event is a message, its value the MB that it carries."""
    traffic = events(spark, d).groupBy(F.dayofmonth("ts").alias("round")).agg(F.count("*").alias("messages"), F.sum("value").alias("mb"))
    n = F.size("active")
    share = lambda signed: F.round(S.control_overhead(n, F.col("messages"), F.col("mb"), signed), 9)
    both = _active(spark, d).join(traffic, "round")
    return both.select("round", n.alias("n"), "messages", S.digest_bytes(n).alias("digest_bytes"), share(False).alias("unsigned"), share(True).alias("signed"))


@query(f"""WITH {_UP}, f AS (SELECT min(round) AS down FROM up WHERE len(active) < 14), v AS (SELECT extract(day FROM ts)::INT AS round, avg(value) AS level FROM events GROUP BY 1)
SELECT v.round, CASE WHEN down IS NULL OR v.round < down + 3 THEN 'federated' ELSE 'gossip' END AS mode, round(level, 6) AS level FROM v, f""")
def timeline_by_day(spark, d):
    """The days' levels with the mode in force: gossip from three rounds after the first day on which a node is missing."""
    first = _active(spark, d).filter(F.size("active") < NODES).agg(F.min("round").alias("down"))
    level = events(spark, d).groupBy(F.dayofmonth("ts").alias("round")).agg(F.round(F.avg("value"), 6).alias("level"))
    late = F.col("round") >= F.col("down") + 3
    return level.crossJoin(F.broadcast(first)).select("round", F.when(late, "gossip").otherwise("federated").alias("mode"), "level")


def switches_by_kind(spark, d):
    """Commits of one control plane for each kind of event: in a round (a day) the nodes report that have an event of the kind with a value above 60."""
    from ..operators import control

    e = events(spark, d).filter("value > 60").groupBy(F.col("event_type").alias("scenario"), F.dayofmonth("ts").alias("round"))
    seen = e.agg(F.array_sort(F.collect_set((F.col("user_id") % NODES).cast("int"))).alias("reported")).withColumn("dwell", F.lit(3))
    return control.fold(seen.select("scenario", "dwell", "round", "reported"), control.Settings(NODES, dwell=3, cooldown=2))


query(None)(switches_by_kind)
