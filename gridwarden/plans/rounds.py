"""Queries about rounds, nodes and models on the wire; same conventions as ``catalogue``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.ordering import shuffle_order
from ..operators import federation, partition, topology
from ..session import table
from .catalogue import _DAYS, KEY, LABEL, SEED, attack, days, events, md5, query

#: Fixed values: (nodes, gossip messages, model traffic in MB of 10^6 bytes).
TRAFFIC = [(10, 887, 11.180484), (14, 1643, 21.322653), (20, 3197, 40.66538), (30, 6907, 88.724407), (50, 18527, 241.539349), (70, 35747, 463.176907), (100, 72077, 938.757587)]


@query(
    """SELECT n, round(unsigned::DOUBLE, 6) AS unsigned, round(signed::DOUBLE, 6) AS signed FROM (VALUES (10, 0.031733867693026524, 0.7933466923256631), (14, 0.030821680585431842, 0.770542014635796), (20, 0.04717034489779759, 0.801895863262559),
(30, 0.06227824098052298, 0.8096171327467987), (50, 0.10738540162249091, 0.8437424413195715), (70, 0.1389201383479164, 0.8798275428701371), (100, 0.1996257634506873, 0.9367055054224558)) t(n, unsigned, signed)"""
)
def control_overhead(spark, d):
    t = spark.createDataFrame(TRAFFIC, "n int, messages int, mb double")
    share = lambda signed: F.round(100 * F.col("messages") * S.digest_bytes(F.col("n"), signed) / (F.col("mb") * 1e6), 6)
    return t.select("n", share(False).alias("unsigned"), share(True).alias("signed"))


@query("SELECT r::INT AS round, ([0, 2, 5, 7])[((r - 1) % 4 + 1)::INT]::INT AS head FROM range(1, 13) t(r)")
def head_election(spark, d):
    active = F.array(*[F.lit(i) for i in (0, 2, 5, 7)])
    return spark.range(1, 13).select(F.col("id").cast("int").alias("round"), topology.head(F.col("id"), active).alias("head"))


@query("SELECT * FROM (VALUES (3, 0, 30), (2, 1, 20)) t(node, ord, model)")
def gossip_participants(spark, d):
    """Head 3 of a ring of six: itself and its up neighbours that have a model; node 4 is down."""
    nodes = spark.range(6).select(F.col("id").cast("int").alias("node"), (F.col("id") != 4).alias("up"))
    pool = spark.createDataFrame([(i, 10 * i) for i in (0, 2, 3, 4)], "node int, model int")
    return topology.participants(topology.edges(spark, "ring", 6), nodes, pool, 3)


@query("SELECT event_type, round(sum((user_id + 1) * value) / sum(user_id + 1), 6) AS loss FROM events GROUP BY event_type")
def weighted_loss(spark, d):
    e = events(spark, d).select(LABEL, F.col("value").alias("loss"), (F.col("user_id") + 1).alias("n"))
    return federation.weighted_loss(e, LABEL).withColumn("loss", F.round("loss", 6))


@query(
    "SELECT p_brand AS run, count(*) AS trees, round(arg_min(p_retailprice, p_partkey), 2) AS intercept, max(r)::INT AS last_id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS r FROM part) GROUP BY p_brand"
)
def merged_trees(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("run"), F.col("p_partkey").alias("ord"), F.col("p_retailprice").alias("intercept"), F.array(F.col("p_size")).alias("trees"))
    m = federation.concat_trees(p, "run")
    return m.select("run", F.size("trees").cast("bigint").alias("trees"), F.round("intercept", 2).alias("intercept"), F.array_max(F.transform("trees", lambda t: t["tree_id"])).alias("last_id"))


@query("WITH u AS (SELECT min(doc_id) AS ord, sha256(text) AS sha256 FROM documents WHERE length(text) > 0 GROUP BY 2) SELECT n::INT AS node, count(*) AS models FROM range(5) t(n), u GROUP BY n")
def seed_all_nodes(spark, d):
    models = federation.dedup_union(table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text"), "text", "ord")
    nodes = spark.range(5).select(F.col("id").cast("int").alias("node"))
    return federation.seed_all(nodes, models).groupBy("node").agg(F.count("*").alias("models"))


@query(
    """WITH k AS (SELECT 0 AS age, doc_id AS ord, sha256(text) AS sha256 FROM documents WHERE lang <> 'fr'), n AS (SELECT 1 AS age, doc_id AS ord, sha256(text) AS sha256 FROM documents WHERE lang <> 'en'),
f AS (SELECT sha256, min(age * 1000000000 + ord) AS f FROM (SELECT * FROM k UNION ALL SELECT * FROM n) GROUP BY 1) SELECT row_number() OVER (ORDER BY f, sha256) - 1 AS ord, sha256 FROM f"""
)
def retained_union(spark, d):
    """What is retained after a round; the numbering of a union of models is one task's work, as few as models are."""
    t = table(spark, d, "documents").select("lang", F.col("doc_id").alias("ord"), F.sha2("text", 256).alias("sha256"))
    return federation.retain(t.filter("lang <> 'fr'"), t.filter("lang <> 'en'"))


@query(f"WITH {_DAYS} SELECT mode, min(round) AS first_round, max(round) AS last_round, count(*) AS n FROM days GROUP BY mode")
def phase_bounds(spark, d):
    return days(spark, d).groupBy("mode").agg(F.min("round").alias("first_round"), F.max("round").alias("last_round"), F.count("*").alias("n"))


@query(f"WITH {_DAYS} SELECT round // 10 AS block, max(round) AS round, arg_max(share, round) AS share FROM days GROUP BY 1")
def block_representatives(spark, d):
    return days(spark, d).groupBy(F.floor(F.col("round") / 10).cast("int").alias("block")).agg(F.max("round").alias("round"), F.max_by("share", "round").alias("share"))


@query(f"WITH {_DAYS}, l(round, nodes) AS (VALUES (5, 10), (10, 9), (15, 7), (20, 5)) SELECT round, nodes, share FROM days JOIN l USING (round)")
def nodes_of_round(spark, d):
    return days(spark, d).join(F.broadcast(spark.createDataFrame([(5, 10), (10, 9), (15, 7), (20, 5)], "round int, nodes int")), "round").select("round", "nodes", "share")


@query("WITH lv(n, fl, gl) AS (VALUES (10, 95.7, 95.7), (7, 70.0, 95.6), (5, 50.0, 95.5)), lat(n, wait) AS (VALUES (10, 13), (7, 9), (5, 7)) SELECT n, r::INT AS round, CASE WHEN r < wait THEN fl ELSE gl END::DOUBLE AS f1 FROM lv JOIN lat USING (n), range(1, 16) t(r)")
def latency_timeline(spark, d):
    """Level of each size before and after its switch has taken effect."""
    levels = spark.createDataFrame([(10, 95.7, 95.7), (7, 70.0, 95.6), (5, 50.0, 95.5)], "n int, fl double, gl double")
    wait = spark.createDataFrame([(10, 13), (7, 9), (5, 7)], "n int, wait int")
    grid = levels.join(wait, "n").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(15))))
    return grid.select("n", "round", F.when(F.col("round") < F.col("wait"), F.col("fl")).otherwise(F.col("gl")).alias("f1"))


@query("SELECT event_id AS seq FROM events ORDER BY event_id DESC LIMIT 100")
def trail_tail(spark, d):
    from ..sources.trail import tail

    return tail(events(spark, d).select(F.col(KEY).alias("seq")), 100)


@query(f"SELECT client_id, event_type, count(*) AS n FROM (SELECT event_type, (ntile(3) OVER (ORDER BY {md5('iid')}) - 1)::INT AS client_id FROM events) GROUP BY ROLLUP (client_id, event_type)")
def partition_rollup(spark, d):
    return partition.iid(events(spark, d), 3, SEED, KEY).rollup("client_id", LABEL).agg(F.count("*").alias("n"))


@query(f"SELECT event_id FROM events ORDER BY {md5('prefix')} LIMIT 200")
def seeded_prefix(spark, d):
    """A random subset of fixed size: an ordered limit, so only its rows reach one task."""
    return events(spark, d).orderBy(*shuffle_order(SEED, KEY, "prefix")).limit(200).select(KEY)


@query(f"WITH {_DAYS} SELECT mode, round(avg(share), 6) AS mean_f1, min(share) AS min_f1 FROM days GROUP BY mode")
def run_summary(spark, d):
    return days(spark, d).groupBy("mode").agg(F.round(F.avg("share"), 6).alias("mean_f1"), F.min("share").alias("min_f1"))


@query("SELECT day AS round, attack, count(*)::INT AS n_flags, count(DISTINCT node)::INT AS k_votes FROM (SELECT extract(day FROM ts)::INT AS day, event_type AS attack, (user_id % 5)::INT AS node FROM events WHERE event_type <> 'view' AND value > 100) GROUP BY ALL HAVING count(DISTINCT node) >= 2")
def intrusion_alarms(spark, d):
    from ..sources.trail import intrusions

    flags = events(spark, d).filter(attack() & (F.col("value") > 100)).select(F.dayofmonth("ts").alias("round"), F.col(LABEL).alias("attack"), (F.col("user_id") % 5).cast("int").alias("node"))
    return intrusions(flags, 2).select("round", "attack", "n_flags", "k_votes")
