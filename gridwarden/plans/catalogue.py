"""Registered queries over the driver's tables, each with the same result as SQL.

``events`` stands for labelled flows (normal class ``view``), ``embeddings`` for a wide
feature matrix, ``documents`` for model payloads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import metrics as M
from ..functions import scalars as S
from ..operators import control, federation, hygiene, partition, selection, topology, voting
from ..session import ship, table

NORMAL, KEY, LABEL, SEED = "view", "event_id", "event_type", 42
#: Rule models: (node, the class it is for, predicate).
SPECIALISTS = [(0, "click", "value >= 120"), (1, "error", "hour(ts) < 6"), (2, "purchase", "user_id % 7 = 0"), (3, "signup", "value < 10")]
NODES = [n for n, _, _ in SPECIALISTS]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def votes(spark: SparkSession, d: str) -> DataFrame:
    return voting.score(events(spark, d), SPECIALISTS, [KEY, LABEL])




def attack():
    return F.col(LABEL) != NORMAL


_V = """v AS (SELECT event_id, event_type, event_type <> 'view' AS attack, value, user_id, ts,
  (value >= 120)::INT AS f0, (extract(hour FROM ts) < 6)::INT AS f1, (user_id % 7 = 0)::INT AS f2, (value < 10)::INT AS f3 FROM events),
w AS (SELECT *, f0 + f1 + f2 + f3 AS votes FROM v)"""
_COUNTS = """count(*) FILTER (WHERE {on} AND attack) AS tp, count(*) FILTER (WHERE {on} AND NOT attack) AS fp,
  count(*) FILTER (WHERE NOT ({on}) AND attack) AS fn, count(*) FILTER (WHERE NOT ({on}) AND NOT attack) AS tn"""
_RATES = """round(100 * coalesce((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy,
  round(100 * coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(100 * coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
  round(100 * coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(100 * coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0), 6) AS fpr,
  round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE) * sqrt((tp + fn)::DOUBLE) * sqrt((tn + fp)::DOUBLE) * sqrt((tn + fn)::DOUBLE), 0), 0) + 0.0, 6) AS mcc,
  round(1e6 * coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0), 6) AS fp_per_million"""


def rates(counts_sql: str) -> str:
    return f"SELECT *, {_RATES} FROM ({counts_sql})"


def md5(salt: str, key: str = "event_id", seed: int = SEED) -> str:
    return f"md5('{seed}|{salt}|' || {key}::VARCHAR), {key}"


# ---- decisions ------------------------------------------------------------------------------------------------


@query(f"WITH {_V} " + rates(f"SELECT k, {_COUNTS.format(on='votes >= k')} FROM w, (VALUES (1), (2), (3)) t(k) GROUP BY k"))
def vote_kofn_metrics(spark, d):
    return voting.fuse(votes(spark, d), attack(), [1, 2, 3])


_RULE = "CASE WHEN value >= 120 THEN 'click' WHEN extract(hour FROM ts) < 6 THEN 'error' WHEN user_id % 7 = 0 THEN 'purchase' WHEN value < 10 THEN 'signup' ELSE 'view' END"


def predicted(spark, d):
    rule = F.lit(NORMAL)
    for _, name, when in reversed(SPECIALISTS):
        rule = F.when(F.expr(when), name).otherwise(rule)
    return events(spark, d).withColumn("pred", rule)


@query(
    f"WITH p AS (SELECT event_type AS y, {_RULE} AS pred FROM events) "
    + rates("SELECT count(*) FILTER (WHERE y = pred AND pred <> 'view') AS tp, count(*) FILTER (WHERE y <> pred AND pred <> 'view') AS fp, count(*) FILTER (WHERE y <> pred AND pred = 'view') AS fn, count(*) FILTER (WHERE y = pred AND pred = 'view') AS tn FROM p")
)
def confusion_multiclass(spark, d):
    return predicted(spark, d).agg(*M.multiclass_counts(F.col(LABEL), F.col("pred"), NORMAL)).withColumns(M.derived())


CLASSES = ["click", "error", "purchase", "signup", "view"]


@query(f"WITH p AS (SELECT event_type AS expected, {_RULE} AS pred FROM events) SELECT expected, " + ", ".join(f"count(*) FILTER (WHERE pred = '{c}') AS {c}" for c in CLASSES) + " FROM p GROUP BY expected")
def confusion_matrix_pivot(spark, d):
    return M.confusion_matrix(predicted(spark, d), LABEL, "pred", CLASSES)


@query(f"WITH {_V} SELECT event_type AS class, count(*) AS n, round(100 * avg((votes >= 1)::INT), 6) AS recall FROM w WHERE attack GROUP BY event_type")
def per_class_recall(spark, d):
    return M.per_class_recall(votes(spark, d).filter(attack()), LABEL, F.col("votes") >= 1)


@query(f"WITH {_V} SELECT round(avg(recall), 6) AS macro_recall FROM (SELECT round(100 * avg((votes >= 1)::INT), 6) AS recall FROM w WHERE attack GROUP BY event_type)")
def macro_recall(spark, d):
    return per_class_recall(spark, d).agg(F.round(F.avg("recall"), 6).alias("macro_recall"))


@query(
    """WITH s AS (SELECT event_type <> 'view' AS attack, round(greatest(value / 500, (user_id % 7) / 7.0), 4) AS s FROM events),
g AS (SELECT s, count(*) FILTER (WHERE attack) AS p, count(*) AS n FROM s GROUP BY s),
c AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn, sum(p) OVER () AS all_p FROM g)
SELECT round(sum(p / all_p::DOUBLE * cp::DOUBLE / cn), 6) AS average_precision FROM c"""
)
def pr_auc_or(spark, d):
    scored = events(spark, d).withColumn("s", F.round(voting.or_score([F.col("value") / 500, (F.col("user_id") % 7) / 7.0]), 4))
    return M.average_precision(scored, "s", attack())


@query(f"WITH {_V} SELECT votes, count(*) AS n FROM w WHERE NOT attack AND votes > 0 GROUP BY votes")
def vote_histogram_fp(spark, d):
    return voting.vote_histogram(votes(spark, d), attack())


@query(f"WITH {_V} SELECT node, round(100 * avg(f), 6) AS fpr FROM (SELECT unnest([0, 1, 2, 3]) AS node, unnest([f0, f1, f2, f3]) AS f FROM w WHERE NOT attack) GROUP BY node")
def specialist_fpr(spark, d):
    return voting.own_rates(votes(spark, d), attack(), NODES)


@query(
    f"WITH {_V}, r AS (SELECT avg(f0) * 100 < 20 AS g0, avg(f1) * 100 < 20 AS g1, avg(f2) * 100 < 20 AS g2, avg(f3) * 100 < 20 AS g3 FROM w WHERE NOT attack), x AS (SELECT attack, (f0 = 1 AND g0) OR (f1 = 1 AND g1) OR (f2 = 1 AND g2) OR (f3 = 1 AND g3) AS hit FROM w, r) "
    + rates(f"SELECT {_COUNTS.format(on='hit')} FROM x")
)
def selective_or(spark, d):
    return voting.selective_or(votes(spark, d), attack(), NODES, 20.0)


@query(f"WITH {_V} " + rates(f"SELECT rule, {_COUNTS.format(on='votes >= need')} FROM w, (VALUES ('and', 4), ('majority', 3), ('or', 1)) t(rule, need) GROUP BY rule"))
def view_arbitration(spark, d):
    return voting.arbitration(votes(spark, d), attack(), len(NODES))


@query(
    f"""WITH {_V}, s AS (SELECT * FROM (SELECT event_id, unnest([0, 1, 2, 3]) AS node, unnest([f0, f1, f2, f3]) AS f FROM w WHERE NOT attack) WHERE f = 1)
SELECT a.node AS a, b.node AS b, count(*) FILTER (WHERE a.event_id = b.event_id) AS both_, round(coalesce(count(*) FILTER (WHERE a.event_id = b.event_id)::DOUBLE, 0) / greatest(any_value(na) + any_value(nb) - count(*) FILTER (WHERE a.event_id = b.event_id), 1), 6) AS jaccard
FROM (SELECT *, count(*) OVER (PARTITION BY node) AS na FROM s) a JOIN (SELECT *, count(*) OVER (PARTITION BY node) AS nb FROM s) b ON a.node < b.node GROUP BY a.node, b.node"""
)
def fp_overlap(spark, d):
    """Jaccard of the specialists' false-positive sets; from one aggregation over vote patterns, no row pairs."""
    pattern = votes(spark, d).filter(~attack()).groupBy("fired").agg(F.count("*").alias("n"))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in NODES for b in NODES if a < b])
    flat = pattern.select("n", "fired", F.explode(pairs).alias("p")).select("n", "p.a", "p.b", F.get("fired", F.col("p.a")).alias("x"), F.get("fired", F.col("p.b")).alias("y"))
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    out = flat.groupBy("a", "b").agg(some(F.col("x") & F.col("y")).alias("both_"), some(F.col("x") | F.col("y")).alias("any_"))
    return out.select("a", "b", "both_", F.round(F.col("both_") / F.greatest("any_", F.lit(1)), 6).alias("jaccard"))


@query(
    """WITH p AS (SELECT event_id, unnest([CASE WHEN value >= 120 THEN 'click' ELSE 'view' END, CASE WHEN extract(hour FROM ts) < 6 THEN 'error' ELSE 'view' END, CASE WHEN user_id % 7 = 0 THEN 'click' ELSE 'signup' END]) AS label FROM events),
c AS (SELECT event_id, label, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, label) AS i FROM c) SELECT event_id, label AS voted FROM r WHERE i = 1"""
)
def majority_vote(spark, d):
    each = F.array(
        F.when(F.col("value") >= 120, "click").otherwise("view"), F.when(F.hour("ts") < 6, "error").otherwise("view"), F.when(F.col("user_id") % 7 == 0, "click").otherwise("signup")
    )
    return voting.majority(events(spark, d).select(KEY, F.explode(each).alias("label")), KEY, "label")


@query(f"WITH {_V} SELECT count(*) AS n, count(*) FILTER (WHERE (votes >= 1) <> (votes >= 2)) AS differ, round(100 * avg(((votes >= 1) = (votes >= 2))::INT), 6) AS agree FROM w")
def agreement_two_models(spark, d):
    v = votes(spark, d)
    return voting.agreement(v.withColumn("x", F.col("votes") >= 1), v.withColumn("x", F.col("votes") >= 2), KEY, "x")


@query(f"WITH {_V} " + rates(f"SELECT k, {_COUNTS.format(on='(votes >= 1)::INT + (votes >= 2)::INT + f0 >= k')} FROM w, (VALUES (1), (2), (3)) t(k) GROUP BY k"))
def arch_vote(spark, d):
    """Three architectures (OR, two-of-n, a central model) vote on each row."""
    v = votes(spark, d)
    return voting.fuse(v.withColumn("votes", (F.col("votes") >= 1).cast("int") + (F.col("votes") >= 2).cast("int") + F.col("fired")[0].cast("int")), attack(), [1, 2, 3])


_TAU = "s AS (SELECT attack, least(value / 200, 1.0) AS s, split FROM (SELECT *, CASE WHEN row_number() OVER (ORDER BY {order}) <= ceil(0.2 * count(*) OVER ()) THEN 'val' ELSE 'train' END AS split FROM v))"


@query(f"WITH {_V}, {_TAU.format(order=md5('holdout'))} " + rates(f"SELECT round(tau, 2)::DOUBLE AS tau, {_COUNTS.format(on='s >= tau')} FROM s, (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS tau) GROUP BY tau"))
def tau_sweep(spark, d):
    scored = events(spark, d).select(attack().alias("attack"), F.least(F.col("value") / 200, F.lit(1.0)).alias("s"))
    # equal scores fall together first, so the sweep multiplies distinct scores, not rows
    tally = scored.groupBy("s", "attack").agg(F.count("*").alias("n"))
    swept = hygiene.sweep(tally, "s")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    on, bad = F.col("fired"), F.col("attack")
    return swept.groupBy("tau").agg(some(on & bad).alias("tp"), some(on & ~bad).alias("fp"), some(~on & bad).alias("fn"), some(~on & ~bad).alias("tn")).withColumns(M.derived())


@query(f"WITH {_V}, {_TAU.format(order=md5('holdout'))}, c AS (" + rates(f"SELECT tau, {_COUNTS.format(on='s >= tau')} FROM s, (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS tau) WHERE split = 'val' GROUP BY tau") + ") SELECT tau, f1 FROM c ORDER BY f1 DESC, tau LIMIT 1")
def best_tau_on_validation(spark, d):
    split = partition.holdout(events(spark, d).select(KEY, LABEL, "value"), SEED, KEY).filter("split = 'val'")
    swept = hygiene.sweep(split.select(attack().alias("attack"), F.least(F.col("value") / 200, F.lit(1.0)).alias("s")), "s")
    return voting.best_tau(swept.groupBy("tau").agg(*M.binary_counts(F.col("fired"), F.col("attack"))).withColumns(M.derived()))


@query(f"WITH {_V} " + rates(f"SELECT n_active, {_COUNTS.format(on='f0 + (n_active > 1)::INT * f1 + (n_active > 2)::INT * f2 + (n_active > 3)::INT * f3 >= 1')} FROM w, (VALUES (1), (2), (3), (4)) t(n_active) GROUP BY n_active"))
def node_drop_curve(spark, d):
    return voting.node_drop(votes(spark, d), attack(), len(NODES), 1)


@query(f"WITH {_V}, k AS (" + rates(f"SELECT k, {_COUNTS.format(on='votes >= k')} FROM w, (VALUES (1), (2)) t(k) GROUP BY k") + ") SELECT 1 AS pair, round(a.f1 - b.f1, 6) AS d_f1, round(a.fpr - b.fpr, 6) AS d_fpr FROM k a, k b WHERE a.k = 1 AND b.k = 2")
def metric_deltas(spark, d):
    f = voting.fuse(votes(spark, d), attack(), [1, 2]).withColumn("pair", F.lit(1))
    return M.metric_deltas(f.filter("k = 1"), f.filter("k = 2"), ["pair"], ["f1", "fpr"])


@query(
    f"WITH {_V}, t AS (SELECT *, ntile(5) OVER (PARTITION BY event_type ORDER BY {md5('fold')}) - 1 AS fold FROM w), c AS (SELECT fold, {_COUNTS.format(on='votes >= 1')} FROM t GROUP BY fold), a AS (SELECT avg(tp) AS tp, avg(fp) AS fp, avg(fn) AS fn, avg(tn) AS tn FROM c) "
    + rates("SELECT * FROM a")
)
def fold_average(spark, d):
    folded = partition.kfold(votes(spark, d), 5, SEED, KEY, LABEL)
    return M.fold_average(folded.groupBy("fold").agg(*M.binary_counts(F.col("votes") >= 1, attack())))


# ---- hygiene and splits -----------------------------------------------------------------------------------------


@query("SELECT event_type, (event_type <> 'view')::INT AS y, count(*) AS n FROM events GROUP BY ALL")
def binarize(spark, d):
    return hygiene.binarize(events(spark, d), LABEL, NORMAL).groupBy(LABEL, "y").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, (event_type = 'error')::INT AS y FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {md5('ovn')}) AS r FROM events WHERE event_type IN ('error', 'view')) WHERE event_type = 'error' OR r <= 500")
def one_vs_normal(spark, d):
    return hygiene.one_vs_normal(events(spark, d), LABEL, "error", NORMAL, 500, SEED, KEY).select(KEY, "y")


@query("WITH x AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 11 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 13 = 0 THEN 'inf'::DOUBLE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders) SELECT count(*) AS kept, round(sum(v), 2) AS total FROM x WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)")
def hygiene_finite(spark, d):
    k = F.col("o_orderkey")
    v = F.when(k % 11 == 0, float("nan")).when(k % 13 == 0, float("inf")).when(k % 17 == 0, None).otherwise(F.col("o_totalprice"))
    return hygiene.drop_invalid(table(spark, d, "orders").withColumn("v", v), ["v"]).agg(F.count("*").alias("kept"), F.round(F.sum("v"), 2).alias("total"))


@query("SELECT o_orderpriority AS cls, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS class_idx, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS c FROM orders WHERE o_orderkey % 5 < 4 OR o_orderpriority <> '5-LOW') WHERE c >= 10 GROUP BY o_orderpriority")
def rare_class_relabel(spark, d):
    some = table(spark, d, "orders").filter((F.col("o_orderkey") % 5 < 4) | (F.col("o_orderpriority") != "5-LOW"))
    return hygiene.relabel_rare(some, "o_orderpriority", 10).groupBy(F.col("o_orderpriority").alias("cls"), F.col("class_idx").cast("bigint").alias("class_idx")).agg(F.count("*").alias("n"))


@query("SELECT class, count(*) AS n FROM (SELECT CASE WHEN trim(event_type) = 'view' THEN 'normal' WHEN contains(event_type, 'sign') THEN 'account' WHEN contains(event_type, 'c') THEN 'commerce' ELSE 'other' END AS class FROM events) GROUP BY class")
def label_map(spark, d):
    return hygiene.map_labels(events(spark, d), LABEL, {"view": "normal"}, [("sign", "account"), ("c", "commerce"), ("", "other")]).groupBy("class").agg(F.count("*").alias("n"))


@query(f"SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT *, row_number() OVER (PARTITION BY event_type = 'view' ORDER BY {md5('cap')}) AS r FROM events) WHERE event_type <> 'view' OR r <= 700 GROUP BY event_type")
def benign_cap(spark, d):
    return hygiene.benign_cap(events(spark, d), LABEL, NORMAL, 700, SEED, KEY).groupBy(LABEL).agg(F.count("*").alias("n"), F.sum(KEY).alias("ids"))


@query("SELECT event_type AS class, count(*) AS n, count(*) < 2000 AS skipped FROM events WHERE event_type <> 'view' GROUP BY event_type")
def min_positives(spark, d):
    return hygiene.enough_positives(events(spark, d), LABEL, NORMAL, 2000)


def summed(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(KEY).alias("ids"))


_SUM = "count(*) AS n, sum(event_id)::BIGINT AS ids"


@query(f"SELECT client_id, {_SUM} FROM (SELECT *, (ntile(10) OVER (ORDER BY {md5('iid')}) - 1)::INT AS client_id FROM events) GROUP BY client_id")
def part_iid(spark, d):
    return summed(partition.iid(events(spark, d), 10, SEED, KEY), "client_id")


@query(
    f"""WITH s AS (SELECT *, (ntile(20) OVER (ORDER BY event_type, {md5('rows')}) - 1)::INT AS s FROM events), m AS (SELECT s, ((row_number() OVER (ORDER BY md5('{SEED}|shard|' || s::VARCHAR), s) - 1) // 2)::INT AS client_id FROM range(20) t(s))
SELECT client_id, {_SUM} FROM s JOIN m USING (s) GROUP BY client_id"""
)
def part_shard(spark, d):
    return summed(partition.shard(events(spark, d), 10, SEED, KEY, LABEL), "client_id")


def _unequal_sql(kind: str, weight: str) -> str:
    return f"""WITH t AS (SELECT count(*) AS n FROM events), z AS (SELECT i, round_even({weight} / (SELECT sum({weight}) FROM range(6) r(i)) * n, 0) AS z FROM range(6) r(i), t),
f AS (SELECT i, z + CASE WHEN i = 0 THEN n - (SELECT sum(z) FROM z) ELSE 0 END AS z FROM z, t), u AS (SELECT i, sum(z) OVER (ORDER BY i) AS hi, sum(z) OVER (ORDER BY i) - z AS lo FROM f),
r AS (SELECT *, row_number() OVER (ORDER BY {md5(kind)}) AS r FROM events) SELECT i::INT AS client_id, {_SUM} FROM r JOIN u ON r > lo AND r <= hi GROUP BY i"""


@query(_unequal_sql("exponential", "pow(2.0, i)"))
def part_exponential(spark, d):
    return summed(partition.unequal(events(spark, d), 6, SEED, KEY, "exponential"), "client_id")


@query(_unequal_sql("linear", "(6.0 - i)"))
def part_linear(spark, d):
    return summed(partition.unequal(events(spark, d), 6, SEED, KEY, "linear"), "client_id")


SHARES = partition.dirichlet_shares(CLASSES, 6, SEED)


@query(
    f"""WITH s(c, client, share) AS (VALUES {", ".join(f"('{c}', {i}, {x}::DOUBLE)" for c, i, x in SHARES)}), n AS (SELECT event_type AS c, count(*) AS n FROM events GROUP BY 1),
b AS (SELECT c, client, floor(share * n)::BIGINT AS cut FROM s JOIN n USING (c) WHERE client < 5), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {md5('dir')}) AS r FROM events),
p AS (SELECT event_id, (SELECT count(*) FROM b WHERE c = event_type AND cut < r)::INT AS client_id FROM r) SELECT client_id, {_SUM} FROM p GROUP BY client_id"""
)
def part_dirichlet(spark, d):
    return summed(partition.dirichlet(events(spark, d), 6, SEED, KEY, LABEL, SHARES), "client_id")


@query(
    f"""WITH c AS (SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, event_type) - 1 AS rk, count(*) OVER () AS k FROM c),
s AS (SELECT *, 1 + greatest(10 - k, 0) // k + (rk < greatest(10 - k, 0) % k)::INT AS sensors FROM k), f AS (SELECT *, coalesce(sum(sensors) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM s),
r AS (SELECT e.event_id, e.event_type, first, sensors, n, row_number() OVER (PARTITION BY e.event_type ORDER BY {md5('attack', 'e.event_id')}) - 1 AS r FROM events e JOIN f USING (event_type)),
a AS (SELECT event_id, event_type, first + CASE WHEN r < (n % sensors) * (n // sensors + 1) THEN r // (n // sensors + 1) ELSE n % sensors + (r - (n % sensors) * (n // sensors + 1)) // (n // sensors) END AS client_id FROM r
UNION ALL SELECT event_id, event_type, ntile(10) OVER (ORDER BY {md5('attack')}) - 1 FROM events WHERE event_type = 'view')
SELECT client_id::INT AS client_id, event_type, {_SUM} FROM a GROUP BY ALL"""
)
def part_attack(spark, d):
    return summed(partition.attack(events(spark, d), 10, SEED, KEY, LABEL, NORMAL), "client_id", LABEL)


@query(
    f"""WITH c AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS rk FROM events WHERE event_type <> 'view' GROUP BY 1),
a AS (SELECT event_id, event_type, rk % 3 AS client_id FROM events JOIN c USING (event_type) UNION ALL SELECT event_id, event_type, ntile(3) OVER (ORDER BY {md5('attack')}) - 1 FROM events WHERE event_type = 'view')
SELECT client_id::INT AS client_id, event_type, {_SUM} FROM a GROUP BY ALL"""
)
def part_attack_few(spark, d):
    return summed(partition.attack(events(spark, d), 3, SEED, KEY, LABEL, NORMAL), "client_id", LABEL)


@query(f"SELECT client_id, event_type, n, round(n / sum(n) OVER (PARTITION BY client_id)::DOUBLE, 6) AS share FROM (SELECT client_id, event_type, count(*) AS n FROM (SELECT *, (ntile(5) OVER (ORDER BY {md5('iid')}) - 1)::INT AS client_id FROM events) GROUP BY ALL)")
def partition_matrix(spark, d):
    return partition.matrix(partition.iid(events(spark, d), 5, SEED, KEY), LABEL)


@query(f"SELECT fold, event_type, {_SUM} FROM (SELECT *, (ntile(5) OVER (PARTITION BY event_type ORDER BY {md5('fold')}) - 1)::INT AS fold FROM events) GROUP BY ALL")
def stratified_kfold(spark, d):
    return summed(partition.kfold(events(spark, d), 5, SEED, KEY, LABEL), "fold", LABEL)


@query(f"SELECT split, event_type, {_SUM} FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY {md5('holdout')}) <= ceil(0.2 * count(*) OVER (PARTITION BY event_type)) THEN 'val' ELSE 'train' END AS split FROM events) GROUP BY ALL")
def stratified_holdout(spark, d):
    return summed(partition.holdout(events(spark, d), SEED, KEY, 0.2, LABEL), "split", LABEL)


@query(
    f"""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), x AS (SELECT *, least(1000, sum(n) OVER ()) * n / (sum(n) OVER ())::DOUBLE AS x, least(1000, sum(n) OVER ()) AS t FROM c), q AS (SELECT *, floor(x) AS q FROM x),
z AS (SELECT event_type, q + (row_number() OVER (ORDER BY round(x - q, 9) DESC, event_type) <= t - sum(q) OVER ())::INT AS q FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {md5('sample')}) AS r FROM events)
SELECT event_type, {_SUM} FROM r JOIN z USING (event_type) WHERE r <= q GROUP BY event_type"""
)
def stratified_sample(spark, d):
    return summed(partition.stratified_sample(events(spark, d), 1000, SEED, KEY, LABEL), LABEL)


# ---- models as tables ---------------------------------------------------------------------------------------------


def cells(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 4).alias("client"), F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))


_CELLS = "cells AS (SELECT vec_id, label, vec_id % 4 AS client, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(f"WITH {_CELLS} SELECT client, label, i::INT AS i, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM cells GROUP BY ALL")
def nb_suffstats(spark, d):
    s = federation.nb_statistics(cells(spark, d), "client", "label", "i", "x")
    return s.withColumns({"mean": F.round("mean", 6), "var": F.round("var", 6)})


@query(f"WITH {_CELLS} SELECT label, i::INT AS i, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM cells GROUP BY ALL")
def nb_federated_merge(spark, d):
    m = federation.nb_merge(federation.nb_statistics(cells(spark, d), "client", "label", "i", "x"), "label", "i")
    return m.withColumns({"n": F.col("n").cast("bigint"), "mean": F.round("mean", 6), "var": F.round("var", 6)})


@query(
    f"""WITH {_CELLS}, m AS (SELECT label, i, count(*) AS n, avg(x) AS mean, var_pop(x) + 1e-9 AS var FROM cells GROUP BY ALL), p AS (SELECT label, ln(max(n) / sum(max(n)) OVER ()::DOUBLE) AS prior FROM m GROUP BY label),
l AS (SELECT c.vec_id, m.label, sum(-0.5 * (ln(2 * pi() * var) + (x - mean) * (x - mean) / var)) AS ll FROM cells c JOIN m USING (i) GROUP BY ALL)
SELECT vec_id, label AS predicted FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY round(ll + prior, 6) DESC, label) AS r FROM l JOIN p USING (label)) WHERE r = 1"""
)
def nb_predict(spark, d):
    c = cells(spark, d)
    model = federation.nb_merge(federation.nb_statistics(c, "client", "label", "i", "x"), "label", "i")
    return federation.nb_predict(c.select("vec_id", "i", "x"), model, "vec_id", "label", "i", "x")


@query(f"WITH {_CELLS} SELECT i::INT AS pos, round(avg(x), 6) AS value FROM cells GROUP BY i")
def param_average_inplace(spark, d):
    return federation.average_parameters(table(spark, d, "embeddings"), "embedding").select("pos", F.round("value", 6).alias("value"))


@query(f"WITH {_CELLS} SELECT i::INT AS pos, round(sum((label + 1) * x) / sum(label + 1), 6) AS value FROM cells GROUP BY i")
def param_average_score(spark, d):
    return federation.average_parameters(table(spark, d, "embeddings").withColumn("w", F.col("label") + 1), "embedding", "w").select("pos", F.round("value", 6).alias("value"))


@query("SELECT doc_id AS ord, sha256 FROM (SELECT doc_id, sha256(text) AS sha256, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents WHERE length(text) > 0) WHERE r = 1")
def dedup_union(spark, d):
    return federation.dedup_union(table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text"), "text", "ord")


@query(
    """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q.vec_id AS query, e.vec_id AS nearest, e.label AS predicted, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 6) AS dist FROM embeddings e, q WHERE e.vec_id <> q.vec_id)
SELECT query, nearest, predicted FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, nearest) AS r FROM p) WHERE r = 1"""
)
def knn1(spark, d):
    e = table(spark, d, "embeddings")
    return federation.knn1(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", "label")


@query("WITH u AS (SELECT DISTINCT event_type, user_id FROM events WHERE value > 150), n AS (SELECT event_type, count(*) AS n FROM u GROUP BY 1) SELECT a.event_type AS a, b.event_type AS b, round((SELECT count(*) FROM u x JOIN u y USING (user_id) WHERE x.event_type = a.event_type AND y.event_type = b.event_type)::DOUBLE / greatest(a.n + b.n - (SELECT count(*) FROM u x JOIN u y USING (user_id) WHERE x.event_type = a.event_type AND y.event_type = b.event_type), 1), 6) AS jaccard FROM n a JOIN n b ON a.event_type < b.event_type")
def jaccard_pairs(spark, d):
    some = events(spark, d).filter("value > 150")
    return selection.pairwise_jaccard(some.groupBy(F.col(LABEL).alias("attack")).agg(F.collect_set("user_id").alias("features")))


# ---- statistics ---------------------------------------------------------------------------------------------------


_MONTHS = "m AS (SELECT o_orderpriority AS p, extract(month FROM o_orderdate) % 5 AS seed, avg(o_totalprice) AS v FROM orders GROUP BY ALL)"


def months(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p"), (F.month("o_orderdate") % 5).alias("seed")).agg(F.avg("o_totalprice").alias("v"))


@query(f"WITH {_MONTHS} SELECT p, count(v) AS n, round(avg(v), 4) AS mean, round(2.7764451051977934 * stddev_samp(v) / sqrt(count(v)), 4) AS ci95 FROM m GROUP BY p")
def mean_ci95(spark, d):
    return M.mean_ci95(months(spark, d), "v", "p", digits=4)


@query(
    f"""WITH {_MONTHS}, x AS (SELECT a.p || ' vs ' || b.p AS contrast, a.v - b.v AS d FROM m a JOIN m b ON a.seed = b.seed AND a.p < b.p), t AS (SELECT contrast, avg(d) AS effect, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t FROM x GROUP BY 1),
r AS (SELECT contrast, effect, (1 - abs(t) / sqrt(4 + t * t)) * (1 - abs(t) / sqrt(4 + t * t)) * (2 + abs(t) / sqrt(4 + t * t)) / 2 AS p FROM t), h AS (SELECT *, least(1.0, p * (count(*) OVER () - (row_number() OVER (ORDER BY p, contrast) - 1))) AS q FROM r),
o AS (SELECT contrast, round(effect, 4) AS effect, round(p, 6) AS p_raw, max(q) OVER (ORDER BY p, contrast) AS q FROM h)
SELECT contrast, effect, p_raw, round(q, 6) AS p_holm, CASE WHEN q < 0.001 THEN '***' WHEN q < 0.01 THEN '**' WHEN q < 0.05 THEN '*' ELSE 'ns' END AS significance FROM o"""
)
def paired_t_holm(spark, d):
    m = months(spark, d)
    a, b = m.alias("a"), m.alias("b")
    pairs = a.join(b, (F.col("a.seed") == F.col("b.seed")) & (F.col("a.p") < F.col("b.p"))).select(F.concat("a.p", F.lit(" vs "), "b.p").alias("contrast"), (F.col("a.v") - F.col("b.v")).alias("diff"))
    out = M.holm(M.paired_t(pairs, "diff", "contrast"))
    return out.select("contrast", F.round("effect", 4).alias("effect"), F.round("p_raw", 6).alias("p_raw"), F.round("p_holm", 6).alias("p_holm"), "significance")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return M.percentiles(events(spark, d), "value", LABEL)


@query(f"WITH {_V}, k AS (" + rates(f"SELECT k, {_COUNTS.format(on='votes >= k')} FROM w, (VALUES (1), (2)) t(k) GROUP BY k") + ") SELECT k, metric, value FROM (SELECT k, f1, recall, fpr FROM k) UNPIVOT (value FOR metric IN (f1, recall, fpr))")
def metrics_long(spark, d):
    f = voting.fuse(votes(spark, d), attack(), [1, 2])
    return f.unpivot(["k"], ["f1", "recall", "fpr"], "metric", "value")


# ---- parsimony ------------------------------------------------------------------------------------------------------


def parts_log(spark, d):
    """part as a search log: brand = attack, size = subset size, price = F1."""
    p = table(spark, d, "part")
    return p.select(F.col("p_brand").alias("attack"), F.col("p_partkey").alias("line_no"), F.round(F.col("p_retailprice") / 25, 3).alias("f1"), F.sequence(F.lit(1), F.col("p_size") % 12 + 1).alias("features"))


_LOG = """l AS (SELECT p_brand AS attack, p_partkey AS line_no, round(p_retailprice / 25, 3) AS f1, p_size % 12 + 1 AS k FROM part), g AS (SELECT attack, k, max(f1) AS f1, min(line_no) AS first_line FROM l GROUP BY ALL),
fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attack, k ORDER BY f1 DESC, first_line) AS r FROM g) WHERE r = 1)"""


@query(f"WITH {_LOG} SELECT attack, k, f1, first_line FROM fr")
def pareto_front(spark, d):
    return selection.pareto(parts_log(spark, d)).drop("features")


@query(f"WITH {_LOG} SELECT attack, lam, k, f1 FROM (SELECT *, row_number() OVER (PARTITION BY attack, lam ORDER BY round(f1 - lam * k, 9) DESC, k) AS b FROM fr, (SELECT unnest([0.0, 0.05, 0.2, 1.0])::DOUBLE AS lam)) WHERE b = 1")
def lambda_argmax(spark, d):
    return selection.lambda_argmax(selection.pareto(parts_log(spark, d)), [0.0, 0.05, 0.2, 1.0])


@query(f"WITH {_LOG}, b AS (SELECT *, max(f1) OVER (PARTITION BY attack) AS best FROM fr) SELECT attack, k, f1 FROM (SELECT *, row_number() OVER (PARTITION BY attack ORDER BY k, f1 DESC) AS i FROM b WHERE f1 >= best - 2.0) WHERE i = 1")
def eps_minimal(spark, d):
    return selection.eps_minimal(selection.pareto(parts_log(spark, d)), 2.0).drop("features")


@query(f"WITH {_LOG}, b AS (SELECT *, max(f1) OVER (PARTITION BY attack) AS best FROM fr), e AS (SELECT attack, k FROM (SELECT *, row_number() OVER (PARTITION BY attack ORDER BY k, f1 DESC) AS i FROM b WHERE f1 >= best - 2.0) WHERE i = 1) SELECT max(k)::INT AS n_union, min(k)::INT AS n_intersection FROM e")
def feature_superset(spark, d):
    s = selection.superset(selection.eps_minimal(selection.pareto(parts_log(spark, d)), 2.0))
    return s.select(F.size("union").alias("n_union"), F.size("intersection").alias("n_intersection"))


@query("SELECT p_brand AS attack, p_partkey AS feature, round(p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand), 6) AS share FROM part QUALIFY p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand) >= 0.0133")
def importance_share(spark, d):
    g = table(spark, d, "part").select(F.col("p_brand").alias("attack"), F.col("p_partkey").alias("feature"), F.col("p_retailprice").alias("gain"))
    return selection.important(g, 0.0133).select("attack", "feature", F.round("share", 6).alias("share"))


# ---- rounds, schedules, graphs -----------------------------------------------------------------------------------


def days(spark, d):
    """Events of each day as one round: share of errors and a mode that depends on it."""
    e = events(spark, d).groupBy(F.dayofmonth("ts").alias("round")).agg(F.count("*").alias("n"), F.round(F.avg((F.col(LABEL) == "error").cast("int")), 6).alias("share"))
    return e.withColumn("mode", F.when(F.col("share") > 0.2, "gossip").otherwise("federated"))


_DAYS = "dd AS (SELECT extract(day FROM ts)::INT AS round, count(*) AS n, round(avg((event_type = 'error')::INT), 6) AS share FROM events GROUP BY 1), days AS (SELECT *, CASE WHEN share > 0.2 THEN 'gossip' ELSE 'federated' END AS mode FROM dd)"


@query(f"WITH {_DAYS} SELECT min(round) FILTER (WHERE share >= 0.21) AS first_over, min(round) FILTER (WHERE share < (SELECT share FROM days ORDER BY round LIMIT 1)) AS first_below_start FROM days")
def first_threshold_round(spark, d):
    r = days(spark, d)
    start = r.agg(F.min_by("share", "round").alias("start"))
    return r.crossJoin(F.broadcast(start)).agg(F.min(F.when(F.col("share") >= 0.21, F.col("round"))).alias("first_over"), F.min(F.when(F.col("share") < F.col("start"), F.col("round"))).alias("first_below_start"))


@query(f"WITH {_DAYS} SELECT round, prev AS from_mode, mode AS to_mode FROM (SELECT *, lag(mode) OVER (ORDER BY round) AS prev FROM days) WHERE prev <> mode")
def mode_transitions(spark, d):
    w = Window.orderBy("round")  # one row for each round
    return days(spark, d).withColumn("from_mode", F.lag("mode").over(w)).filter(F.col("from_mode") != F.col("mode")).select("round", "from_mode", F.col("mode").alias("to_mode"))


@query(f"WITH {_DAYS} SELECT round, round - coalesce(max(CASE WHEN mode = 'gossip' THEN round END) OVER (ORDER BY round), 0) AS stable FROM days")
def dwell_islands(spark, d):
    w = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return days(spark, d).select("round", (F.col("round") - F.coalesce(F.max(F.when(F.col("mode") == "gossip", F.col("round"))).over(w), F.lit(0))).alias("stable"))


SCHEDULE = [{"from": 3, "to": 9, "mode": "gossip", "active_clients": [0, 1]}, {"from": 8, "to": 15, "mode": "federated"}, {"from": 20, "to": 22, "mode": "gossip"}]


@query(
    """SELECT r::INT AS round, CASE WHEN r BETWEEN 3 AND 9 THEN 'gossip' WHEN r BETWEEN 8 AND 15 THEN 'federated' WHEN r BETWEEN 20 AND 22 THEN 'gossip' ELSE 'federated' END AS mode,
CASE WHEN r BETWEEN 3 AND 9 THEN '0,1' ELSE 'all' END AS clients FROM range(1, 26) t(r)"""
)
def schedule_lookup(spark, d):
    s = spark.createDataFrame(topology.check_schedule(SCHEDULE), "ord int, `from` int, to int, mode string, active_clients array<int>")
    rounds = spark.range(1, 26).select(F.col("id").cast("int").alias("round"))
    out = topology.schedule_lookup(rounds, s, "federated")
    return out.select("round", "mode", F.coalesce(F.array_join("active_clients", ","), F.lit("all")).alias("clients"))


@query(
    """WITH f(ord, round, node, up) AS (VALUES (0, 5, 1, false), (1, 5, 2, false), (2, 9, 1, true), (3, 12, 2, true), (4, 12, 2, false)), g AS (SELECT r, n FROM range(1, 16) a(r), range(4) b(n))
SELECT r::INT AS round, n::INT AS node, coalesce((SELECT up FROM f WHERE f.node = n AND f.round <= r ORDER BY f.round DESC, ord DESC LIMIT 1), true) AS up FROM g"""
)
def fault_asof(spark, d):
    f = spark.createDataFrame([(0, 5, 1, False), (1, 5, 2, False), (2, 9, 1, True), (3, 12, 2, True), (4, 12, 2, False)], "ord int, round int, node int, up boolean")
    rounds = spark.range(1, 16).select(F.col("id").cast("int").alias("round"))
    nodes = spark.range(4).select(F.col("id").cast("int").alias("node"))
    return topology.alive_asof(rounds, nodes, f)


@query("SELECT i::INT AS src, ((i + CASE p WHEN 0 THEN 13 ELSE 1 END) % 14)::INT AS dst, p::INT AS pos FROM range(14) a(i), range(2) b(p)")
def topology_edges(spark, d):
    return topology.edges(spark, "ring", 14)


SIZES = [10, 14, 20, 30, 50, 70, 100]


def _per_size(spark, f):
    return spark.createDataFrame([(n, f(n)) for n in SIZES], "n int, rounds int")


@query("SELECT n, rounds FROM (VALUES (10, 13), (14, 19), (20, 28), (30, 43), (50, 73), (70, 103), (100, 148)) t(n, rounds)")
def vote_diffusion(spark, d):
    return _per_size(spark, control.rounds_to_quorum)


@query("SELECT n, rounds FROM (VALUES (10, 9), (14, 15), (20, 24), (30, 39), (50, 69), (70, 99), (100, 144)) t(n, rounds)")
def peer_failure(spark, d):
    return _per_size(spark, control.detection_latency)


@query(
    """WITH RECURSIVE s AS (SELECT 1 AS r, list_transform(range(14), lambda x: (1::BIGINT << x::INT)) AS v UNION ALL
SELECT r + 1, list_transform(range(14), lambda i: CASE WHEN i = (r - 1) % 14 THEN v[i + 1] | v[(i + 13) % 14 + 1] | v[(i + 1) % 14 + 1] ELSE v[i + 1] END) FROM s WHERE list_min(list_transform(v, lambda x: bit_count(x))) < 8)
SELECT (max(r) - 1)::INT AS rounds FROM s"""
)
def vote_diffusion_native(spark, d):
    """N = 14 as one fold over a sequence of rounds, with a bit set for each node."""
    start = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
    done = lambda v: ~F.exists(v, lambda x: F.bit_count(x) < 8)
    at = lambda v, i: F.get(v, F.pmod(i, F.lit(14)).cast("int"))

    def one(state, r):
        v = state["v"]
        nxt = F.transform(v, lambda x, i: F.when(i == F.pmod(r - 1, F.lit(14)), at(v, i).bitwiseOR(at(v, i - 1)).bitwiseOR(at(v, i + 1))).otherwise(x))
        return F.when(done(v), state).otherwise(F.struct(nxt.alias("v"), r.alias("n")))

    zero = F.struct(start.alias("v"), F.lit(0).alias("n"))
    return spark.range(1).select(F.aggregate(F.sequence(F.lit(1), F.lit(40)), zero, one, lambda s: s["n"]).alias("rounds"))


def scenario_rounds(spark, rounds: int = 40):
    """Two fault histories over 14 nodes and six dwell times, as observations."""
    rows = [("A_clean", 10, 3, False), ("A_clean", 24, 3, True), ("B_unstable", 10, 3, False), ("B_unstable", 20, 3, True), ("B_unstable", 22, 3, False)]
    ship(spark)
    faults = spark.createDataFrame([(s, i, r, n, u) for i, (s, r, n, u) in enumerate(rows)], "scenario string, ord int, round int, node int, up boolean")
    grid = spark.range(1, rounds + 1).select(F.col("id").cast("int").alias("round"))
    nodes = spark.range(14).select(F.col("id").cast("int").alias("node"))
    out = None
    for s in ("A_clean", "B_unstable"):
        up = topology.alive_asof(grid, nodes, faults.filter(F.col("scenario") == s)).filter("up")
        one = up.groupBy("round").agg(F.array_sort(F.collect_list("node")).alias("reported")).withColumn("scenario", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("dwell", F.explode(F.array(*[F.lit(x) for x in (1, 2, 3, 4, 5, 8)])))


@query(
    """SELECT * FROM (VALUES ('A_clean', 1, 24, 2, false), ('A_clean', 2, 25, 2, false), ('A_clean', 3, 26, 2, false), ('A_clean', 4, 27, 2, false), ('A_clean', 5, 28, 2, false), ('A_clean', 8, 31, 2, false),
('B_unstable', 1, 20, 3, true), ('B_unstable', 2, 21, 3, true), ('B_unstable', 3, NULL, 1, false), ('B_unstable', 4, NULL, 1, false), ('B_unstable', 5, NULL, 1, false), ('B_unstable', 8, NULL, 1, false)) t(scenario, dwell, recovery_round, n_switches, flap)"""
)
def dwell_sweep(spark, d):
    return control.dwell_sweep(scenario_rounds(spark), control.Settings(14, cooldown=2)).withColumn("n_switches", F.col("n_switches").cast("int"))


@query("SELECT n, digest_unsigned, digest_signed FROM (VALUES (10, 4, 100), (14, 4, 100), (20, 6, 102), (30, 8, 104), (50, 14, 110), (70, 18, 114), (100, 26, 122)) t(n, digest_unsigned, digest_signed)")
def control_digest_bytes(spark, d):
    n = spark.createDataFrame([(x,) for x in SIZES], "n int")
    return n.select("n", S.digest_bytes(F.col("n")).alias("digest_unsigned"), S.digest_bytes(F.col("n"), True).alias("digest_signed"))


@query(
    """WITH m AS (SELECT event_type AS k, user_id % 14 AS i FROM events WHERE value > 300 GROUP BY ALL), b AS (SELECT k, sum(CASE WHEN i < 8 THEN 1 << i::INT ELSE 0 END) AS lo, sum(CASE WHEN i >= 8 THEN 1 << (i - 8)::INT ELSE 0 END) AS hi FROM m GROUP BY k)
SELECT k, printf('%02X%02X', lo::INT, hi::INT) AS bitmap FROM b"""
)
def digest_hex(spark, d):
    m = events(spark, d).filter("value > 300").groupBy(F.col(LABEL).alias("k")).agg(F.collect_set((F.col("user_id") % 14).cast("int")).alias("m"))
    return m.select("k", S.bitmap_hex(F.col("m"), 14).alias("bitmap"))


# ---- logs and trails ------------------------------------------------------------------------------------------------


@query(f"WITH {_DAYS} SELECT round, mode, share AS f1 FROM days")
def log_parse_round(spark, d):
    from ..sources.logs import parse_rounds

    lines = days(spark, d).select(F.format_string("ROUND;%d;%s;f1=%.6f;recall=1.0;fpr=0.0", "round", "mode", "share").alias("value"))
    noise = spark.createDataFrame([("[x] starting",), ("ROUND;a;b",)], "value string")
    return parse_rounds(lines.unionByName(noise)).select("round", "mode", "f1")


@query("SELECT p_brand AS attack, count(*) AS n, round(max(p_retailprice), 2) AS best FROM part GROUP BY p_brand")
def log_section_fill(spark, d):
    from ..sources.logs import parse_selection

    p = table(spark, d, "part")
    order = Window.partitionBy("p_brand").orderBy("p_partkey")
    num = F.dense_rank().over(Window.orderBy("p_brand")) * 100000
    heads = p.select("p_brand").distinct().select((F.dense_rank().over(Window.orderBy("p_brand")) * 100000).alias("line_no"), F.concat(F.lit("[sel] ATAQUE "), F.regexp_replace("p_brand", "#", "_"), F.lit(" (5) | x")).alias("value"), "p_brand")
    evs = p.select((num + F.row_number().over(order)).alias("line_no"), F.concat(F.lit("EV;1;"), F.format_string("%.2f", "p_retailprice"), F.lit(";[1, 2]")).alias("value"), "p_brand")
    log = parse_selection(heads.unionByName(evs).select("line_no", "value").withColumn("file", F.lit("x")))
    names = p.select("p_brand", F.regexp_replace("p_brand", "#", "_").alias("attack")).distinct()
    return log.join(F.broadcast(names), "attack").groupBy(F.col("p_brand").alias("attack")).agg(F.count("*").alias("n"), F.max("f1").alias("best"))


@query("SELECT date_trunc('day', ts) AS start, event_type AS attack, count(*) AS n_flags, count(DISTINCT user_id) AS detectors FROM events WHERE event_type <> 'view' GROUP BY ALL")
def event_window_counts(spark, d):
    w = events(spark, d).filter(attack()).groupBy(F.window("ts", "1 day").alias("w"), F.col(LABEL).alias("attack"))
    return w.agg(F.count("*").alias("n_flags"), F.countDistinct("user_id").alias("detectors")).select(F.col("w.start").alias("start"), "attack", "n_flags", "detectors")


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def event_dedup(spark, d):
    from ..sources.trail import dedup

    e = events(spark, d).withColumnRenamed(KEY, "seq")
    return dedup(e.unionByName(e.filter("seq % 3 = 0"))).groupBy(LABEL).agg(F.count("*").alias("n"))


@query("SELECT event_id AS seq, event_type AS type FROM events WHERE event_id > 500 AND event_type = 'error' ORDER BY event_id LIMIT 50")
def events_since(spark, d):
    from ..sources.trail import since

    return since(events(spark, d).select(F.col(KEY).alias("seq"), F.col(LABEL).alias("type")), 500, "error", 50)


@query(
    """WITH t AS (SELECT event_id AS seq, user_id % 14 AS node, event_type FROM events WHERE event_type IN ('error', 'signup')), g AS (SELECT *, count(*) FILTER (WHERE event_type = 'signup') OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM t)
SELECT max(seq) FILTER (WHERE event_type = 'signup') AS seq, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'node_failure' ELSE 'scheduled' END AS reason, coalesce(array_to_string(list_sort(list(DISTINCT node) FILTER (WHERE event_type = 'error')), ','), '') AS failed FROM g GROUP BY coalesce(grp, 0) HAVING max(seq) FILTER (WHERE event_type = 'signup') IS NOT NULL"""
)
def switch_context(spark, d):
    from ..sources.trail import switches

    e = events(spark, d).filter("event_type IN ('error', 'signup')")
    t = e.select(F.col(KEY).alias("seq"), F.when(F.col(LABEL) == "signup", "architecture_change").otherwise("node_failure").alias("type"), F.array((F.col("user_id") % 14).cast("int")).alias("failed_nodes"))
    return switches(t).select("seq", "reason", F.array_join("failed_nodes", ",").alias("failed"))


@query("SELECT event_type AS type, arg_max(event_id, ts) AS last_id, max(ts) AS last_ts FROM events GROUP BY event_type")
def live_status(spark, d):
    return events(spark, d).groupBy(F.col(LABEL).alias("type")).agg(F.max_by(KEY, "ts").alias("last_id"), F.max("ts").alias("last_ts"))
