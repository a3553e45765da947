"""Queries whose result comes from trained models or stateful loops: compared by tests, not by SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import control, experiment, federation, models, partition, pools, random_trees, selection, topology, trees, voting
from ..session import table
from .catalogue import KEY, LABEL, NORMAL, SEED, attack, events, scenario_rounds

FEATURES = ["value", "hour", "weekday", "user_id"]


def features(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return e.select(KEY, LABEL, "value", F.hour("ts").cast("double").alias("hour"), F.dayofweek("ts").cast("double").alias("weekday"), F.col("user_id").cast("double").alias("user_id"))


def gbt_specialists(spark: SparkSession, d: str) -> DataFrame:
    """One boosted specialist for each sensor of the attack partition; fused decisions for k = 1..3 on a holdout."""
    split = models.saved(partition.holdout(features(spark, d), SEED, KEY, 0.2, LABEL))
    train = partition.attack(split.filter("split = 'train'"), 4, SEED, KEY, LABEL, NORMAL)
    test = split.filter("split = 'val'")
    data = trees.binned(train, FEATURES, attack().cast("int"), KEY, F.array("client_id"), bins=64)
    grown = trees.rows_of(spark, trees.grow(data, trees.Growth(rounds=5, depth=3, rate=0.1), balanced=True, final_loss=False))
    scored = pools.votes(test, grown, FEATURES, [KEY, LABEL], depth=3).withColumn("votes", F.size(F.filter("fired", lambda x: x)))
    return voting.fuse(scored, attack(), [1, 2, 3])


def softmax_boosting(spark: SparkSession, d: str) -> DataFrame:
    """(round, loss) of boosting over all five classes at once: one tree a class a round, from 80 % of the rows and of the features."""
    kinds = F.array(*[F.lit(c) for c in ("click", "error", "purchase", "signup", NORMAL)])
    data = trees.binned(features(spark, d), FEATURES, F.array_position(kinds, F.col(LABEL)) - 1, KEY, F.array(F.lit(0)))
    model = trees.grow(data, trees.Growth(rounds=10, depth=4, rows=0.8, features=0.8), classes=5)[0]
    return spark.createDataFrame([(k + 1, round(x, 6)) for k, x in enumerate(model.losses)], "round int, loss double")


def boosting_continued(spark: SparkSession, d: str) -> DataFrame:
    """Training loss after each boosting round: 3 rounds, then 3 more from the model received."""
    train = features(spark, d).withColumn("y", attack().cast("int"))
    first = models.boost(train, FEATURES, rounds=3, depth=2)
    more = models.boost(train, FEATURES, rounds=3, depth=2, start=first)
    return spark.createDataFrame([(i + 1, round(x, 6)) for i, x in enumerate(more.losses)], "round int, loss double")


def gossip_equals_federated(spark: SparkSession, d: str) -> DataFrame:
    """(node, models, equal): after enough gossip rounds every pool is the union of all models."""
    n = 6
    own = table(spark, d, "documents").select((F.col("doc_id") % n).cast("int").alias("node"), F.col("doc_id").alias("ord"), F.sha2("text", 256).alias("sha256"))
    union = own.groupBy("sha256").agg(F.min("ord").alias("ord"))
    edge = topology.edges(spark, "ring", n)
    pool = models.saved(own.groupBy("node", "sha256").agg(F.min("ord").alias("ord")).select("node", "ord", "sha256"))
    for r in range(1, 2 * n + 1):
        pool = federation.gossip_round(pool, None, edge, r, list(range(n)))
    total = union.count()
    return pool.groupBy("node").agg(F.count("*").alias("models")).withColumn("equal", F.col("models") == total)


def grasp_nb(spark: SparkSession, d: str) -> DataFrame:
    """Search over all of the embedding's positions with naive Bayes as the wrapper, until 15 iterations bring nothing."""
    width, rows = 64, table(spark, d, "embeddings")
    names = [f"f{i + 1}" for i in range(width)]
    e = rows.select("vec_id", F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("cls"), *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(names)])
    evaluate = selection.evaluator(e, names, "cls", "c0", 5, SEED, "vec_id")
    found = selection.grasp(evaluate, list(range(1, width + 1)), "vnd", iterations=1000, penalty=0.05, patience=15, most=100_000)
    return spark.createDataFrame([(found.features, round(found.f1, 6), len(evaluate.log))], "features array<int>, f1 double, evaluations int")


def classifier_cv(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validated counts and rates of all registered classifiers over 5 folds."""
    rows = partition.kfold(features(spark, d).withColumn("y", attack().cast("int")), 5, SEED, KEY, LABEL)
    return M.fold_average(models.cross_validate(rows, FEATURES, models.REGISTRY, 5), "classifier")


def decentralised_switches(spark: SparkSession, d: str) -> DataFrame:
    """Commits of the decentralised control plane over the fault scenarios."""
    s = control.Settings(14, cooldown=2, decentralised=True)
    return control.fold(scenario_rounds(spark, 60).filter("dwell = 3"), s)


def importance_by_class(spark: SparkSession, d: str) -> DataFrame:
    """Gain shares of one-vs-normal trees."""
    return models.importances(features(spark, d), FEATURES, LABEL, NORMAL, depth=4).select("attack", "feature", F.round("gain", 6).alias("gain"))


def stream_control(spark: SparkSession, d: str) -> DataFrame:
    """The same commits from a stream of reports."""
    from ..streaming.control import replay

    return replay(scenario_rounds(spark, 40).filter("dwell = 3"), control.Settings(14, dwell=3, cooldown=2))


def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Alarms per day and attack from a stream with a watermark."""
    from ..streaming.monitor import replay_windows

    return replay_windows(spark, f"{d}/events.parquet", NORMAL)


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Training and test rows with y, a rule of value and hour, since the table's labels follow from no column."""
    rule = (F.col("value") >= 60) & (F.col("hour") < 12) | (F.col("value") < 5)
    return experiment.split_given(features(spark, d).withColumn("y", rule.cast("int")), None, SEED, KEY, 0.2, LABEL)


def _nodes(spark: SparkSession, d: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Training rows with client and y, and test rows."""
    train, test = _split(spark, d)
    # written once: every fit, round and evaluation reads them again
    return models.saved(partition.iid(train, n, SEED, KEY)), models.saved(test)


def random_cut_trees(spark: SparkSession, d: str) -> DataFrame:
    """(y, n, right): test rows of each class of a rule, and how many of them five trees with random thresholds predict."""
    train, test = _nodes(spark, d, 2)
    made = random_trees.grow(train, FEATURES, "y", 2, trees=5, depth=8, features=2, least=5)
    scored = random_trees.predict(test, made, FEATURES)
    return scored.groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("y")).alias("right"))


def timed_rounds(spark: SparkSession, d: str) -> DataFrame:
    """(kind, day, n, nodes): each kind of event's rounds of a day, closed by timers on a stream that arrives out of order in several batches."""
    from ..streaming import rounds

    got = rounds.replay(events(spark, d), F.col(LABEL), F.col("user_id") % 8, 86_400_000_000)
    day = F.floor(F.col("round_us") / 86_400_000_000).cast("int")
    return got.select(F.col("key").alias("kind"), day.alias("day"), "n", F.array_join("nodes", ",").alias("nodes"), "late")


def trail_replayed(spark: SparkSession, d: str) -> DataFrame:
    """(type, n, numbers): the events as a trail, written as a stream whose batches are then delivered again, and read as a stream by its offsets."""
    from ..session import shared_root
    from ..sources import trail_stream

    trail_stream.register(spark)
    root = shared_root(spark)
    events(spark, d).select(F.col(LABEL).alias("type"), F.dayofmonth("ts").alias("round"), F.col(KEY).cast("string").alias("detail")).write.parquet(f"{root}/in")
    source = spark.readStream.schema("type string, round int, detail string").parquet(f"{root}/in")
    path = f"{root}/trail".removeprefix("file://") if root.startswith("file://") else f"{root}/trail"
    for again in ("w1", "w2"):  # the second run has lost its checkpoint
        source.writeStream.format("trail").option("path", path).option("order", "round").option("checkpointLocation", f"{root}/{again}").trigger(availableNow=True).start().awaitTermination()
    read = spark.readStream.format("trail").load(path)
    read.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/r").trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.schema(read.schema).parquet(f"{root}/out")
    total = seen.agg(F.count_distinct("seq").alias("numbers"), F.max("seq").alias("last"))
    return seen.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("detail").alias("events")).crossJoin(F.broadcast(total))


#: Nodes of the pools' queries, and how their trees are grown.
POOLED, SHALLOW = 4, trees.Growth(rounds=2, depth=3)


def _pooled(spark: SparkSession, d: str) -> tuple[trees.Binned, DataFrame]:
    """Training rows of POOLED nodes in bins, which writes them, and test rows with y."""
    train, test = _split(spark, d)
    return trees.binned(partition.iid(train, POOLED, SEED, KEY), FEATURES, F.col("y"), KEY, F.array("client_id"), bins=32), test


def _vote_patterns(test: DataFrame, made: DataFrame) -> DataFrame:
    return models.saved(pools.patterns(pools.votes(test, made, FEATURES, ["y"], depth=SHALLOW.depth), "y"))


def gossip_pool_decisions(spark: SparkSession, d: str) -> DataFrame:
    """(node, models, n, differ): models in each node's pool after enough gossip rounds, and test rows on which any of them firing differs from any of the federation's."""
    data, test = _pooled(spark, d)
    federated = pools.run(spark, data, POOLED, ["federated"], SHALLOW, adopt=False)
    gossip = pools.run(spark, data, POOLED, ["gossip"] * (2 * POOLED), SHALLOW, adopt=False)
    pattern, last = _vote_patterns(test, gossip.models), gossip.pools.filter(F.col("round") == 2 * POOLED)
    reference = pools.decisions(pattern, federated.pools.filter("node = 0"), gossip.models)
    same = pools.agreement(pools.decisions(pattern, last, gossip.models), reference, "node")
    return same.join(last.groupBy("node").agg(F.count("*").alias("models")), "node").select("node", "models", "n", "differ")


def recall_by_node_round(spark: SparkSession, d: str) -> DataFrame:
    """(round, mode, node, recall, fpr, models) after each round of federated, gossip without node 1, and federated training; nodes that hold one model go on from it."""
    data, test = _pooled(spark, d)
    modes = ["gossip", "gossip", "federated", "gossip", "gossip", "federated"]
    made = pools.run(spark, data, POOLED, modes, SHALLOW, active=lambda r: [0, 2, 3] if r in (4, 5) else [0, 1, 2, 3])
    found = pools.counted(pools.decisions(_vote_patterns(test, made.models), made.pools, made.models), F.col("y") == 1, "round", "mode", "node")
    held = made.pools.groupBy("round", "node").agg(F.count("*").alias("models"))
    return found.join(held, ["round", "node"]).select("round", "mode", "node", "recall", "fpr", "models")


def models_as_nodes_drop(spark: SparkSession, d: str) -> DataFrame:
    """(gone, models, tp, fp, fn, tn, recall, fpr): the federation's models aggregated again as its nodes drop out one by one."""
    data, test = _pooled(spark, d)
    grown = trees.grow(data, SHALLOW, balanced=True)
    made = trees.rows_of(spark, grown)
    pool = made.select(F.lit("federated").alias("mode"), F.lit(0).alias("head"), F.lit(0).alias("node"), F.col("model").cast("bigint").alias("ord"), "sha256")
    gone = spark.createDataFrame([(k, i) for k in range(POOLED) for i in [-1, *range(k)]], "step int, node int")
    left = pools.without(pool, gone, made.select("sha256", F.col("model").alias("node")))
    found = pools.counted(pools.decisions(_vote_patterns(test, made), left, made), F.col("y") == 1, "round")
    return found.join(left.groupBy("round").agg(F.count("*").alias("models")), "round").select(F.col("round").alias("gone"), "models", "tp", "fp", "fn", "tn", "recall", "fpr")


def head_and_validators(spark: SparkSession, d: str) -> DataFrame:
    """(round, node, role, n, accuracy): in each round the head trains and all other nodes score the model that they hold, each on its own test rows."""
    data, test = _pooled(spark, d)
    made = pools.roles(spark, data, POOLED, POOLED, SHALLOW)
    own = partition.iid(models.saved(test), POOLED, SEED, KEY)
    return pools.role_accuracy(pools.role_predictions(own, made, FEATURES, "client_id", KEY, "y", depth=SHALLOW.depth), "y")


def grasp_trees(spark: SparkSession, d: str) -> DataFrame:
    """Search with boosted trees as the wrapper, over 12 positions of the embedding; the ladder of the subset found and the loss of leaving each feature out follow in the same table."""
    names = [f"f{i + 1}" for i in range(12)]
    e = table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") % 3 == 0, "c0").otherwise("c1").alias("cls"), *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(names)])
    evaluate = selection.tree_evaluator(e, names, "cls", "c0", 3, SEED, "vec_id", trees.Growth(rounds=3, depth=3))
    found = selection.grasp(evaluate, list(range(1, 13)), "vnd", iterations=3, penalty=0.05, patience=2)
    rows = [("found", len(found.features), found.features, round(found.f1, 6))]
    rows += [("ladder", k, s, round(f, 6)) for k, s, f in selection.ladder(evaluate, found.features)]
    rows += [("without", out, [i for i in found.features if i != out], round(f, 6)) for out, f, _ in selection.ablation(evaluate, found.features) if out is not None]
    return spark.createDataFrame(rows, "step string, k int, features array<int>, f1 double")


def round_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counts on the test rows after each round: federated, two gossip rounds without node 1, federated again."""
    train, test = _nodes(spark, d, 3)
    on_round, rows = experiment.round_rows(spark, test, FEATURES)
    experiment.train_rounds(train, FEATURES, "client_id", 3, ["federated", "gossip", "gossip", "federated"], active=lambda r: [0, 2] if r in (2, 3) else [0, 1, 2], on_round=on_round)
    return rows()


def cyclic_boosting(spark: SparkSession, d: str) -> DataFrame:
    """Counts after each round of a model that goes round the clients."""
    train, test = _nodes(spark, d, 2)
    on_round, rows = experiment.round_rows(spark, test, FEATURES)
    experiment.cyclic(train, FEATURES, "client_id", 3, on_round=on_round)
    return rows()


def client_report(spark: SparkSession, d: str) -> DataFrame:
    """What each node's own model finds after two gossip rounds."""
    train, test = _nodes(spark, d, 3)
    _, held = experiment.train_rounds(train, FEATURES, "client_id", 3, ["gossip", "gossip"])
    return experiment.client_report(held, test, FEATURES)


def central_vs_distributed(spark: SparkSession, d: str) -> DataFrame:
    """One model on all rows against a federation with the same number of trees."""
    train, test = _nodes(spark, d, 2)
    return experiment.central_vs_distributed(train, test, FEATURES, "client_id", 2, 2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (gbt_specialists, softmax_boosting, random_cut_trees, timed_rounds, trail_replayed, gossip_pool_decisions, recall_by_node_round, models_as_nodes_drop, head_and_validators, grasp_trees, boosting_continued, gossip_equals_federated, grasp_nb, classifier_cv, decentralised_switches, importance_by_class, stream_control, stream_window_counts, round_metrics, cyclic_boosting, client_report, central_vs_distributed)
}
SQL: dict[str, str] = {
    "timed_rounds": """SELECT event_type AS kind, (epoch_us(date_trunc('day', ts)) // 86400000000)::INT AS day, count(*) AS n,
  array_to_string(list_sort(list(DISTINCT (user_id % 8)::INT)), ',') AS nodes, false AS late FROM events GROUP BY ALL""",
    "trail_replayed": """SELECT event_type AS type, count(*) AS n, count(DISTINCT event_id) AS events, (SELECT count(*) FROM events) AS numbers, (SELECT count(*) FROM events) AS last FROM events GROUP BY ALL""",
    "gossip_pool_decisions": f"SELECT n::INT AS node, {POOLED}::BIGINT AS models, (SELECT sum(ceil(0.2 * c))::BIGINT FROM (SELECT count(*) AS c FROM events GROUP BY event_type)) AS n, 0::BIGINT AS differ FROM range({POOLED}) t(n)",
    "stream_window_counts": "SELECT date_trunc('day', ts) AS start, event_type AS attack, count(*) AS n_flags FROM events WHERE event_type <> 'view' GROUP BY ALL",
    "gossip_equals_federated": "SELECT n::INT AS node, (SELECT count(DISTINCT sha256(text)) FROM documents) AS models, true AS equal FROM range(6) t(n)",
    "stream_control": """SELECT * FROM (VALUES ('A_clean', 3, 10, 'gossip', 'node_failure', [3]), ('A_clean', 3, 26, 'federated', 'recovery', CAST([] AS INT[])), ('B_unstable', 3, 10, 'gossip', 'node_failure', [3])) t(scenario, dwell, round, mode, reason, nodes)""",
}
