"""Classifiers, specialists, continued boosting and cross-validation on Spark's ML library."""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import binary_counts, derived, fold_average

DEFAULTS = {"seed": 42}
#: The library's limit on a tree's depth.
DEEPEST = 30


def classifier(name: str, label: str = "y", **more):
    """A registered classifier by name; trees are capped at depth 30, the library's limit, boosted ones at their own depth."""
    common = {"labelCol": label, "featuresCol": "features"} | more
    made = {
        "random_tree": lambda: RandomForestClassifier(numTrees=1, featureSubsetStrategy="sqrt", bootstrap=False, maxDepth=DEEPEST, **DEFAULTS, **common),
        "j48": lambda: DecisionTreeClassifier(impurity="entropy", maxDepth=DEEPEST, **DEFAULTS, **common),
        "rep_tree": lambda: DecisionTreeClassifier(impurity="entropy", maxDepth=DEEPEST, minInstancesPerNode=2, **DEFAULTS, **common),
        "naive_bayes": lambda: NaiveBayes(modelType="gaussian", **common),
        "random_forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=DEEPEST, cacheNodeIds=True, maxMemoryInMB=1024, **DEFAULTS, **common),
        "boosted": lambda: GBTClassifier(maxIter=50, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", **DEFAULTS, **common),
        "boosted_multiclass": lambda: OneVsRest(classifier=GBTClassifier(maxIter=20, maxDepth=5, stepSize=0.1, **DEFAULTS), labelCol=label, featuresCol="features"),
    }
    if name not in made:
        raise ValueError(f"unknown classifier {name}; there are {', '.join(made)}")
    return made[name]()


#: The order in which results number the classifiers.
REGISTRY = ["random_tree", "j48", "rep_tree", "naive_bayes", "random_forest", "boosted"]


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df)


def probability(col: str = "probability") -> Column:
    """Probability of class 1."""
    return vector_to_array(F.col(col))[1]


def balanced(df: DataFrame, label: str = "y") -> DataFrame:
    """``weight``: negatives / positives for positive rows, 1 for others; from this table's own counts."""
    n = df.agg(F.sum((F.col(label) == 1).cast("int")).alias("p"), F.sum((F.col(label) == 0).cast("int")).alias("n")).first()
    return df.withColumn("weight", F.when(F.col(label) == 1, float(n["n"] or 1) / float(n["p"] or 1)).otherwise(1.0))


def fit_specialists(df: DataFrame, columns: list[str], client: str, rounds: int = 10, depth: int = 4, parallel: int = 4) -> dict[int, object]:
    """One boosted model for each client (None where a client has one class only), fitted side by side.

    Clients are tens, each fit is a distributed job of its own; threads only submit them.
    """
    data = assemble(df, columns).select(client, "y", "features").cache()
    try:
        clients = sorted(r[0] for r in data.select(client).distinct().collect())

        def fit(c):
            own = data.filter(F.col(client) == c)
            if own.select("y").distinct().count() < 2:
                return None
            return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.1, labelCol="y", weightCol="weight", **DEFAULTS).fit(balanced(own))

        with ThreadPoolExecutor(parallel) as pool:
            return dict(zip(clients, pool.map(fit, clients)))
    finally:
        data.unpersist()


def score_specialists(df: DataFrame, fitted: dict[int, object], columns: list[str], keep: list[str], threshold: float = 0.5) -> DataFrame:
    """``probs``, ``fired`` and ``votes`` of all specialists in one pass; a client without a model never fires."""
    out = assemble(df, columns)
    names = []
    for c, m in sorted(fitted.items()):
        name = f"_p{c}"
        if m is None:
            out = out.withColumn(name, F.lit(0.0))
        else:
            drop = [f"_raw{c}", f"_prob{c}", f"_pred{c}"]
            m.setRawPredictionCol(drop[0]).setProbabilityCol(drop[1]).setPredictionCol(drop[2])
            out = m.transform(out).withColumn(name, vector_to_array(drop[1])[1]).drop(*drop)
        names.append(name)
    fired = F.array(*[F.col(n) >= threshold for n in names])
    return out.select(*keep, F.array(*names).alias("probs"), fired.alias("fired")).withColumn("votes", F.size(F.filter("fired", lambda x: x)))


@dataclass
class Boosted:
    """An additive model: intercept and regression trees on the logistic gradient."""

    intercept: float
    rate: float
    trees: list = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    #: each tree's own rate, where models of several nodes were summed; else ``rate`` for all
    rates: list[float] | None = None

    def margin(self, df: DataFrame) -> DataFrame:
        """``df`` (with ``features``) and its margin."""
        out = df.withColumn("margin", F.lit(self.intercept))
        for t, rate in zip(self.trees, self.rates or [self.rate] * len(self.trees)):
            out = t.setPredictionCol("_t").transform(out).withColumn("margin", F.col("margin") + rate * F.col("_t")).drop("_t")
        return out


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage: checkpoint where the session has a folder for it, which a lost executor cannot take along."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(root or f"file://{tempfile.gettempdir()}/gridwarden-{uuid.uuid4().hex}")
    return df.checkpoint()


def boost(df: DataFrame, columns: list[str], rounds: int, depth: int = 4, rate: float = 0.3, start: Boosted | None = None) -> Boosted:
    """Gradient boosting of ``y``; with ``start`` it goes on from the model received (warm start)."""
    data = assemble(df, columns).select("y", "features")
    if start is None:
        share = data.agg(F.avg("y")).first()[0]
        share = min(max(share, 1e-6), 1 - 1e-6)
        import math

        start = Boosted(math.log(share / (1 - share)), rate)
    rates = None if start.rates is None else [*start.rates, *[start.rate] * rounds]
    model = Boosted(start.intercept, start.rate, list(start.trees), list(start.losses))
    model.rates = None if start.rates is None else list(start.rates)
    state = saved(model.margin(data)) if rounds else None
    for k in range(rounds):
        p = 1 / (1 + F.exp(-F.col("margin")))
        tree = DecisionTreeRegressor(maxDepth=depth, labelCol="_g", predictionCol="_t", **DEFAULTS).fit(state.withColumn("_g", 4 * (F.col("y") - p)))
        model.trees.append(tree)
        state = tree.transform(state).withColumn("margin", F.col("margin") + model.rate * F.col("_t")).drop("_t")
        if k < rounds - 1:  # the last one is read for its loss only
            state = saved(state)
        y = F.col("y").cast("double")
        loss = state.agg(F.avg(F.log1p(F.exp(F.col("margin"))) - y * F.col("margin"))).first()[0]
        model.losses.append(float(loss))
    model.rates = rates
    return model


COUNTS = "classifier string, fold int, tp bigint, fp bigint, fn bigint, tn bigint, fit_s double, ns_per_row double"


def cross_validate(df: DataFrame, columns: list[str], names: list[str], folds: int, parallel: int = 8) -> DataFrame:
    """(classifier, fold, tp, fp, fn, tn, fit_s, ns_per_row) of every classifier and fold; ``df`` has y and fold.

    Trees are grown and tested by tasks from cells of equal rows (``deep_trees``), where these are few enough; there times are those of all tasks together.
    Else, and for other classifiers, each fit and each test is a distributed job of its own; threads only submit them side by side.
    """
    from . import deep_trees

    grown = [name for name in names if name in deep_trees.NAMES]
    whole = df
    for c in columns:  # as ``assemble`` skips them
        whole = whole.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    found = deep_trees.validate(whole, columns, grown, folds) if grown else []
    if found is None:
        grown, found = [], []
    data = saved(assemble(df, columns).select("fold", "y", "features"))

    def one(task):
        name, k = task
        began = time.perf_counter()
        m = classifier(name).fit(data.filter(F.col("fold") != k))
        fitted = time.perf_counter()
        r = m.transform(data.filter(F.col("fold") == k)).agg(*binary_counts(F.col("prediction") == 1, F.col("y") == 1), F.count("*").alias("rows")).first()
        return name, k, r["tp"], r["fp"], r["fn"], r["tn"], fitted - began, 1e9 * (time.perf_counter() - fitted) / max(1, r["rows"])

    with ThreadPoolExecutor(parallel) as pool:
        rows = found + list(pool.map(one, [(name, k) for name in names if name not in grown for k in range(folds)]))
    rows.sort(key=lambda x: (names.index(x[0]), x[1]))
    return df.sparkSession.createDataFrame(rows, COUNTS)


def evaluate(model: PipelineModel, df: DataFrame, columns: list[str], label: str = "y") -> DataFrame:
    scored = model.transform(assemble(df, columns))
    return scored.agg(*binary_counts(F.col("prediction") == 1, F.col(label) == 1)).withColumns(derived())


def importances(df: DataFrame, columns: list[str], label: str, normal: str, depth: int = 4) -> DataFrame:
    """(attack, feature, gain): normalised gains of one tree for each attack class against the normal one."""
    data = assemble(df, columns)
    attacks = sorted(r[0] for r in data.filter(F.col(label) != normal).select(label).distinct().collect())
    rows = []
    for a in attacks:
        own = data.filter(F.col(label).isin(a, normal)).withColumn("y", (F.col(label) == a).cast("int"))
        m = DecisionTreeClassifier(impurity="entropy", maxDepth=depth, labelCol="y", **DEFAULTS).fit(own)
        rows += [(a, c, float(g)) for c, g in zip(columns, m.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "attack string, feature string, gain double")
