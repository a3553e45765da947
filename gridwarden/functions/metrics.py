"""Detection metrics as column expressions and small aggregations.

Rates are in percent and 0 where their denominator is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import student
from .ordering import cumulative


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")


def binary_counts(fired: Column, attack: Column) -> list[Column]:
    """tp, fp, fn, tn."""
    return [
        count_if(fired & attack).alias("tp"),
        count_if(fired & ~attack).alias("fp"),
        count_if(~fired & attack).alias("fn"),
        count_if(~fired & ~attack).alias("tn"),
    ]


def multiclass_counts(expected: Column, predicted: Column, normal: str) -> list[Column]:
    """The counting rule of the domain: any wrong alarm is a false positive, also one of the wrong kind;
    a false negative is an attack predicted as normal."""
    right, calm = expected == predicted, predicted == normal
    return [
        count_if(right & ~calm).alias("tp"),
        count_if(~right & ~calm).alias("fp"),
        count_if(~right & calm).alias("fn"),
        count_if(right & calm).alias("tn"),
    ]


def derived(digits: int = 6) -> dict[str, Column]:
    """Rates from columns tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    out = {
        "accuracy": 100 * ratio(tp + tn, tp + fp + fn + tn),
        "precision": 100 * precision,
        "recall": 100 * recall,
        "f1": 100 * ratio(2 * precision * recall, precision + recall),
        "fpr": 100 * ratio(fp, fp + tn),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)),
        "fp_per_million": 1e6 * ratio(fp, fp + tn),
    }
    return {k: F.round(v + F.lit(0.0), digits) for k, v in out.items()}


def confusion_matrix(df: DataFrame, expected: str, predicted: str, classes: list[str]) -> DataFrame:
    """One row for each expected class, one column for each predicted one."""
    return df.groupBy(F.col(expected).alias("expected")).pivot(predicted, classes).agg(F.count(F.lit(1))).na.fill(0)


def per_class_recall(df: DataFrame, label: str, fired: Column, digits: int = 6) -> DataFrame:
    return df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"), F.round(100 * F.avg(fired.cast("int")), digits).alias("recall"))


def fold_average(df: DataFrame, *by: str) -> DataFrame:
    """Counts averaged over folds first, rates derived from the averages."""
    return df.groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("tp", "fp", "fn", "tn"))).withColumns(derived())


def average_precision(df: DataFrame, score: str, attack: Column, digits: int = 6) -> DataFrame:
    """Sum over distinct thresholds of (recall step) x precision.

    Scores are aggregated first, so the ordered pass sees one row for each distinct score.
    """
    steps = df.groupBy(F.col(score).alias("s")).agg(count_if(attack).alias("p"), F.count("*").alias("n"))
    all_p = steps.agg(F.sum("p").alias("all_p"))
    placed = cumulative(steps, {"tp": F.col("p"), "seen": F.col("n")}, [F.desc("s")]).crossJoin(F.broadcast(all_p))
    return placed.agg(F.round(F.sum(F.col("p") / F.col("all_p") * F.col("tp") / F.col("seen")), digits).alias("average_precision"))


def mean_ci95(df: DataFrame, value: str, *by: str, digits: int = 6) -> DataFrame:
    """Mean and half-width of its 95 % interval (Student's t with n - 1 degrees of freedom, for every n; 0 for one value)."""
    return (
        df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
        .withColumn("t", student.quantile_udf()(F.col("n") - 1))  # one row for each group
        .select(*by, "n", F.round("m", digits).alias("mean"), F.round(F.coalesce(F.col("t") * F.col("s") / F.sqrt("n"), F.lit(0.0)), digits).alias("ci95"))
    )


def paired_t(df: DataFrame, difference: str, *by: str) -> DataFrame:
    """One-sample test on paired differences, any number of them: effect, t, p_raw (null for fewer than two, or if all are equal)."""
    stats = df.groupBy(*by).agg(F.avg(difference).alias("effect"), F.stddev_samp(difference).alias("s"), F.count(difference).alias("n"))
    t = F.try_divide(F.col("effect"), F.col("s") / F.sqrt("n"))
    return stats.withColumn("t", t).select(*by, "effect", "t", student.two_sided_udf()(F.col("t"), F.col("n") - 1).alias("p_raw"))


def holm(df: DataFrame, p: str = "p_raw", name: str = "contrast") -> DataFrame:
    """Step-down correction over all rows of a small family of tests: running maximum of min(1, p (m - i))."""
    order = Window.orderBy(F.col(p), F.col(name))
    i, m = F.row_number().over(order) - 1, F.count("*").over(Window.partitionBy())
    scaled = df.withColumn("_q", F.least(F.lit(1.0), F.col(p) * (m - i)))
    out = scaled.withColumn("p_holm", F.max("_q").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_q")
    q = F.col("p_holm")
    return out.withColumn("significance", F.when(q < 0.001, "***").when(q < 0.01, "**").when(q < 0.05, "*").otherwise("ns"))


def percentiles(df: DataFrame, value: str, *by: str, digits: int = 6) -> DataFrame:
    """Mean, median and 95th percentile with linear interpolation; nulls count nowhere.

    Equal values are counted first, and the values on both sides of a percentile are found by running counts, so no task holds all values of a group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    running = cumulative(counts, {"_upto": F.col("_n")}, [F.col("_v")], list(by))
    whole = counts.groupBy(*by).agg(F.sum("_n").alias("_all"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("_mean"))
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by]
    both = running.alias("r").join(whole.alias("w"), keys).select(*[f"r.{c}" for c in by], "_v", "_upto", "_all", "_mean") if by else running.crossJoin(F.broadcast(whole))
    at = lambda q: (F.col("_all") - 1) * F.lit(q)
    first = lambda place, name: F.min(F.when(F.col("_upto") > place, F.col("_v"))).alias(name)
    shares = {"median": 0.5, "p95": 0.95}
    found = both.groupBy(*by).agg(F.first("_mean").alias("_mean"), F.first("_all").alias("_all"), *[f(at(q)) for k, q in shares.items() for f in (lambda x, k=k: first(F.floor(x), f"_lo_{k}"), lambda x, k=k: first(F.ceil(x), f"_hi_{k}"))])
    between = lambda k, q: F.round(F.col(f"_lo_{k}") + (at(q) - F.floor(at(q))) * (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")), digits).alias(k)
    return found.select(*by, F.round("_mean", digits).alias("mean"), *[between(k, q) for k, q in shares.items()])


def view_overlap(votes: DataFrame, views: list[int], fired: str = "fired") -> DataFrame:
    """(n_intersection, n_union, n_majority, jaccard) of the rows on which any number of views fire, from one aggregation."""
    on = F.size(F.filter(F.array(*[F.get(fired, F.lit(v)) for v in views]), lambda x: x))
    counted = votes.agg(count_if(on == len(views)).alias("n_intersection"), count_if(on > 0).alias("n_union"), count_if(on > len(views) // 2).alias("n_majority"))
    return counted.withColumn("jaccard", F.round(ratio(F.col("n_intersection"), F.col("n_union")), 6))


def check_variant(variant: str, allowed: tuple[str, ...]) -> str:
    """A variant's name; an unknown one is an error, not a silent default."""
    if variant not in allowed:
        raise ValueError(f"unknown variant {variant}; there are {', '.join(allowed)}")
    return variant


def metric_deltas(a: DataFrame, b: DataFrame, on: list[str], metrics: list[str]) -> DataFrame:
    """a - b of each metric, in percentage points."""
    right = b.select(*on, *(F.col(m).alias(f"_{m}") for m in metrics))
    return a.join(right, on).select(*on, *(F.round(F.col(m) - F.col(f"_{m}"), 6).alias(f"d_{m}") for m in metrics))


def jaccard_arrays(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
