"""Feature selection: analytics over a log of evaluated subsets, and the search itself.

The search is a driver loop by nature, each step depending on the last; what is heavy,
the evaluation, is not: Gaussian moments per fold, class and feature are aggregated
once by Spark, and a job over all rows then counts the confusions of many candidate
subsets together; boosted trees of many subsets are grown in the same passes (``TreeEvaluator``).  Only counts and trees reach the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pareto(log: DataFrame) -> DataFrame:
    """Best subset of each size: log (attack, line_no, f1, features); of equal F1 the subset seen first."""
    seen = log.groupBy("attack", "features").agg(F.max("f1").alias("f1"), F.min("line_no").alias("first_line")).withColumn("k", F.size("features"))
    best = seen.groupBy("attack", "k").agg(F.min_by(F.struct("f1", "first_line", "features"), F.struct(-F.col("f1"), F.col("first_line"))).alias("b"))
    return best.select("attack", "k", "b.f1", "b.first_line", "b.features")


def lambda_argmax(front: DataFrame, lambdas: list[float]) -> DataFrame:
    """Per attack and penalty the size with the largest f1 - lambda k (of equals the smallest)."""
    grid = front.withColumn("lam", F.explode(F.array(*[F.lit(float(x)) for x in lambdas])))
    gain = F.round(F.col("f1") - F.col("lam") * F.col("k"), 9)
    return grid.groupBy("attack", "lam").agg(F.min_by(F.struct("k", "f1"), F.struct(-gain, F.col("k"))).alias("b")).select("attack", "lam", "b.k", "b.f1")


def eps_minimal(front: DataFrame, eps: float) -> DataFrame:
    """The smallest size within eps of the best F1; of equals the higher F1, then the smaller subset."""
    best = front.withColumn("_best", F.max("f1").over(Window.partitionBy("attack"))).filter(F.col("f1") >= F.col("_best") - eps)
    return best.groupBy("attack").agg(F.min(F.struct(F.col("k"), (-F.col("f1")).alias("neg"), F.col("features"))).alias("b")).select("attack", "b.k", (-F.col("b.neg")).alias("f1"), "b.features")


def superset(chosen: DataFrame) -> DataFrame:
    """Union and intersection of the attacks' subsets, sorted."""
    exploded = chosen.select(F.explode("features").alias("x"))
    n = chosen.count()
    counts = exploded.groupBy("x").agg(F.count("*").alias("c"))
    return counts.agg(F.array_sort(F.collect_list("x")).alias("union"), F.array_sort(F.collect_list(F.when(F.col("c") == n, F.col("x")))).alias("intersection"))


def pairwise_jaccard(sets: DataFrame, name: str = "attack", features: str = "features") -> DataFrame:
    """(a, b, jaccard) of a table of named small sets, each pair once."""
    a, b = sets.alias("a"), sets.alias("b")
    fa, fb = F.col(f"a.{features}"), F.col(f"b.{features}")
    return a.join(b, F.col(f"a.{name}") < F.col(f"b.{name}")).select(
        F.col(f"a.{name}").alias("a"), F.col(f"b.{name}").alias("b"), F.round(F.size(F.array_intersect(fa, fb)) / F.greatest(F.size(F.array_union(fa, fb)), F.lit(1)), 6).alias("jaccard")
    )


def important(gains: DataFrame, share: float = 0.03) -> DataFrame:
    """Features with at least this share of their attack's total gain: gains (attack, feature, gain)."""
    s = F.col("gain") / F.sum("gain").over(Window.partitionBy("attack"))
    return gains.withColumn("share", s).filter(F.col("share") >= share)


# ---- search -------------------------------------------------------------------------------------------------


#: Subsets that one job evaluates, as far as the search can name so many ahead.
AHEAD = 512


@dataclass
class Evaluator:
    """F1 (percent) of feature subsets by cross-validated Gaussian naive Bayes.

    ``rows`` (fold, truth, x) are the test rows; a row's log-likelihoods are made where it
    lies from ``mean`` and ``var``, the moments of the other folds (folds x classes x
    features), and ``prior`` (folds x classes).
    """

    rows: DataFrame
    mean: np.ndarray
    var: np.ndarray
    prior: np.ndarray
    log: list[tuple[int, float, list[int]]] = field(default_factory=list)
    seen: dict[tuple[int, ...], float] = field(default_factory=dict)

    def __call__(self, subsets: list[list[int]]) -> list[float]:
        self.ahead([subsets])
        out = []
        for s in subsets:
            key = tuple(sorted(s))
            out.append(self.seen[key])
            self.log.append((len(self.log) + 1, self.seen[key], list(key)))
        return out

    def ahead(self, offers: Iterable[list[list[int]]]) -> None:
        """One job for those of the first subsets that aren't known; later offers may not be wanted, so they aren't logged."""
        keys: dict[tuple[int, ...], None] = {}
        for offer in offers:
            new = [k for k in (tuple(sorted(s)) for s in offer) if k not in self.seen]
            if keys and len(keys) + len(new) > AHEAD:
                break
            keys |= dict.fromkeys(new)
        if keys:
            self.seen |= zip(keys, self._f1(list(keys)))

    def _f1(self, keys: list[tuple[int, ...]]) -> list[float]:
        mean, var, prior = self.mean, self.var, self.prior
        chosen = np.zeros((mean.shape[2], len(keys)))
        for k, key in enumerate(keys):
            chosen[[i - 1 for i in key], k] = 1

        def run(batches):
            counts = np.zeros((3, len(keys)), np.int64)
            for whole in batches:
                for lo in range(0, whole.num_rows, 500):
                    b = whole.slice(lo, 500)
                    fold, truth = b.column(0).to_numpy(), b.column(1).to_numpy()
                    x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, 1, -1)
                    terms = -0.5 * (np.log(2 * np.pi * var[fold]) + (x - mean[fold]) ** 2 / var[fold])
                    score = (terms.reshape(-1, len(chosen)) @ chosen).reshape(*terms.shape[:2], -1)
                    pred = (score + prior[fold][:, :, None]).argmax(1)
                    right, alarm = pred == truth[:, None], pred > 0
                    counts += [(right & alarm).sum(0), (~right & alarm).sum(0), (~right & ~alarm).sum(0)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(keys)), pa.int32()), *map(pa.array, counts)], ["k", "tp", "fp", "fn"])

        parts = self.rows.mapInArrow(run, "k int, tp bigint, fp bigint, fn bigint")
        found = {r["k"]: r for r in parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).collect()}
        return [200 * r["tp"] / max(2 * r["tp"] + r["fp"] + r["fn"], 1) if key and (r := found.get(k)) else 0.0 for k, key in enumerate(keys)]


@dataclass
class TreeEvaluator(Evaluator):
    """F1 (percent) of feature subsets by cross-validated boosted trees: all subsets of a batch, and all their folds, are grown level by level in the same passes.

    ``rows`` are bins (``trees.Binned``) whose memberships are the folds that a row trains; it tests the fold that it is held out for.
    """

    growth: object = None
    folds: int = 0

    def _f1(self, keys: list[tuple[int, ...]]) -> list[float]:
        from . import trees

        number = {(s, k): s * self.folds + k for s, key in enumerate(keys) if key for k in range(self.folds)}
        variants = {v: k for (_, k), v in number.items()}
        allowed = {v: [i - 1 for i in keys[s]] for (s, _), v in number.items()}
        grown = trees.grow(self.rows, self.growth, variants=variants, allowed=allowed, balanced=True, final_loss=False)
        seen = {r["model"]: r for r in trees.confusion(self.rows, grown, {v: k for v, k in variants.items() if v in grown}).collect()}
        out = []
        for s, key in enumerate(keys):
            cells = [seen[number[s, k]] for k in range(self.folds) if key and number[s, k] in seen]
            tp, fp, fn = (sum(c[x] for c in cells) for x in ("tp", "fp", "fn"))
            out.append(200 * tp / max(2 * tp + fp + fn, 1))
        return out


def tree_evaluator(df: DataFrame, features: list[str], label: str, normal: str, folds: int, seed: int, key: str, growth=None, bins: int = 32) -> TreeEvaluator:
    """The search's wrapper around boosted trees: all rows are binned once, in ``folds`` stratified folds; attacks are all classes but ``normal``."""
    from . import trees
    from .partition import kfold

    rows = kfold(df.select(key, label, *features), folds, seed, key, label)
    members = F.filter(F.array(*[F.lit(k) for k in range(folds)]), lambda k: k != F.col("fold"))
    data = trees.binned(rows, features, (F.col(label) != normal).cast("int"), key, members, bins, held=F.col("fold"))
    return TreeEvaluator(data, np.zeros(0), np.zeros(0), np.zeros(0), growth=growth or trees.Growth(rounds=3, depth=3), folds=folds)


def ladder(evaluate: Evaluator, order: list[int]) -> list[tuple[int, list[int], float]]:
    """(size, features, F1) of the first feature, the first two, and so on, in one batch: the ladder of a ranking."""
    steps = [order[: k + 1] for k in range(len(order))]
    return [(len(s), s, f) for s, f in zip(steps, evaluate(steps))]


def ablation(evaluate: Evaluator, features: list[int]) -> list[tuple[int | None, float, float]]:
    """(left out, F1, F1 less that of all features) of the whole set (None) and of the set without each of its features, in one batch."""
    tried = [features, *[[i for i in features if i != out] for out in features]]
    got = evaluate(tried)
    return [(out, f, f - got[0]) for out, f in zip([None, *features], got)]


def evaluator(df: DataFrame, features: list[str], label: str, normal: str, folds: int, seed: int, key: str, sample: int | None = None) -> Evaluator:
    """Moments by one aggregation over all rows; subsets are tested on all rows, or with ``sample`` on a stratified sample of so many."""
    from .models import saved
    from .partition import kfold, stratified_sample

    rows = kfold(df.select(key, label, *features), folds, seed, key, label)
    cells = rows.select("fold", F.col(label).alias("c"), F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("i", "x"))
    stats = cells.groupBy("fold", "c", "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).collect()  # folds x classes x features
    classes = [normal] + sorted({r["c"] for r in stats} - {normal})
    at = {c: k for k, c in enumerate(classes)}
    n, s, q = (np.zeros((folds, len(classes), len(features))) for _ in range(3))
    for r in stats:
        n[r["fold"], at[r["c"]], r["i"]], s[r["fold"], at[r["c"]], r["i"]], q[r["fold"], at[r["c"]], r["i"]] = r["n"], r["s"], r["q"]
    n, s, q = (np.maximum(a.sum(0)[None] - a, 1e-12) if a is n else a.sum(0)[None] - a for a in (n, s, q))
    mean = s / n
    var = np.maximum(q / n - mean * mean, 0) + 1e-9 * max(1.0, float((q / n - mean * mean).max()))
    test = rows if sample is None else stratified_sample(rows, sample, seed, key, label)
    truth = F.create_map(*[v for c, k in at.items() for v in (F.lit(c), F.lit(k))])[F.col(label)]
    test = saved(test.select(F.col("fold").cast("int").alias("fold"), truth.alias("truth"), F.array(*[F.col(f).cast("double") for f in features]).alias("x")))
    share = n[:, :, 0]
    return Evaluator(test, mean, var, np.log(share / share.sum(1, keepdims=True)))


@dataclass
class Found:
    features: list[int]
    f1: float

    def beats(self, other: Found, penalty: float) -> bool:
        """Better by f1 - penalty x size; of equals the smaller; anything beats an empty subset."""
        if not other.features:
            return bool(self.features)
        a, b = self.f1 - penalty * len(self.features), other.f1 - penalty * len(other.features)
        return a > b or a == b and len(self.features) < len(other.features)


def _best(evaluate: Evaluator, subsets: list[list[int]], penalty: float) -> Found | None:
    found = [Found(s, f) for s, f in zip(subsets, evaluate(subsets)) if s]
    top = None
    for x in found:
        if top is None or x.beats(top, penalty):
            top = x
    return top


#: Moves of one bit-flip search, and moves without gain after which it ends.
FLIPS, IDLE_FLIPS = 50, 20


def bit_flips(current: Found, pool: list[int], evaluate: Evaluator, penalty: float, rng) -> Found | None:
    """FLIPS moves that each swap a random feature for a random one outside, kept if better; ends early after IDLE_FLIPS moves without gain.

    Moves are drawn ahead: as long as none is kept they all start from the same subset, so one job evaluates them together;
    after one is kept the rest are drawn anew.
    """
    best, idle, done = current, 0, 0
    while done < FLIPS and idle < IDLE_FLIPS:
        outside = [i for i in pool if i not in best.features]
        if not outside or not best.features:
            break
        ahead = []
        for _ in range(min(FLIPS - done, IDLE_FLIPS - idle)):
            a, b = int(rng.integers(len(best.features))), int(rng.integers(len(outside)))
            ahead.append([*best.features[:a], *best.features[a + 1 :], outside[b]])
        evaluate.ahead([[t] for t in ahead])
        for t in ahead:
            done += 1
            got = Found(t, evaluate([t])[0])
            if got.beats(best, penalty):
                best, idle = got, 0
                break
            idle += 1
    return best if best is not current else None


def additions(current: Found, pool: list[int], evaluate: Evaluator, penalty: float, rng, replacing: bool = False) -> Found | None:
    """Incremental wrapper: features are offered in turn and kept if better; with ``replacing`` each may also take a place."""
    kept, order = Found([], 0.0), list(reversed(pool))

    def offer(i: int) -> list[list[int]]:
        tried = [[*kept.features, i]] if i not in kept.features else []
        if replacing:
            tried += [[*kept.features[:k], *kept.features[k + 1 :], i] for k in range(len(kept.features)) if i not in kept.features]
        return tried

    for at, i in enumerate(order):
        tried = offer(i)
        if any(tuple(sorted(t)) not in evaluate.seen for t in tried):  # what follows if this one isn't kept, in the same job
            evaluate.ahead(map(offer, order[at:]))
        top = _best(evaluate, tried, penalty) if tried else None
        if top and top.beats(kept, penalty):
            kept = top
    return kept if kept.features else None


NEIGHBOURHOODS: dict[str, Callable] = {
    "bit_flip": bit_flips,
    "add": additions,
    "add_or_replace": lambda *a: additions(*a, replacing=True),
}


def descend(start: Found, pool: list[int], evaluate: Evaluator, penalty: float, rng, names: list[str], random_order: bool = False) -> Found:
    """Variable neighbourhood descent; with ``random_order`` the next neighbourhood is drawn and spent ones are left out."""
    best, open_ = start, list(names)
    k = 0
    while open_ and k < len(open_):
        name = open_[int(rng.integers(len(open_)))] if random_order else open_[k]
        got = NEIGHBOURHOODS[name](best, pool, evaluate, penalty, rng)
        if got and got.beats(best, penalty):
            best, open_, k = got, list(names), 0
        elif random_order:
            open_.remove(name)
        else:
            k += 1
    return best


#: method -> (neighbourhoods, random order)
METHODS = {
    "bit_flip": (["bit_flip"], False),
    "iwss": (["add"], False),
    "iwssr": (["add_or_replace"], False),
    "vnd": (["add_or_replace", "add", "bit_flip"], False),
    "rvnd": (["add_or_replace", "add", "bit_flip"], True),
}


#: Start lists by name; each maps (gains by feature number, how many) to the restricted candidates of the search.
RCL: dict[str, Callable[[dict[int, float], int], list[int]]] = {
    "all": lambda gains, n: sorted(gains),
    "top": lambda gains, n: sorted(sorted(gains, key=lambda i: (-gains[i], i))[:n]),
    "positive": lambda gains, n: sorted(i for i, g in gains.items() if g > 0),
    "above_mean": lambda gains, n: sorted(i for i, g in gains.items() if g >= sum(gains.values()) / max(1, len(gains))),
}


def candidates(name: str, gains: dict[int, float], n: int = 20) -> list[int]:
    """The pool of a named start list; an unknown name is an error."""
    if name not in RCL:
        raise ValueError(f"unknown start list {name}; there are {', '.join(RCL)}")
    return RCL[name](gains, n)


def dispatch(name: str, gains: dict[int, float], evaluate: Evaluator, n: int = 20, seed: int = 42) -> tuple[str, list[int]]:
    """(search, start list) of a run's method, named list-G-search: list F is all features, GR the ``n`` with the largest gains, I what an
    incremental search with replacement keeps of all features; search VND or RVND.  Any other name is the bit-flip search on the ranked list.
    """
    start, _, search = name.upper().partition("-G-")
    if search not in ("VND", "RVND") or start not in ("F", "GR", "I"):
        return "bit_flip", candidates("top", gains, n)
    if start == "I":
        kept = additions(Found([], 0.0), sorted(gains, key=lambda i: (gains[i], -i)), evaluate, 0.0, np.random.default_rng(seed), replacing=True)
        return search.lower(), sorted(kept.features) if kept else sorted(gains)
    return search.lower(), candidates("all" if start == "F" else "top", gains, n)


def search_per_attack(df: DataFrame, features: list[str], label: str, normal: str, key: str, folds: int = 3, seed: int = 42, least: int = 1, **more) -> tuple[dict[str, Found], dict[str, int], list[int]]:
    """(found by attack, rows of attacks that were skipped for having fewer than ``least``, sorted union of the features).

    Each attack is searched against the normal class with an evaluator of its own.
    """
    sizes = {r[0]: r[1] for r in df.filter(F.col(label) != normal).groupBy(label).agg(F.count("*")).collect()}  # one row for each class
    pool = more.pop("pool", None) or list(range(1, len(features) + 1))  # the same for every attack
    found, skipped = {}, {a: n for a, n in sizes.items() if n < least}
    for a in sorted(set(sizes) - set(skipped)):
        evaluate = evaluator(df.filter(F.col(label).isin(a, normal)), features, label, normal, folds, seed, key)
        found[a] = grasp(evaluate, pool, seed=seed, **more)
    return found, skipped, sorted({i for f in found.values() for i in f.features})


def grasp(
    evaluate: Evaluator, pool: list[int], method: str = "vnd", iterations: int = 5, start: int = 5, penalty: float = 0.0, patience: int = 3, most: int = 5000, seed: int = 42,
    seconds: float | None = None, clock: Callable[[], float] = time.monotonic,
) -> Found:
    """Greedy randomised search: a random start of ``start`` features, then descent; stops on iterations, evaluations, ``seconds`` or no gain."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; there are {', '.join(METHODS)}")
    names, random_order = METHODS[method]
    began = clock()
    rng = np.random.default_rng(seed)
    best, idle = Found([], 0.0), 0
    for _ in range(iterations):
        if idle >= patience or len(evaluate.log) >= most or seconds is not None and clock() - began >= seconds:
            break
        first = [int(x) for x in rng.choice(pool, min(start, len(pool)), replace=False)]
        got = descend(Found(first, evaluate([first])[0]), pool, evaluate, penalty, rng, names, random_order)
        if got.beats(best, penalty):
            best, idle = got, 0
        else:
            idle += 1
    return Found(sorted(best.features), best.f1)
