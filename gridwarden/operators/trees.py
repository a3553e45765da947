"""Boosted trees for many models at once, from histograms.

One pass over the rows serves one level of the trees of *all* models that are being grown: clients of a federation, folds,
feature subsets, classes.  A task adds each row's gradient to a histogram over (model, class, tree node, feature, bin) and
hands over its non-empty cells when its rows end; Spark sums cells and picks each node's best split by windows over bins.
The driver gets one row for each node of the level.  So a level costs one job however many models there are, and
what is shuffled depends on models and bins, not on rows.

Features are cut once into bins by quantiles of all rows, and a row is one byte for each feature; rows with equal bins, class and models are
one row with their number (and how many of them each round's sample holds), so passes don't grow with copies. A missing or not-a-number
value lies in the first bin.  Trees hold thresholds (``x <= cut`` goes left), so models from different runs can be scored, continued and united.

A model is a row: (model, sha256 of its content, intercepts, trees as arrays of nodes); ``scored`` evaluates all
models of such a table for each row by folds over these arrays, without Python.

Gradients are rounded to multiples of a power of two so small that all sums are exact: neither the cut into tasks nor the order in which these end
can change a model. Ties between splits (gains are rounded to 9 digits for this) go to the smaller feature, then the smaller cut.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordering import cumulative
from .models import saved

NODE = "struct<f:int,cut:double,l:int,r:int,v:double,gain:double>"
TREE = f"struct<cls:int,rate:double,nodes:array<{NODE}>>"
MODEL = f"model int, sha256 string, intercepts array<double>, trees array<{TREE}>"
#: Cells of a task's histogram; more models than fit are grown in turn.
MOST_CELLS = 1 << 23
#: Nodes of a tree whose splits are all compared for each row; larger ones are followed.
MOST_CHOICES = 63
#: Binned rows of a task, at least.
ROWS_A_TASK = 50_000
#: Rounds after which the margins so far are written, so that rows aren't sent through all earlier trees again.
REFRESH = 8


@dataclass(frozen=True)
class Growth:
    """How trees are grown: ``least`` is the smallest hessian of a child, ``rows`` and ``features`` the shares that a tree may see."""

    rounds: int = 10
    depth: int = 4
    rate: float = 0.3
    ridge: float = 1.0
    least: float = 1e-3
    gain: float = 0.0
    rows: float = 1.0
    features: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes in the order they were made; feature -1 marks a leaf."""

    cls: int
    rate: float
    f: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    l: list[int] = field(default_factory=lambda: [-1])  # noqa: E741
    r: list[int] = field(default_factory=lambda: [-1])
    v: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: float, gain: float, left: float, right: float) -> tuple[int, int]:
        n = len(self.f)
        self.f[node], self.cut[node], self.l[node], self.r[node], self.gain[node] = feature, cut, n, n + 1, gain
        for v in (left, right):
            for column, x in zip((self.f, self.cut, self.l, self.r, self.v, self.gain), (-1, 0.0, -1, -1, v, 0.0)):
                column.append(x)
        return n, n + 1

    def row(self) -> tuple:
        return self.cls, self.rate, list(zip(self.f, self.cut, self.l, self.r, self.v, self.gain))


@dataclass
class Model:
    """An additive model with one margin for each class (two classes: one margin)."""

    intercepts: list[float]
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def digest(self) -> str:
        return hashlib.sha256(repr((self.intercepts, [t.row() for t in self.trees])).encode()).hexdigest()

    def importance(self, width: int) -> np.ndarray:
        """Share of each feature in the gain of all splits."""
        out = np.zeros(width)
        for t in self.trees:
            for f, g in zip(t.f, t.gain):
                if f >= 0:
                    out[f] += g
        return out / max(out.sum(), 1e-300)


def rows_of(spark: SparkSession, models: dict[int, Model]) -> DataFrame:
    """The models as a table."""
    return spark.createDataFrame([(int(k), m.digest(), m.intercepts, [t.row() for t in m.trees]) for k, m in sorted(models.items())], MODEL)


def models_of(table: DataFrame) -> dict[int, Model]:
    """Models of a table, for continuing them; the driver holds trees, never rows."""
    out = {}
    for r in table.collect():
        trees = [Tree(t["cls"], t["rate"], *(list(c) for c in zip(*[tuple(n) for n in t["nodes"]]))) for t in r["trees"]]
        out[r["model"]] = Model(list(r["intercepts"]), trees)
    return out


def union(*tables: DataFrame) -> DataFrame:
    """Each content once, with its smallest number: a pool of models."""
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    return both.groupBy("sha256").agg(F.min(F.struct("model", "intercepts", "trees")).alias("m")).select("m.model", "sha256", "m.intercepts", "m.trees")


# ---- scoring -------------------------------------------------------------------------------------------------


def _leaf(nodes: Column, x: Column, depth: int) -> Column:
    """Value of the leaf that a row reaches."""
    step = lambda at, _: F.when(nodes[at]["f"] < 0, at).when(F.coalesce(x[nodes[at]["f"]] > nodes[at]["cut"], F.lit(False)), nodes[at]["r"]).otherwise(nodes[at]["l"])
    return nodes[F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)]["v"]


def margins(trees: Column, intercepts: Column, x: Column, depth: int) -> Column:
    """A model's margins for features ``x``: a fold over its trees."""
    # a not-a-number compares as larger than all numbers, but lies in the first bin
    clean = F.transform(x, lambda v: F.when(~F.isnan(v), v))
    add = lambda s, t: F.transform(s, lambda m, c: F.when(c == t["cls"], m + t["rate"] * _leaf(t["nodes"], clean, depth)).otherwise(m))
    return F.aggregate(trees, intercepts, add)


def scored(df: DataFrame, models: DataFrame, columns: list[str], depth: int = 8) -> DataFrame:
    """``df`` with ``scores`` array<struct<model, sha256, margins>> of every model of the table, ordered by model and digest.

    All models travel as one broadcast row: a table of models is what a driver has grown. No tree may be deeper than ``depth``.
    """
    one = models.agg(F.array_sort(F.collect_list(F.struct("model", "sha256", "intercepts", "trees"))).alias("_models"))
    x = F.array(*[F.col(c).cast("double") for c in columns])
    both = df.withColumn("_x", x).crossJoin(F.broadcast(one))
    each = F.transform("_models", lambda m: F.struct(m["model"].alias("model"), m["sha256"].alias("sha256"), margins(m["trees"], m["intercepts"], F.col("_x"), depth).alias("margins")))
    return both.withColumn("scores", each).drop("_x", "_models")


class Follow:
    """A tree of a table over plain values, for tasks."""

    def __init__(self, rate: float, nodes: list, depth: int) -> None:
        self.rate, self.depth = rate, depth
        self.f, self.cut, self.l, self.r, self.v = (np.array([n[c] for n in nodes]) for c in ("f", "cut", "l", "r", "v"))

    def value(self, x: np.ndarray) -> np.ndarray:
        """Value of the leaf that each row reaches; ``x`` has a line for each feature, a missing value is not a number and goes left."""
        at, each = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
        for _ in range(self.depth):
            f = self.f[at]
            if (f < 0).all():
                break
            over = x[np.maximum(f, 0), each] > self.cut[at]
            at = np.where(f < 0, at, np.where(over, self.r[at], self.l[at]))
        return self.v[at]


# ---- growing -------------------------------------------------------------------------------------------------


_ROWS = "key bigint, y int, members array<int>, bins binary, held int"
_GROUPS = "y int, members array<int>, bins binary, held int, n array<bigint>, base array<double>"


@dataclass
class Binned:
    """Rows (key, y, members array<int>, bins binary, held int) and the features' inner edges."""

    rows: DataFrame
    edges: list[np.ndarray]
    columns: list[str]
    made: dict[tuple, DataFrame] = field(default_factory=dict)

    def groups(self, share: float = 1.0, salts: tuple[int, ...] = ()) -> DataFrame:
        """Equal rows once, written: (y, members, bins, held, n, base); n has their number, then for each salt how many of them are in its sample of this share."""
        asked = (share, salts)
        if asked not in self.made:

            def run(batches):
                for b in batches:
                    key = b.column(0).to_numpy(zero_copy_only=False)
                    flags = [pa.array((_uniform(key, s) < share).astype(np.int64)) for s in salts]
                    yield pa.RecordBatch.from_arrays([*b.columns[1:], *flags], ["y", "members", "bins", "held", *(f"s{i}" for i in range(len(salts)))])

            names = [f"s{i}" for i in range(len(salts))]
            rows = self.rows.mapInArrow(run, ", ".join(["y int, members array<int>, bins binary, held int", *(f"{c} bigint" for c in names)])) if salts else self.rows
            found = rows.groupBy("y", "members", "bins", "held").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in names])
            each = saved(found.select("y", "members", "bins", "held", F.array("_n", *names).alias("n"), F.array().cast("array<double>").alias("base")))
            # each level is a pass over these small rows, so a task is worth starting for many of them only
            self.made[asked] = each.coalesce(max(1, -(-each.count() // ROWS_A_TASK)))
        return self.made[asked]


def _quantiles(df: DataFrame, bins: int) -> tuple[list[list[float]], list[float]]:
    """The values at k / ``bins`` of each column's rows, and each column's largest.

    A sketch depends on the order of rows, so it gives only brackets around these values; what lies inside them is then counted value by value, so tasks
    can't change the result. Should a value lie between brackets, that gap is counted in a further pass.
    """
    error, columns = 1 / (100 * bins), df.columns
    ends = [min(max(k / bins + d * error, 0.0), 1.0) for d in (-1.5, 1.5) for k in range(1, bins)]
    got = df.agg(*[f(c) for c in columns for f in (lambda v: F.percentile_approx(v, F.lit(ends), F.lit(100 * bins)), F.count, F.max)]).first()
    low, high = ([sorted(got[3 * i][at]) if got[3 * i + 1] else [] for i in range(len(columns))] for at in (slice(bins - 1), slice(bins - 1, None)))
    asked = [(i, k, -(-k * got[3 * i + 1] // bins)) for i in range(len(columns)) if got[3 * i + 1] for k in range(1, bins)]
    values: list[dict[int, float]] = [{} for _ in columns]
    while asked:
        brackets = [(np.array(a, float), np.maximum.accumulate(np.array(b, float))) for a, b in zip(low, high)]

        def run(batches, brackets=brackets):
            for b in batches:
                for i, (lo, hi) in enumerate(brackets):
                    v = b.column(i).to_numpy(zero_copy_only=False).astype(float)
                    v = v[~np.isnan(v)]
                    if not len(v):
                        continue
                    at = np.searchsorted(lo, v, "right")
                    inside = (at > 0) & (v <= hi[at - 1])
                    # rows of a gap count at the bracket that ends it, before the rows inside
                    for flag, x in ((0, np.append(lo, np.inf)[at[~inside]]), (1, v[inside])):
                        x, n = np.unique(x, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i), pa.int32()), pa.array(x), pa.array(np.full(len(x), flag), pa.int32()), pa.array(n, pa.int64())], ["f", "v", "inside", "n"])

        counts = df.mapInArrow(run, "f int, v double, inside int, n bigint").groupBy("f", "v", "inside").agg(F.sum("n").alias("n"))
        upto = cumulative(counts, {"upto": F.col("n")}, [F.col("v"), F.col("inside")], ["f"]).alias("u")
        ranks = F.broadcast(df.sparkSession.createDataFrame(asked, "f int, k int, rank bigint")).alias("r")
        found = upto.join(ranks, F.expr("u.f = r.f AND r.rank <= u.upto AND r.rank > u.upto - u.n")).select("r.f", "r.k", "r.rank", "u.v", "u.inside").collect()
        asked = []
        for f, k, rank, v, inside in found:
            if inside:
                values[f][k] = v
            else:
                asked.append((f, k, rank))
                lo, hi = brackets[f]
                end = int(np.searchsorted(lo, v))
                low[f], high[f] = sorted([*low[f], hi[end - 1] if end else -np.inf]), sorted([*high[f], v])
    return [sorted(v.values()) for v in values], [got[3 * i + 2] for i in range(len(columns))]


def binned(df: DataFrame, columns: list[str], y: Column, key: str, members: Column, bins: int = 64, held: Column | None = None) -> Binned:
    """Cut features by quantiles of all rows; ``members`` are the numbers of the models that a row is trained in, ``held`` the one that it tests."""
    if not 2 <= bins <= 256:
        raise ValueError("a bin's number is one byte: 2 to 256 bins")
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    read = [value(c).alias(f"v{i}") for i, c in enumerate(columns)]
    held = (F.lit(None) if held is None else held).cast("int").alias("held")
    # what comes before may be dear, and is read twice from here
    source = saved(df.select(F.col(key).cast("bigint").alias("key"), y.cast("int").alias("y"), members.cast("array<int>").alias("members"), held, *read))
    values, most = _quantiles(source.select(*[f"v{i}" for i in range(len(columns))]), bins)
    edges = []
    for i in range(len(columns)):
        inner = np.unique(np.array(values[i], float))
        edges.append(inner[inner < most[i]] if len(inner) else inner)

    def run(batches):
        for b in batches:
            n = b.num_rows
            cells = np.zeros((n, len(columns)), np.uint8)
            for i, e in enumerate(edges):
                v = b.column(4 + i).to_numpy(zero_copy_only=False).astype(float)
                cells[:, i] = np.where(np.isnan(v), 0, np.searchsorted(e, v, "left"))
            raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * len(columns)).tobytes()), pa.py_buffer(cells.tobytes())])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], raw, b.column(3)], ["key", "y", "members", "bins", "held"])

    return Binned(source.mapInArrow(run, _ROWS), edges, columns)


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each row's key, by the splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt) * np.uint64(0xD1B54A32D192ED03)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53


class _Compact:
    """A tree over bins, for tasks."""

    def __init__(self, t: Tree, edges: list[np.ndarray]) -> None:
        self.cls, self.rate = t.cls, t.rate
        self.f, self.l, self.r, self.v = (np.array(x) for x in (t.f, t.l, t.r, t.v))
        # x <= cut means bin <= number of edges up to the cut
        self.k = np.array([np.searchsorted(edges[f], c, "right") - 1 if f >= 0 else 0 for f, c in zip(t.f, t.cut)])
        self.depth = 0
        level = [0]
        while level := [c for n in level if t.f[n] >= 0 for c in (t.l[n], t.r[n])]:
            self.depth += 1

    def node(self, b: np.ndarray) -> np.ndarray:
        """The node that each row reaches; ``b`` has a line of bins for each feature."""
        if len(self.f) <= MOST_CHOICES:
            return np.broadcast_to(self._choose(b, 0), b.shape[1:])
        at = np.zeros(b.shape[1], np.int64)
        each = np.arange(b.shape[1])
        for _ in range(self.depth):
            f = self.f[at]
            left = b[np.maximum(f, 0), each] <= self.k[at]
            at = np.where(f < 0, at, np.where(left, self.l[at], self.r[at]))
        return at

    def _choose(self, b: np.ndarray, n: int) -> np.ndarray:
        """All splits of a small tree are compared at once, which is cheaper than to follow each row."""
        if self.f[n] < 0:
            return np.array(n, np.uint8)
        return np.where(b[self.f[n]] <= self.k[n], self._choose(b, self.l[n]), self._choose(b, self.r[n]))


@dataclass
class _Work:
    """What a task needs of one model: the trees behind the written margins, those being grown, and the nodes to be split."""

    model: int
    member: int  # the rows it is trained on: those with this membership
    past: list[_Compact]
    now: list[_Compact]  # one for each class
    open: list[dict[int, int]]  # for each class: node -> number among the level's nodes
    allowed: list[np.ndarray]  # for each class: features
    positive: float  # weight of y = 1
    sample: int  # which of the rows' numbers counts


def _probabilities(margin: np.ndarray) -> np.ndarray:
    if margin.shape[1] == 1:
        return 1 / (1 + np.exp(-margin))
    e = np.exp(margin - margin.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _losses(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    if margin.shape[1] == 1:
        return np.logaddexp(0, margin[:, 0]) - y * margin[:, 0]
    top = margin.max(1)
    return np.log(np.exp(margin - top[:, None]).sum(1)) + top - margin[np.arange(len(y)), y]


def _batch(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """(y, a line of bins for each feature, numbers of rows, each membership's row, the memberships)."""
    raw, rows = b.column(2), b.num_rows
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset :]
    flat = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[rows]] if rows and width else np.zeros(0, np.uint8)
    lists = b.column(1)
    sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    numbers = b.column(4).flatten().to_numpy(zero_copy_only=False)
    return b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), np.ascontiguousarray(flat.reshape(rows, width).T), numbers.reshape(rows, -1), np.repeat(np.arange(rows), sizes), np.asarray(lists.flatten())


def _written(b: pa.RecordBatch) -> bool:
    """Whether rows hold margins; those without have empty lists, since a column of null lists costs a batch the square of its rows when it is handed to Python."""
    return len(b.column(5).flatten()) > 0


def _base(b: pa.RecordBatch, n: int, classes: int, start: dict[int, list[float]], members: np.ndarray) -> np.ndarray:
    """(memberships, classes) margins as written, or the intercepts."""
    if _written(b):
        return np.array(b.column(5).flatten()).reshape(n, classes)
    out = np.zeros((n, classes))
    for m, v in start.items():
        out[members == m] = v
    return out


def _begin(w: _Work, base: np.ndarray, written: bool, start: dict[int, list[float]]) -> np.ndarray:
    """Margins that a model goes on from: those written, or its own intercepts."""
    return base if written else np.tile(np.array(start[w.model]), (len(base), 1))


def _margin(base: np.ndarray, past: list[_Compact], bins: np.ndarray) -> np.ndarray:
    out = base.copy()
    for t in past:
        out[:, t.cls] += t.rate * t.v[t.node(bins)]
    return out


def _level(data: Binned, rows: DataFrame, work: list[_Work], classes: int, start: dict[int, list[float]], growth: Growth, first: bool, unit: float) -> tuple[dict, dict]:
    """Best splits of all open nodes: ({(model, class, node): row}, {model: (loss, rows)}), the losses where ``first``; gradients are multiples of ``unit``."""
    width = len(data.columns)
    bins = max([2, *(len(e) + 1 for e in data.edges)])
    nodes = max([1, *(len(o) for w in work for o in w.open)])
    shape = (len(work), classes, nodes, width, bins)

    def run(batches):
        total = np.zeros((2, *shape))
        losses = np.zeros((len(work), 2))
        for b in batches:
            y, cells, numbers, row, member = _batch(b, width)
            base = _base(b, len(row), classes, {}, member)
            written = _written(b)
            for shared in sorted({w.member for w in work}):
                at = np.flatnonzero(member == shared)
                if not len(at):
                    continue
                own, t, many, begun = cells[:, row[at]], y[row[at]], numbers[row[at]], base[at]
                for i, w in enumerate(work):
                    if w.member != shared:
                        continue
                    m = _margin(_begin(w, begun, written, start), w.past, own)
                    if first:
                        losses[i] += (_losses(m, t) * many[:, 0]).sum(), many[:, 0].sum()
                    p, seen = _probabilities(m), many[:, w.sample]
                    for c in range(classes):
                        if not w.open[c]:
                            continue
                        number = np.full(len(w.now[c].f), -1)
                        number[list(w.open[c])] = list(w.open[c].values())
                        n = number[w.now[c].node(own)]
                        truth = t == c if classes > 1 else t > 0
                        weight = np.where(truth, w.positive, 1.0) if classes == 1 else 1.0
                        q = p[:, c]
                        g = np.rint(weight * (q - truth) / unit) * seen
                        h = np.maximum(np.rint(weight * (q * (1 - q)) / unit), 1) * seen
                        which = None if (n >= 0).all() else np.flatnonzero(n >= 0)
                        if which is not None:
                            n, g, h = n[which], g[which], h[which]
                        place = n * bins
                        for f in w.allowed[c].tolist():
                            cell = place + (own[f] if which is None else own[f][which])
                            for k, v in ((0, g), (1, h)):
                                total[k, i, c, :, f] += np.bincount(cell, v, nodes * bins).reshape(nodes, bins)
        total = total.reshape(2, -1)
        some = np.flatnonzero(total[1])
        extra = np.flatnonzero(losses[:, 1])  # as rows of one bin of a node below 0
        columns = [some // (bins * width), some // bins % width, some % bins, total[0, some], total[1, some]]
        tail = [-1 - extra, np.full(len(extra), -1), np.zeros(len(extra), np.int64), losses[extra, 0], losses[extra, 1]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(columns, tail), kinds)], ["node", "f", "bin", "g", "h"])

    # a task has summed its rows, so cells go to their node's partition at once: one exchange for sums, windows and the choice
    parts = rows.mapInArrow(run, "node bigint, f int, bin int, g double, h double").repartition("node")
    size = F.when(F.col("f") < 0, 1.0).otherwise(unit)  # losses are as they are
    cells = parts.groupBy("node", "f", "bin").agg((F.sum("g") * size).alias("g"), (F.sum("h") * size).alias("h"))
    whole = Window.partitionBy("node", "f")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.select("node", "f", "bin", *[F.sum(x).over(w).alias(f"{x}{s}") for x in "gh" for s, w in (("l", upto), ("t", whole))])
    square = lambda g, h: g * g / (h + growth.ridge)
    g, h = F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    gain = F.round((square(F.col("gl"), F.col("hl")) + square(g, h) - square(F.col("gt"), F.col("ht"))) / 2, 9)
    valid = (F.col("f") >= 0) & (F.col("hl") >= growth.least) & (h >= growth.least) & (gain > growth.gain)
    order = F.struct(F.when(valid, 0).otherwise(1).alias("no"), F.when(valid, -gain).alias("by"), "f", "bin")
    best = sums.groupBy("node").agg(F.min_by(F.struct(F.when(valid, F.col("f")).alias("f"), "bin", gain.alias("gain"), "gl", "hl", "gt", "ht"), order).alias("b")).select("node", "b.*")
    found, lost = {}, {}
    names = {(i, c, k): (w.model, c, n) for i, w in enumerate(work) for c in range(classes) for n, k in w.open[c].items()}
    for r in best.collect():
        if r["node"] < 0:
            lost[work[-1 - r["node"]].model] = (r["gt"], r["ht"])
        else:
            k, c, i = r["node"] % nodes, r["node"] // nodes % classes, r["node"] // nodes // classes
            found[names[i, c, k]] = r
    return found, lost


def _with_base(rows: DataFrame, width: int, since: dict[int, list[_Compact]], classes: int, start: dict[int, list[float]]) -> DataFrame:
    """Groups of rows with the margins of all models so far, written."""

    def run(batches):
        for b in batches:
            _, cells, _, row, member = _batch(b, width)
            base = _base(b, len(row), classes, start, member)
            for m, past in since.items():
                at = np.flatnonzero(member == m)
                base[at] = _margin(base[at], past, cells[:, row[at]])
            offsets = pa.array(np.asarray(b.column(1).offsets) * classes - int(b.column(1).offsets[0].as_py()) * classes, pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.ListArray.from_arrays(offsets, pa.array(base.ravel()))], b.schema.names)

    return saved(rows.mapInArrow(run, _GROUPS))


def class_counts(rows: DataFrame, classes: int) -> dict[int, np.ndarray]:
    """Rows of each class that each model is trained on, from groups of rows."""
    out: dict[int, np.ndarray] = {}
    for r in rows.select(F.explode("members").alias("m"), "y", F.col("n")[0].alias("n")).groupBy("m", "y").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["m"], np.zeros(max(2, classes)))[r["y"]] = r["n"]
    return out


def grow(
    data: Binned, growth: Growth = Growth(), classes: int = 1, start: dict[int, Model] | None = None, allowed: dict[int, Iterable[int]] | None = None, balanced: bool = False, final_loss: bool = True,
    only: Iterable[int] | None = None, variants: dict[int, int] | None = None,
) -> dict[int, Model]:
    """All models that rows are members of: logistic for ``classes`` 1 (y is 0 or 1), softmax for more (y from 0).

    ``start`` continues models, ``allowed`` has the features of a model (all if not named); with ``balanced`` the positive rows of
    each model weigh as much as its others; ``only`` names the memberships to be trained. With ``variants`` (model -> membership) several
    models, of other ``allowed`` features, are trained on the same rows. A model whose rows have one class gets no tree and an intercept that never leaves this class.
    """
    salts: tuple[int, ...] = ()
    if growth.rows < 1:  # one for each number of trees that a model can have when a round begins
        had = {0, *(len(m.trees) for m in (start or {}).values())}
        salts = tuple(sorted({_salt(growth, h + k * classes) for h in had for k in range(growth.rounds)}))
    rows = data.groups(growth.rows, salts)
    if only is not None:
        only = sorted(set(only))
        rows = rows.filter(F.arrays_overlap("members", F.array(*[F.lit(int(m)) for m in only])))
    counts = {m: n for m, n in class_counts(rows, classes).items() if only is None or m in only}
    member = {m: m for m in counts} if variants is None else {v: m for v, m in variants.items() if m in counts}
    counts = {v: counts[m] for v, m in member.items()}
    if variants is not None and (growth.rounds >= REFRESH or start):
        raise ValueError("variants share their rows' written margins: they are grown afresh, in fewer rounds than REFRESH")
    every = np.arange(len(data.columns))
    may = {m: np.array(sorted((allowed or {}).get(m, every)), np.int64) for m in counts}
    models, intercepts = {}, {}
    for m, n in sorted(counts.items()):
        own = Model(list(start[m].intercepts), list(start[m].trees), list(start[m].losses)) if start and m in start else None
        if own is None:
            share = np.clip((n / n.sum())[: max(2, classes)], 1e-6, 1 - 1e-6)
            own = Model([float(0.0 if balanced and min(n[:2]) > 0 else math.log(share[1] / share[0]))] if classes == 1 else [float(math.log(s)) for s in share])
        models[m], intercepts[m] = own, own.intercepts
    still = [m for m, n in sorted(counts.items()) if (n > 0).sum() > 1 and len(may[m])]
    at_once = max(1, MOST_CELLS // max(1, classes * 2 ** (growth.depth - 1) * len(every) * max([2, *(len(e) + 1 for e in data.edges)])))
    # sums of gradients stay below twice the rows of a model, in whole multiples of the unit below 2^52
    unit = 2.0 ** (math.ceil(math.log2(2 * max([1.0, *(n.sum() for n in counts.values())]))) - 51)
    for lo in range(0, len(still), at_once):
        _grow(data, rows, salts, unit, growth, classes, models, intercepts, still[lo : lo + at_once], may, {m: float(counts[m][0] / max(1.0, counts[m][1])) if balanced else 1.0 for m in counts}, final_loss, member)
    return models


def _salt(growth: Growth, had: int) -> int:
    """What draws the sample of a round that begins with so many trees."""
    return growth.seed * 1_000_003 + had


def _grow(data: Binned, rows: DataFrame, salts: tuple[int, ...], unit: float, growth: Growth, classes: int, models: dict[int, Model], intercepts: dict, names: list[int], may: dict, positive: dict, final_loss: bool, member: dict) -> None:
    since = {m: [_Compact(t, data.edges) for t in models[m].trees] for m in names}
    for r in range(growth.rounds + final_loss):
        if r and r % REFRESH == 0:
            rows, since = _with_base(rows, len(data.columns), since, classes, intercepts), {m: [] for m in names}
        last = r == growth.rounds
        trees, allowed = {}, {}
        for m in names:
            number = len(models[m].trees)
            rng = np.random.default_rng([growth.seed, m, number])
            take = max(1, math.ceil(growth.features * len(may[m])))
            trees[m] = [Tree(c, growth.rate) for c in range(classes)]
            allowed[m] = [np.sort(rng.choice(may[m], take, replace=False)) if take < len(may[m]) else may[m] for _ in range(classes)]
        open_ = {m: [{} if last else {0: 0} for _ in range(classes)] for m in names}
        for level in range(1 if last else growth.depth):
            work = [_Work(m, member[m], since[m], [_Compact(t, data.edges) for t in trees[m]], open_[m], allowed[m], positive[m], 1 + salts.index(_salt(growth, len(models[m].trees))) if salts and not last else 0) for m in names if last or any(open_[m])]
            if not work:
                break
            found, lost = _level(data, rows, work, classes, intercepts, growth, level == 0 and (r > 0 or last), unit)
            for m, (s, n) in lost.items():
                models[m].losses.append(s / n)
            after = {m: [[] for _ in range(classes)] for m in names}
            for (m, c, node), b in sorted(found.items()):
                t = trees[m][c]
                value = lambda g, h: float(-g / (h + growth.ridge))
                if node == 0 and level == 0:
                    t.v[0] = value(b["gt"], b["ht"])
                if b["f"] is None:
                    continue
                gl, hl = b["gl"], b["hl"]
                after[m][c] += t.split(node, b["f"], float(data.edges[b["f"]][b["bin"]]), float(b["gain"]), value(gl, hl), value(b["gt"] - gl, b["ht"] - hl))
            open_ = {m: [{n: k for k, n in enumerate(sorted(ns))} for ns in per] for m, per in after.items()}
        if not last:
            for m in names:
                models[m].trees += trees[m]
                since[m] += [_Compact(t, data.edges) for t in trees[m]]


def confusion(data: Binned, models: dict[int, Model], variants: dict[int, int], threshold: float = 0.5) -> DataFrame:
    """(model, tp, fp, fn, tn) of two-class models on the rows that their membership is ``held`` out for."""
    width, bar = len(data.columns), math.log(threshold / (1 - threshold))
    compact = {m: (models[m].intercepts[0], [_Compact(t, data.edges) for t in models[m].trees]) for m in variants}

    def run(batches):
        total = {m: np.zeros(4, np.int64) for m in variants}
        for b in batches:
            held = b.column(3).to_numpy(zero_copy_only=False)
            y, cells, numbers, _, _ = _batch(b, width)
            for member in sorted(set(variants.values())):
                at = np.flatnonzero(held == member)
                own, truth, n = cells[:, at], y[at] == 1, numbers[at, 0]
                for m in (m for m, k in variants.items() if k == member):
                    intercept, past = compact[m]
                    fired = _margin(np.full((len(at), 1), intercept), past, own)[:, 0] >= bar
                    total[m] += [n[fired & truth].sum(), n[fired & ~truth].sum(), n[~fired & truth].sum(), n[~fired & ~truth].sum()]
        names = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array([int(total[m][k]) for m in names], pa.int64()) for k in range(4))], ["model", "tp", "fp", "fn", "tn"])

    parts = data.groups().filter("held is not null").mapInArrow(run, "model int, tp bigint, fp bigint, fn bigint, tn bigint")
    return parts.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
