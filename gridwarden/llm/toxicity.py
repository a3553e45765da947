"""Toxicity by a classifier chain of linear models.

Labels say whether a document is toxic; with the documents' language they also say what
kind of toxicity it is, and kinds are the chain's categories: "toxic, in language l" for each
language with at least ``LEAST_KIND`` toxic sampled texts, the most frequent one first, and
``toxic`` itself last.  Words that mark one kind say nothing about another, so each
category has its own linear model, and the later ones get the probabilities of all earlier ones.

Features are words and word prefixes (the markers) that speak for toxic texts more than
chance allows among so many.  Each model is logistic regression on the damped counts of markers, the text's length,
and the probabilities of all earlier categories.  Those inputs are out-of-fold: for training,
an earlier category's probability of a document comes from a model whose markers were chosen and whose
weights were fitted without its fold; a last model, on all folds, serves prediction.  Near copies in the
sample count once.  The verdict's threshold is where out-of-fold F0.5 of the last category is
largest, each class weighted as it is among all labelled documents, and a half at least.

The sample is bounded (``SAMPLE`` documents, half of them toxic where there are so
many; documented).  Training and prediction read every whole text: executors turn each sampled text into its
distinct terms, Spark counts these by fold, and the driver gets only MinHash keys, numbers of words
and the counts of the markers, so its memory depends on documents and markers, not on lengths.
Prediction makes one look-up for each distinct word of a batch.

Cases: a null or empty text has probability 0 in all categories and is not toxic; with
no labelled row, or only one class, nothing is toxic; without languages there is one
category; repeated rows get equal results and of rows with one doc_id one is sampled (that with the smallest digest);
labels whose doc_id repeats count once, toxic if any is; a very long text counts with all its words; an empty table gives no row;
extra columns pass as they are.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .minhash import bands, shingle_sets, sketch
from .store import materialise, returning

LAST = "toxic"
#: Bound of the fit in documents; folds; shortest and longest prefix; texts that make a feature, and a kind, at least.
SAMPLE, FOLDS, PREFIXES, SUPPORT, LEAST_KIND = 4000, 3, (4, 7), 3, 6
RIDGE = 1e-3
#: Models weigh the classes alike, so below a half a text is rather clean, however few labels say so.
LEAST_THRESHOLD = 0.5
_WORD = regex.compile(r"[\p{L}\p{M}]+")


def terms(word: str) -> list[str]:
    """Features of a chunk of text without white space: its words, and their prefixes (marked by a bar)."""
    out = []
    for w in _WORD.findall(word.lower()):
        out.append(w)
        out += [f"{w[:n]}|" for n in range(PREFIXES[0], min(PREFIXES[1], len(w) - 1) + 1)]
    return out


def chunks_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct chunks without white space, (text, chunk) of each different chunk of each text): the one way in which texts are split here."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    coded = split.values.dictionary_encode()
    names = coded.dictionary.to_pylist()
    which = coded.indices.to_numpy()
    texts_ = np.repeat(np.arange(len(texts)), np.diff(np.asarray(split.offsets)))
    if "" in names:  # what stands before a leading blank is no chunk
        real = which != names.index("")
        which, texts_ = which[real], texts_[real]
    each = np.unique(texts_ * (1 << 32) + which)
    return names, each >> 32, each & 0xFFFFFFFF


@dataclass
class Counts:
    """Sparse matrix: how many different words of a text show a feature, damped; column 0 is the text's length."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, words: np.ndarray) -> Counts:
        """From (text, feature) of each different word, and the number of different words of each text."""
        pairs, many = np.unique(rows * (1 << 32) + columns, return_counts=True)
        n = len(words)
        return cls(np.concatenate([np.arange(n), pairs >> 32]), np.concatenate([np.zeros(n, np.int64), pairs & 0xFFFFFFFF]), np.concatenate([np.log1p(words) / 4, np.log2(1 + many)]))

    def take(self, keep: np.ndarray) -> Counts:
        """Only the texts where ``keep``, renumbered."""
        at = np.cumsum(keep) - 1
        inside = keep[self.rows]
        return Counts(at[self.rows[inside]], self.columns[inside], self.values[inside])

    def only(self, columns: np.ndarray) -> Counts:
        """Zero in all other columns."""
        inside = columns[self.columns]
        return Counts(self.rows[inside], self.columns[inside], self.values[inside])


@dataclass
class Linear:
    weights: np.ndarray
    chained: np.ndarray  # weights of earlier categories' probabilities
    bias: float

    def probability(self, x: Counts, n: int, earlier: np.ndarray) -> np.ndarray:
        score = np.bincount(x.rows, self.weights[x.columns] * x.values, n) + earlier @ self.chained + self.bias
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


@dataclass
class Chain:
    features: dict[str, int] = field(default_factory=dict)
    categories: list[str] = field(default_factory=list)
    models: list[Linear] = field(default_factory=list)
    threshold: float = 0.5

    def probabilities(self, x: Counts, n: int) -> np.ndarray:
        p = np.zeros((n, len(self.models)))
        for k, m in enumerate(self.models):
            p[:, k] = m.probability(x, n, p[:, :k])
        return p


def _fit(x: Counts, n: int, width: int, earlier: np.ndarray, y: np.ndarray, steps: int = 200) -> Linear:
    """Logistic regression with a ridge, balanced classes, full-batch Adam."""
    pos = y.sum()
    if pos == 0 or pos == n:
        return Linear(np.zeros(width), np.zeros(earlier.shape[1]), 20.0 if n and pos == n else -20.0)
    weight = np.where(y > 0, 0.5 / pos, 0.5 / (n - pos))
    params = [np.zeros(width), np.zeros(earlier.shape[1]), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        d = (Linear(params[0], params[1], params[2][0]).probability(x, n, earlier) - y) * weight
        grads = [np.bincount(x.columns, d[x.rows] * x.values, width) + RIDGE * params[0], earlier.T @ d + RIDGE * params[1], np.array([d.sum()])]
        for p, g, a, b in zip(params, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= 0.1 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-9)
    return Linear(params[0], params[1], float(params[2][0]))


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """Where F0.5 (precision counts twice) is largest, half-way between the scores on both sides."""
    weight = np.ones(len(y)) if weight is None else weight
    order = np.argsort(-p)
    tp = np.cumsum((y * weight)[order])
    f = 1.25 * tp / (np.cumsum(weight[order]) + 0.25 * (y * weight).sum())
    k = int(f.argmax())
    below = p[order[k + 1]] if k + 1 < len(y) else 0.0
    return float((p[order[k]] + below) / 2)


def distinct(keys: list[list[int]]) -> list[int]:
    """Positions of one text of each group of near copies, by their MinHash keys: a copied text would make its chance words look like markers."""
    seen: set[int] = set()
    keep = []
    for i, own in enumerate(keys):
        if seen.isdisjoint(own):
            keep.append(i)
        seen.update(own)
    return keep


def evidence(in_pos: np.ndarray, in_neg: np.ndarray, pos: float, neg: float) -> np.ndarray:
    """Log-likelihood ratio (G) of presence against class, for features more frequent in toxic texts; else 0."""
    total = pos + neg
    out = np.zeros(len(in_pos))
    for seen, of in ((in_pos, pos), (in_neg, neg), (pos - in_pos, pos), (neg - in_neg, neg)):
        present = in_pos + in_neg if seen is in_pos or seen is in_neg else total - in_pos - in_neg
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(seen > 0, 2 * seen * np.log(seen * total / (present * of)), 0)
    return np.where(in_pos * neg > in_neg * pos, out, 0)


def chain_of(x: Counts, words: int, targets: list[np.ndarray], fold: np.ndarray, masks: np.ndarray) -> tuple[list[Linear], np.ndarray]:
    """Models of the targets in turn, fitted on all texts, and the out-of-fold probabilities (texts x targets).

    ``masks`` (FOLDS + 1, columns): the columns that may be used without each fold, and with all.
    """
    n = len(fold)
    earlier, models = np.zeros((n, 0)), []
    for target in targets:
        models.append(_fit(x.only(masks[-1]), n, words, earlier, target))
        out = np.zeros(n)
        for k in range(len(masks) - 1):
            kept, own = fold != k, x.only(masks[k])
            m = _fit(own.take(kept), int(kept.sum()), words, earlier[kept], target[kept])
            out[~kept] = m.probability(own, n, earlier)[~kept]
        earlier = np.column_stack([earlier, out])
    return models, earlier


def train(texts: DataFrame, counts: dict[int, int], chained: bool = True) -> Chain:
    """Fit the chain on labelled texts, given by ``described``; ``counts`` are the labels' classes, 0 and 1.

    Without ``chained`` it is the last category's model alone, for comparison.
    """
    spark = texts.sparkSession
    first = texts.groupBy("doc_id").agg(F.min(F.struct("digest", "row")).alias("f")).select("f.row")
    rows = texts.join(first, "row", "left_semi").select("row", "doc_id", "digest", "toxic", "kind", "keys", "words").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["digest"]))
    rows = [rows[i] for i in distinct([r["keys"] for r in rows])]
    y, words = np.array([r["toxic"] for r in rows], float), np.array([r["words"] for r in rows], np.int64)
    n = len(rows)
    if not n or y.sum() in (0, n):
        return Chain()
    fold = np.arange(n) % FOLDS
    place = spark.createDataFrame([(r["row"], i, i % FOLDS) for i, r in enumerate(rows)], "row bigint, i int, fold int")
    cells = texts.join(F.broadcast(place), "row").select("i", "fold", "toxic", F.explode(F.arrays_zip("terms", "chunks")).alias("c")).select("i", "fold", "toxic", "c.terms", "c.chunks")
    # texts that show each feature, by fold: toxic ones and others
    tallies = [f"{c}{k}" for c in "pn" for k in range(FOLDS)]
    made = [F.count(F.when((F.col("fold") == k) & (F.col("toxic") == int(c == "p")), 1)).alias(f"{c}{k}") for c in "pn" for k in range(FOLDS)]
    shown = materialise(cells.groupBy("terms").agg(*made))
    kinds = shown.groupBy(*tallies).agg(F.count("*").alias("terms")).toArrow()
    seen = np.array([kinds.column(t).to_numpy() for t in tallies], float).reshape(2, FOLDS, -1)
    many = kinds.column("terms").to_numpy().astype(float)
    # what chance would give the best of so many features is no evidence
    use = np.zeros((FOLDS + 1, len(many)), bool)
    for k in range(FOLDS + 1):
        kept, texts_in = np.arange(FOLDS) != k, fold != k
        in_pos, in_neg, pos, neg = seen[0, kept].sum(0), seen[1, kept].sum(0), y[texts_in].sum(), (1 - y[texts_in]).sum()
        if pos and neg:
            use[k] = (in_pos >= SUPPORT) & (evidence(in_pos, in_neg, pos, neg) > 2 * np.log(max(2.0, many[in_pos + in_neg > 0].sum())))
    good = np.flatnonzero(use.any(0))
    if not use[-1].any():
        return Chain()
    values = [(*map(int, seen[:, :, g].ravel()), [bool(u) for u in use[:, g]]) for g in good]
    wanted = spark.createDataFrame(values, ", ".join(f"{t} bigint" for t in tallies) + ", use array<boolean>")
    chosen = sorted(shown.join(F.broadcast(wanted), tallies).select("terms", "use").collect())
    features = {r["terms"]: i + 1 for i, r in enumerate(chosen)}
    masks = np.column_stack([np.ones(FOLDS + 1, bool), np.array([r["use"] for r in chosen]).T])
    marked = cells.join(F.broadcast(spark.createDataFrame(list(features.items()), "terms string, at int")), "terms").select("i", "at", "chunks").toArrow()
    at, column, chunks = (marked.column(c).to_numpy().astype(np.int64) for c in ("i", "at", "chunks"))
    x = Counts.of(np.repeat(at, chunks), np.repeat(column, chunks), words)
    kind = np.array([r["kind"] or "" for r in rows])
    found = Counter(kind[(y > 0) & (kind != "")].tolist())
    categories = [k for k, c in sorted(found.items(), key=lambda kc: (-kc[1], kc[0])) if c >= LEAST_KIND] if chained else []
    targets = [y * (kind == k) for k in categories] + [y]
    models, out = chain_of(x, len(features) + 1, targets, fold, masks)
    weight = np.where(y > 0, counts[1] / y.sum(), counts[0] / (n - y.sum()))
    return Chain(features, [*categories, LAST], models, max(LEAST_THRESHOLD, best_threshold(out[:, -1], y, weight)))


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[DataFrame, dict[int, int]] | None:
    """(doc_id, text, toxic, kind) of at most ``size`` labelled documents, up to half of them toxic, by a hash of doc_id, and the labels by class; None if a class is missing."""
    truth = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in truth.groupBy("toxic").agg(F.count("*").alias("n")).filter("toxic in (0, 1)").collect()}
    if len(counts) < 2:
        return None
    place = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    bound = F.when(F.col("toxic") == 1, min(1.0, size / 2 / counts[1])).otherwise(min(1.0, size / 2 / counts[0]))
    picked = truth.filter("toxic in (0, 1)").filter(place < bound).orderBy(place, "doc_id").limit(size)  # bounded, so broadcast
    kind = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"), kind.alias("kind")).filter(F.col("text").isNotNull())
    return text.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic", "kind"), counts


def described(texts: DataFrame) -> DataFrame:
    """What training needs of (doc_id, text, toxic, kind), written once: MinHash keys, different words, and each term of the whole text with the words that show it."""
    fields = "digest string, toxic int, kind string, keys array<bigint>, words bigint, terms array<string>, chunks array<bigint>"
    source = texts.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "toxic", "kind", "text")

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 50):
                b = whole.slice(lo, 50)
                keys = [bands(sketch(s)).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in shingle_sets(b.column(4))]
                names_, text, chunk = chunks_of(b.column(4))
                words = np.bincount(text, minlength=b.num_rows)
                shown = [set(terms(c)) for c in names_]
                found = [Counter() for _ in range(b.num_rows)]
                for i, c in zip(text.tolist(), chunk.tolist()):
                    found[i].update(shown[c])
                made = [pa.array(keys, pa.list_(pa.int64())), pa.array(words, pa.int64()), pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:4], *made], names)

    schema = T.StructType([source.schema["doc_id"], *T.StructType.fromDDL(fields).fields])
    names = schema.names
    return materialise(source.mapInArrow(returning(run), schema).withColumn("row", F.monotonically_increasing_id()))


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Chain:
    found = sample(docs, labels, size)
    return Chain() if found is None else train(described(found[0]), found[1])


class _Columns(dict):
    """chunk -> chosen feature columns, remembered in a worker's task."""

    def __init__(self, chain: Chain) -> None:
        super().__init__()
        self.known = chain.features

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) > 150_000:
            self.clear()
        known = self.known
        got = self[chunk] = tuple({known[t] for t in terms(chunk) if t in known})
        return got


def predict(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` with ``kinds`` (map of each earlier category to its probability), ``p_toxic`` and ``toxic``; columns of these names are replaced."""
    added = ["kinds", "p_toxic", "toxic"]
    kept = [c for c in docs.columns if c not in added]
    # plain names for the way through Arrow, where a dot would be read as a field
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    text_at = kept.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        model = shared.value
        memo = _Columns(model)
        width = max(1, len(model.models))
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                n = b.num_rows
                p = np.zeros((n, width))
                if model.models:
                    texts = pc.fill_null(b.column(text_at), "").cast(pa.large_string())
                    names, docs_, which = chunks_of(texts)
                    found = [memo[w] for w in names]
                    sizes = np.fromiter(map(len, found), np.int64, len(found))
                    different = np.bincount(docs_, minlength=n)
                    some = sizes[which] > 0 if len(which) else np.zeros(0, bool)
                    which, docs_ = which[some], docs_[some]
                    flat = np.array([c for w in which.tolist() for c in found[w]], np.int64)
                    p = model.probabilities(Counts.of(np.repeat(docs_, sizes[which]), flat, different), n)
                    p[np.asarray(pc.utf8_length(texts)) == 0] = 0
                toxic = pa.array(((p[:, -1] >= model.threshold) & (p[:, -1] > 0)).tolist(), pa.bool_())
                kinds = model.categories[:-1]
                per_kind = pa.MapArray.from_arrays(pa.array(np.arange(n + 1) * len(kinds), pa.int32()), pa.array(kinds * n, pa.string()), pa.array(p[:, : len(kinds)].ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([*b.columns, per_kind, pa.array(p[:, -1]), toxic], [*b.schema.names, *added])

    fields = [T.StructField("kinds", T.MapType(T.StringType(), T.DoubleType())), T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())]
    return source.mapInArrow(returning(run), T.StructType([*source.schema.fields, *fields])).toDF(*kept, *added)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, kinds, p_toxic, toxic) of every document."""
    return predict(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs, labels)).drop("text")
