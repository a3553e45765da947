"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes in both directions with one gated recurrent unit
each (update gate, reset gate, candidate), labels every byte from the two states
there, and a document's probability is the mean over all its bytes.  Every byte of
every text lies in exactly one window.  Input weights are a 256-row table, so a
step is one gather, one small matrix product and the gates, done for all windows of a
batch at once in single precision.

Training is back-propagation through time in numpy with Adam on the driver.  It takes
about ``SAMPLE`` labelled documents (documented bound: in each language the rows whose hash of doc_id and text
lies below the language's share, at least one share each; copies of a text count once) and reads them whole:
executors cut every sampled text into windows, and every window is trained on in each
epoch, languages weighted alike.  Its random numbers have a fixed seed.

Cases: ``und`` with score 0 for a null or empty text or one without a letter; a label
that is null is never learned; with no labelled row every text is ``und``; with one
label every text with a letter gets it; of labels that tie the first in the model's order counts; repeated rows get equal results; rows
without a doc_id, or of one, are sampled like any others and never held out; a very long text is many windows; an empty table gives no row; extra
columns pass as they are, and columns named like the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import returning

UNKNOWN = "und"
#: Bound of the training sample, in labelled documents; no language gets less than LEAST_SHARE of them.
SAMPLE, LEAST_SHARE = 800, 4
#: Bytes that go through the network as one sequence.
WINDOW = 128
HIDDEN = 8
#: Training goes through all windows as often as it takes to make STEPS steps of BATCH windows, once at least.
STEPS, BATCH, RATE = 150, 96, 0.03
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Direction:
    """One gated unit: table (3H, 256) of a byte's inputs, recurrent (3H, H); rows: update, reset, candidate."""

    table: np.ndarray
    recurrent: np.ndarray


@dataclass
class Network:
    labels: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # (K, 2H)
    bias: np.ndarray  # (K, 1)


def _run(d: Direction, x: np.ndarray, live: np.ndarray | None = None, keep: bool = False):
    """States (T, H, B) after each step over x (T, B), and what back-propagation needs.

    Where ``live`` is 0 (no byte: before a reversed window begins, or after its end) the state is
    zero.  Windows are the last axis throughout, so every operation runs over long rows.
    """
    steps, batch = x.shape
    hid = d.recurrent.shape[1]
    two = 2 * hid
    half = np.float32(0.5)
    # sigmoid(a) = (1 + tanh(a / 2)) / 2: one tanh call serves both gates
    table = d.table.copy()
    table[:two] *= half
    gates, cand = d.recurrent[:two] * half, np.ascontiguousarray(d.recurrent[two:])
    states = np.empty((steps, hid, batch), np.float32)
    h = np.zeros((hid, batch), np.float32)
    memo = []
    g, zr, u, n = (np.empty((k, batch), np.float32) for k in (3 * hid, two, hid, hid))
    for t in range(steps):
        if keep:
            zr, u, n = np.empty_like(zr), np.empty_like(u), np.empty_like(n)
        np.take(table, x[t], axis=1, out=g, mode="clip")
        np.matmul(gates, h, out=zr)
        zr += g[:two]
        np.tanh(zr, out=zr)
        zr += 1
        zr *= half
        np.matmul(cand, h, out=u)
        np.multiply(u, zr[hid:], out=n)
        n += g[two:]
        np.tanh(n, out=n)
        if keep:
            memo.append((h, zr, u, n))
        new = states[t]
        np.subtract(h, n, out=new)
        new *= zr[:hid]
        new += n
        if live is not None:
            new *= live[t]
        h = new
    return states, memo


def _softmax(a: np.ndarray) -> np.ndarray:
    """Over the middle axis of (T, K, B)."""
    a -= a.max(1, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(1, keepdims=True)
    return a


def _back(d: Direction, x: np.ndarray, live: np.ndarray, memo: list, grad: np.ndarray) -> Direction:
    """Gradients of table and recurrent weights, given those of the states (T, H, B)."""
    hid = d.recurrent.shape[1]
    rec = np.zeros_like(d.recurrent)
    inputs = np.zeros((len(x), 3 * hid, x.shape[1]), np.float32)
    dh = np.zeros_like(grad[0])
    for t in range(len(x) - 1, -1, -1):
        h, zr, u, n = memo[t]
        z, r = zr[:hid], zr[hid:]
        dh = (dh + grad[t]) * live[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * u * r * (1 - r)
        inputs[t, :hid], inputs[t, hid : 2 * hid], inputs[t, 2 * hid :] = dz, dr, dn
        back = np.concatenate([dz, dr, dn * r])
        rec += back @ h.T
        dh = dh * z + d.recurrent.T @ back
    flat = x.ravel()
    table = np.stack([np.bincount(flat, inputs[:, k].ravel(), 256) for k in range(3 * hid)]).astype(np.float32)
    return Direction(table, rec)


def train(windows: list[bytes], labels: list[str], seed: int = 7) -> Network:
    """Fit on windows of at most WINDOW bytes and their labels; each window is used in every epoch."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    init = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    k = max(1, len(names))
    net = Network(names, *(Direction(init(3 * HIDDEN, 256), init(3 * HIDDEN, HIDDEN)) for _ in range(2)), init(k, 2 * HIDDEN), np.zeros((k, 1), np.float32))
    if len(names) < 2:
        return net
    number = {n: i for i, n in enumerate(names)}
    y_all = np.array([number[x] for x in labels])
    # every language counts alike, so that a rare one is learned too
    importance = (len(y_all) / (len(names) * np.bincount(y_all, minlength=len(names))))[y_all].astype(np.float32)
    per_epoch = -(-len(windows) // BATCH)
    total = per_epoch * -(-STEPS // per_epoch)
    weights = [net.forward.table, net.forward.recurrent, net.backward.table, net.backward.recurrent, net.out, net.bias]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, total + 1):
        at = (step - 1) % per_epoch * BATCH
        if at == 0:
            order = rng.permutation(len(windows))
        pick = order[at : at + BATCH]
        x, live = _matrix([windows[i] for i in pick])
        y = y_all[pick]
        fwd, memo_f = _run(net.forward, x, live, True)
        bwd, memo_b = _run(net.backward, x[::-1], live[::-1], True)
        both = np.concatenate([fwd, bwd[::-1]], 1)
        p = _softmax(net.out @ both + net.bias)
        p[:, y, np.arange(len(y))] -= 1
        share = live * importance[pick]
        p *= (share / share.sum())[:, None, :]
        up = net.out.T @ p
        gf = _back(net.forward, x, live, memo_f, up[:, :HIDDEN])
        gb = _back(net.backward, x[::-1], live[::-1], memo_b, up[::-1, HIDDEN:])
        grads = [gf.table, gf.recurrent, gb.table, gb.recurrent, (p @ both.transpose(0, 2, 1)).sum(0), p.sum((0, 2))[:, None]]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - step / (total + 1)))
        for w, g, a, b in zip(weights, grads, m, v):
            g = g * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            a += np.float32(0.1) * (g - a)
            b += np.float32(0.01) * (g * g - b)
            w -= np.float32(rate) * (a / np.float32(1 - 0.9**step)) / (np.sqrt(b / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return net


def _matrix(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(T, B) bytes padded with 0, and which of them are real."""
    sizes = np.array([len(w) for w in windows])
    x = np.zeros((max(1, sizes.max()), len(windows)), np.uint8)
    for i, w in enumerate(windows):
        x[: len(w), i] = np.frombuffer(w, np.uint8)
    return x, (np.arange(len(x))[:, None] < sizes[None, :]).astype(np.float32)


#: Windows that go through the network together: their states stay in the CPU's cache.
TOGETHER = 768


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean over the bytes of each text of the label probabilities at them; zeros for an empty text."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    counts = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = starts[doc] + nth * WINDOW
    length = np.minimum(WINDOW, sizes[doc] - nth * WINDOW)
    total = np.zeros((len(texts), len(net.labels)))
    order = np.argsort(-length, kind="stable")
    for lo in range(0, len(order), TOGETHER):
        at = order[lo : lo + TOGETHER]
        steps = int(length[at].max())
        where = begin[at][None, :] + np.arange(steps)[:, None]
        real = np.arange(steps)[:, None] < length[at][None, :]
        full = bool(real.all())
        x = flat[np.minimum(where, len(flat) - 1)]
        live = None if full else real.astype(np.float32)
        fwd, _ = _run(net.forward, x, live)
        bwd, _ = _run(net.backward, x[::-1], None if full else live[::-1])
        p = net.out[:, :HIDDEN] @ fwd
        p += net.out[:, HIDDEN:] @ bwd[::-1]
        p += net.bias
        _softmax(p)
        if not full:
            p *= live[:, None, :]
        np.add.at(total, doc[at], p.sum(0).T)
    return total / np.maximum(sizes, 1)[:, None]


def held_out():
    """Whether crc32 of doc_id as text leaves 2 modulo 4."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def training_windows(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[bytes, str]]:
    """All windows, with their labels, of the sampled documents that have a label and a text and are not held out.

    Executors turn each sampled text into its windows; those without a letter say nothing
    about a language and stay behind.
    """
    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.coalesce(~held_out(), F.lit(True)))
    usable = usable.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # one row for each language, and as many weights in the network, so this table is as small as the model
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    share = max(LEAST_SHARE, sample // max(1, counts.count()))
    # a row's place in [0, 1) by hash of doc_id and text, so rows without a doc_id, or of one, are drawn apart; about `share`
    # rows of each language lie below its bound, and copies of a drawn text count once
    place = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = usable.join(F.broadcast(counts.select("lang", (F.lit(float(share)) / F.col("n")).alias("bound"))), "lang").filter(place < F.col("bound"))

    def run(batches):
        for b in batches:
            langs, found = [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = text.encode()
                for at in range(0, len(raw), WINDOW):
                    w = raw[at : at + WINDOW]
                    if _LETTER.search(w.decode(errors="ignore")):
                        langs.append(lang)
                        found.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "part"])

    rows = picked.select("lang", "text").distinct().mapInArrow(returning(run), "lang string, part binary").toArrow()
    # an order that does not depend on partitions
    return sorted(zip(rows.column(1).to_pylist(), rows.column(0).to_pylist()))


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with lang_pred and score."""
    names = net.labels if net else []
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    # plain names for the way through Arrow, where a dot would be read as a field
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    shared = docs.sparkSession.sparkContext.broadcast(net)
    text_at = kept.index("text")

    def run(batches):
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = [t or "" for t in b.column(text_at).to_pylist()]
                labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                known = [i for i, t in enumerate(texts) if names and _LETTER.search(t)]
                if known:
                    p = document_probabilities(model, [texts[i].encode() for i in known]) if len(names) > 1 else np.ones((len(known), 1))
                    for i, k, s in zip(known, p.argmax(1).tolist(), p.max(1).tolist()):
                        labels[i], scores[i] = names[k], min(1.0, s)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return source.mapInArrow(returning(run), T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])).toDF(*kept, "lang_pred", "score")


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    found = training_windows(docs, sample)
    return train([w for w, _ in found], [y for _, y in found]) if found else None


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    return predict(docs.select("doc_id", F.col("text").cast("string")), fit(docs, sample)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
