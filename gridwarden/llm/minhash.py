"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

Sketch.  ``T`` coordinates are filled in rounds: in round i < T every shingle is
thrown into one coordinate by hash i and leaves the value i + fraction there; the
smallest value stays.  A coordinate still empty after T rounds is filled in round T + k
by all shingles at coordinate k, so every coordinate is filled, and the share of
equal coordinates is an unbiased, Chernoff-concentrated estimate of similarity.
Rounds end as soon as no coordinate is empty, after one or two for long texts.

Banding.  ``ROWS`` coordinates make a band; two documents are candidates if they
agree in one of ``BANDS`` bands.  At similarity 0.75 a pair misses all bands with
probability (1 - 0.75 ** 5) ** 40 = 2e-5, at 0.8 with 1e-7.

Verification.  Equal sets are one class (128-bit fingerprint) with its smallest
doc_id as representative.  In every band bucket each representative is first held
against the bucket's smallest: a star, not all pairs.  Exact intersections of whole
sets decide.  Only buckets whose members are not yet connected are looked at again:
small ones pair by pair across components; large ones in blocks, whose members
are compared inside a task by inverted lists and which return the edges of a
spanning forest.  No candidate is dropped or capped, and no bucket's pairs become rows.

Components come from alternating large-star and small-star steps on tables in the
shared folder.

Crowds.  A class of copies, a bucket or a pivot may hold a large part of all rows.  Tables
with one row for each key carry the key's number of rows, and those of the few heavy keys are
broadcast (``skew.join_counted``); a heavy pivot's set goes to several tasks, each with a
share of its candidates (``skew.salted``); blocks are bounded in members and in shingles.

Cases: a null or empty text, or one of white space, has no shingle, is linked with
nothing and kept; fewer than five words make one shingle; rows with equal doc_id are
one document, whose set is the union of theirs, and each of them gets its result; a row with a null doc_id is linked with nothing and kept; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .skew import join_counted, salted
from .store import discard, materialise, returning

WORDS, PERCENT = 5, 75
ROWS, BANDS = 5, 40
T = ROWS * BANDS
#: Buckets up to this many representatives are paired row by row; larger ones in blocks of BLOCK members and HELD shingles.
SMALL, BLOCK, HELD = 24, 1024, 1 << 20
MEMORY = 200_000

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """word -> 64-bit hash of it in lower case, computed once in a worker."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMORY:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word.lower())  # of bytes: A-Z only
        return got


@functools.cache
def _word_hashes() -> _WordHashes:
    return _WordHashes()


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    # the cast also rebases a slice, which some string kernels do not honour
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    coded = split.values.dictionary_encode()
    known = _word_hashes()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    real = np.fromiter((len(w) > 0 for w in words), bool, len(words))
    hashes = np.fromiter((known[w] for w in words), np.uint64, len(words))
    codes = coded.indices.to_numpy()
    bounds = np.asarray(split.offsets)
    flat, used = (hashes[codes], real[codes]) if len(codes) else (np.zeros(0, np.uint64), np.zeros(0, bool))
    # empty strings at a text's ends are no words
    upto = np.concatenate([[0], np.cumsum(used)])
    flat, bounds = flat[used], upto[bounds]
    with np.errstate(over="ignore"):
        acc = np.zeros(len(flat), np.uint64)
        n = max(0, len(flat) - WORDS + 1)
        for k in range(WORDS):
            acc[:n] = mix(acc[:n] * _G + flat[k : k + n] + np.uint64(k + 1))
        out = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo >= WORDS:
                out.append(np.unique(acc[lo : hi - WORDS + 1]))
            elif hi > lo:
                short = np.zeros(1, np.uint64)
                for k in range(lo, hi):
                    short = mix(short * _G + flat[k] + np.uint64(k - lo + 101))
                out.append(short)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


@functools.cache
def _seeds() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 2 * T + 1, dtype=np.uint64) * _G)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """T coordinates of a non-empty set."""
    seeds = _seeds()
    values = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    n, done = len(shingles), 0
    with np.errstate(over="ignore"):
        while done < T:
            # so many rounds at once that most sets need one step
            more = min(T - done, max(1, int(T * 6 / n)))
            h = mix(shingles[None, :] ^ seeds[done : done + more, None])
            rounds = np.arange(done, done + more, dtype=np.uint64)[:, None] << np.uint64(48)
            np.minimum.at(values, (h % np.uint64(T)).ravel().astype(np.int64), (rounds | (h >> np.uint64(16))).ravel())
            done += more
            if (values >> np.uint64(48)).max() < done:
                return values
        for k in np.flatnonzero(values == np.iinfo(np.uint64).max):
            h = mix(shingles ^ seeds[T + k])
            values[k] = (np.uint64(T + k) << np.uint64(48)) | (h.min() >> np.uint64(16))
    return values


def bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    with np.errstate(over="ignore"):
        acc = np.arange(1, BANDS + 1, dtype=np.uint64) * _G
        for column in values.reshape(BANDS, ROWS).T:
            acc = mix(acc * _M1 + column)
    return acc


_SLICE = 500


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, fp, bands) of every row; fp and bands are null where there is no shingle."""
    schema = "doc_id bigint, n_shingles bigint, fp string, bands array<bigint>"

    def run(batches):
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                b = whole.slice(at, _SLICE)
                sets = shingle_sets(b.column(1))
                keys = [bands(sketch(s)).view(np.int64) if len(s) else None for s in sets]
                fps = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
                counts = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), counts, pa.array(fps, pa.string()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "fp", "bands"])

    return _texts(docs).mapInArrow(returning(run), schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles array<bigint>) of every row."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                b = whole.slice(at, _SLICE)
                sets = [s.view(np.int64) for s in shingle_sets(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return _texts(docs).mapInArrow(returning(run), "doc_id bigint, shingles array<bigint>")


def _sets_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The sets of the documents in ``asked``, one row for each, in the shared folder."""
    sets = materialise(_sets(_texts(docs).join(asked, "doc_id", "left_semi")))
    if sets.select("doc_id").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return sets
    return materialise(sets.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("shingles")))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 * intersection >= 75 * union."""
    of = lambda side: sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"s{side}"))
    both = F.size(F.array_intersect("sa", "sb"))
    # a document is few pairs' b, one of each band at most, but a pivot may be all others' a
    return salted(pairs, of("a"), "a", "b").join(of("b"), "b").filter(100 * both >= PERCENT * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _block_edges(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Links of a spanning forest among the members (doc_id, cluster, comp), compared block against block.

    A cluster has as many blocks as its members and their shingles need; each block meets
    each other block of its cluster in one task, so a task holds two blocks.
    """
    sized = members.join(sets.select("doc_id", F.size("shingles").alias("size")), "doc_id")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / HELD)).cast("int")
    spread = members.join(sized.groupBy("cluster").agg(blocks.alias("blocks")), "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = spread.select(
        "cluster", "comp", "doc_id", "block",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select("cluster", "comp", "doc_id", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def run(frame):
        import pandas as pd

        ids, comps, blocks = frame["doc_id"].to_numpy(), frame["comp"].to_numpy(), frame["block"].to_numpy()
        order = np.lexsort((ids, blocks))
        ids, comps, blocks = ids[order], comps[order], blocks[order]
        sets_ = [np.asarray(frame["shingles"].iloc[i]) for i in order]
        sizes_ = np.array([len(s) for s in sets_])
        within = blocks[0] == blocks[-1]
        half = len(ids) if within else int(np.searchsorted(blocks, blocks[-1]))
        # inverted lists of the first block: shingle -> its members
        flat = np.concatenate(sets_[:half])
        owner = np.repeat(np.arange(half), sizes_[:half])
        by = np.argsort(flat, kind="stable")
        flat, owner = flat[by], owner[by]
        root = {c: c for c in set(comps.tolist())}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        edges = []
        for j in range(len(ids)) if within else range(half, len(ids)):
            lo, hi = np.searchsorted(flat, sets_[j], "left"), np.searchsorted(flat, sets_[j], "right")
            some = hi > lo
            lo, n = lo[some], (hi - lo)[some]
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=half)
            linked = np.flatnonzero(100 * common >= PERCENT * (sizes_[:half] + sizes_[j] - common))
            for i in linked.tolist():
                if i != j and (x := find(int(comps[i]))) != (y := find(int(comps[j]))):
                    root[x] = y
                    edges.append((int(ids[i]), int(ids[j])))
        return pd.DataFrame(edges, columns=["a", "b"])

    return dealt.join(sets, "doc_id").groupBy("cluster", "lo", "hi").applyInPandas(run, "a bigint, b bigint")


def _united(drawn: DataFrame, docs: DataFrame) -> DataFrame:
    """``drawn`` where rows of one doc_id with different texts have the sketch of their united set; the same table if there are none."""
    several = drawn.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("fp", F.lit(""))).alias("a"), F.max(F.coalesce("fp", F.lit(""))).alias("b"))
    several = materialise(several.filter("a < b").select("doc_id"))
    if several.isEmpty():
        return drawn
    each = _sets(_texts(docs).join(several, "doc_id", "left_semi")).select("doc_id", F.explode("shingles").alias("x")).distinct()
    whole = each.groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("shingles"))

    def run(batches):
        import xxhash

        for b in batches:
            # the order of unsigned numbers, as in ``shingle_sets``
            sets = [np.sort(np.asarray(x.values).view(np.uint64)) for x in b.column(1)]
            fps = [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]
            keys = pa.array([bands(sketch(s)).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.string()), keys], ["doc_id", "n_shingles", "fp", "bands"])

    made = whole.mapInArrow(returning(run), "doc_id bigint, n_shingles bigint, fp string, bands array<bigint>")
    again = drawn.select("doc_id").join(several, "doc_id", "left_semi").join(made, "doc_id")
    rest = drawn.join(several, "doc_id", "left_anti")
    return materialise(rest.unionByName(again))


def links_and_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per document: doc_id, n_shingles, rep, component), (links between representatives that join all components), (rep -> component)."""
    drawn = _united(materialise(sketches(docs)), docs)
    filled = drawn.filter(F.col("fp").isNotNull() & F.col("doc_id").isNotNull())
    # equal sets have equal bands, so those of any row are its class's and travel once
    classes = materialise(filled.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands")))
    reps = classes.select(F.col("rep").alias("doc_id"), F.explode("bands").alias("key"))
    shared = materialise(reps.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("pivot < last").drop("last"))
    crowd = materialise(join_counted(reps, shared, "key").select("key", "doc_id", "pivot"))
    asked = crowd.select("doc_id").distinct()
    sets = _sets_of(docs, asked)
    star = materialise(crowd.filter("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct())
    links = materialise(_similar(star, sets))
    first = components(links)
    placed = crowd.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
    split = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m")).filter("c0 < c1").select("key", "m")
    open_ = materialise(placed.join(split, "key"))
    few = open_.filter(F.col("m") <= SMALL)
    one, two = few.alias("x"), few.alias("y")
    pairs = (
        one.join(two, (F.col("x.key") == F.col("y.key")) & (F.col("x.doc_id") < F.col("y.doc_id")))
        .filter("x.comp <> y.comp and x.doc_id <> x.pivot")  # what holds the pivot has been compared
        .select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
        .distinct()
    )
    many = open_.filter(F.col("m") > SMALL)
    clusters = components(many.filter("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct())
    members = clusters.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "cluster").join(many.select("doc_id", "comp").distinct(), "doc_id")
    pairs = materialise(pairs)
    later = materialise(_similar(pairs, sets).unionByName(_block_edges(sets, members)))
    # the stars of the first links stand for them
    final = components(later.unionByName(first.select(F.col("component").alias("a"), F.col("node").alias("b"))))
    discard(shared, crowd, sets, star, first, open_, clusters, pairs)
    # classes meet their components first, so documents meet one table whose heavy keys are known
    named = materialise(classes.drop("bands").join(final.withColumnRenamed("node", "rep"), "rep", "left"))
    per_doc = join_counted(drawn.drop("bands"), named, "fp", "left")
    return per_doc, links.unionByName(later), final


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    named, _, _ = links_and_classes(docs)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
