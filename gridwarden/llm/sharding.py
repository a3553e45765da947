"""A uniform shuffle of all rows into shards of exact sizes, in built-in functions only.

The rows lie in parts (the tasks' partitions).  How many rows each part gives to each shard is
a matrix with known row sums (the parts' rows) and column sums (the shards' sizes).  In a uniform
permutation this matrix is multivariate hypergeometric, so it is drawn first, exactly, and then

1. each part is permuted locally (sorted by a random number) and written, in order, to the shared folder;
2. part p gives its first M[p, 0] rows to shard 0, the next M[p, 1] to shard 1, and so on: one exchange;
3. each shard is permuted again by a second random number and numbered.

The matrix is drawn top-down over a tree in which a node has up to ``FANOUT`` children: a node's
counts by shard are split over its children by univariate draws, each from a hash of (seed,
node, child, shard).  A draw inverts the cumulative distribution; weights follow from the
ratio of neighbours, over 12 standard deviations (and 40 more) around the mean, outside of which less
than 1e-30 lies.  So the matrix takes a few aggregations of one small row for each part, and no draw waits for more than FANOUT others.

A shard may be larger than a task: in step 3 the second number's range is cut into buckets, so many that one has about
``BUCKET`` bytes; rows are exchanged by (shard, bucket), numbered inside, and begin behind the rows of the buckets before, which come from counts.
What one key holds plays no part, since rows go by random numbers; equal rows are drawn one by one.

Everything random is written with the rows before it is used, so lost executors repeat the same. The numbers depend on
the seed and on how the input is partitioned.  The matrix has at most ``MOST_CELLS`` cells (parts are merged to keep that), so it is broadcast.

Cases: a null text has no bytes (size 1, CRC of nothing); null and repeated doc_ids are rows like any others;
columns of any name and type pass as they are in ``shuffle``; fewer rows than shards leave shards empty; an empty table gives no row; a very long
text is one row of one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

FANOUT = 64
MOST_CELLS = 1 << 20
#: Bytes of text in a bucket of a shard, and the least number of buckets.
BUCKET, LEAST_BUCKETS = 32 << 20, 64


def uniform(*keys) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) * F.lit(2.0**-53)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` rows out of ``total``, ``marked`` of them marked, are marked: the value at ``u`` of the cumulative distribution."""

    def spread(v: Column) -> Column:
        share = v["marked"] / F.greatest(v["total"], F.lit(1))
        mean = v["drawn"] * share
        return F.struct(v.alias("v"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), mean * (1 - share) * (v["total"] - v["drawn"]) / F.greatest(v["total"] - 1, F.lit(1)))).alias("dev"))

    def bounds(d: Column) -> Column:
        v = d["v"]
        lo = F.greatest(F.lit(0).cast("bigint"), v["drawn"] + v["marked"] - v["total"], F.floor(d["mean"] - 12 * d["dev"]).cast("bigint") - 40)
        hi = F.least(v["drawn"], v["marked"], F.ceil(d["mean"] + 12 * d["dev"]).cast("bigint") + 40)
        others = v["total"] - v["marked"] - v["drawn"]
        return F.struct(v["marked"].cast("double").alias("m"), v["drawn"].cast("double").alias("d"), others.cast("double").alias("o"), lo.alias("lo"), hi.alias("hi"), v["u"].alias("u"))

    def inverted(x: Column) -> Column:
        # weight(k + 1) / weight(k); weights begin at 1 for lo, so that the largest stays far below a double's limit
        step = lambda s, k: (s["w"] * (x["m"] - k) * (x["d"] - k) / ((k + 1) * (x["o"] + k + 1))).alias("w")
        ks = F.sequence(x["lo"], x["hi"])
        nothing = [F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")]
        whole = F.aggregate(ks, F.struct(*nothing), lambda s, k: F.struct(step(s, k), (s["sum"] + s["w"]).alias("sum")), lambda s: s["sum"])

        def found(bar: Column) -> Column:
            passed = lambda s, k: F.when(s["sum"] + s["w"] <= bar, F.least(k + 1, x["hi"])).otherwise(s["at"]).alias("at")
            return F.aggregate(ks, F.struct(*nothing, x["lo"].alias("at")), lambda s, k: F.struct(step(s, k), (s["sum"] + s["w"]).alias("sum"), passed(s, k)), lambda s: s["at"])

        return F.when(x["lo"] >= x["hi"], x["lo"]).otherwise(_let(x["u"] * whole, found))

    given = F.struct(total.alias("total"), marked.alias("marked"), drawn.alias("drawn"), u.alias("u"))
    return _let(_let(_let(given, spread), bounds), inverted)


def _split(children: Column, counts: Column, seed: int, level: int) -> Column:
    """Arrays of counts by shard, one for each child (id, rows), that add up to ``counts``; the last child takes what is left."""
    longs = F.array().cast("array<bigint>")

    def child(state, c):
        def shard(s, k, left):
            own = F.element_at(left, k + 1)
            drawn = hypergeometric(s["total"], own, s["need"], uniform(F.lit(seed), F.lit(level), c["id"], k))
            return _let(drawn, lambda got: F.struct((s["need"] - got).alias("need"), (s["total"] - own).alias("total"), F.concat(s["given"], F.array(got)).alias("given")))

        def given(left):
            start = F.struct(c["rows"].alias("need"), F.aggregate(left, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), longs.alias("given"))
            return F.aggregate(F.sequence(F.lit(0), F.size(left) - 1), start, lambda s, k: shard(s, k, left), lambda s: s["given"])

        return _let(given(state["left"]), lambda g: F.struct(F.zip_with(state["left"], g, lambda x, y: x - y).alias("left"), F.concat(state["out"], F.array(g)).alias("out")))

    begin = F.struct(counts.alias("left"), F.array().cast("array<array<bigint>>").alias("out"))
    return F.aggregate(children, begin, child, lambda s: s["out"])


def communication(parts: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """(part, counts array<bigint>): how many of its rows each part gives to each shard.

    ``parts`` has (part, rows), one row for each part; ``sizes`` are the shards' and add up to all rows.
    """
    top = parts.agg(F.max("part")).first()[0]
    if top is None:
        return parts.select("part", F.array().cast("array<bigint>").alias("counts"))
    levels = [parts.select(F.col("part").cast("bigint").alias("id"), F.col("rows").cast("bigint").alias("rows"))]
    while top > 0:
        top //= FANOUT
        levels.append(levels[-1].groupBy(F.floor(F.col("id") / FANOUT).cast("bigint").alias("id")).agg(F.sum("rows").alias("rows")))
    drawn = levels.pop().select("id", F.array(*[F.lit(int(n)).cast("bigint") for n in sizes]).alias("counts"))
    while levels:
        own = levels.pop()
        children = own.groupBy(F.floor(F.col("id") / FANOUT).cast("bigint").alias("up")).agg(F.array_sort(F.collect_list(F.struct("id", "rows"))).alias("children"))
        both = drawn.join(children, F.col("id") == F.col("up")).select("children", _split(F.col("children"), F.col("counts"), seed, len(levels)).alias("out"))
        each = both.select(F.explode(F.arrays_zip("children", "out")).alias("x"))
        drawn = each.select(F.col("x.children.id").alias("id"), F.col("x.out").alias("counts"))
    return drawn.withColumnRenamed("id", "part")


def even(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart."""
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def shuffle(docs: DataFrame, shards: int, seed: int = 7, sizes: list[int] | None = None, weight: Column | None = None) -> DataFrame:
    """(row, shard, slot) with all columns of ``docs`` in the struct ``row``.

    ``sizes`` are the shards' rows (near equal if not given). ``weight`` is a row's bytes, for the number of buckets; by default those of ``text``.
    """
    weight = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) if weight is None else weight
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    merged = docs.select(row.alias("row"), weight.cast("bigint").alias("bytes")).coalesce(max(1, MOST_CELLS // shards))
    permuted = merged.withColumns({"local": F.rand(seed), "again": F.rand(seed + 1)}).sortWithinPartitions("local")
    numbered = permuted.withColumn("at", F.monotonically_increasing_id()).select("row", "bytes", "again", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at"))
    stored = materialise(numbered)

    parts = materialise(stored.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes")))
    rows, total = parts.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    sizes = even(rows, shards) if sizes is None else sizes
    if sum(sizes) != rows or len(sizes) != shards:
        raise ValueError(f"sizes of {shards} shards that add up to {rows} rows are needed")
    matrix = materialise(communication(parts, sizes, seed))

    # the first shard whose rows of this part end behind the row
    upto = F.transform(F.sequence(F.lit(1), F.size("counts")), lambda k: F.aggregate(F.slice("counts", 1, k), F.lit(0).cast("bigint"), lambda s, x: s + x))
    ends = F.broadcast(matrix.select("part", upto.alias("ends")))
    buckets = max(LEAST_BUCKETS, -(-total // (shards * BUCKET)))
    dealt = stored.join(ends, "part").withColumns({"shard": F.size(F.filter("ends", lambda e: e <= F.col("at"))), "bucket": F.floor(F.col("again") * buckets).cast("int")}).drop("ends")
    counts = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # a window over counts: one small row for each bucket
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("again", "part", "at"))
    ranked = dealt.select("row", "shard", "bucket", (inside - 1).alias("rank"))
    return ranked.join(bases, ["shard", "bucket"]).select("row", "shard", (F.col("base") + F.col("rank")).alias("slot"))


def write(docs: DataFrame, path: str, shards: int, seed: int = 7) -> None:
    """Parquet files below ``path``/shard=k, their rows with slot in ascending order inside each file."""
    out = shuffle(docs, shards, seed)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def assignment(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), taken from the rows in their shards."""
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    return shuffle(docs.select("doc_id", "text"), shards, seed).select(
        F.col("row.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
