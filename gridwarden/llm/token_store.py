"""Token ids in a content-addressed store.

Writing.  Each text is encoded, and a rolling hash over the last 32 ids cuts its
id stream into chunks wherever the hash ends in zeros, so that equal passages give
equal chunks wherever they stand.  A chunk is addressed by the SHA-256 of its ids
and stored once.  A document is a recipe: the digests of its chunks in order, and
the root of a Merkle tree over them.

Layout, below one folder:

* ``parts/kind=0``: chunks (key = digest, n, payload = ids as little-endian
  16-bit numbers, or 32-bit ones for a larger vocabulary, compressed by zstd).
* ``parts/kind=1``: recipes as they were written.
* ``index``: recipes in ascending order of doc_id, range by range, with ``start``, the
  number of ids of all documents before.

Reading.  Every stored chunk is decompressed and hashed again; a digest that
differs from its address, a missing chunk or a recipe whose Merkle root does not
follow from the chunks' own digests raises an error.  ``read_ids`` rebuilds the
id arrays.  ``read_checksums`` rebuilds only CRC-32 and count of each document:
the CRC of a concatenation follows from CRC and length of its parts, so that ids
are not shuffled again.

Cases: a null text is empty; an empty text has no ids of its own, only the end id; rows
with equal doc_id are kept, ordered by their Merkle root; a null doc_id comes first;
extra columns are ignored; an empty table gives an empty store; a very long text is a slice of its own and, like any, chunks of MOST ids at most.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .skew import heavy
from .store import returning, shared_dir

#: Chunk sizes in ids: at least, on average about LEAST + 2 ** BITS, at most.
LEAST, BITS, MOST = 128, 10, 4096
_PART = "kind int, key binary, n bigint, payload binary, doc_id bigint, chunks array<struct<digest:binary,n:int>>, root binary"


def gear(n: int) -> np.ndarray:
    """A fixed pseudo-random 64-bit number for each id below ``n`` (splitmix64)."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def rolling(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """h[i] = sum of table[ids[i - j]] << j for j < 32, by doubling the window five times."""
    h = table[ids]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint64(k))
    return h


def cuts(hashes: np.ndarray) -> list[int]:
    """Ends of the chunks of one document with these rolling hashes.

    The smallest chunk exceeds the window, so a cut never depends on what stands
    before the document.
    """
    n, mask = len(hashes), np.uint64(((1 << BITS) - 1) << 20)
    ends, last = [], 0
    for p in (np.flatnonzero((hashes & mask) == 0) + 1).tolist():
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p - last >= LEAST and p < n:
            ends.append(p)
            last = p
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, n]


def merkle(leaves: list[bytes]) -> bytes:
    """Root over the leaves; an odd node moves up as it is; leaves and inner nodes are told apart."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        above = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = above + ([level[-1]] if len(level) % 2 else [])
    return level[0] if level else hashlib.sha256(b"").digest()


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, wide: bool = False) -> None:
    """Encode ``text`` of every row, append ``end_id`` and write a store at ``path``."""
    spark = docs.sparkSession
    unit = "<u4" if wide else "<u2"

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        task, row = TaskContext.get().partitionId(), 0
        enc, press = tokens.library(tokenizer), zstandard.ZstdCompressor(level=1)
        table, seen = gear(1 << 16), set()
        for whole in batches:
            for b in tokens.slices(whole):
                ids, bounds = enc.encode(b.column(1))
                hashes = rolling(ids % (1 << 16), table)
                out = {k: [] for k in ("kind", "key", "n", "payload", "doc_id", "chunks", "root")}

                def put(*values):
                    for k, v in zip(out, values):
                        out[k].append(v)  # noqa: B023

                for k, doc in enumerate(b.column(0).to_pylist()):
                    lo, hi = int(bounds[k]), int(bounds[k + 1])
                    own = np.append(ids[lo:hi], np.uint32(end_id))
                    ends, last, recipe = cuts(np.append(hashes[lo:hi], np.uint64(1 << 20))), 0, []
                    for at in ends:
                        part = own[last:at]
                        digest = hashlib.sha256(part.astype("<u4").tobytes()).digest()
                        recipe.append({"digest": digest, "n": at - last})
                        if digest not in seen:  # most copies end here; the rest go before the table is written
                            if len(seen) > 200_000:
                                seen.clear()
                            seen.add(digest)
                            if not wide and int(part.max()) > 65535:
                                raise ValueError("ids above 65535 need wide=True")
                            put(0, digest, at - last, press.compress(part.astype(unit).tobytes()), None, None, None)
                        last = at
                    put(1, b"%d %d" % (task, row), len(own), None, doc, recipe, merkle([x["digest"] for x in recipe]))
                    row += 1
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema(
        [("kind", pa.int32()), ("key", pa.binary()), ("n", pa.int64()), ("payload", pa.binary()), ("doc_id", pa.int64()),
         ("chunks", pa.list_(pa.struct([("digest", pa.binary()), ("n", pa.int32())]))), ("root", pa.binary())]
    )
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(returning(run), _PART)
    rows.dropDuplicates(["kind", "key"]).write.partitionBy("kind").parquet(f"{path}/parts")
    _write_index(spark, path)


def _parts(spark: SparkSession, path: str, kind: int) -> DataFrame:
    return spark.read.schema(_PART).parquet(f"{path}/parts").filter(F.col("kind") == kind)


def _write_index(spark: SparkSession, path: str) -> None:
    """Recipes by range of doc_id; inside a range, and from range to range, ids are counted up."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        _parts(spark, path, 1)
        .select("doc_id", "root", "key", "n", "chunks")
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "root", "key")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root", "key")
        .withColumn("part", F.spark_partition_id())
        .write.parquet(f"{path}/ranges")
    )
    ranges = spark.read.parquet(f"{path}/ranges")
    # one row for each range, so this window over all of them is small at any size of input
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("part").agg(F.sum("n").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root", "key").rowsBetween(Window.unboundedPreceding, -1)
    (
        ranges.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(F.broadcast(totals), "part")
        .select("doc_id", "key", (F.col("base") + F.col("inner")).alias("start"), F.col("n").alias("n_tokens"), "chunks", "root", "part")
        .sortWithinPartitions("part", "start")
        .write.parquet(f"{path}/index")
    )


def _checked(stored: DataFrame, wide: bool, with_ids: bool) -> DataFrame:
    """(digest, n, crc[, ids]) of the ``stored`` chunks (key, n, payload), from their bytes; raises if they are not what the address says."""
    unit = "<u4" if wide else "<u2"
    ids_type = ", ids array<int>" if with_ids else ""

    def run(batches):
        import zstandard

        press = zstandard.ZstdDecompressor()
        for b in batches:
            digests, counts, crcs, lists = [], [], [], []
            for key, n, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids = np.frombuffer(press.decompress(payload), unit).astype("<u4")
                raw = ids.tobytes()
                if (digest := hashlib.sha256(raw).digest()) != key or len(ids) != n:
                    raise ValueError(f"chunk {key.hex()} does not hold what its address says")
                digests.append(digest)
                counts.append(n)
                crcs.append(zlib.crc32(raw))
                if with_ids:
                    lists.append(ids.astype(np.int32))
            columns = [pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(lists, pa.list_(pa.int32()))] if with_ids else []), ["digest", "n", "crc", "ids"][: 3 + with_ids])

    return stored.mapInArrow(returning(run), "digest binary, n bigint, crc bigint" + ids_type)


def _assembled(spark: SparkSession, path: str, wide: bool, with_ids: bool) -> DataFrame:
    """Per index row the checked chunks in order; a missing one keeps its row with nulls."""
    index = spark.read.parquet(f"{path}/index")
    refs = index.select("key", F.posexplode("chunks").alias("pos", "chunk")).select("key", "pos", F.col("chunk.digest").alias("digest"))
    stored = _parts(spark, path, 0).select("key", "n", "payload")
    checked = lambda some: _checked(some, wide, with_ids)
    # a passage that very many documents share is one key: its chunk, of at most MOST ids, goes to the references instead
    hot = heavy(refs.groupBy("digest").agg(F.count(F.lit(1)).alias("n")))
    if hot is None:
        found = refs.join(checked(stored), "digest", "left")
    else:
        keys = F.broadcast(hot[0].select("digest"))
        # parted before their bytes are read, so that each chunk is checked once
        of = F.col("key") == F.col("digest")
        often = refs.join(keys, "digest", "left_semi").join(F.broadcast(checked(stored.join(keys, of, "left_semi"))), "digest", "left")
        found = often.unionByName(refs.join(keys, "digest", "left_anti").join(checked(stored.join(keys, of, "left_anti")), "digest", "left"))
    fields = ["pos", "digest", "n", "crc", *(["ids"] if with_ids else [])]
    per_doc = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("parts"))
    return index.drop("chunks", "part").join(per_doc, "key")


def shifts() -> list[int]:
    """x^(32 n) modulo the CRC-32 polynomial, reflected, for n = 0..MOST: appending n ids multiplies by it."""
    out, value = [], 0x80000000
    for _ in range(MOST + 1):
        out.append(value)
        for _ in range(32):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
    return out


def times(a: int, b: int) -> int:
    """Product of two reflected polynomials modulo that of CRC-32."""
    product = 0
    while a:
        if a & 0x80000000:
            product ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return product


def read_checksums(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_chunks, merkle_root) of every document, from the stored bytes."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, n_chunks int, merkle_root string"

    def run(batches):
        powers = shifts()
        for b in batches:
            out = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "merkle_root")}
            for doc, start, n, root, parts in zip(*(b.column(i).to_pylist() for i in range(5))):
                if any(p["crc"] is None for p in parts) or sum(p["n"] for p in parts) != n or merkle([p["digest"] for p in parts]) != root:
                    raise ValueError(f"document {doc} cannot be rebuilt from its chunks")
                crc = 0
                for p in parts:
                    crc = times(powers[p["n"]], crc) ^ p["crc"] if crc else p["crc"]
                for k, v in zip(out, (doc, start, n, crc, len(parts), root.hex())):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_chunks", pa.int32()), ("merkle_root", pa.string())])
    return _assembled(spark, path, wide, False).select("doc_id", "start", "n_tokens", "root", "parts").mapInArrow(returning(run), schema)


def read_ids(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """(doc_id, start, token_ids) of every document."""
    whole = _assembled(spark, path, wide, True)
    bad = F.exists("parts", lambda p: p["crc"].isNull()) | (F.aggregate("parts", F.lit(0).cast("bigint"), lambda s, p: s + p["n"]) != F.col("n_tokens"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    return whole.select("doc_id", "start", F.when(bad, F.raise_error(F.lit("a document cannot be rebuilt"))).otherwise(ids).alias("token_ids"))


def store_and_check(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write a store in the shared folder and return its documents' checksums, read back."""
    path = shared_dir(docs.sparkSession)
    write(docs, tokenizer, path, end_id)
    return read_checksums(docs.sparkSession, path)
