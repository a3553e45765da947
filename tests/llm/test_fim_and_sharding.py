import hashlib
import math
import os
import re
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from helpers import TEXTS, docs, empty  # noqa: E402

from gridwarden.llm import fim, sharding  # noqa: E402

LONG = ("einé zeile \U0001f600 mit text\n" * 30_000) + "x" * 400_000
MORE = [*TEXTS, "\n", "\n\n\n", "no end", "end\n", "has <S> inside\nsecond", "<<P\n<S\n>M>", LONG]


def plain(doc_id, text):
    """The contract by a regular expression and string slices."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_lines_are_cut_and_rebuilt(spark):
    texts = MORE + ["\n".join(f"l{k} é" for k in range(j)) for j in range(40)]
    rows = fim.restore(fim.transform(docs(spark, texts))).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, texts[r.doc_id])
        assert r.restored == (texts[r.doc_id] or "")
    assert {r.form for r in rows} == {"plain", "spm", "psm"}
    assert fim.digests(empty(spark)).count() == 0
    for r in fim.digests(docs(spark, texts)).collect():
        want = plain(r.doc_id, texts[r.doc_id])[4]
        assert (r.output_sha256, r.restored_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (want, texts[r.doc_id] or ""))


def test_null_id_other_units_and_rates(spark):
    df = spark.createDataFrame([(None, "a b\nc"), (3, "one two  three"), (4, None)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in fim.restore(fim.transform(df, unit="word", spm=0)).collect()}
    assert rows[None].n == 3 and rows[3].n == 3 and rows[4].n == 0 and rows[3].form == "psm" and rows[3].restored == "one two  three"
    assert all(r.form == "plain" for r in fim.transform(df, rate=0).collect())
    with pytest.raises(ValueError, match="unknown unit"):
        fim.transform(df, unit="page")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<PSM>\n aé", max_size=40))
def test_units_cover_every_text(text):
    for unit, pattern in (("line", r"[^\n]*\n|[^\n]+"), ("char", r"(?s:.)")):
        ends = fim.unit_ends(fim.points_of(text), unit).tolist()
        assert [text[a:b] for a, b in zip([0, *ends], ends)] == re.findall(pattern, text)


def test_draws_follow_the_hypergeometric_distribution(spark):
    for total, marked, drawn in ((30, 12, 10), (7, 7, 3), (50, 1, 25), (9, 4, 8), (4000, 1000, 800)):
        n = 20_000
        args = [F.lit(x).cast("bigint") for x in (total, marked, drawn)]
        got = spark.range(n).select(sharding.hypergeometric(*args, sharding.uniform(F.lit(5), F.col("id"))).alias("k")).groupBy("k").count().collect()
        p = {k: math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn) for k in range(max(0, drawn + marked - total), min(marked, drawn) + 1)}
        assert {r.k for r in got} <= set(p)
        often = [k for k in p if n * p[k] >= 5]
        chi = sum((dict(map(tuple, got)).get(k, 0) - n * p[k]) ** 2 / (n * p[k]) for k in often)
        assert chi < len(often) + 5 * math.sqrt(2 * len(often)) + 5


def test_matrix_has_both_sums(spark):
    rng = np.random.default_rng(0)
    rows = [int(x) for x in rng.integers(0, 900, 200)]
    parts = spark.createDataFrame([(3 * i, n) for i, n in enumerate(rows) if n], "part int, rows bigint")
    for sizes in (sharding.even(sum(rows), 16), [sum(rows) - 5, 0, 5], [sum(rows)]):
        got = {r.part: r.counts for r in sharding.communication(parts, sizes, 1).collect()}
        assert {p: sum(c) for p, c in got.items()} == {3 * i: n for i, n in enumerate(rows) if n}
        assert np.array(list(got.values())).sum(0).tolist() == sizes
    assert sharding.communication(parts.limit(0), [0, 0], 1).count() == 0


def test_every_row_lands_once_in_shards_of_exact_size(spark):
    texts = MORE[:-1] + ["the same"] * 300 + [f"text {i}" for i in range(600)]
    for shards in (16, 1, 5):
        rows = sharding.assignment(docs(spark, texts).repartition(7), shards).collect()
        assert sorted(r.doc_id for r in rows) == sorted([*range(len(texts)), 4])
        own = [sorted(r.slot for r in rows if r.shard == k) for k in range(shards)]
        assert all(s == list(range(len(s))) for s in own) and [len(s) for s in own] == sharding.even(len(rows), shards)
        for r in rows:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    assert sharding.assignment(empty(spark)).count() == 0
    assert len({r.shard for r in sharding.assignment(docs(spark, ["a", "b"] * 3)).collect()}) == 7  # fewer rows than shards


def test_shuffle_is_uniform_and_passes_columns(spark):
    """Where rows of three parts go over several shuffles, by tens."""
    seen, times = np.zeros((6, 6)), 10
    for seed in range(times):
        df = spark.range(60, numPartitions=3).select("id", F.lit("x").alias("shard"), F.create_map(F.lit("k"), "id").alias("slot"), F.lit(None).cast("string").alias("a.b"))
        rows = sharding.shuffle(df, 3, seed, weight=F.lit(1)).collect()
        for r in rows:
            assert r.row["slot"] == {"k": r.row["id"]} and r.row["shard"] == "x"
            seen[r.row["id"] // 10, (20 * r.shard + r.slot) // 10] += 1
    assert (seen.sum(0) == 10 * times).all() and (seen.sum(1) == 10 * times).all()
    expected = 10 * times / 6
    assert ((seen - expected) ** 2 / expected).sum() < 25 + 5 * math.sqrt(2 * 25)
    with pytest.raises(ValueError, match="sizes"):
        sharding.shuffle(df, 3, sizes=[1, 2, 3], weight=F.lit(1))


def test_written_shards(spark, tmp_path):
    sharding.write(docs(spark, ["text"] * 40), f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {0: 11, 1: 10, 2: 10, 3: 10}
