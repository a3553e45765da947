import hashlib
import os
import random
import struct
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(__file__))
from helpers import TEXTS, docs, empty, near_components, shingles  # noqa: E402

from gridwarden.llm import components, gif, minhash, skew  # noqa: E402


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for n, common in ((3, 2), (50, 40), (1500, 900)):
        a, b = pool[:n], np.concatenate([pool[:common], pool[2000 : 2000 + n - common]])
        truth = common / (2 * n - common)
        x, y = minhash.sketch(np.unique(a)), minhash.sketch(np.unique(b))
        assert (x != np.iinfo(np.uint64).max).all()
        assert abs((x == y).mean() - truth) < 0.2


def test_edge_cases(spark):
    rows = minhash.near_duplicates(docs(spark)).collect()
    assert len(rows) == len(TEXTS) + 1
    want = near_components(dict(enumerate(TEXTS)))
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(shingles(TEXTS[r.doc_id])), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(empty(spark)).count() == 0
    none = docs(spark).withColumn("doc_id", docs(spark).doc_id.substr(9, 1).cast("bigint")) if False else spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id bigint, text string")
    got = minhash.near_duplicates(none).collect()
    assert len(got) == 3 and all(r.kept for r in got)


@pytest.mark.parametrize("small", [0, 24])
def test_groups_against_all_pairs(spark, monkeypatch, small):
    """A crowd of near copies around the threshold, with both ways of settling a bucket."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    random.seed(5)
    base = [f"w{i}" for i in range(120)]
    rows = {}
    for i in range(90):
        w = list(base)
        for _ in range(random.choice((1, 2, 3, 5, 8))):
            w[random.randrange(len(w))] = f"n{random.random()}"
        rows[i] = " ".join(w)
    for i in range(90, 120):
        rows[i] = " ".join(base[:40] + [f"z{i}_{k}" for k in range(80)])
    rows[130] = rows[3]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")).collect()}
    assert got == near_components(rows)


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for a, b in edges if a is not None and a != b for n in (a, b)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.integers(1, 40))
def test_code_streams(data, times):
    data = data * times
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def simple(frames, palette, size, local=None):
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x80 | 0, 0, 0) + palette
    for delay, disposal, clear, box, least, stream, interlaced in frames:
        flags = disposal << 2 | (clear is not None)
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", flags, delay, clear or 0, 0)
        out += b"\x2c" + struct.pack("<HHHHB", *box, 0x40 * interlaced) + bytes([least]) + gif._blocks(stream)
    return out + b"\x3b"


def literal(samples):
    """A stream of 2-bit samples with a clear code before each second one."""
    bits = at = 0
    for i, s in enumerate(samples):
        if i % 2 == 0:
            bits |= 4 << at
            at += 3
        bits |= s << at
        at += 3
    bits |= 5 << at
    return bits.to_bytes((at + 3 + 7) // 8, "little")


def test_disposal_and_transparency():
    red_green = bytes([255, 0, 0, 0, 255, 0])
    frames = [
        (5, 1, None, (0, 0, 2, 2), 2, literal([0, 0, 0, 0]), 0),
        (7, 3, 0, (0, 0, 2, 1), 2, literal([1, 0]), 0),
        (0, 2, None, (1, 1, 1, 1), 2, literal([1]), 0),
        (1, 0, 1, (0, 0, 1, 1), 2, literal([1]), 0),
    ]
    colour = lambda f: ["".join("-" if p[3] == 0 else "R" if p[0] else "G" for p in row) for row in f.canvas]
    shown = [(colour(f), f.start_ms, f.delay_ms, int(f.histogram().sum())) for f in gif.decode(simple(frames, red_green, (2, 2)))]
    assert shown == [(["RR", "RR"], 0, 50, 4), (["GR", "RR"], 50, 70, 4), (["RR", "RG"], 120, 0, 4), (["RR", "R-"], 120, 10, 3)]
    rows = next(gif.decode(simple([(0, 0, None, (0, 0, 1, 8), 2, literal([0, 0, 0, 0, 1, 1, 1, 1]), 1)], red_green, (1, 8))))
    assert rows.samples[:, 0].tolist() == [0, 1, 0, 1, 0, 1, 0, 1]


def test_damaged_headers_take_no_memory():
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"
    outside = simple([(0, 0, None, (0, 0, 60000, 60000), 2, literal([0]), 0)], bytes(6), (2, 2))
    for data in (huge, outside, b"", b"GIF89a", gif.store_payload(bytes(64))[:700]):
        with pytest.raises(ValueError):
            list(gif.decode(data))


def test_media_columns(spark):
    good = gif.store_payload(bytes(range(64)) * 3)
    df = spark.createDataFrame([(1, good, "x"), (2, None, "x"), (3, good[:-30], "x"), (4, b"no gif", "x")], "doc_id bigint, media binary, error string")
    rows = gif.frames(df).collect()
    assert sorted({r.doc_id for r in rows if r.error}) == [3, 4] and [r.samples for r in rows if r.doc_id == 1] == [bytes(range(64)) * 3]
    assert "samples" not in gif.frames(df, samples=False).columns
    damaged = df.selectExpr("doc_id as row", "doc_id", "1L as n_bytes", "media")
    got = {r.doc_id: r for r in gif.features(gif.stored_frames(damaged)).collect()}
    assert got[2].media_sha256 is None and got[2].feature is None and got[4].n_frames == 0 and got[4].media_bytes == 6 and got[1].feature == "frames=1;ms=100;colours=0:192"
    texts = [*TEXTS, "long " * 40000]
    made = gif.stored_frames(gif.stored(docs(spark, texts)))
    timed = made.filter("frame_no is not null").orderBy("row", "frame_no").collect()
    long = [r for r in timed if r.doc_id == len(TEXTS)]
    assert [(r.frame_no, r.start_ms, r.delay_ms) for r in long] == [(i, 100 * i, 100) for i in range(len(long))] and len(long) == 4
    for r in gif.features(made).collect():
        n, want = gif.payload(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert r.n_frames == -(-len(want) // (64 * 1024)) and r.duration_ms == 100 * r.n_frames
        # the screen is as high as the first frame, so a shorter last frame shows older rows below it
        assert r.media_sha256 == hashlib.sha256(gif.store_payload(want)).hexdigest()
    assert gif.features(gif.stored_frames(gif.stored(empty(spark)))).count() == 0


def test_joins_on_heavy_keys(spark, monkeypatch):
    """A key with half of all rows, with few and with many keys that count as heavy."""
    random.seed(6)
    left = [(0 if random.random() < 0.5 else random.randrange(1, 60), i) for i in range(800)] + [(None, 900), (77, 901)]
    counts = {}
    for k, _ in left:
        counts[k] = counts.get(k, 0) + 1
    right = [(k, f"r{k}", n) for k, n in counts.items() if k is not None and k != 77]
    a, b = spark.createDataFrame(left, "k int, i int"), spark.createDataFrame(right, "k int, name string, n bigint")
    for shares in (1, 3, 1000):
        monkeypatch.setattr(skew, "SHARES", shares)
        inner = sorted((k, i, f"r{k}") for k, i in left if k is not None and k != 77)
        assert sorted(map(tuple, skew.join_counted(a, b, "k").select("k", "i", "name").collect())) == inner
        outer = {r.i: r.name for r in skew.join_counted(a, b, "k", "left").collect()}
        assert len(outer) == len(left) and outer[900] is None and outer[901] is None and all(outer[i] == f"r{k}" for k, i, _ in inner)
        assert sorted(map(tuple, skew.salted(a, b.drop("n"), "k", "i").select("k", "i", "name").collect())) == inner
    assert skew.join_counted(a.limit(0), b.limit(0), "k").count() == 0
