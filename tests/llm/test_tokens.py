import hashlib
import os
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(__file__))
from helpers import TEXTS, docs, empty  # noqa: E402

from gridwarden.llm import bpe, packing, token_store, tokens  # noqa: E402
from gridwarden.llm.queries import vocabulary  # noqa: E402


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@example([":\u058b", "\u208f1\u0558x", "\U0001f6d8\U000323b0"])  # of other classes in other versions of Unicode
@given(st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=30), min_size=1, max_size=4))
def test_both_encoders_are_the_library(texts):
    from tokenizers import Tokenizer

    global _LIB
    _LIB = globals().get("_LIB") or Tokenizer.from_file(vocabulary())
    want = [ids_of(_LIB, t) for t in texts]
    for enc in (tokens.library(vocabulary()), bpe.backtracking(vocabulary())):
        ids, at = enc.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 5)
    enc = tokens.LibraryEncoder(vocabulary())
    for t in TEXTS * 2:
        ids, _ = enc.encode(pa.array([t, t], pa.string()))
        assert ids.tolist() == ids_of(library, t) * 2


def test_slices_keep_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["a" * 10, None, "b" * 50, "c"])], ["i", "t"])
    parts = list(tokens.slices(b, 1, 12))
    assert [x for p in parts for x in p.column(0).to_pylist()] == [1, 2, 3, 4] and len(parts) > 1


def test_encode_then_decode(spark, library):
    got = bpe.encode(docs(spark), vocabulary())
    rows = {r.doc_id: r.token_ids for r in got.collect()}
    assert all(rows[i] == ids_of(library, t) for i, t in enumerate(TEXTS))
    texts = {r.doc_id: r.text for r in bpe.decode(got, vocabulary()).collect()}
    assert all(texts[i] == library.decode(rows[i], skip_special_tokens=False) for i in rows)
    for r in bpe.round_trip_digests(docs(spark), vocabulary()).collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, rows[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.round_trip_digests(empty(spark), vocabulary()).count() == 0


def test_store_rebuilds_every_document(spark, library, tmp_path):
    path = f"file://{tmp_path}/store"
    df = docs(spark)
    token_store.write(df, vocabulary(), path)
    ids = {r.doc_id: r for r in token_store.read_ids(spark, path).collect()}
    sums = sorted(token_store.read_checksums(spark, path).collect(), key=lambda r: r.start)
    assert len(sums) == len(TEXTS) + 1
    at = 0
    for r in sums:
        want = np.array([*ids_of(library, TEXTS[r.doc_id]), 1], "<u4")
        assert ids[r.doc_id].token_ids == want.tolist()
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    assert [r.doc_id for r in sums] == sorted(r.doc_id for r in sums)
    chunks = spark.read.parquet(f"{path}/parts").filter("kind = 0")
    assert chunks.count() == chunks.select("key").distinct().count()
    assert token_store.store_and_check(empty(spark), vocabulary()).count() == 0


def test_store_notices_damage(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write(docs(spark), vocabulary(), path)
    parts = spark.read.parquet(f"{path}/parts").collect()
    schema = spark.read.parquet(f"{path}/parts").schema
    bad = [r if r.kind or r.n < 5 else type(r)(**{**r.asDict(), "key": b"0" * 32}) for r in parts]
    spark.createDataFrame(bad, schema).write.partitionBy("kind").parquet(f"file://{tmp_path}/bad/parts")
    spark.read.parquet(f"{path}/index").write.parquet(f"file://{tmp_path}/bad/index")
    with pytest.raises(Exception, match="address"):
        token_store.read_checksums(spark, f"file://{tmp_path}/bad").collect()


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    table = token_store.gear(1 << 16)
    a, b = rng.integers(0, 49000, 20000), rng.integers(0, 49000, 300)
    ends = [set(np.array(token_store.cuts(token_store.rolling(x, table))) - off) for x, off in ((a, 0), (np.concatenate([b, a]), 300))]
    assert len(ends[0] & ends[1]) > 0.8 * len(ends[0])
    one = np.zeros(10000, np.int64)
    sizes = np.diff([0, *token_store.cuts(token_store.rolling(one, table))])
    assert sizes.sum() == 10000 and sizes.max() <= token_store.MOST


def test_crc_of_a_concatenation():
    powers = token_store.shifts()
    a, b = np.arange(77, dtype="<u4"), np.arange(500, dtype="<u4")
    assert token_store.times(powers[500], zlib.crc32(a.tobytes())) ^ zlib.crc32(b.tobytes()) == zlib.crc32(a.tobytes() + b.tobytes())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_patterns_use_every_length(histogram):
    found = packing.patterns(histogram, 64)
    used: dict = {}
    for lengths, count in found:
        assert sum(lengths) <= 64 and count > 0
        for n in lengths:
            used[n] = used.get(n, 0) + count
    assert used == histogram
    assert len(found) <= 3 * len(histogram) + 1


def test_packing_places_every_token_once(spark, library):
    df = docs(spark)
    rows = packing.pack(df, vocabulary(), 2, 64).collect()
    seq, doc = {}, {}
    for r in rows:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        want = np.array([*ids_of(library, TEXTS[r.doc_id]), 2], "<u4")
        assert r.doc_tokens == len(want) and zlib.crc32(want[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        doc[r.doc_id] = doc.get(r.doc_id, 0) + r.length
    for pieces in seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert all(doc[i] == (len(ids_of(library, t)) + 1) * (2 if i == 4 else 1) for i, t in enumerate(TEXTS))
    assert packing.pack(empty(spark), vocabulary()).count() == 0
    assert (packing.padded(1024), packing.padded(1025)) == (1024, 4096)


@pytest.mark.parametrize("histogram", [{2151: 2690}, {1500: 1000}, {2151: 900, 700: 90, 60: 40}, {4000: 50}, {1: 5}, {2100: 2}, {}])
def test_cuts_fill_the_room_of_a_common_length(histogram):
    plan = packing.plan_cuts(histogram)
    slots = packing.Slots(plan)
    lengths = np.concatenate([np.zeros(0, int), *[np.full(c, n) for n, c in histogram.items()]])
    ranks = np.concatenate([np.zeros(0, int), *[np.arange(c) for c in histogram.values()]])
    row, start, length, sequence, offset = slots.place(lengths, ranks)
    assert (np.bincount(row, length, len(lengths)) == lengths).all()
    seen: dict = {}
    for s, o, n in zip(sequence.tolist(), offset.tolist(), length.tolist()):
        seen.setdefault(s, []).append((o, n))
    for parts in seen.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    if sum(histogram.values()) >= 900:
        padding = packing.unfilled(packing.patterns(packing.part_histogram(plan)))
        assert padding <= 0.02 * lengths.sum()


def test_cut_documents_keep_their_ids(spark, library):
    text = "some words that stand for a common text " * 38
    rows = spark.createDataFrame([(i, text) for i in range(40)], "doc_id bigint, text string")
    want = np.array([*ids_of(library, text), 2], "<u4")
    assert 256 < len(want) < 400
    placed = packing.pack(rows, vocabulary(), 2, 512).collect()
    assert any(r.length < len(want) for r in placed)
    for r in placed:
        assert zlib.crc32(want[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert len({r.sequence_id for r in placed}) <= 1.1 * 40 * len(want) / 512 + 1
