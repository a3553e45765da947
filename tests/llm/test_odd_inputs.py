"""Inputs that once lost data or failed: each case has its defined result."""

import os
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from helpers import docs  # noqa: E402

import corpus_pipeline  # noqa: E402
from gridwarden.llm import langid, licences, minhash, tokens, toxicity  # noqa: E402
from gridwarden.llm.queries import vocabulary  # noqa: E402


def test_given_notices_are_looked_for_on_every_line(spark):
    df = docs(spark, ["first\nGPL v2 or later\nlast", "Licensed under MIT", None, "", "x"])
    rows = {r.doc_id: r.notices for r in licences.scan(df, lines=[("GPL", "GPL v2 or later")]).collect()}
    assert rows == {0: "GPL", 1: "", 2: "", 3: "", 4: ""}


def test_texts_are_drawn_by_themselves(spark):
    """Labelled rows without a doc_id, or all of one, are sampled like any others, and copies of a text once."""
    for doc in (None, 1):
        rows = [(doc, f"some words of number {i} here", "en") for i in range(1000)] + [(doc, "one text again and again", "en")] * 1000
        df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
        found = [w for w, _ in langid.training_windows(df, 100)]
        assert len(found) == len(set(found)) and 15 < len(found) < 250
    net = langid.train([b"the words of one", b"die worte von zwei"] * 3, ["en", "de"] * 3)
    out = langid.predict(spark.createDataFrame([(1, "the", 5)], "doc_id int, text string, `a.b` int"), net).first()
    assert out["a.b"] == 5 and out["lang_pred"] in ("en", "de")


def test_rows_of_one_document_have_one_set(spark):
    a, b, c = ("  ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    most = " ".join(a.split()[:38])
    df = spark.createDataFrame([(1, a), (3, b), (5, a), (5, b), (7, c), (8, c), (8, None), (9, most), (9, a), (None, a)], "doc_id bigint, text string").repartition(4)
    rows = minhash.near_duplicates(df).collect()
    root = {(r.doc_id, r.component_id) for r in rows}
    assert root == {(1, 1), (3, 3), (5, 5), (7, 7), (8, 7), (9, 1), (None, None)}
    n = {r.doc_id: r.n_shingles for r in rows}
    assert n[5] == n[1] + n[3] and n[9] == n[1] and len(rows) == 10


def test_one_way_of_splitting(spark):
    texts = ["a b c", " a  b ", "", None, " x y\tx"]
    names, text, chunk = toxicity.chunks_of(pa.array(texts))
    got = [sorted(names[c] for c in chunk[text == i]) for i in range(5)]
    want = [["a b", "c"], ["a", "b"], [], [], ["x", " x", "y"]]
    assert got == [sorted(x) for x in want]
    df = spark.createDataFrame([(i, t, i % 2, "en") for i, t in enumerate(texts) if t is not None], "doc_id bigint, text string, toxic int, kind string")
    assert {r.doc_id: r.words for r in toxicity.described(df).collect()} == {0: 2, 1: 2, 2: 0, 4: 3}


def test_maps_pass_the_pipeline(spark):
    rows = [(1, "one two three four five six", {"k": "b"}, [1.5]), (1, "one two three four five six", {"k": "a"}, [1.5]), (2, "other words in here " * 3, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, extra map<string,string>, `x.y` array<double>")
    for parts in (1, 3):
        out = corpus_pipeline.unique(spark, df.repartition(parts), "")
        assert out.dtypes == df.dtypes
        assert {r.doc_id: r.extra for r in out.collect()} == {1: {"k": "a"}, 2: None}


def test_words_that_come_again_stay(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 6)
    enc = tokens.LibraryEncoder(vocabulary())
    text = lambda i: pa.array([f"the cat {i} sat w{i}"])
    for i in range(20):
        ids, _ = enc.encode(text(i))
        assert ids.tolist() == enc.whole.encode(f"the cat {i} sat w{i}", add_special_tokens=False).ids
    assert {"the", "cat", "sat"} <= set(enc.words.to_pylist()) and len(enc.words) <= 12


def test_language_of_equal_rows(spark):
    """Very long text, ties between labels, one label only."""
    df = spark.createDataFrame([(1, "word " * 100_000, "en"), (2, "word " * 100_000, "en"), (3, None, "en"), (4, "", None)], "doc_id bigint, text string, lang string")
    rows = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df).collect()}
    assert rows[1] == rows[2] and rows[3][0] == rows[4][0] == langid.UNKNOWN and np.isfinite(rows[1][1])
    assert langid.identify(df.limit(0)).count() == 0 and langid.predict(df.select("doc_id", F.col("text")), None).filter("lang_pred <> 'und'").count() == 0
