import hashlib
import os
import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(__file__))
from helpers import TEXTS, docs, empty  # noqa: E402

from gridwarden.llm import align  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MORE = [*TEXTS, "x ▁y", "▁", " ", "  ", "a ", " a", "a  b   c \n\n d\t e \r\n f", "naïve café 中文 中 \U0001f600 end", "<|endoftext|> <s> </s> <unk> 12 345 I'll don't", "“quoted” — dash  nb 　 wide", "z" * 3000, "mixed 中文" * 200, "qué ñandú " * 4000]


def whole(text):
    """Ids and byte ends of both sides of a whole text, or None."""
    two = align.pair(A, B)
    if not text:
        return None
    raw = (" " + text).encode()
    out = []
    for ids, table in ((two.a.encode(" " + text, add_special_tokens=False).ids, two.a_bytes), (two.b.encode(text), two.b_bytes)):
        if b"".join(table[i] for i in ids) != raw:
            return None
        at, ends = 0, []
        for i in ids:
            at += len(table[i])
            ends.append(at)
        out.append((ids, ends))
    return out


def expected(texts):
    """doc -> contract's values, by walking over bytes of whole texts."""
    made, held = {}, Counter()
    for k, t in texts:
        both = whole(t)
        if both is None:
            made[k] = None
            continue
        (a, ea), (b, eb) = both
        common = sorted(set(ea) & set(eb))
        groups, links, i, j = [], [], 0, 0
        for c in common:
            x, y = ea.index(c, i) + 1, eb.index(c, j) + 1
            groups.append((a[i:x], b[j:y]))
            for m in range(i, x):
                for n in range(j, y):
                    lo_a, lo_b = ea[m - 1] if m else 0, eb[n - 1] if n else 0
                    if lo_a < eb[n] and lo_b < ea[m]:
                        links.append((a[m], b[n]))
            i, j = x, y
        made[k] = (len(a), len(b), groups, links)
        held.update(set(links))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    out = {}
    for k, v in made.items():
        if v is None:
            out[k] = (0, 0, 0, 0, 0, 0, "")
            continue
        n_a, n_b, groups, links = v
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out[k] = (n_a, n_b, len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in align.aligned_documents(df, A, B).collect()}


@settings(max_examples=300, deadline=None)
@example("a ​b ᠎c   d　 e﻿ f \x85 g \x1c h")
@given(st.text(st.sampled_from("ab \n\t\r,.'1é  ’　中\U0001f600ก​﻿\x85\x1c\x00▁"), max_size=40))
def test_units_give_the_tokens_of_the_whole_text(text):
    two = align.pair(A, B)
    units, at = align.cut_units(pa.array([text]))
    names = units.to_pylist()
    assert at.tolist() == [0, len(names)] and "".join(names) == (" " + text if text else "")
    ok, a, b = two.encode(names)
    if ok.all() and text:
        for (ids, n), (want, ends) in zip((a, b), whole(text)):
            assert ids.tolist() == want and n.sum() == len(ids)
            size, cut = (two.a_sizes if ids is a[0] else two.b_sizes)[ids], np.cumsum(n)
            assert np.cumsum(size)[cut - 1].tolist() == np.cumsum([len(x.encode()) for x in names]).tolist()
    else:
        assert whole(text) is None


def test_offsets_of_many_texts():
    texts = ["a b", None, "", "c", " d  e"]
    units, at = align.cut_units(pa.array(texts).slice(0))
    names = units.to_pylist()
    assert [names[i:j] for i, j in zip(at, at[1:])] == [[" a", " b"], [], [], [" c"], ["  d", "  e"]] or "".join(names) == " a b c  d  e"
    assert align.cut_units(pa.array([], pa.string()))[0].to_pylist() == []


def test_texts_of_units(monkeypatch):
    """Written groups against a loop over links."""
    monkeypatch.setattr(align, "WRITTEN", 3)
    rng = random.Random(0)

    class Units:
        def __init__(self, lists):
            self.n = np.array([len(x) for x in lists], np.int64)
            self.at = np.concatenate([[0], np.cumsum(self.n)])
            self.links = np.array([y for x in lists for y in x], np.int64)

    for _ in range(300):
        lists, want = [], []
        for _ in range(rng.randrange(6)):
            own, groups = [], []
            for _ in range(rng.choice([0, 0, 1, 3])):
                a, b = [], []
                for flags in [*rng.choices([1, 2], k=rng.choice([0, 1, 4])), 3]:
                    x, y = rng.randrange(50_000), rng.randrange(32_000)
                    own.append(x << 33 | y << 2 | flags)
                    a += [x] * (flags >> 1)
                    b += [y] * (flags & 1)
                groups.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
            lists.append(own)
            want.append(";".join(groups))
        assert align._texts(Units(lists)) == want


def test_documents_against_whole_texts(spark):
    df = docs(spark, MORE).repartition(5)
    want = expected([*enumerate(MORE), (4, MORE[4])])  # the fixture repeats a row
    assert result(df) == want
    assert sum(v[0] > 0 for v in want.values()) > 15 and any(v[4] < v[3] for v in want.values())


def test_small_blocks_bins_and_a_hot_word(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK", 300)
    monkeypatch.setattr(align, "CELLS", 40)
    texts = ["the " + t for t in ("same words again " * 3, "other words", "quite different ones, these")] * 20 + [None] * 5 + ["w" * 900 + "é" * 300]
    df = docs(spark, texts, clash=False).repartition(3)
    assert result(df) == expected([*enumerate(texts), (4, texts[4])])


def test_empty_tables_and_null_ids(spark):
    assert align.aligned_documents(empty(spark), A, B).count() == 0
    df = spark.createDataFrame([(None, "one two"), (None, None), (7, "one two")], "doc_id bigint, text string")
    rows = sorted(tuple(r) for r in align.aligned_documents(df, A, B).fillna(-1).collect())
    assert [r[0] for r in rows] == [-1, -1, 7] and rows[1][1:] == rows[2][1:] and rows[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_long_tokens_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(align, "BIN", 3)
    with pytest.raises(Exception, match="longer than a bin"):
        align.aligned_documents(docs(spark), A, B).collect()
