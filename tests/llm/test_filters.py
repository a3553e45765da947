import fnmatch
import os
import random
import re
import sys

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from helpers import docs, empty  # noqa: E402
from oracle import same  # noqa: E402

from gridwarden.llm import langid, licences, quality, queries, toxicity, urlfilter  # noqa: E402


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab/.*?", min_size=1, max_size=8), min_size=1, max_size=30), st.lists(st.text("ab/.", max_size=12), min_size=1, max_size=8))
def test_automaton_is_glob_matching(globs, texts):
    got = urlfilter.ShiftAnd(globs).match([t.encode() for t in texts])
    for g, glob in enumerate(globs):
        pattern = "".join({"*": "[^/]*", "?": "."}.get(x, re.escape(x)) if x != "**" else ".*" for x in re.findall(r"\*\*|.", glob))
        for t, text in enumerate(texts):
            # stars that touch count as the widest of them
            assert got[t, g] == bool(re.fullmatch(re.sub(r"(\[\^/\]\*)*(\.\*)(\[\^/\]\*|\.\*)*", ".*", pattern), text)), (glob, text)
    assert fnmatch.fnmatchcase("a", "a")


def test_url_cases(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.NET/en/x?y#z", "http://example.net/fr/", "ftp://example.net", "http://x.org/fr/", "http://evil.com/x.example.net/en/", "http://sub.example.com/de/q", "http://net/", "http://internet/", "a://b://net/x", "http://é.net/" + "x" * 3000]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, None, "clash")], "page_id int, url string, verdict string")
    rules = [urlfilter.host_rule(*r) for r in queries.URL_RULES]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, rules).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[4] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[5][2:] == ("net/", "block") and got[6] == ("example.net", "", None, "allow")
    assert got[7][2] == "org/fr/" and got[8][2] is None and got[9][3] == "block" and got[10][2] == "net/" and got[11][2] is None
    assert got[12][:2] == ("b:", "//net/x") and got[13][2] == "net/"
    assert urlfilter.judge(df.limit(0), rules).count() == 0
    assert urlfilter.judge(df, []).filter("verdict <> 'allow'").count() == 0


def test_sql(spark, sf):
    for name in queries.SQL:
        same(queries.QUERIES[name](spark, sf), queries.SQL[name], sf)


def repeated_words(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    return len({i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)})


def test_quality_against_brute_force(spark):
    random.seed(2)
    texts = [" ".join(random.choice("ab") for _ in range(random.randint(0, 40))) for _ in range(60)] + ["x y z " * 500, None, "", "a\nb\na\n \nA"]
    df = docs(spark, texts)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), repeated_words(t)), t
    assert got[len(texts) - 1].n_dup_lines == 1
    assert quality.judge(empty(spark)).count() == 0


def normal(line):
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[0-9]", "0", line.lower())))


def removed(rows, share, least):
    """(doc_id, text, host) -> {doc_id: (removed line numbers, words in them)}, by counting distinct documents in plain sets."""
    hosts, held = {}, {}
    for i, text, host in rows:
        hosts.setdefault(host, set()).add(i)
        for line in (text or "").split("\n"):
            if normal(line):
                held.setdefault((host, normal(line)), set()).add(i)
    out = {}
    for i, text, host in rows:
        at = [k for k, x in enumerate((text or "").split("\n")) if normal(x) and len(held[host, normal(x)]) > max(least, share * len(hosts[host]) / 100)]
        out[i, host] = (at, sum(len(normal((text or "").split("\n")[k]).split(" ")) for k in at))
    return out


def test_frequent_lines_against_brute_force(spark):
    random.seed(4)
    pool = [f"Line {k} of\tthe site" for k in range(12)] + ["UNIQUE words here", "", " \x0b ", "123 a", "456 A"]
    rows = []
    for i in range(150):
        host = random.choice(["h", "h", "k", None])
        rows.append((i, "\n".join(random.choice(pool) if random.random() < 0.3 else f"own {i} x{random.random()}" for _ in range(random.randint(1, 6))), host))
    rows += [(i, t, "k") for i, t, _ in rows[:20]] + rows[5:9] + [(None, "Line 3 of the site\nZ", "k"), (900, None, "h"), (901, "", "h")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id int, text string, source string, removed_words string, _hit int")
    for share, least in ((5, 5), (20, 2), (1, 0)):
        want = removed([(i, t, h or "") for i, t, h in rows], share, least)
        got = quality.clean(df, share=share, least=least).collect()
        assert len(got) == len(rows)
        for r in got:
            at = want[r.doc_id, r.source or ""][0]
            assert (r.removed_lines or []) == at
            if r.text is not None:
                assert r.clean_text == "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in at)
        judged = quality.judge(df, share=share, least=least).collect()
        assert sorted(x.removed_words for x in judged) == sorted(want[i, h or ""][1] for i, _, h in rows)


def test_depleted_documents_are_rejected(spark):
    line = " ".join(f"common{k}" for k in range(72))
    own = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}x{k}" for k in range(80))
    rows = [(i, line + f"\n{own(i)}" if i < 10 else f"{line.upper()}\nfew words {own(i)[:2]}" if i < 20 else own(i), "h") for i in range(100)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert all(got[i].removed_words == 72 and got[i].kept for i in range(10))
    assert not any(got[i].kept or got[i].base_failed for i in range(10, 20))
    assert all(got[i].removed_words == 0 and got[i].kept for i in range(20, 100))


def test_licences(spark):
    mit = dict(licences.TEXTS)["MIT"]
    noisy = "Copyright (c) 1999 Some Body\n\n" + mit.upper().replace(",", " , ").replace("\n", "\n\n   ")
    df = docs(spark, [noisy, mit + " more", "x\nReleased under the MIT License.\nLICENSED UNDER CC BY-NC 4.0", None, "", "!!!"])
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert got[0].license_id == "MIT" and got[1].license_id is None
    assert got[2].notices == "CC-BY-NC-4.0,MIT" and got[3].license_id is None and got[3].canonical_sha256 == got[4].canonical_sha256 == got[5].canonical_sha256
    assert licences.scan(empty(spark)).count() == 0


def test_notices_follow_a_rule(spark):
    """Names and phrases that no list holds together; what names no known licence, or says more, is no notice."""
    given = {
        "This software is licensed under the terms of the Mozilla Public Licence, v2.0": "MPL-2.0", "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "Available under the Boost Software License 1.0.": "BSL-1.0",
        "Published under a Creative Commons Attribution-ShareAlike 3.0 Unported License": "CC-BY-SA-3.0", "Distributed under the GNU LGPL v3": "LGPL-3.0", "Licensed under the Secret License": "",
        "We do not know what is licensed under the MIT License.": "", "MIT License": "", "Released under the BSD 3-Clause License": "BSD-3-Clause",
    }
    got = {r.doc_id: r.notices for r in licences.scan(docs(spark, [f"a b\n  {x}  \nc" for x in given])).collect()}
    assert [got[i] for i in range(len(given))] == list(given.values())
    ours = spark.createDataFrame([(0, "some terms, of ours"), (1, "Under our licence")], "doc_id int, text string")
    own = licences.scan(ours, texts=[("own", "Some TERMS of ours")], digests=[], lines=[("own-line", "under our license")]).collect()
    assert {r.doc_id: (r.license_id, r.notices) for r in own} == {0: ("own", ""), 1: (None, "own-line")}


def test_whole_long_licences(spark):
    """Published texts that this machine has, in other case and layout, with another holder's line and after the end of their terms."""
    folder, given = "/usr/share/common-licenses", []
    for name, key in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if os.path.exists(f"{folder}/{name}"):
            with open(f"{folder}/{name}", encoding="utf-8") as f:
                text = f.read()
            given += [(key, text), (key, "Copyright 2031 Somebody Else\n" + text.upper()), (key, text.replace("\n\n", "\n\n\n").replace("\n", "\r\n    ").replace('"', "\u201d").replace("license", "licence")), (None, text + "\nand more")]
            end = text.find("END OF TERMS AND CONDITIONS")
            given += [(key, text[:end])] * (end > 0)
    rows = [(i, t) for i, (_, t) in enumerate(given)]
    got = {r.doc_id: r.license_id for r in licences.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [got[i] for i in range(len(given))] == [k for k, _ in given]


def test_licence_titles_and_lists(spark):
    plain = dict(licences._PLAIN)
    bsd = plain["BSD-3-Clause"]
    given = ["BSD 3-Clause License\n\nCopyright (c) 2020, A\n\n" + bsd, "ISC License\n" + plain["ISC"], "BSD Zero Clause License\n" + plain["0BSD"], "zlib License\n" + plain["Zlib"]]
    given += [re.sub(r"(?m)^[0-9]\. ", "* ", bsd), "BSD 3-Clause License\n" + bsd.replace("1. ", "(a) ").replace("2. ", "(b) ").replace("3. ", "(c) ")]
    got = {r.doc_id: r.license_id for r in licences.scan(docs(spark, given)).collect()}
    assert [got[i] for i in range(6)] == ["BSD-3-Clause", "ISC", "0BSD", "Zlib", "BSD-3-Clause", "BSD-3-Clause"]


def test_gradients_of_the_network():
    """Back-propagation against finite differences of the same loss."""
    rng = np.random.default_rng(1)
    d = langid.Direction(rng.standard_normal((12, 256)) * 0.3, rng.standard_normal((12, 4)) * 0.3)
    d = langid.Direction(d.table.astype(np.float32), d.recurrent.astype(np.float32))
    x, live = langid._matrix([b"hello", b"abc"])
    w = rng.standard_normal((len(x), 4, 2)).astype(np.float32)
    states, memo = langid._run(d, x, live, True)
    grad = langid._back(d, x, live, memo, w)
    for name, at in (("recurrent", (1, 2)), ("recurrent", (5, 0)), ("recurrent", (9, 3)), ("table", (3, ord("l"))), ("table", (10, ord("a")))):
        sides = []
        for eps in (1e-2, -1e-2):
            m = langid.Direction(d.table.copy(), d.recurrent.copy())
            getattr(m, name)[at] += eps
            sides.append(float((langid._run(m, x, live)[0] * w).sum()))
        assert abs((sides[0] - sides[1]) / 2e-2 - getattr(grad, name)[at]) < 2e-2


def test_inference_is_a_plain_loop_over_bytes():
    """Batched windows against one byte at a time."""
    rng = np.random.default_rng(5)
    make = lambda: langid.Direction(rng.standard_normal((3 * langid.HIDDEN, 256)).astype(np.float32), rng.standard_normal((3 * langid.HIDDEN, langid.HIDDEN)).astype(np.float32))
    net = langid.Network(["a", "b", "c"], make(), make(), rng.standard_normal((3, 2 * langid.HIDDEN)).astype(np.float32), rng.standard_normal((3, 1)).astype(np.float32))
    sigmoid = lambda a: 1 / (1 + np.exp(-a))

    def states(d, raw):
        h, out, n = np.zeros(langid.HIDDEN), [], langid.HIDDEN
        for c in raw:
            x = d.table[:, c].astype(float)
            z, r = sigmoid(x[:n] + d.recurrent[:n] @ h), sigmoid(x[n : 2 * n] + d.recurrent[n : 2 * n] @ h)
            new = np.tanh(x[2 * n :] + r * (d.recurrent[2 * n :] @ h))
            h = z * h + (1 - z) * new
            out.append(h)
        return out

    texts = ["", "a", "gr\u00fc\u00dfe " * 40, "x" * 128, "hello world " * 100, "\u65e5\u672c" * 30]
    got = langid.document_probabilities(net, [t.encode() for t in texts])
    for t, row in zip(texts, got):
        raw, total = t.encode(), np.zeros(3)
        for at in range(0, len(raw), langid.WINDOW):
            w = raw[at : at + langid.WINDOW]
            for f, b in zip(states(net.forward, w), states(net.backward, w[::-1])[::-1]):
                s = net.out.astype(float) @ np.concatenate([f, b]) + net.bias[:, 0]
                e = np.exp(s - s.max())
                total += e / e.sum()
        assert np.allclose(row, total / max(1, len(raw)), atol=1e-4)


def test_training_reads_whole_texts_of_every_language(spark):
    """Only the second half of a text tells its language, and there are more languages than a small sample has rows."""
    same_start = "the quick brown fox " * 1500
    rows = [(i, same_start + f"{chr(97 + i % 2) * 3} " * 9000, "ab"[i % 2]) for i in range(24)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    p = langid.document_probabilities(net, [b"aaa " * 50, b"bbb " * 50])
    assert p[0, 0] > 0.8 and p[1, 1] > 0.8
    many = spark.createDataFrame([(i, f"word{i % 300} text", f"l{i % 300:03d}") for i in range(3000)], "doc_id bigint, text string, lang string")
    found = langid.training_windows(many, sample=50)
    assert len({y for _, y in found}) > 250 and max(map(len, (w for w, _ in found))) <= langid.WINDOW


def test_language(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.identify(real).join(real.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    odd = {r.doc_id: r for r in langid.identify(docs(spark)).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == odd[6].lang_pred == "und" and odd[0].score == 0 and odd[4].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert langid.identify(empty(spark)).count() == 0
    unlabelled = langid.identify(docs(spark).filter("lang is null"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_toxicity(spark, sf):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held, seen = labels.filter("doc_id % 3 = 0"), labels.filter("doc_id % 3 <> 0")
    texts, counts = toxicity.sample(d, seen)
    told = toxicity.described(texts)
    loss = {}
    for chained in (True, False):
        chain = toxicity.train(told, counts, chained)
        assert chain.categories[-1] == "toxic" and len(chain.categories) == (5 if chained else 1)
        rows = toxicity.predict(d, chain).join(held.select("doc_id", labels.toxic.alias("truth")), "doc_id").collect()
        y, p = np.array([r.truth for r in rows]), np.array([r.p_toxic for r in rows])
        loss[chained] = -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))
        if chained:
            caught = sum(r.toxic and r.truth for r in rows)
            assert caught >= 0.88 * y.sum() and sum(r.toxic and not r.truth for r in rows) <= 0.005 * len(rows)
            assert all(set(r.kinds) == set(chain.categories[:-1]) for r in rows)
    assert loss[True] < loss[False], "the chain beats its last model alone"
    judged = toxicity.classify(docs(spark), seen.limit(0))
    assert judged.columns == ["doc_id", "kinds", "p_toxic", "toxic"]
    odd = judged.collect()
    assert len(odd) == 13 and not any(r.toxic for r in odd)
    one = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    assert toxicity.classify(docs(spark), one).count() == 13
    assert toxicity.classify(empty(spark), seen).count() == 0


def test_chain_against_a_dense_version():
    """Sparse counts, masks, out-of-fold inputs and the threshold against full matrices and plain loops."""
    rng = np.random.default_rng(8)
    n, width = 90, 7
    pairs = [(i, c) for i in range(n) for c in rng.integers(1, width, rng.integers(0, 6))]
    words = rng.integers(3, 60, n)
    x = toxicity.Counts.of(np.array([i for i, _ in pairs]), np.array([c for _, c in pairs]), words)
    dense = np.zeros((n, width))
    dense[:, 0] = np.log1p(words) / 4
    for i in range(n):
        for c in range(1, width):
            dense[i, c] = np.log2(1 + sum(p == (i, c) for p in pairs))
    y = (dense[:, 1] + dense[:, 2] + rng.random(n) > 1.5) * 1.0
    kind = y * (dense[:, 1] > 0)
    fold = np.arange(n) % 3
    masks = np.ones((4, width), bool)
    masks[0, 2] = masks[1, 3] = False

    def fit(m, earlier, target):
        w, c, b = np.zeros(width), np.zeros(earlier.shape[1]), np.zeros(1)
        weight = np.where(target > 0, 0.5 / target.sum(), 0.5 / (len(target) - target.sum()))
        memory = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, c, b)]
        for t in range(1, 201):
            d = (1 / (1 + np.exp(-(m @ w + earlier @ c + b))) - target) * weight
            for v, g, (a, s) in zip((w, c, b), (m.T @ d + 1e-3 * w, earlier.T @ d + 1e-3 * c, d.sum()), memory):
                a[:] = 0.9 * a + 0.1 * g
                s[:] = 0.99 * s + 0.01 * g * g
                v -= 0.1 * (a / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
        return lambda m, e: 1 / (1 + np.exp(-(m @ w + e @ c + b)))

    want, served = np.zeros((n, 0)), np.zeros((n, 0))
    for target in (kind, y):
        out, final = np.zeros(n), fit(dense * masks[3], want, target)
        for k in range(3):
            kept = fold != k
            out[~kept] = fit((dense * masks[k])[kept], want[kept], target[kept])((dense * masks[k])[~kept], want[~kept])
        served = np.column_stack([served, final(dense, served)])
        want = np.column_stack([want, out])
    models, got = toxicity.chain_of(x, width, [kind, y], fold, masks)
    assert np.allclose(got, want, atol=1e-6)
    assert np.allclose(toxicity.Chain({}, ["k", "toxic"], models).probabilities(x, n), served, atol=1e-6)
    weight = np.where(y > 0, 2.0, 7.0)
    f = lambda t: 1.25 * ((got[:, -1] >= t) * y * weight).sum() / (((got[:, -1] >= t) * weight).sum() + 0.25 * (y * weight).sum())
    assert f(toxicity.best_threshold(got[:, -1], y, weight)) == max(f(t) for t in got[:, -1])


def test_markers_are_chosen_without_the_fold(spark):
    """Labels that no word explains: out-of-fold probabilities must not know them."""
    random.seed(9)
    rows = [(i, " ".join("".join(random.choice("abcdefgh") for _ in range(3)) for _ in range(60))) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    judged = toxicity.classify(spark.createDataFrame(rows, "doc_id bigint, text string"), labels).filter("toxic").collect()
    assert len(judged) <= 24


def test_toxicity_learns_whole_texts(spark):
    """Markers that stand after 20,000 characters only."""
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefghijklmnop") for _ in range(7))
    text = lambda bad: " ".join([word() for _ in range(2600)] + ["zuxwv qyzzt"] * bad)
    rows = [(i, text(i % 4 == 0)) for i in range(60)]
    assert all(t.find("zuxwv") > 20_000 for i, t in rows if i % 4 == 0)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    chain = toxicity.fit(d, labels)
    assert {"zuxwv", "qyzzt"} <= set(chain.features)
    assert {r.doc_id for r in toxicity.predict(d, chain).filter("toxic").collect()} == set(range(0, 60, 4))
