"""Small tables with every awkward case, and brute-force versions."""

from __future__ import annotations

import re

#: null, empty, blank, ties, repeated rows, odd characters, no letters
TEXTS = [
    None, "", "   \t\n", "a", "The quick brown fox jumps over the lazy dog", "The quick brown fox jumps over the lazy dog", "1 2 3 !!! 4", "\x00\x1c odd \u00a0 e\u0301 \u0130 \u03a3\u039f\u03a3 <|endoftext|> x",
    "don't STOP can't \ud55c\uad6d\uc5b4 \U0001f389\U0001f389", "word " * 3000, "line one\nline two\nline one\n\n", "x" * 5000,
]


def docs(spark, texts=TEXTS, clash: bool = True):
    """documents with extra columns whose names clash with those the operators add."""
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, len(t or ""), "clash", 7) for i, t in enumerate(texts)]
    rows.append(rows[4])
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n int")
    return df if clash else df.drop("score", "n")


def empty(spark):
    return docs(spark).limit(0)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= 5:
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def near_components(rows: dict) -> dict:
    """doc_id -> smallest reachable doc_id, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in rows}
