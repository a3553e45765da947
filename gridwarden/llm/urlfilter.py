"""URL rules as one bit-parallel automaton.

Each rule is a glob over the canonical URL ``.host/path``: literal characters,
``?`` (one character), ``*`` (any characters but ``/``) and ``**`` (any
characters).  A glob becomes a row of states, one for each symbol after a start
state; a star adds no state but lets the state before it loop on its characters.
The states of all rules are packed into 64-bit words, and

    D = ((D << 1) & follow[c]) | (D & loop[c])

moves every rule of every URL of a batch one character on.  Rules differ in
length, so the shift also moves one rule's last state onto the next rule's start
state; ``follow`` never has start states, which drops it again.

Cases: a null url, or one without ``://``, has an empty host and path and fits no
rule; an empty table gives no row; repeated rows are judged each; very long urls
take as many steps as they have bytes, and leave the batch when they end; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; ``glob`` is over ``.host/path``; ``allow`` or ``block``."""

    name: str
    glob: str
    verdict: str


def host_rule(name: str, verdict: str) -> Rule:
    """``host/path`` for the host and all its subdomains, and every path that starts so."""
    return Rule(name, f"*.{name}**", verdict)


#: What a url gets that no rule fits.
DEFAULT = "allow"


class ShiftAnd:
    """Masks of all rules; ``match`` gives, for each text, which rules fit it as a whole."""

    def __init__(self, globs: list[str]) -> None:
        rows, starts, ends = [], [], []
        for glob in globs:
            states: list[tuple[str | None, str]] = [(None, "")]  # (byte that leads in, "" / "*" / "**" loop)
            raw = glob.encode().decode("latin-1")
            i = 0
            while i < len(raw):
                if raw[i] == "*":
                    wide = raw[i : i + 2] == "**"
                    last, before = states[-1]
                    states[-1] = (last, "**" if wide or before == "**" else "*")
                    i += 1 + wide
                else:
                    states.append((raw[i], ""))
                    i += 1
            starts.append(len(rows))
            rows += states
            ends.append(len(rows) - 1)
        self.words = max(1, -(-len(rows) // 64))
        self.follow = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        for s, (symbol, loops) in enumerate(rows):
            word, bit = s // 64, np.uint64(1 << (s % 64))
            if symbol == "?":
                self.follow[:, word] |= bit
            elif symbol is not None:
                self.follow[ord(symbol), word] |= bit
            if loops:
                self.loop[:, word] |= bit
                if loops == "*":
                    self.loop[ord("/"), word] &= ~bit
        self.begin = np.zeros(self.words, np.uint64)
        for s in starts:
            self.begin[s // 64] |= np.uint64(1 << (s % 64))
        self.ends = ends

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Boolean array, one row for each text and one column for each rule."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(texts), np.uint8)
        starts = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        state = np.tile(self.begin, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, side="left"))  # texts longer than step come first
            d = state[:live]
            c = flat[starts[:live] + step]
            shifted = d << one
            shifted[:, 1:] |= d[:, :-1] >> top
            state[:live] = (shifted & self.follow[c]) | (d & self.loop[c])
        fits = np.zeros((len(texts), len(self.ends)), bool)
        for r, s in enumerate(self.ends):
            fits[order, r] = (state[:, s // 64] >> np.uint64(s % 64)) & one != 0
        return fits


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``host``: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; ``path``: then up to ``?``, ``#`` or end."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.withColumns({"host": F.translate(host, upper, lower), "path": path})


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(id, host, path, rule, verdict): the longest rule that fits (the first of equals), else ``default``."""
    schema = f"`{id_col}` {dict(pages.dtypes)[id_col]}, host string, path string, rule string, verdict string"
    best_first = sorted(range(len(rules)), key=lambda i: -len(rules[i].name))
    names = [rules[i].name for i in best_first] + [None]
    verdicts = [rules[i].verdict for i in best_first] + [default]
    globs = [rules[i].glob for i in best_first]

    def run(batches):
        automaton = ShiftAnd(globs)
        for b in batches:
            hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            fits = automaton.match([f".{h}{p}".encode() if h or p else b"" for h, p in zip(hosts, paths)])
            first = np.where(fits.any(1), fits.argmax(1), len(globs)) if len(globs) else np.zeros(len(hosts), int)
            out = [pa.array([x[i] for i in first], pa.string()) for x in (names, verdicts)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *out], [id_col, "host", "path", "rule", "verdict"])

    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    return with_host_and_path(named).select(F.col("id").alias(id_col), "host", "path").mapInArrow(run, schema)
