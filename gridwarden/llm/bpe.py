"""BPE encoding by backtracking, decoding by an offset table.

Encoding.  A pre-token is a string over 512 symbols: its bytes, the last one as
an end-of-word symbol.  One Aho-Corasick pass reports every vocabulary entry that
occurs in it, hence the longest entry at each position.  Entries are then placed
left to right, longest first.  Two neighbours may stand together only if merging
by rank would never have joined across their border (the pair-compatibility
table); otherwise the next shorter prefix entry is tried, and when none is left the
last entry is taken back and its end marked as impossible.  Each position is given
up at most once, so the work is linear, and the one sequence whose neighbours are
all compatible is the one that merging by rank yields.

Decoding.  All entries lie in one byte string; an offset table gives the place
of each, and the text of any id sequence is one gather.

Cases: a null text is an empty text; an empty text has no ids and decodes to an
empty string; strings of special tokens become their ids, as in the library;
repeated rows give repeated results; extra columns are ignored; an empty table gives no row; a very long text is a slice of its own, and a
very long word one pass of the automaton, in time that grows with its length.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import returning
from .tokens import WordEncoder, byte_alphabet, slices

END = "</w>"
#: Pairs remembered in the compatibility table before it starts afresh.
PAIRS = 2_000_000


class Vocabulary:
    """Entries as strings of symbols, the merge that makes each, and prefix links."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        symbol = {c: chr(b) for b, c in enumerate(byte_alphabet())}

        def symbols(entry: str) -> str:
            ends = entry.endswith(END) and entry != END
            body = "".join(symbol[c] for c in (entry[: -len(END)] if ends else entry))
            return body[:-1] + chr(256 + ord(body[-1])) if ends else body

        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        self.texts = [b""] * size
        for entry, i in vocab.items():
            self.strings[i] = symbols(entry)
            self.texts[i] = entry.encode()
        for entry, i in self.special.items():
            self.texts[i] = entry.encode()
        self.lengths = [len(s) for s in self.strings]
        by_string = {s: i for i, s in enumerate(self.strings) if s}
        #: (left, right) -> rank and product; product -> (rank, left, right)
        self.joins: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = vocab[left], vocab[right]
            self.joins[a, b] = rank
            self.made.setdefault(vocab[left + right], (rank, a, b))
        self.shorter: list[int] = [-1] * size
        self.automaton = ahocorasick.Automaton()
        usable = self.usable(by_string)
        for s, i in usable.items():
            self.automaton.add_word(s, (len(s), i))
            for n in range(len(s) - 1, 0, -1):
                if (j := usable.get(s[:n], -1)) >= 0:
                    self.shorter[i] = j
                    break
        self.automaton.make_automaton()

    def usable(self, by_string: dict[str, int]) -> dict[str, int]:
        """The entries that merging their own symbols by rank yields; no result holds another."""
        good = {i for i in by_string.values() if i not in self.made}
        for i, (_, a, b) in sorted(self.made.items(), key=lambda x: x[1]):
            if a in good and b in good and self.stand(a, b, joined=True):
                good.add(i)
        return {s: i for s, i in by_string.items() if i in good}

    def stand(self, left: int, right: int, joined: bool = False) -> bool:
        """Whether merging by rank can leave ``left`` and ``right`` side by side.

        Both are unfolded at their common border, the later merge first.  The border
        was crossed by no merge if no two parts that met there had a merge of lower
        rank than the one that took a part up.  ``joined``: the merge of the two
        themselves is to come, so it does not count.
        """
        a, b, limit = left, right, float("inf")
        while True:
            rank = self.joins.get((a, b))
            if rank is not None and rank < limit and not joined:
                return False
            joined = False
            up_a, up_b = self.made.get(a), self.made.get(b)
            if up_a is None and up_b is None:
                return True
            if up_b is None or up_a is not None and up_a[0] > up_b[0]:
                limit, a = up_a[0], up_a[2]
            else:  # of two equal merges the left one goes first
                limit, b = up_b[0] + 1, up_b[1]


class BacktrackingEncoder(WordEncoder):
    def __init__(self, path: str) -> None:
        super().__init__()
        self.vocabulary = Vocabulary(path)
        self.compatible: dict[tuple[int, int], bool] = {}
        from tokenizers import Tokenizer

        # what a letter is depends on the version of Unicode: the library's own normaliser and splitter say it for words with rare characters
        frame = Tokenizer.from_file(path)
        self.normal, self.cut = frame.normalizer, frame.pre_tokenizer
        marks = "|".join(map(regex.escape, sorted(self.vocabulary.special, key=len, reverse=True)))
        self.marks = regex.compile(f"({marks})") if marks else None

    def pair(self, left: int, right: int) -> bool:
        got = self.compatible.get((left, right))
        if got is None:
            if len(self.compatible) > PAIRS:
                self.compatible.clear()
            got = self.compatible[left, right] = self.vocabulary.stand(left, right)
        return got

    def entries(self, symbols: str) -> list[int]:
        v = self.vocabulary
        lengths, shorter, pair = v.lengths, v.shorter, self.pair
        n = len(symbols)
        longest, size = [-1] * n, [0] * n
        for end, (m, i) in v.automaton.iter(symbols):
            if m > size[end - m + 1]:
                size[end - m + 1], longest[end - m + 1] = m, i
        if size[0] == n:
            return [longest[0]]
        open_ = [True] * (n + 1)
        placed: list[int] = []
        at, entry = 0, longest[0]
        while at < n:
            while entry >= 0 and not (open_[at + lengths[entry]] and (not placed or pair(placed[-1], entry))):
                entry = shorter[entry]
            if entry < 0:
                if not placed:
                    raise ValueError("no way to write this piece in the vocabulary")
                open_[at] = False
                last = placed.pop()
                at -= lengths[last]
                entry = shorter[last]
            else:
                placed.append(entry)
                at += lengths[entry]
                entry = longest[at] if at < n else -1
        return placed

    def piece(self, piece: str) -> bytes:
        raw = piece.encode().decode("latin-1")
        return np.array(self.entries(raw[:-1] + chr(256 + ord(raw[-1]))), np.uint32).tobytes()

    def odd_word(self, word: str) -> bytes:
        parts = self.marks.split(word) if self.marks else [word]
        out = []
        for part in parts:
            if part in self.vocabulary.special:
                out.append(np.array([self.vocabulary.special[part]], np.uint32).tobytes())
                continue
            plain = self.normal.normalize_str(part)
            for _, (lo, hi) in self.cut.pre_tokenize_str(plain):
                p = plain[lo:hi]
                got = self.pieces.get(p)
                if got is None:
                    got = self.pieces[p] = self.piece(p)
                out.append(got)
        return b"".join(out)


class OffsetDecoder:
    """Entries, each followed by one space, in one byte array; a decoded text drops the last space."""

    def __init__(self, texts: list[bytes]) -> None:
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.sizes = sizes
        self.bytes = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each stretch ``ids[bounds[i]:bounds[i + 1]]``."""
        each = self.sizes[ids]
        upto = np.concatenate([[0], np.cumsum(each)])
        text = self.bytes[np.repeat(self.offsets[ids] - upto[:-1], each) + np.arange(upto[-1])].tobytes()
        at = upto[bounds]
        return [text[a : b - 1] if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


@functools.cache
def backtracking(path: str) -> BacktrackingEncoder:
    return BacktrackingEncoder(path)


@functools.cache
def decoder(path: str) -> OffsetDecoder:
    return OffsetDecoder(backtracking(path).vocabulary.texts)


def _ids_arrow(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids array<int>) for every row; see the module for null and empty texts."""
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, token_ids array<int>"

    def run(batches):
        enc = backtracking(path)
        for whole in batches:
            for b in slices(whole):
                ids, bounds = enc.encode(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), _ids_arrow(ids, bounds)], [id_col, "token_ids"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(returning(run), schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, text) from (id, token ids)."""
    schema = f"`{id_col}` {dict(encoded.dtypes)[id_col]}, text string"

    def run(batches):
        dec = decoder(path)
        for b in batches:
            lists = b.column(1)
            lengths = np.asarray(lists.value_lengths().fill_null(0))
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            texts = dec.decode(ids, np.concatenate([[0], np.cumsum(lengths)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode() for t in texts], pa.string())], [id_col, "text"])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(returning(run), schema)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: token count and SHA-256 of its decimal ids and of its decoded text.

    Encoder and decoder run in one pass, so that neither ids nor texts are
    shuffled or written.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_decoded_bytes bigint"

    def run(batches):
        enc, dec = backtracking(path), decoder(path)
        decimal = OffsetDecoder([str(i).encode() for i in range(len(dec.sizes))])
        sha = hashlib.sha256
        for whole in batches:
            for b in slices(whole):
                ids, bounds = enc.encode(b.column(1))
                numbers, texts = decimal.decode(ids, bounds), dec.decode(ids, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).cast(pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([sha(x).hexdigest() for x in numbers]),
                        pa.array([sha(x).hexdigest() for x in texts]),
                        pa.array([len(x) for x in texts], pa.int64()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_decoded_bytes"],
                )

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(returning(run), schema)
