"""Whole-column token ids, one computation per distinct word.

A column of texts is cut at ASCII white space, which no pre-token of the word
vocabulary crosses, and looked up in Arrow.  Only words a worker has not met are
encoded; the ids of every text are then gathered by array indexing.  Two
encoders share this frame: the tokenizers library (this module) and the
backtracking encoder of ``bpe``.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The pre-token pattern of the word vocabulary, and its white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+"

PIECES = regex.compile(PIECE)
PIECES_OR_GAP = regex.compile(PIECE + "| ")
#: Words the library would change only by lower-casing: printable ASCII, Latin letters.
PLAIN = "^[\x21-\x7e\u00c0-\u012f\u0131-\u017e]+$"
#: Distinct words, and distinct pre-tokens, that one Python worker remembers before it forgets those that it met once.
MEMORY, PIECE_MEMORY = 1_000_000, 400_000


@functools.cache
def byte_alphabet() -> tuple[str, ...]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return tuple(chr(b) if b in set(visible) else chr(next(spare)) for b in range(256))


@functools.cache
def byte_table() -> dict[int, str]:
    """For ``str.translate`` on text whose characters are bytes."""
    return dict(enumerate(byte_alphabet()))


class WordEncoder:
    """A table of words and their ids; subclasses encode what is not in it.

    The table is an Arrow array of the words and one flat array of ids, so that known
    words are found without making a Python object of each.
    """

    def __init__(self) -> None:
        self.pieces: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([""], pa.large_string())
        self.flat = np.zeros(0, np.uint32)
        self.sizes = np.zeros(1, np.int32)
        self.used = np.zeros(1, np.int32)

    def keep(self, most: int) -> None:
        """Forget the words that one slice alone has used since the last time; all if too many remain."""
        keep = self.used > 1
        keep[0] = True  # the empty string
        if np.count_nonzero(keep) > most:
            return self.forget()
        self.words = self.words.filter(pa.array(keep))
        self.flat, self.sizes = self.flat[np.repeat(keep, self.sizes)], self.sizes[keep]
        self.used = np.zeros(len(self.words), np.int32)

    def piece(self, piece: str) -> bytes:
        """Ids of one lower-cased pre-token, as little-endian 32-bit numbers."""
        raise NotImplementedError

    def odd_word(self, word: str) -> bytes:
        """Ids of a word that is not PLAIN, or that holds a special token."""
        raise NotImplementedError

    def learn(self, words: pa.Array) -> None:
        """Add distinct unknown words to the table."""
        if len(self.pieces) > PIECE_MEMORY:
            self.pieces.clear()
        names = words.to_pylist()
        ids: list[bytes] = [b""] * len(names)
        simple = pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, "<|")).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(simple).tolist()
        for i in np.flatnonzero(~simple).tolist():
            ids[i] = self.odd_word(names[i])
        known, at, own = self.pieces, 0, []
        for p in PIECES_OR_GAP.findall(" ".join([names[i] for i in plain]).lower()) if plain else ():
            if p == " ":
                ids[plain[at]] = b"".join(own)
                at, own = at + 1, []
            else:
                got = known.get(p)
                if got is None:
                    got = known[p] = self.piece(p)
                own.append(got)
        if plain:
            ids[plain[at]] = b"".join(own)
        self.words = pa.concat_arrays([self.words, words])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.uint32)])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, ids), np.int32, len(ids)) // 4])
        self.used = np.concatenate([self.used, np.zeros(len(ids), np.int32)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in one uint32 array, and each text's offsets in it (nulls: empty)."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        # the cast also rebases a slice, which some string kernels do not honour
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        words = split.values
        which = pc.index_in(words, self.words)
        if which.null_count and len(self.words) > MEMORY:
            self.keep(MEMORY // 2)
            which = pc.index_in(words, self.words)
        if which.null_count:
            unknown = which.is_null()
            late = words.filter(unknown)
            new, before = pc.unique(late), len(self.words)
            self.learn(new)
            which = pc.replace_with_mask(which, unknown, pc.add(pc.index_in(late, new), pa.scalar(before, pa.int32())))
        which = which.to_numpy()
        seen = np.zeros(len(self.words), bool)
        seen[which] = True
        self.used += seen
        starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        each = self.sizes[which]
        upto = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        place = np.arange(upto[-1], dtype=np.int64)
        place += np.repeat(starts[which] - upto[:-1], each)
        return self.flat[place], upto[np.asarray(split.offsets)]


class LibraryEncoder(WordEncoder):
    """The tokenizers library: its BPE model for plain pre-tokens, its whole pipeline for all else."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.raw = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size() + 1)]

    def piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(byte_table())
        return b"".join([self.raw[t.id] for t in self.model.tokenize(piece)])

    def odd_word(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()


@functools.cache
def library(path: str) -> LibraryEncoder:
    """One per Python worker, kept between tasks."""
    return LibraryEncoder(path)


#: Bytes of text that are worked on together (a longer text is a slice of its own).
SLICE = 8_000_000


def slices(batch: pa.RecordBatch, column: int = 1, size: int = SLICE):
    """The batch in consecutive slices of about ``size`` bytes of the text column."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    upto = np.cumsum(lengths)
    lo = 0
    while lo < batch.num_rows:
        done = upto[lo] - lengths[lo]
        hi = max(lo + 1, int(np.searchsorted(upto, done + size, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
