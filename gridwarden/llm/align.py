"""Alignment of two tokenizers' tokens over the bytes of the same texts.

Tokenizer A is a byte-level BPE that encodes space + text, B a sentencepiece BPE that encodes the
text and adds the space.  Wherever an A and a B token end at the same byte the text is
cut; the tokens between two such cuts are a group, and an A and a B token that share bytes are a link.

Neither tokenizer joins what follows a space to what stands before it, if that is not
white space itself: A's pre-tokens take a space only in front, and no piece of B has a space behind another
character (``Pair`` checks it).  So texts are cut there into *units*, words with the white space before
them, and everything is aligned once for each distinct unit of the corpus instead of each occurrence:

1. ``blocks``: texts are cut in tasks; a block of about ``BLOCK`` bytes has a dictionary of its units, and its documents are codes of it;
2. ``encoded``: distinct units are gathered, with the places (block, code) that hold them, and encoded by both tokenizers;
3. ``align``: purely relational over the tokens of distinct units: posexplode, cumulative lengths by window, an equi-join of both
   sides on unit and end, running counts of the cuts as group ids, and a range join of both sides inside a group
   (by bins as wide as the longest token, so that a token meets a bounded number of others, whatever the group's size);
4. units go back to their blocks, where a document's values are sums over its codes, and its distinct pairs are counted into
   one row for each block and pair; pairs are summed over blocks, compared by A id, and the units' sums of counts go back the same way.

A word that every document holds is one row for each block, a pair likewise, so no key grows with the number of documents.
Lists of places cover ``REGION`` input parts at most. A block's units and codes are what one task holds.
Every step's result is written to the shared folder, its shuffle files go when it ends, and tables that nothing reads any more are deleted.

Cases: a null or empty text has no tokens, nor has one that the tokens' bytes do not give back (U+2581 reads as a space);
such documents have zeros and an empty digest, and hold no pair. Very long texts are a block of their own, a long run without spaces is one unit.
Repeated rows, and rows with one doc_id, are documents each, also in counts; null doc_ids are kept; other columns are ignored; an empty table gives no row.
Ties for an A id's highest count are all highest.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .skew import join_counted
from .store import ALL_KEYS, discard, give_back, materialise, returning, settings

#: Bytes of text in a block.
BLOCK = 8 << 20
#: Bits of a place: code within the block, block within the input part; input parts whose units are gathered together (a power of two).
CODE_BITS, BLOCK_BITS, REGION_BITS = 28, 13, 10
#: Width in bytes of the bins of the range join: no token of either vocabulary is longer.
BIN = 512
#: Fixed value: A's pre-tokens (its own splitter, said as a pattern).
_PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space (of any kind) of three bytes, and the mark of a space, by their first two bytes: no cut behind these.
_BARRED = np.array([0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE296, 0xE380, 0xEFBB], np.uint16)


# ---- units ---------------------------------------------------------------------------------------------------


def cut_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all units of space + text in order, each text's offsets in them); null and empty texts have none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    joined = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    raw = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    at = np.flatnonzero(raw == 32)
    before = np.zeros((4, len(at)), np.uint8)
    for k in range(4):
        ok = at > k
        before[k, ok] = raw[at[ok] - 1 - k]
    one, two, three, four = before
    tail = (one >= 0x80) & (one < 0xC0)
    safe = (one > 32) & (one < 127)
    safe |= tail & (two > 0xC2) & (two < 0xE0)
    safe |= tail & (three >= 0xE0) & (three < 0xF0) & ~np.isin(three.astype(np.uint16) << 8 | two, _BARRED)
    safe |= tail & (four >= 0xF0)
    begins = np.zeros(len(raw), bool)
    begins[at[safe]] = True
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    bounds = np.append(starts, len(raw)) if len(starts) else np.zeros(1, np.int64)
    units = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes()))
    return units, np.searchsorted(starts, offsets)


def _packed(codes: np.ndarray, press) -> bytes:
    return press.compress(codes.astype("<u4").tobytes())


def _unpacked(payloads: list[bytes]) -> list[np.ndarray]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    return [np.frombuffer(press.decompress(p), "<u4") for p in payloads]


_BLOCKS = "kind int, block bigint, row int, doc_id bigint, codes binary, units array<string>"


def blocks(docs: DataFrame) -> DataFrame:
    """Documents as codes (kind 0: block, row, doc_id, codes) and the dictionaries of their blocks (kind 1: block, units)."""

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        press, number = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << BLOCK_BITS
        last = number + (1 << BLOCK_BITS)
        for whole in batches:
            for b in tokens.slices(whole, 1, BLOCK):
                if number == last:
                    raise ValueError("an input part has too many blocks: read it in more parts")
                units, at = cut_units(b.column(1))
                coded = units.dictionary_encode()
                codes = coded.indices.to_numpy()
                n = b.num_rows
                columns = [[0] * n + [1], [number] * (n + 1), [*range(n), None], [*b.column(0).to_pylist(), None]]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int64()))),
                     pa.array([*(_packed(codes[i:j], press) for i, j in zip(at[:-1], at[1:])), None], pa.binary()),
                     pa.concat_arrays([pa.nulls(n, pa.list_(pa.string())), pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.string()))])],
                    ["kind", "block", "row", "doc_id", "codes", "units"],
                )
                number += 1

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(returning(run), _BLOCKS)


# ---- tokens --------------------------------------------------------------------------------------------------


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import json

        import sentencepiece

        self.a_path = a_path
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: i for i, c in enumerate(tokens.byte_alphabet())}
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, merges = model["vocab"], model["merges"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a space behind another character: texts can't be cut at spaces")
        self.space = self.b.piece_to_id("▁")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # where the order of merges is the order of ids, the same vocabulary read as ranks gives the same ids, several times faster
        self.ranks = None
        if all(vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m)) == 256 + i for i, m in enumerate(merges)):
            import tiktoken

            self.ranks = tiktoken.Encoding("own", pat_str=_PRE_TOKEN, mergeable_ranks={x: i for i, x in enumerate(self.a_bytes)}, special_tokens={})

    @functools.cached_property
    def a(self):
        """The tokenizers library's A; where ranks serve, most workers never load it."""
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.a_path)
        out.encode_special_tokens = True
        out.no_truncation()
        out.no_padding()
        return out

    def of_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, how many each has)."""
        # a unit that ends in white space would lend it to the next one; very long ones are merged in better time by the library
        short = [self.ranks is not None and len(u) < 1000 for u in units]
        together = [s and not u[-1].isspace() for s, u in zip(short, units)]
        if all(together) and units:
            ids = np.array(self.ranks.encode_ordinary("".join(units)), np.int32)
            ends = np.cumsum(self.a_sizes[ids])
            wanted = np.cumsum([len(u.encode()) for u in units])
            at = np.searchsorted(ends, wanted)
            if len(ends) and at[-1] < len(ends) and (ends[at] == wanted).all():
                return ids, np.diff(at, prepend=-1)
            together = [False] * len(units)
        plain = self.of_a([u for u, t in zip(units, together) if t]) if any(together) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        found = iter(np.split(plain[0], np.cumsum(plain[1])[:-1]))
        alone = lambda u, s: self.ranks.encode_ordinary(u) if s else self.a.encode(u, add_special_tokens=False).ids
        each = [next(found) if t else alone(u, s) for u, s, t in zip(units, short, together)]
        return np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64)

    def of_b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [x or [self.space] for x in self.b.encode([u[1:] for u in units], num_threads=1)]
        return np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64)

    def encode(self, units: list[str]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(do both sides give back the unit's bytes?, A's ids and how many each unit has, B's); no ids if not."""
        raw = [u.encode() for u in units]
        sides, ok = [self.of_a(units), self.of_b(units)], np.ones(len(units), bool)
        for (ids, n), table in zip(sides, (self.a_bytes, self.b_bytes)):
            if b"".join([table[i] for i in ids.tolist()]) != b"".join(raw):
                ends = np.cumsum(n).tolist()
                ok &= [b"".join([table[i] for i in ids[lo:hi].tolist()]) == r for r, lo, hi in zip(raw, [0, *ends], ends)]
            else:
                size = np.concatenate([[0], np.cumsum((self.a_sizes if table is self.a_bytes else self.b_sizes)[ids])])[np.concatenate([[0], np.cumsum(n)])]
                ok &= np.diff(size) == [len(r) for r in raw]
        if not ok.all():
            sides = [(ids[np.repeat(ok, n)], n * ok) for ids, n in sides]
        return ok, *sides


@functools.cache
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _tokens(ids: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """array<struct<id, n>>: ids and their bytes."""
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(ids.astype(np.int32)), pa.array(sizes[ids].astype(np.int32))], ["id", "n"]))


#: Units that are encoded together.
TOGETHER = 2000


def encoded(dictionaries: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(uid, ok, a, b, places) of each distinct unit: its tokens on both sides and the places (block, code) of the dictionaries that hold it."""
    each = dictionaries.select("block", F.posexplode("units").alias("code", "unit"))
    place = F.shiftleft("block", CODE_BITS).bitwiseOR(F.col("code"))
    # places of one list are bounded by the region's blocks
    region = F.shiftright("block", BLOCK_BITS + REGION_BITS).cast("int")
    lying = each.select(region.alias("region"), "unit", place.alias("place")).repartition("region", "unit").sortWithinPartitions("region", "unit", "place")

    def run(batches):
        two = pair(a_path, b_path)
        if max(two.a_sizes.max(), two.b_sizes.max()) > BIN:
            raise ValueError("a token is longer than a bin of the range join")

        def made(units: pa.Array, places: np.ndarray, starts: np.ndarray):
            bounds = np.append(starts, len(places))
            for lo in range(0, len(starts), TOGETHER):
                hi = min(lo + TOGETHER, len(starts))
                ok, a, b = two.encode(units.take(pa.array(starts[lo:hi])).to_pylist())
                lists = pa.ListArray.from_arrays((bounds[lo : hi + 1] - bounds[lo]).astype(np.int32), pa.array(places[bounds[lo] : bounds[hi]]))
                yield pa.RecordBatch.from_arrays([pa.array(ok), _tokens(*a, two.a_sizes), _tokens(*b, two.b_sizes), lists], ["ok", "a", "b", "places"])

        # rows are sorted, so equal units lie together; the last unit of a batch waits for the next one
        held: pa.RecordBatch | None = None
        for b in batches:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            units, regions = b.column(1), b.column(0).to_numpy()
            new = np.ones(b.num_rows, bool)
            new[1:] = np.asarray(pc.not_equal(units.slice(1), units.slice(0, b.num_rows - 1))) | (regions[1:] != regions[:-1])
            starts = np.flatnonzero(new)
            held = b.slice(starts[-1])
            yield from made(units, b.column(2).to_numpy()[: starts[-1]], starts[:-1])
        if held is not None:
            yield from made(held.column(1), held.column(2).to_numpy(), np.zeros(1, np.int64))

    schema = "ok boolean, a array<struct<id:int,n:int>>, b array<struct<id:int,n:int>>, places array<bigint>"
    return lying.mapInArrow(returning(run), schema).select(F.monotonically_increasing_id().alias("uid"), "*")


# ---- alignment -----------------------------------------------------------------------------------------------


def _side(units: DataFrame, side: str) -> DataFrame:
    """(uid, stop, pos, id, start) of one side's tokens: byte ranges from cumulative lengths."""
    each = units.select("uid", F.posexplode(side).alias("pos", "t")).select("uid", "pos", "t.id", "t.n")
    stop = F.sum("n").over(Window.partitionBy("uid").orderBy("pos"))
    return each.select("uid", stop.alias("stop"), "pos", "id", (stop - F.col("n")).alias("start"))


def grouped(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides' tokens with ``g``, the number of common ends before them, that is the group's id."""
    a, b = _side(units, "a"), _side(units, "b")
    before = Window.partitionBy("uid").orderBy("stop").rowsBetween(Window.unboundedPreceding, -1)

    def with_groups(own: DataFrame, other: DataFrame) -> DataFrame:
        ends = other.select("uid", "stop", F.lit(1).alias("cut"))
        return own.join(ends, ["uid", "stop"], "left").withColumn("g", F.coalesce(F.sum("cut").over(before), F.lit(0))).drop("cut")

    return with_groups(a, b), with_groups(b, a)


def links(units: DataFrame) -> DataFrame:
    """(uid, g, a_id, b_id, a_stop, b_stop): all pairs of an A and a B token of a unit whose byte ranges overlap."""
    binned = lambda t, name: t.select(
        "uid", "g", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("stop") - 1) / BIN))).alias("bin"),
        F.col("id").alias(f"{name}_id"), F.col("start").alias(f"{name}_start"), F.col("stop").alias(f"{name}_stop"),
    )
    a, b = grouped(units)
    overlap = (F.col("a_start") < F.col("b_stop")) & (F.col("b_start") < F.col("a_stop"))
    once = F.floor(F.greatest("a_start", "b_start") / BIN) == F.col("bin")
    return binned(a, "a").join(binned(b, "b"), ["uid", "g", "bin"]).filter(overlap & once).drop("bin")


#: A link in one number: A id, B id, and whether the A and the B token end in this piece.
_A_SHIFT, _B_SHIFT = 33, 2


def align(units: DataFrame) -> DataFrame:
    """(uid, links array<bigint>): each unit's links in the order of their bytes, as numbers that ``_texts`` reads."""
    lying = units.select("uid", "a", "b").repartition("uid")
    ends = F.when(F.col("a_stop") <= F.col("b_stop"), 2).otherwise(0) + F.when(F.col("b_stop") <= F.col("a_stop"), 1).otherwise(0)
    number = F.shiftleft(F.col("a_id").cast("bigint"), _A_SHIFT).bitwiseOR(F.shiftleft(F.col("b_id").cast("bigint"), _B_SHIFT)).bitwiseOR(ends.cast("bigint"))
    rows = links(lying).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(F.least("a_stop", "b_stop").alias("at"), number.alias("link")))).alias("links"))
    return rows.select("uid", F.transform("links", lambda x: x["link"]).alias("links"))


# ---- documents -----------------------------------------------------------------------------------------------


class _Units:
    """A block's units by code: their links, one after the other."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by("code")
        code = table.column("code").to_numpy()
        assert len(code) == 0 or code[-1] == len(code) - 1
        self.ok = np.asarray(table.column("ok"), bool)
        lists = pc.fill_null(table.column("links").combine_chunks(), []) if table.num_rows else pa.array([], pa.list_(pa.int64()))
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        self.n = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.links = np.asarray(lists.flatten()).astype(np.int64)

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sum over each unit's links."""
        upto = np.concatenate([[0], np.cumsum(values)])
        return upto[self.at[1:]] - upto[self.at[:-1]]


def _distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values, sorted; ``x`` is sorted in place."""
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _per_document(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return upto[at[1:]] - upto[at[:-1]]


#: Units whose texts are written together.
WRITTEN = 20_000


def _texts(units: _Units) -> list[str]:
    """`a1,a2|b1;a3|b2`: the groups of each unit."""
    out: list[str] = []
    for lo in range(0, len(units.n), WRITTEN):
        n, at = units.n[lo : lo + WRITTEN], units.at[lo : lo + WRITTEN + 1]
        out += _written(n, at - at[0], units.links[at[0] : at[-1]])
    return out


def _written(sizes: np.ndarray, starts: np.ndarray, links: np.ndarray) -> list[str]:
    """The groups of units with so many links, the first at ``starts``.

    Tokens are put in the order in which they are written (of each group A's, then B's), each with the character before it;
    then the characters of all tokens are one buffer, of which a unit is a slice.
    """
    ends_a, ends_b = (links & 2) > 0, (links & 1) > 0
    last = ends_a & ends_b
    group = np.cumsum(last) - last  # links of a group come one after the other
    n = int(last.sum())
    in_a, in_b = (np.bincount(group[e], minlength=n)[:n] for e in (ends_a, ends_b))
    begin = np.concatenate([[0], np.cumsum(in_a + in_b)])
    ids, before = np.zeros(begin[-1], np.int32), np.zeros(begin[-1], np.int8)
    for e, off, value in ((ends_a, begin[:-1], links >> _A_SHIFT), (ends_b, begin[:-1] + in_a, links >> _B_SHIFT & (1 << _A_SHIFT - _B_SHIFT) - 1)):
        g = group[e]
        rank = np.arange(len(g)) - np.searchsorted(g, g)
        ids[off[g] + rank] = value[e]
    first = np.zeros(n, bool)
    some = sizes > 0
    first[group[starts[:-1][some]]] = True
    before[begin[:-1]] = np.where(first, 0, 1)  # nothing at a unit's begin, a semicolon at a group's
    before[:] = np.where(np.isin(np.arange(len(before)), begin[:-1], assume_unique=True), before, 2)
    before[begin[:-1] + in_a] = 3
    mark = pa.array(["", ";", ",", "|"], pa.large_string()).take(pa.array(before))
    written = pc.binary_join_element_wise(mark, pa.array(ids).cast(pa.large_string()), pa.scalar("", pa.large_string()))
    at = np.frombuffer(written.buffers()[1], np.int64)[written.offset : written.offset + len(written) + 1] if len(written) else np.zeros(1, np.int64)
    own = group[np.minimum(starts[:-1], len(links) - 1)] if len(links) else np.zeros(len(sizes), np.int64)
    token = np.append(np.where(some, begin[own], begin[-1]), begin[-1])
    # a unit without tokens is an empty slice at the place where the next one begins
    token = np.minimum.accumulate(token[::-1])[::-1]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(at[token].astype(np.int64).tobytes()), written.buffers()[2] or pa.py_buffer(b"")).to_pylist()


def _codes(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    each = _unpacked(docs.column("codes").to_pylist())
    at = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    return np.concatenate([*each, np.zeros(0, "<u4")]).astype(np.int64), at


def _lean(run):
    """``run`` for applyInArrow; memory that a group has freed goes back to the system."""

    @functools.wraps(run)
    def inner(key, left, right):
        out = run(key, left, right)
        del left, right
        give_back()
        return out

    return inner


#: Cells (document, pair) that are looked at together.
CELLS = 1 << 19


def _held(u: _Units, pairs: np.ndarray, number: np.ndarray, codes: np.ndarray, at: np.ndarray, good: np.ndarray) -> np.ndarray:
    """How many of the good documents hold each of a block's pairs; a few documents at a time."""
    n, width = np.zeros(len(pairs), np.int64), len(pairs) + 1
    upto = np.concatenate([[0], np.cumsum(u.n[codes])])[at]
    lo = 0
    while lo < len(good):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + CELLS, "right")) - 1)
        owner = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
        keep = good[lo:hi][owner]
        own = _distinct(owner[keep] * len(u.n) + codes[at[lo] : at[hi]][keep])  # distinct units of each document
        doc, code = own // max(1, len(u.n)), own % max(1, len(u.n))
        each = u.n[code]
        place = np.arange(each.sum()) + np.repeat(u.at[code] - np.cumsum(each) + each, each)
        held = _distinct(np.repeat(doc, each) * width + number[place])
        n += np.bincount(held % width, minlength=width)[: len(pairs)]
        lo = hi
    return n


_DOCUMENTS = "kind int, block bigint, row int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pair bigint, n bigint"


def documents(units: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents (kind 0) with their counts and digest, and for each block the pairs (kind 1) with the number ``n`` of its documents that hold them.

    ``units`` has (block, code, ok, links), ``docs`` the documents of ``blocks``.
    """
    schema = pa.schema(
        [("kind", pa.int32()), ("block", pa.int64()), ("row", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pair", pa.int64()), ("n", pa.int64())]
    )

    @_lean
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        block, u = key[0].as_py(), _Units(left)
        codes, at = _codes(right)
        good = _per_document(~u.ok[codes], at) == 0
        flags = u.links & 3
        counts = [_per_document(u.summed(x)[codes], at) * good for x in (flags >> 1, flags & 1, flags == 3, np.ones(len(flags), np.int64))]
        good &= counts[0] > 0
        texts, digests, starts = _texts(u), [], at.tolist()
        for ok, lo, hi in zip(good.tolist(), starts, starts[1:]):
            digests.append(hashlib.sha256(";".join([texts[c] for c in codes[lo:hi].tolist()]).encode()).hexdigest() if ok else "")
        pairs = _distinct(u.links >> _B_SHIFT)
        number = np.searchsorted(pairs, u.links >> _B_SHIFT)
        n = _held(u, pairs, number, codes, at, good)
        some, d, p = np.flatnonzero(n), len(good), np.count_nonzero(n)
        null = lambda k, kind: pa.nulls(k, kind)
        one = [pa.array(np.zeros(d, np.int32)), pa.array(np.full(d, block)), right.column("row").combine_chunks(), right.column("doc_id").combine_chunks(), *map(pa.array, counts), pa.array(digests, pa.string()), null(d, pa.int64()), null(d, pa.int64())]
        two = [pa.array(np.ones(p, np.int32)), pa.array(np.full(p, block)), null(p, pa.int32()), *[null(p, pa.int64())] * 5, null(p, pa.string()), pa.array(pairs[some]), pa.array(n[some].astype(np.int64))]
        return pa.concat_tables([pa.Table.from_arrays(x, schema=schema) for x in (one, two)])

    return units.groupBy("block").cogroup(docs.groupBy("block")).applyInArrow(run, _DOCUMENTS)


def counted(parts: DataFrame) -> DataFrame:
    """(pair, n, best) of all pairs: documents that hold it, and whether no pair of its A id is held by more."""
    total = parts.groupBy("pair").agg(F.sum("n").alias("n"))
    a = F.shiftright("pair", _A_SHIFT - _B_SHIFT)
    return total.select("pair", "n", (F.col("n") == F.max("n").over(Window.partitionBy(a))).cast("int").alias("best"))


def unit_sums(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """(uid, n_best, count_sum): over a unit's links, those whose pair is its A id's best, and the pairs' counts."""
    each = aligned.select("uid", F.explode(F.transform("links", lambda x: F.shiftright(x, _B_SHIFT))).alias("pair"))
    # how often a pair is among the units, for those that are heavy
    often = each.groupBy("pair").agg(F.count(F.lit(1)).alias("rows")).join(pairs, "pair")
    return join_counted(each, materialise(often, tidy=True), "pair", weight="rows").groupBy("uid").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))


def document_sums(units: DataFrame, docs: DataFrame) -> DataFrame:
    """(block, row, n_best, count_sum): a document's sums over its units (block, code, n_best, count_sum)."""
    schema = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    @_lean
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("code")
        codes, at = _codes(right)
        sums = [pa.array(_per_document(np.asarray(pc.fill_null(left.column(c), 0))[codes], at)) for c in ("n_best", "count_sum")]
        return pa.Table.from_arrays([pa.array(np.full(right.num_rows, key[0].as_py())), right.column("row").combine_chunks(), *sums], schema=schema)

    return units.groupBy("block").cogroup(docs.groupBy("block")).applyInArrow(run, "block bigint, row int, n_best bigint, count_sum bigint")


def _placed(units: DataFrame, *columns: str) -> DataFrame:
    """(block, code) of every place of a unit, with the unit's columns."""
    each = units.select(F.explode("places").alias("place"), *columns)
    return each.select(F.shiftright("place", CODE_BITS).alias("block"), F.col("place").bitwiseAND((1 << CODE_BITS) - 1).cast("int").alias("code"), *columns)


def aligned_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``."""
    spark = docs.sparkSession
    cut = materialise(blocks(docs), partition_by=["kind"])
    texts = cut.filter("kind = 0").select("block", "row", "doc_id", "codes")
    units = materialise(encoded(cut.filter("kind = 1").select("block", "units"), a_path, b_path), tidy=True)
    discard(cut, "kind=1")
    with settings(spark, {ALL_KEYS: "false"}):  # all joins of the alignment find their rows together by unit
        aligned = materialise(units.select("uid", "ok", "places").join(align(units), "uid", "left"), tidy=True)
    discard(units)
    found = materialise(documents(_placed(aligned, "ok", "links"), texts), partition_by=["kind"], tidy=True)
    pairs = materialise(counted(found.filter("kind = 1").select("pair", "n")), tidy=True)
    sums = materialise(aligned.select("uid", "places").join(unit_sums(aligned, pairs), "uid", "left"), tidy=True)
    discard(aligned)
    totals = materialise(document_sums(_placed(sums, "n_best", "count_sum"), texts.select("block", "row", "codes")), tidy=True)
    discard(sums, cut)
    own = found.filter("kind = 0").select("block", "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    value = lambda c: F.when(F.col("n_a") > 0, F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias(c)
    return own.join(totals, ["block", "row"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", value("n_best"), value("count_sum"), "groups_sha256")
