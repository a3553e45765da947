"""Packing by shortest-pack-first over the length histogram.

Documents are cut into full sequences and one rest, which is shorter than a
sequence.  The histogram of the rests has at most ``size - 1`` bins
whatever the number of documents.  Lengths are placed from the longest: the bin
joins the pattern with the most room left (the shortest pack); the smaller of the
two counts is taken, and what remains goes on.  The result is a list of patterns
(lengths, count), again bounded by the number of bins.

Cutting.  Where one length is so common that it leaves packs with much room (copies
of a text longer than half a sequence), some of its documents are cut: the first
part fills the room of the others' packs, and the rest is packed like any other length.
The plan says how many documents of a length are cut, and where; it is made on the
histogram, and only while padding exceeds ``MOST_PADDING``.  Cuts stand on a grid of
``GRID`` ids, for which the CRC-32 of each prefix is kept: the CRC of a part follows from
those of two prefixes, so ids are neither stored nor encoded again.

Joining back.  Slot number r of a length belongs to a known pattern and copy of it, so
each piece needs only its rank among the pieces of its length.  Ranks are counted
part by part of the input (``part`` is the task that cut it): within a part by a
window, before it by the parts' histograms.  No length, however common, is one
task's work.

A last sequence of a pattern is padded to ``size``; where the filled length is
a power of two it is left as it is (``padded`` gives the length).

Cases: a null text is an empty one, whose only id is the end id; equal doc_ids
are kept as rows of their own; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .store import materialise, returning
from .token_store import shifts, times

SIZE = 4096
GRID, MOST_PADDING = 64, 0.01
PIECE = "part int, row bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, prefixes array<bigint>"


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, number of such packs) that use every length as often as it occurs."""
    packs: dict[int, list[list]] = {}  # used length -> [[lengths, count], ...]
    used = np.zeros(size + 1, bool)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fits = np.flatnonzero(used[: size - length + 1])
            if not len(fits):
                # a new pack takes as many of this length as it holds before the next one is opened
                full, rest = divmod(left, size // length)
                for k, count in ((size // length, full), (rest, 1)):
                    if k and count:
                        packs.setdefault(k * length, []).append([(length,) * k, count])
                        used[k * length] = True
                break
            shortest = int(fits[0])
            lengths, count = packs[shortest][-1]
            taken = min(count, left)
            left -= taken
            if taken == count:
                packs[shortest].pop()
                used[shortest] = bool(packs[shortest])
            else:
                packs[shortest][-1][1] -= taken
            packs.setdefault(shortest + length, []).append([(*lengths, length), taken])
            used[shortest + length] = True
    return [(tuple(lengths), count) for total in sorted(packs) for lengths, count in packs[total]]


def unfilled(found: list[tuple[tuple[int, ...], int]], size: int = SIZE) -> int:
    """Ids of padding."""
    return sum(count * (padded(sum(lengths), size) - sum(lengths)) for lengths, count in found)


def plan_cuts(histogram: dict[int, int], size: int = SIZE, tries: int = 40) -> dict[int, list[tuple[int, tuple[int, ...]]]]:
    """length -> [(documents, their part lengths), ...]: the first so many documents of the length are cut so."""
    plan = {n: [(c, (n,))] for n, c in histogram.items()}
    total = sum(n * c for n, c in histogram.items())
    found = patterns(histogram, size)
    given_up: set[tuple[int, ...]] = set()
    for _ in range(tries):
        padding = unfilled(found, size)
        worst = [(c * (size - sum(p)), p, c) for p, c in found if c > 1 and size - sum(p) >= GRID and padded(sum(p), size) > sum(p) and p not in given_up]
        if padding <= MOST_PADDING * total or not worst:
            break
        _, lengths, count = max(worst)
        first = (size - sum(lengths)) // GRID * GRID
        whole = max(lengths)  # longer than the room, else it would have been placed there
        entries = [(c, n, i) for n, e in plan.items() for i, (c, parts) in enumerate(e) if whole in parts]
        if not entries or first >= whole:
            given_up.add(lengths)
            continue
        has, n, i = max(entries)
        cut = min(has, max(1, count * len(lengths) // (len(lengths) + 1)))
        parts = plan[n][i][1]
        at = parts.index(whole)
        new = (*parts[:at], first, whole - first, *parts[at + 1 :])
        entry = [(cut, new)] + ([(has - cut, parts)] if has > cut else [])
        tried = plan | {n: [*plan[n][:i], *entry, *plan[n][i + 1 :]]}
        again = patterns(part_histogram(tried), size)
        if unfilled(again, size) < padding:
            plan, found = tried, again
        else:
            given_up.add(lengths)
    return plan


def part_histogram(plan: dict[int, list[tuple[int, tuple[int, ...]]]]) -> dict[int, int]:
    out: dict[int, int] = {}
    for entries in plan.values():
        for count, parts in entries:
            for n in parts:
                out[n] = out.get(n, 0) + count
    return out


class Slots:
    """For each length the runs of slots that patterns offer: first rank, sequence of that rank, offset."""

    def __init__(self, plan: dict[int, list[tuple[int, tuple[int, ...]]]], size: int = SIZE) -> None:
        runs: dict[int, list[tuple[int, int, int]]] = {}
        upto: dict[int, int] = {}
        sequence = 0
        for lengths, count in patterns(part_histogram(plan), size):
            offset = 0
            for n in lengths:
                runs.setdefault(n, []).append((upto.get(n, 0), sequence, offset))
                upto[n] = upto.get(n, 0) + count
                offset += n
            sequence += count
        self.sequences = sequence
        self.runs = {n: np.array(r, np.int64).T for n, r in runs.items()}
        #: length -> [(first document rank, count, [(start, part length, first slot)])]
        self.parts: dict[int, list[tuple[int, int, list[tuple[int, int, int]]]]] = {}
        given: dict[int, int] = {}
        for n in sorted(plan):
            rank = 0
            for count, lengths in plan[n]:
                own, start = [], 0
                for k in lengths:
                    own.append((start, k, given.get(k, 0)))
                    given[k] = given.get(k, 0) + count
                    start += k
                self.parts.setdefault(n, []).append((rank, count, own))
                rank += count

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start in the row's piece, length, sequence, offset) of every part of the pieces with these lengths and ranks."""
        out = []
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(order)]):
            at = order[lo:hi]
            for rank, count, own in self.parts[int(lengths[at[0]])]:
                rows = at[(ranks[at] >= rank) & (ranks[at] < rank + count)]
                for start, n, slot in own:
                    first, base, off = self.runs[n]
                    r = slot + ranks[rows] - rank
                    k = np.searchsorted(first, r, side="right") - 1
                    out.append((rows, np.full(len(rows), start), np.full(len(rows), n), base[k] + r - first[k], off[k]))
        return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(5))


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = SIZE) -> DataFrame:
    """Full sequences and the rest of every document, with the CRC-32 of each one's ids."""

    def run(batches):
        from pyspark import TaskContext

        enc, task, row = tokens.library(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in tokens.slices(whole):
                ids, bounds = enc.encode(b.column(1))
                out = {k: [] for k in arrow.names}
                for k, doc in enumerate(b.column(0).to_pylist()):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), size):
                        part = own[start : start + size]
                        crc, prefixes = 0, []
                        if len(part) < size:  # a full piece is never cut
                            for at in range(0, len(part) - GRID, GRID):
                                crc = zlib.crc32(part[at : at + GRID], crc)
                                prefixes.append(crc)
                        crc = zlib.crc32(part[len(prefixes) * GRID :], crc)
                        for name, v in zip(arrow.names, (task, row, doc, start, len(part), crc, len(own), prefixes)):
                            out[name].append(v)
                    row += 1
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    arrow = pa.schema([("part", pa.int32()), *((n, pa.int64()) for n in ("row", "doc_id", "start", "length", "ids_crc32", "doc_tokens")), ("prefixes", pa.list_(pa.int64()))])
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(returning(run), PIECE)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = SIZE) -> DataFrame:
    """Where each piece of each document goes; see the module for columns and cases."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer, end_id, size))  # once: what follows reads a small table
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    # at most `size` rows come back, however many documents there are
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = Slots(plan_cuts(histogram, size), size)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part", "length").orderBy("row", "start"))
    ranked = cut.withColumn("inside", inside - 1).join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("inside"))
    shared = spark.sparkContext.broadcast(slots)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        powers = shifts()
        for b in batches:
            row, start, length, sequence, offset = shared.value.place(b.column(2).to_numpy(), b.column(6).to_numpy())
            taken = b.take(pa.array(row))
            crcs = taken.column(3).to_numpy().copy()
            whole = taken.column(2).to_numpy()
            for i in np.flatnonzero(length < whole).tolist():
                lo, hi = int(start[i]), int(start[i] + length[i])
                prefixes = taken.column(5)[i].as_py()
                end = int(crcs[i]) if hi == whole[i] else prefixes[hi // GRID - 1]
                crcs[i] = end ^ times(powers[hi - lo], prefixes[lo // GRID - 1]) if lo else end
            out = [taken.column(0), pa.array(taken.column(1).to_numpy() + start), pa.array(length), pa.array(crcs), taken.column(4), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays([x.cast(pa.int64()) for x in out], [*columns, "sequence_id", "offset"])

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return ranked.select(*columns, "prefixes", "rank").mapInArrow(returning(run), schema)


def padded(used: int, size: int = SIZE) -> int:
    """Stored length of a sequence with ``used`` ids."""
    return used if used & (used - 1) == 0 else size
