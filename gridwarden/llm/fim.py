"""Fill-in-middle transformation of whole texts.

A text is decoded to an array of code points.  Each code point has a class, and where
the classes of neighbours say so a unit ends: a line ends after its newline, a word before
the white space that follows it.  Two of the unit ends, drawn by a hash of the row's id, cut the
text into prefix, middle and suffix, which are encoded again and written behind markers, either
prefix-suffix-middle (psm) or suffix-prefix-middle (spm).  ``restore`` takes the form and
the output alone and rebuilds the text.

Every row is worked on where it lies: there is no shuffle, so no key can be hot, and a worker holds
one slice of a batch (``tokens.SLICE`` bytes, or one longer text) at a time.

Cases: a null or empty text is plain, has no unit, and its output is empty; a text that holds a
marker, or that the rate leaves out, is plain, which means that its output is the text; a text of one unit can have any
two pieces empty; very long texts are one array of four bytes a code point; repeated rows give equal
rows; a null doc_id is drawn by the hash of the salt alone; other columns are ignored, whatever their names; an
empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .store import returning

#: Markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SALT = "7:"
#: Percentage of texts that are cut, and of these the percentage written as spm.
RATE, SPM = 100, 50

_SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def _line_ends(points: np.ndarray) -> np.ndarray:
    """A unit ends behind each newline."""
    return points[:-1] == 10


def _word_ends(points: np.ndarray) -> np.ndarray:
    """A unit ends where white space follows something else, so that it begins with its white space."""
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    return blank[1:] & ~blank[:-1]


#: For each kind of unit: does one end between neighbours i and i + 1?
UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"line": _line_ends, "word": _word_ends, "char": lambda points: np.ones(max(0, len(points) - 1), bool)}


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def unit_ends(points: np.ndarray, unit: str = "line") -> np.ndarray:
    """Where the units of a text end, ascending; the last is the text's end."""
    if not len(points):
        return np.zeros(0, np.int64)
    return np.append(np.flatnonzero(UNITS[unit](points)) + 1, len(points))


def draws(doc_id: int | None, salt: str = SALT) -> list[int]:
    """The first four unsigned 32-bit numbers of the hash of salt and id."""
    digest = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def cut(text: str, drawn: list[int], unit: str, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    points = points_of(text)
    ends = np.append(0, unit_ends(points, unit))
    n = len(ends) - 1
    if not text or drawn[2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (int(ends[k]) for k in sorted((drawn[0] % (n + 1), drawn[1] % (n + 1))))
    prefix, middle, suffix = (p.tobytes().decode("utf-32-le") for p in (points[:a], points[a:b], points[b:]))
    if drawn[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, unit: str = "line", rate: int = RATE, spm: int = SPM, salt: str = SALT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit}; there are {', '.join(UNITS)}")

    def run(batches):
        for whole in batches:
            for b in tokens.slices(whole):
                ids = b.column(0).to_pylist()
                rows = [cut(t or "", draws(i, salt), unit, rate, spm) for i, t in zip(ids, b.column(1).to_pylist())]
                columns = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kind) for c, kind in zip(columns, kinds))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(returning(run), _SCHEMA)


def restored(form: Column, output: Column) -> Column:
    """The text, from form and output alone.

    No piece holds a marker, and a marker's first character can't continue a marker that began in a
    piece, so the first occurrence of each is the one that was written.
    """
    first, second = F.when(form == "psm", SUFFIX).otherwise(PREFIX), F.when(form == "psm", PREFIX).otherwise(SUFFIX)
    body = output.substr(F.length(second) + 1, F.length(output))
    at = F.locate(MIDDLE, body)
    head, middle = body.substr(F.lit(1), at - 1), body.substr(at + len(MIDDLE), F.length(body))
    split = F.instr(head, first)
    one, other = head.substr(F.lit(1), split - 1), head.substr(split + F.length(first), F.length(head))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, other)).otherwise(F.concat(other, middle, one))


def restore(cut_texts: DataFrame) -> DataFrame:
    """``cut_texts`` (form, output) with ``restored``."""
    return cut_texts.withColumn("restored", restored(F.col("form"), F.col("output")))


def digests(docs: DataFrame) -> DataFrame:
    """What ``transform`` makes of every row, with the digests of its output and of the text rebuilt from it."""
    both = restore(transform(docs))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
