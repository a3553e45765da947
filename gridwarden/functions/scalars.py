"""Scalar helpers: quorum arithmetic, digest bitmaps, tolerant parsing, number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quorum(n: Column) -> Column:
    """floor(n / 2) + 1."""
    return (F.floor(n / 2) + 1).cast("int")


def digest_bytes(n: Column, signed: bool = False) -> Column:
    """Two bitmaps of ceil(n / 8) bytes, and 96 bytes of signature."""
    return (2 * F.ceil(n / 8) + (96 if signed else 0)).cast("int")


def bitmap_hex(members: Column, n: int) -> Column:
    """Members of 0..n-1 as a bitmap: bit i in byte i // 8 at place i % 8, as upper-case hex of ceil(n / 8) bytes."""
    byte = lambda k: F.aggregate(
        F.filter(members, lambda i: F.floor(i / 8) == k), F.lit(0), lambda s, i: s.bitwiseOR(F.call_function("shiftleft", F.lit(1), (i % 8).cast("int")))
    )
    return F.concat(*[F.lpad(F.hex(byte(k)), 2, "0") for k in range((n + 7) // 8)])


def int_list(text: Column) -> Column:
    """``[1, 2]`` as array<int>; null if it is not such a list."""
    return F.from_json(text, "array<int>")


def control_overhead(n: Column, messages: Column, model_mb: Column, signed: bool) -> Column:
    """Control bytes in percent of model bytes (MB of 1024 x 1024)."""
    return 100 * messages * digest_bytes(n, signed) / (model_mb * 1024 * 1024)


def trimmed_float(c: Column) -> Column:
    """Positional notation without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.15f", c.cast("double")), "0+$", ""), r"\.$", "")
