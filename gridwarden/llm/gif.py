"""GIF media columns: timed frames with colour histograms.

``decode`` reads the block structure, decodes each frame's LZW code stream, applies the
local or global palette, interlacing, transparency and the disposal of the frame before,
and yields the canvas as it is shown, its delay and its colour histogram (2 bits a
channel, 64 bins, of opaque pixels).  ``frames`` turns a table of images into a table of timed
frames: number, start and delay in milliseconds, place, disposal, and the histogram as a
column; ``stored_frames`` writes that table, and ``features`` is computed from it.

Code streams.  Between two clear codes the width of the n-th code follows from n alone,
so a whole stretch is cut from the bits by array operations; only the string table
itself is a loop.  The encoder packs in the same way.

A header may state any size, so a screen of more than ``MOST_PIXELS`` or a frame that does not
lie inside its screen is damage, found before memory is taken; frames share one canvas, which
changes in place.

``store_payload`` writes bytes as such an image: samples are palette indices of a
64-pixel wide grey image, at most ``ROWS`` rows a frame, so a long payload is an animation.

Cases: null media has no frame, and its features are null; a damaged file yields the frames before the damage and
an ``error``; an empty text is one row of 64 zero samples; a very long text is an animation of many frames; repeated rows give equal
results; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise, returning

WIDTH, ROWS, DELAY_CS = 64, 1024, 10
TABLE = 4096
MOST_PIXELS = 1 << 25


@dataclass
class Frame:
    number: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    samples: np.ndarray  # (height, width) palette indices
    canvas: np.ndarray  # (screen height, screen width, 4) RGBA as shown; valid until the next frame is asked for
    start_ms: int

    def histogram(self) -> np.ndarray:
        """Opaque pixels of each of 64 colours; bin = 16 red + 4 green + blue, two bits each."""
        px = self.canvas.reshape(-1, 4)
        key = (px[:, 0] >> 6) << 4 | (px[:, 1] >> 6) << 2 | px[:, 2] >> 6
        return np.bincount(key if px[:, 3].all() else key[px[:, 3] > 0], minlength=64)

    def payload(self) -> bytes:
        """Red channel of the frame's own rows."""
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width, 0].tobytes()


def widths(least: int, n: int) -> np.ndarray:
    """Bits of the codes 0..n-1 after a clear code, for a minimum code size."""
    top = (1 << least) + 1 + np.arange(n)  # largest index the decoder can know by then
    bits = np.floor(np.log2(np.maximum(top, 1))).astype(np.int64) + 1
    return np.clip(bits, least + 1, 12)


def lzw_decode(data: bytes, least: int, most: int) -> bytes:
    """At most ``most`` samples from a code stream (sub-blocks already joined)."""
    clear, end = 1 << least, (1 << least) + 1
    buffer = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    total, at = len(data) * 8, 0
    span = widths(least, TABLE + 2)
    offsets = np.concatenate([[0], np.cumsum(span)])
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    made = 0
    finished = False
    while at < total and made < most and not finished:
        codes: list[int] = []
        n_seen = 0
        while True:  # one stretch, up to the next clear or end code
            if n_seen == 0:
                off, wid = offsets[:-1], span
            else:  # the table is full: twelve bits each from here
                wid = np.full(TABLE, 12, np.int64)
                off = np.arange(TABLE) * 12
            room = int(np.searchsorted(off + wid, total - at, side="right"))
            off, wid = off[:room], wid[:room]
            bit = at + off
            byte = bit >> 3
            raw = buffer[byte] | buffer[byte + 1] << np.uint32(8) | buffer[byte + 2] << np.uint32(16)
            got = (raw >> (bit & 7).astype(np.uint32)) & ((1 << wid) - 1).astype(np.uint32)
            stop = np.flatnonzero((got == clear) | (got == end))
            if len(stop):
                k = int(stop[0])
                codes += got[:k].tolist()
                at += int(off[k] + wid[k])
                finished = int(got[k]) == end
                break
            codes += got.tolist()
            if not room:
                at = total
                break
            at += int(off[-1] + wid[-1])
            n_seen += room
            if at >= total or room < len(span if n_seen == room else off):
                at = total if at + 12 > total else at
                if at >= total:
                    break
        if not codes:
            continue
        table, before = base.copy(), len(out)
        add = table.append
        put = out.append
        prev = table[codes[0]] if codes[0] < clear else None
        if prev is None:
            raise ValueError("a code stream begins with an unknown code")
        put(prev)
        grow = TABLE - len(table)
        for code in codes[1 : grow + 1]:
            try:
                entry = table[code]
            except IndexError:
                if code != len(table):
                    raise ValueError("an unknown code") from None
                entry = prev + prev[:1]
            add(prev + entry[:1])
            put(entry)
            prev = entry
        for code in codes[grow + 1 :]:
            put(table[code])
        made += sum(map(len, out[before:]))
    return b"".join(out)[:most]


def lzw_codes(data: bytes) -> list[list[int]]:
    """Stretches of codes for 8-bit samples, each to be followed by a clear code (the last by the end code)."""
    stretches, out, table, free = [], [], {}, 258
    get, put = table.get, out.append
    if not data:
        return [[]]
    prefix = data[0]
    for c in data[1:]:
        key = prefix << 8 | c
        known = get(key)
        if known is None:
            put(prefix)
            table[key] = free
            free += 1
            prefix = c
            if free == TABLE:
                stretches.append(out)
                out, table, free = [], {}, 258
                get, put = table.get, out.append
        else:
            prefix = known
    put(prefix)
    return [*stretches, out]


def lzw_encode(data: bytes) -> bytes:
    stretches = lzw_codes(data)
    span = widths(8, TABLE)
    codes = [np.array([256])]
    bits = [np.array([9])]
    for i, s in enumerate(stretches):
        codes.append(np.array([*s, 257 if i == len(stretches) - 1 else 256]))
        bits.append(span[: len(s) + 1])
    c, w = np.concatenate(codes).astype(np.uint32), np.concatenate(bits)
    at = np.cumsum(w) - w
    size = int((at[-1] + w[-1] + 7) >> 3)
    flat = np.zeros(size + 3, np.uint32)
    shifted = c << (at & 7).astype(np.uint32)
    byte = at >> 3
    for k in range(3):  # a code of up to 12 bits touches at most three bytes; codes overlap only in disjoint bits
        flat += np.bincount(byte + k, ((shifted >> np.uint32(8 * k)) & np.uint32(255)).astype(np.float64), size + 3).astype(np.uint32)
    return flat[:size].astype(np.uint8).tobytes()


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


_GREY = bytes(v for i in range(256) for v in (i, i, i))


def store_payload(payload: bytes) -> bytes:
    """A grey GIF89a whose samples are the payload (a positive multiple of WIDTH bytes)."""
    height = min(ROWS, len(payload) // WIDTH)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), _GREY]
    for at in range(0, len(payload), WIDTH * ROWS):
        part = payload[at : at + WIDTH * ROWS]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 2 << 2, DELAY_CS, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08" + _blocks(lzw_encode(part)))
    return b"".join(out) + b"\x3b"


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _interlaced(height: int) -> np.ndarray:
    """Row numbers in the order in which an interlaced frame stores them."""
    return np.concatenate([np.arange(a, height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF; raises ValueError at the first damage."""
    if data[:3] != b"GIF" or len(data) < 13:
        raise ValueError("no GIF")
    try:
        yield from _decode(data)
    except (IndexError, struct.error) as e:
        raise ValueError(f"the file ends early: {e}") from None


def _palette(raw: bytes) -> np.ndarray:
    table = np.zeros((256, 4), np.uint8)
    table[:, 3] = 255
    rgb = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    table[: len(rgb), :3] = rgb
    return table


def _decode(data: bytes) -> Iterator[Frame]:
    w, h, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if w * h > MOST_PIXELS:
        raise ValueError(f"a screen of {w} x {h}")
    at, shared, clock = 13, None, 0
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared, at = _palette(data[at : at + n]), at + n
    canvas = np.zeros((h, w, 4), np.uint8)
    number, delay, disposal, clear = 0, 0, 0, None
    while data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            body, end = _sub_blocks(data, at + 2)
            if data[at + 1] == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear = bits >> 2 & 7, index if bits & 1 else None
            at = end
            continue
        if kind != 0x2C:
            raise ValueError(f"an unknown block {kind}")
        left, top, fw, fh, bits = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        if left + fw > w or top + fh > h:
            raise ValueError(f"a frame of {fw} x {fh} at {left}, {top} leaves its screen")
        table = shared
        if bits & 0x80:
            n = 3 << ((bits & 7) + 1)
            table, at = _palette(data[at : at + n]), at + n
        if table is None:
            raise ValueError("a frame without a palette")
        least = data[at]
        if not 2 <= least <= 8:
            raise ValueError("a wrong code size")
        stream, at = _sub_blocks(data, at + 1)
        pixels = lzw_decode(stream, least, fw * fh)
        if len(pixels) < fw * fh:
            raise ValueError("a frame has too few samples")
        samples = np.frombuffer(pixels, np.uint8).reshape(fh, fw)
        if bits & 0x40:
            straight = np.empty_like(samples)
            straight[_interlaced(fh)] = samples
            samples = straight
        region = canvas[top : top + fh, left : left + fw]
        before = region.copy() if disposal == 3 else None
        if clear is None:
            region[:] = table[samples]
        else:
            shown = samples != clear
            region[shown] = table[samples[shown]]
        yield Frame(number, delay * 10, left, top, fw, fh, disposal, samples, canvas, clock)
        if disposal == 2:
            region[:] = 0
        elif before is not None:
            region[:] = before
        clock += delay * 10
        number, delay, disposal, clear = number + 1, 0, 0, None


FRAMES = "frame_no int, start_ms int, delay_ms int, left int, top int, width int, height int, disposal int, histogram array<bigint>, error string"


def _frame_values(f: Frame) -> tuple:
    return f.number, f.start_ms, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, f.histogram().tolist(), None


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", samples: bool = True) -> DataFrame:
    """One row for each frame of each GIF, with its palette indices where ``samples``; a damaged file ends with a row that has only ``error``."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                b = whole.slice(lo, 64)
                rows = []
                for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if data is None:
                        continue
                    try:
                        for f in decode(data):
                            rows.append((key, *_frame_values(f), f.samples.tobytes()))
                    except ValueError as e:
                        rows.append((key, *[None] * 9, str(e), None))
                columns = zip(zip(*rows) if rows else [[]] * 12, [b.schema.types[0], *types])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns][: 12 if samples else 11], names)

    types = [pa.int32()] * 8 + [pa.list_(pa.int64()), pa.string(), pa.binary()]
    schema = f"`{id_col}` {dict(media.dtypes)[id_col]}, {FRAMES}" + (", samples binary" if samples else "")
    names = [id_col, *(c.split()[0] for c in FRAMES.split(", ")), *(["samples"] if samples else [])]
    return media.select(id_col, media_col).mapInArrow(returning(run), schema)


def payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes padded with 0 to a positive multiple of WIDTH."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def stored(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_bytes, media) of every text, as a table in the shared folder; ``row`` numbers the rows in no order."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                both = [payload(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([n for n, _ in both], pa.int64()), pa.array([store_payload(p) for _, p in both], pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    made = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(returning(run), "doc_id bigint, n_bytes bigint, media binary")
    return materialise(made.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", "media"))


_DIGESTS = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string"


def stored_frames(media: DataFrame) -> DataFrame:
    """The frame table of ``stored`` images, in the shared folder: one decoding pass over the stored bytes.

    (row, doc_id, n_bytes, the columns of ``frames`` but the samples, and on the image's last row
    the digests of its payload and of its bytes).  The samples stay in the image.
    """
    types = [pa.int32()] * 8 + [pa.list_(pa.int64()), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["row", "doc_id", "n_bytes", *(c.split()[0] for c in f"{FRAMES}, {_DIGESTS}".split(", "))]

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                at, rows = [], []
                for i, data in enumerate(b.column(3).to_pylist()):
                    sha, tail, size, own = hashlib.sha256(), b"", 0, []
                    if data is not None:
                        try:
                            for f in decode(data):
                                part = f.payload()
                                sha.update(part)
                                tail, size = (tail + part)[-64:], size + len(part)
                                own.append((*_frame_values(f), *[None] * 5))
                        except ValueError as e:
                            own.append((*[None] * 9, str(e), *[None] * 5))
                    if not own:
                        own.append((None,) * 15)
                    if data is not None:
                        own[-1] = (*own[-1][:10], size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest())
                    at += [i] * len(own)
                    rows += own
                keys = b.select(["row", "doc_id", "n_bytes"]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 15, types))], names)

    return materialise(media.select("row", "doc_id", "n_bytes", "media").mapInArrow(returning(run), f"row bigint, doc_id bigint, n_bytes bigint, {FRAMES}, {_DIGESTS}"))


def features(timed: DataFrame) -> DataFrame:
    """Of a ``stored_frames`` table per image: its digests, and as text its frames, duration and summed colour histogram.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_frames, duration_ms)
    """
    bins = [F.sum(F.get("histogram", k)).alias(f"_{k}") for k in range(64)]
    digests = [F.max(c.split()[0]).alias(c.split()[0]) for c in _DIGESTS.split(", ")]
    per = timed.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), *digests, F.count("frame_no").cast("int").alias("n_frames"), F.coalesce(F.sum("delay_ms"), F.lit(0)).alias("duration_ms"), *bins
    )
    colours = F.concat_ws(",", *[F.when(F.col(f"_{k}") > 0, F.concat(F.lit(f"{k}:"), F.col(f"_{k}"))) for k in range(64)])
    feature = F.when(F.col("media_bytes").isNotNull(), F.concat(F.lit("frames="), "n_frames", F.lit(";ms="), "duration_ms", F.lit(";colours="), colours))
    return per.select("doc_id", "n_bytes", *[c.split()[0] for c in _DIGESTS.split(", ")], feature.alias("feature"), "n_frames", "duration_ms")
