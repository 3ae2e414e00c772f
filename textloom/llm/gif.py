"""Operator 1, media columns: GIF.

Reads GIF files held in a binary column: LZW code streams, global and local palettes, interlacing, transparency, the three
disposal rules and frame delays. Each frame becomes a row with its time and colour histograms. A writer stores byte payloads
losslessly as 8-bit samples, so that any payload makes an exact round trip.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH, MAX_ROWS, BINS = 64, 1024, 8
#: The grey ramp: sample value and palette entry are the same number.
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)
#: Fixed values of the format: first row and step of the four interlace passes.
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


class BadGif(ValueError):
    pass


# ---- LZW


def lzw_encode(samples: bytes) -> bytes:
    """LZW for 8-bit samples with a growing dictionary and codes of 9 to 12 bits; a clear code where the table is full."""
    codes = [256]
    put, table, size = codes.append, {}, 258
    prefix = samples[0] if samples else None
    for b in memoryview(samples)[1:]:
        key = prefix << 8 | b
        if key in table:
            prefix = table[key]
            continue
        put(prefix)
        prefix = b
        if size == 4096:
            put(256)
            table.clear()
            size = 258
        else:
            table[key] = size
            size += 1
    if prefix is not None:
        put(prefix)
    put(257)
    flat = np.array(codes, np.uint16)
    since = np.arange(len(flat)) - 1
    since -= np.maximum.accumulate(np.where(np.concatenate(([False], flat[:-1] == 256)), since, 0))  # codes after the last clear code
    widths = _widths(8)[np.maximum(since, 0)]
    bits = np.unpackbits(flat.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def _read_codes(data: np.ndarray, bit: int, widths: np.ndarray) -> np.ndarray:
    at = bit + np.concatenate(([0], np.cumsum(widths[:-1])))
    byte = at >> 3
    if byte[-1] + 3 > len(data):
        keep = byte + 3 <= len(data)
        at, byte, widths = at[keep], byte[keep], widths[: int(keep.sum())]
    v = data[byte].astype(np.uint32) | data[byte + 1].astype(np.uint32) << 8 | data[byte + 2].astype(np.uint32) << 16
    return (v >> (at & 7).astype(np.uint32)) & ((1 << widths.astype(np.uint32)) - 1)


@cache
def _widths(min_size: int) -> np.ndarray:
    """Bits of the j-th code after a clear code: the table has 2**min_size + 2 + max(0, j - 1) entries by then."""
    n = (1 << min_size) + 3 + np.maximum(0, np.arange(4608) - 1)
    return np.minimum(np.maximum(min_size + 1, np.ceil(np.log2(n)).astype(np.int64)), 12)


def lzw_decode(stream: bytes, min_size: int, count: int) -> np.ndarray:
    """The first ``count`` samples of an LZW stream; a stream that ends early or holds an impossible code raises BadGif."""
    if not 1 <= min_size <= 11:
        raise BadGif("code size")
    clear = 1 << min_size
    data = np.frombuffer(stream + b"\0\0\0", np.uint8)
    limit, bit, parts, have = 8 * len(stream), 0, [], 0
    grow = _widths(min_size)
    while have < count:
        if bit + min_size + 1 > limit:
            raise BadGif("short code stream")
        # One segment up to the next clear code.
        codes, j = [], 0
        while True:
            widths = grow[j : j + 1024] if j + 1024 <= len(grow) else grow[-1024:]
            got = _read_codes(data, bit, widths)
            got = got[: int(np.searchsorted(np.cumsum(widths), limit - bit, side="right"))]
            stop = np.flatnonzero((got == clear) | (got == clear + 1))
            n = int(stop[0]) if len(stop) else len(got)
            codes.append(got[:n])
            j += n
            if len(stop):
                bit += int(widths[: n + 1].sum())
                ended = int(got[n]) == clear + 1
                break
            if n < len(widths):
                ended = True
                break
            bit += int(widths.sum())
        seg = _expand(np.concatenate(codes).tolist(), clear)[: count - have]
        parts.append(np.frombuffer(seg, np.uint8))
        have += len(seg)
        if ended:
            break
    if have < count:
        raise BadGif("short code stream")
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def _expand(codes: list[int], clear: int) -> bytes:
    if not codes:
        return b""
    table: list[bytes] = [bytes([i]) if i < 256 else b"" for i in range(clear)] + [b"", b""]
    if codes[0] >= clear:
        raise BadGif("first code")
    last = table[codes[0]]
    out, size, add = [last], len(table), table.append
    for code in codes[1:]:
        if code < size:
            now = table[code]
        elif code == size:
            now = last + last[:1]
        else:
            raise BadGif("code beyond the table")
        if size < 4096:
            add(last + now[:1])
            size += 1
        out.append(now)
        last = now
    return b"".join(out)


# ---- container


def encode_samples(payload: bytes, delay_cs: int = 10) -> bytes:
    """A GIF whose frames hold ``payload`` (a multiple of 64 bytes) row by row: 64 columns, at most 1024 rows a frame, grey ramp."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, MAX_ROWS), 0xF7, 0, 0), GREY.tobytes()]
    for top in range(0, rows, MAX_ROWS):
        part = payload[top * WIDTH : (top + MAX_ROWS) * WIDTH]
        code = lzw_encode(part)
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay_cs, 0), b"\0,", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08"]
        for i in range(0, len(code), 255):
            out += [bytes([len(code[i : i + 255])]), code[i : i + 255]]
        out.append(b"\0")
    return b"".join(out) + b";"


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise BadGif("open sub-block")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def frames(data: bytes) -> Iterator[dict]:
    """The frames in order, each with the canvas (height, width, RGBA) that is shown while it lasts.

    Disposal 2 clears the frame's rectangle to transparent before the next frame, 3 restores what was there before it.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise BadGif("no GIF header")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, common_palette = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        common_palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal = delay = index = start = 0
    clear_index: int | None = None
    while True:
        kind = data[at : at + 1]
        if kind == b";":
            return
        if kind == b"!":
            body, end = _sub_blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                clear_index = body[3] if body[0] & 1 else None
            at = end
            continue
        if kind != b"," or at + 11 > len(data):
            raise BadGif("unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = common_palette
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        if palette is None:
            raise BadGif("no palette")
        min_size = data[at]
        stream, at = _sub_blocks(data, at + 1)
        samples = lzw_decode(stream, min_size, w * h).reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in PASSES])
            plain = np.empty_like(samples)
            plain[order] = samples
            samples = plain
        if samples.size and int(samples.max()) >= len(palette):
            raise BadGif("sample beyond the palette")
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        own = samples[: area.shape[0], : area.shape[1]]
        if clear_index is None:
            area[..., :3] = palette[own]
            area[..., 3] = 255
        else:
            drawn = own != clear_index
            area[drawn] = np.column_stack((palette[own[drawn]], np.full(int(drawn.sum()), 255, np.uint8)))
        yield {"frame_no": index, "start_ms": start * 10, "delay_ms": delay * 10, "left": left, "top": top, "width": w, "height": h, "disposal": disposal, "canvas": canvas, "samples": samples}
        index, start = index + 1, start + delay
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif before is not None:
            canvas = before
        disposal = delay = 0
        clear_index = None


def histogram(channel: np.ndarray, bins: int = BINS) -> list[int]:
    counts = np.bincount(channel.reshape(-1), minlength=256)
    return counts.reshape(bins, -1).sum(1).tolist()


# ---- operators

FRAME_FIELDS = "frame_no int, start_ms long, delay_ms int, left int, top int, width int, height int, disposal int, canvas_width int, canvas_height int, rgba binary, visible_pixels long, hist_r array<long>, hist_g array<long>, hist_b array<long>, error string"


def gif_frames(df: DataFrame, gif: str = "gif", pixels: bool = True) -> DataFrame:
    """One row per frame of the GIFs in binary column ``gif``, with every other column of ``df`` in struct column ``source``.

    ``rgba`` is the composed canvas (null with ``pixels=False``); histograms count the visible pixels by 8 levels a channel.
    A null GIF gives no row; a broken one gives the frames before the fault and then one row with ``error`` and null frame fields.
    Repeated rows give repeated frames; an empty table gives an empty table. ``source`` keeps clashing names apart.
    """
    rest = [c for c in df.columns if c != gif]
    given = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("source") if rest else F.struct(F.lit(1).alias("none")).alias("source"), F.col(f"`{gif}`").alias("gif"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("source").type
            schema = pa.schema([("source", kind), ("frame_no", pa.int32()), ("start_ms", pa.int64()), *[(n, pa.int32()) for n in ("delay_ms", "left", "top", "width", "height", "disposal", "canvas_width", "canvas_height")], ("rgba", pa.binary()), ("visible_pixels", pa.int64()), *[(n, pa.list_(pa.int64())) for n in ("hist_r", "hist_g", "hist_b")], ("error", pa.string())])
            held, size = [], 0
            for i in range(batch.num_rows):
                source, data = batch.column("source")[i].as_py(), batch.column("gif")[i].as_py()
                if data is None:
                    continue
                try:
                    for x in frames(data):
                        canvas = x.pop("canvas")
                        x.pop("samples")
                        seen = canvas[..., 3] > 0
                        row = x | {"source": source, "canvas_width": canvas.shape[1], "canvas_height": canvas.shape[0], "rgba": canvas.tobytes() if pixels else None, "visible_pixels": int(seen.sum())}
                        row |= {f"hist_{n}": histogram(canvas[..., k][seen]) for k, n in enumerate("rgb")}
                        held.append(row)
                        size += len(row["rgba"] or b"")
                        if len(held) >= 256 or size >= common.BLOCK_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                except (BadGif, IndexError, ValueError, struct.error) as error:
                    held.append({"source": source, "error": str(error) or type(error).__name__})
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

    return given.mapInArrow(rows, f"source {given.schema['source'].dataType.simpleString()}, {FRAME_FIELDS}")


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def store_and_read(row: dict) -> Iterator[dict]:
    text = common.text_or_empty(row["text"])
    payload = text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))
    media = encode_samples(payload)
    digest, size, tail, hist, n, lasts = hashlib.sha256(), 0, b"", np.zeros(BINS, np.int64), 0, 0
    for x in frames(media):
        grey = np.ascontiguousarray(x["canvas"][: x["height"], :, 0])
        digest.update(grey)
        size += grey.size
        tail = grey[-1].tobytes()
        hist += histogram(grey)
        n, lasts = n + 1, x["start_ms"] + x["delay_ms"]
    feature = f"frames={n};ms={lasts};grey=" + ",".join(map(str, hist.tolist()))
    yield {"doc_id": row["doc_id"], "n_bytes": len(text), "payload_bytes": size, "payload_sha256": digest.hexdigest(), "tail_crc32": zlib.crc32(tail), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature}


def text_media(docs: DataFrame) -> DataFrame:
    """Store each text as a GIF, read the stored bytes back through ``frames`` and describe what came back.

    A null text counts as empty (64 zero bytes); null ids and repeated rows stay; an empty table gives an empty table; other columns
    are not read. A text is held whole, as its cell is, and its frames are read one at a time.
    """
    return docs.select("doc_id", "text").mapInArrow(common.over_rows(store_and_read, MEDIA), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
