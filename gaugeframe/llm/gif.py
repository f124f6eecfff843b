"""GIF columns: encode, decode LZW code streams, apply palettes, transparency and disposal, and store timed frames.

The decoder reads any GIF87a/89a: global and local palettes, interlaced frames, extensions, sub-blocks, transparency, the four disposal
methods.  Codes are cut out of the bit stream with numpy: between two clear codes the code width depends on the position alone, so a whole
dictionary cycle is cut at once and then ended at the clear code found in it; only the dictionary itself is a loop, one step per code.

The column operators work row by row inside Arrow batches, so they scan without a shuffle; one frame is held at a time.  A payload column
is stored as 8-bit samples in frames of ``ROWS`` rows of 64 pixels, with the palette index -> grey level, so any bytes come back unchanged.

Defined results.  A null text is empty, so is a null or empty media value: it has no frames.  A broken stream gives one row with ``error``
set and the frames before it.  Repeated rows and null ids give rows of their own.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeframe.llm.common import slices, stored

WIDTH, ROWS, PAD = 64, 1024, 64
BINS = 8
_CYCLE = 4096


def _schedule(bits: int) -> np.ndarray:
    """Widths of the codes after a clear code, for a full dictionary cycle: the k-th code sees a dictionary of first + k - 1 entries."""
    first = (1 << bits) + 2
    entries = np.arange(_CYCLE + 1) + first - 1
    entries[0] = first
    return np.minimum(np.maximum(np.ceil(np.log2(entries + 1)).astype(np.int64), bits + 1), 12)


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """LZW with a clear code whenever the dictionary is full."""
    clear, first = 1 << bits, (1 << bits) + 2
    codes, cycles = [clear], [0]  # cycles: where each clear code stands
    put, table, size = codes.append, {}, first
    known, rest = table.get, iter(data)
    prefix = next(rest, None)
    for byte in rest:
        key = prefix << 8 | byte
        longer = known(key)
        if longer is not None:
            prefix = longer
            continue
        put(prefix)
        prefix = byte
        table[key] = size
        size += 1
        if size == _CYCLE:
            cycles.append(len(codes))
            put(clear)
            table, size = {}, first
            known = table.get
    if prefix is not None:
        put(prefix)
    put(clear + 1)
    return _pack(np.array(codes, dtype=np.int64), np.array(cycles), bits)


def _pack(codes: np.ndarray, cycles: np.ndarray, bits: int) -> bytes:
    """Write codes least significant bit first; the widths restart behind each clear code."""
    place = np.arange(len(codes)) - np.repeat(cycles, np.diff(np.append(cycles, len(codes))))
    widths = _schedule(bits)[np.maximum(place - 1, 0)]
    # a clear code is as wide as the dictionary it ends
    widths[cycles[1:]] = _schedule(bits)[cycles[1:] - cycles[:-1] - 1]
    widths[0] = bits + 1
    at = np.concatenate([[0], np.cumsum(widths)])
    size = (at[-1] + 7) // 8
    word = codes << (at[:-1] & 7)
    base = at[:-1] >> 3
    # the bits of different codes never overlap, so adding them is setting them
    out = sum(np.bincount(base + k, weights=(word >> (8 * k)) & 255, minlength=size + 3)[: size + 3] for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, bits: int, limit: int) -> bytes:
    """At most ``limit`` samples of a code stream.  Raises ValueError on an impossible code or a stream that ends early."""
    clear, stop, first = 1 << bits, (1 << bits) + 1, (1 << bits) + 2
    widths = _schedule(bits)
    offsets = np.concatenate([[0], np.cumsum(widths)])[: len(widths)]
    raw = np.frombuffer(data + b"\0\0\0\0", dtype=np.uint8).astype(np.int64)
    total, at, got = 8 * len(data), 0, 0
    roots = [bytes([i]) for i in range(1 << bits)]
    out: list[bytes] = []
    put = out.append
    extend = 0
    previous: bytes | None = None
    table: list[bytes] = []
    while got < limit:
        if extend:  # a full dictionary without a clear code goes on at 12 bits
            place, wide = at + 12 * np.arange(_CYCLE), np.full(_CYCLE, 12)
        else:
            place, wide = at + offsets, widths
        fits = place + wide <= total
        place, wide = place[fits], wide[fits]
        if not len(place):
            raise ValueError("the code stream ends early")
        byte = place >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (place & 7)) & ((1 << wide) - 1)
        ends = np.flatnonzero((codes == clear) | (codes == stop))
        n = int(ends[0]) if len(ends) else len(codes)
        if not extend:
            table, previous = [*roots, b"", b""], None
        push, begin, known = table.append, len(out), len(table)
        for code in codes[:n].tolist():
            if previous is None:
                if code >= clear:
                    raise ValueError("the first code is no sample")
                entry = roots[code]
            elif code < known:
                entry = table[code]
                if known < _CYCLE:
                    push(previous + entry[:1])
                    known += 1
            elif code == known < _CYCLE:
                entry = previous + previous[:1]
                push(entry)
                known += 1
            else:
                raise ValueError("a code is not in the dictionary")
            previous = entry
            put(entry)
        got += sum(map(len, out[begin:]))
        if len(ends):
            at = int(place[n] + wide[n])
            extend = 0
            if codes[n] == stop:
                break
        else:
            at = int(place[-1] + wide[-1])
            extend = 1
    return b"".join(out)[:limit]


@dataclass
class Frame:
    """One decoded frame: its rectangle of palette indices and the composed canvas."""

    number: int
    delay_ms: int
    disposal: int
    left: int
    top: int
    samples: np.ndarray  # (height, width) palette indices
    palette: np.ndarray  # (n, 3)
    transparent: int | None
    canvas: np.ndarray  # (H, W, 4) after drawing this frame


def encode_gif(frames: list[tuple[np.ndarray, int]], palette: np.ndarray, size: tuple[int, int]) -> bytes:
    """A GIF89a of (samples, delay in 1/100 s) frames drawn at the canvas origin, with one global palette of 256 colours."""
    width, height = size
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for samples, delay in frames:
        h, w = samples.shape
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08")
        data = lzw_encode(samples.astype(np.uint8).tobytes())
        out += [bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)]
        out.append(b"\0")
    return b"".join(out) + b"\x3b"


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """Joined sub-blocks from ``at``, and the position behind them."""
    parts = []
    while True:
        n = data[at]
        at += 1
        if not n:
            return b"".join(parts), at
        parts.append(data[at : at + n])
        at += n


def decode_gif(data: bytes) -> Iterator[Frame]:
    """Frames in order; the canvas follows transparency and disposal.  Raises ValueError on a broken stream."""
    try:
        yield from _decode(data)
    except (IndexError, struct.error) as e:
        raise ValueError("the file ends early") from e


def _decode(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF signature")
    width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared, at = np.frombuffer(data[at : at + 3 * n], dtype=np.uint8).reshape(-1, 3), at + 3 * n
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    delay, disposal, transparent, number = 0, 0, None, 0
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            body, at = _blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay, transparent = (body[0] >> 2) & 7, int.from_bytes(body[1:3], "little") * 10, body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind}")
        left, top, w, h, flags = struct.unpack("<HHHHB", data[at : at + 9])
        at += 9
        palette = shared
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette, at = np.frombuffer(data[at : at + 3 * n], dtype=np.uint8).reshape(-1, 3), at + 3 * n
        if palette is None:
            raise ValueError("a frame has no palette")
        bits = data[at]
        if not 1 <= bits <= 8:
            raise ValueError(f"code size {bits}")
        body, at = _blocks(data, at + 1)
        flat = np.frombuffer(lzw_decode(body, bits, w * h), dtype=np.uint8)
        if len(flat) < w * h:
            raise ValueError("a frame has too few samples")
        samples = flat.reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            samples = samples[np.argsort(order)]
        if len(flat) and flat.max() >= len(palette):
            raise ValueError("a sample is not in the palette")
        before = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]  # frames may reach over the canvas; the rest is cut off
        shown = samples[: part.shape[0], : part.shape[1]]
        seen = shown != transparent if transparent is not None else np.ones(shown.shape, dtype=bool)
        part[seen] = np.concatenate([palette[shown[seen]], np.full((int(seen.sum()), 1), 255, dtype=np.uint8)], axis=1)
        yield Frame(number, delay, disposal, left, top, samples, palette, transparent, canvas.copy())
        if disposal == 2:
            part[:] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent, number = 0, 0, None, number + 1


def histogram(canvas: np.ndarray) -> list[int]:
    """Pixels per level of red, green and blue, ``BINS`` levels each, then transparent pixels."""
    seen = canvas[..., 3] > 0
    counts = [np.bincount(canvas[..., c][seen] // (256 // BINS), minlength=BINS) for c in range(3)]
    return [*np.concatenate(counts).tolist(), int((~seen).sum())]


_FRAMES = "doc_id long, frame int, delay_ms int, disposal int, left int, top int, width int, height int, samples binary, histogram array<long>, error string"


def frame_table(media: DataFrame) -> DataFrame:
    """Timed frames of ``media(doc_id, media)``: rectangle, palette indices through the palette's red channel, and canvas histogram."""
    names, kinds = zip(*(x.split() for x in _FRAMES.split(", ")))
    arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, blob in zip(batch["doc_id"], batch["media"]):
                rows, error = [], None
                try:
                    for f in decode_gif(blob.as_py()) if blob.as_py() else ():
                        h, w = f.samples.shape
                        rows.append((doc.as_py(), f.number, f.delay_ms, f.disposal, f.left, f.top, w, h, f.palette[:, 0][f.samples].tobytes(), histogram(f.canvas), None))
                except ValueError as e:
                    error = str(e)
                if error:
                    rows.append((doc.as_py(), None, None, None, None, None, None, None, None, None, error))
                if rows:
                    yield pa.record_batch([pa.array([r[i] for r in rows], arrow[k]) for i, k in enumerate(kinds)], names=list(names))

    return media.select("doc_id", "media").mapInArrow(run, _FRAMES)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the GIF of every text's padded bytes, stored in the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grey = np.repeat(np.arange(256), 3).reshape(256, 3)
        for batch in batches:
            for rows in slices(batch):
                sizes, media = [], []
                for text in rows["text"].to_pylist():
                    data = (text or "").encode()
                    sizes.append(len(data))
                    data += b"\0" * (-len(data) % PAD or (0 if data else PAD))
                    pixels = np.frombuffer(data, dtype=np.uint8).reshape(-1, WIDTH)
                    media.append(encode_gif([(pixels[i : i + ROWS], 10) for i in range(0, len(pixels), ROWS)], grey, (WIDTH, min(len(pixels), ROWS))))
                yield pa.record_batch({"doc_id": rows["doc_id"].combine_chunks().cast(pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(media, pa.binary())})

    return stored(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary"))


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def op1(docs: DataFrame) -> DataFrame:
    """Store all texts as GIFs, read the stored bytes back and digest the frames."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(x.split() for x in _DIGEST.split(", ")))
        for batch in batches:
            rows = []
            for doc, n, blob in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"]):
                media = blob.as_py()
                whole, tail, size, frames, delay, colours = hashlib.sha256(), b"", 0, 0, 0, np.zeros(3 * BINS + 1, dtype=np.int64)
                for f in decode_gif(media):
                    samples = f.palette[:, 0][f.samples].tobytes()
                    whole.update(samples)
                    tail, size, frames, delay = (tail + samples)[-PAD:], size + len(samples), frames + 1, delay + f.delay_ms
                    colours += np.array(histogram(f.canvas))
                feature = f"frames={frames};ms={delay};levels={','.join(map(str, colours[:BINS]))}"
                rows.append((doc, n, size, whole.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64() if k == "long" else pa.string()) for i, k in enumerate(kinds)], names=list(names))

    return to_media(docs).mapInArrow(run, _DIGEST)
