"""Media columns: GIF images as binary columns, decoded to timed frames with colour histograms.

decode_gif() reads the whole format: global and local palettes, interlace, delays,
transparency, and the disposal rules (keep, clear to background, restore what was
before). LZW code streams are cut into codes with array arithmetic, as a code's width
follows from its place after the last clear code, and each code's string is a slice of
the output already written.

encode_gif() stores 8-bit samples losslessly as grey frames of 192 samples a row, a few
hundred rows a frame, so that a payload of any length fits.

Edge cases: a null or broken image, or one of more than MOST_PIXELS, gives the frames
before the break and its error text; null texts are
stored like empty ones; repeated rows stay; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm.common import materialise, table, utf8

ROW = 192
FRAME_ROWS = 320
DELAY_CS = 4
BINS = 16
#: Pixels of the largest canvas and frame that are decoded; a few bytes may declare four thousand million.
MOST_PIXELS = 1 << 24
#: Bytes of output that a task gathers before it hands them on.
BATCH_BYTES = 16 << 20
#: The passes of an interlaced image: first row and step.
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))
NETSCAPE_LOOP = b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
GREY = bytes(v for i in range(256) for v in (i, i, i))


@dataclass
class Frame:
    """One shown frame: its own samples (palette indices) and the composed picture."""

    index: int
    start_ms: int
    delay_ms: int
    left: int
    top: int
    disposal: int
    samples: np.ndarray
    rgba: np.ndarray


def code_widths(count: int, bits: int) -> np.ndarray:
    """The widths of the codes that follow a clear code, for minimum code size bits."""
    return _widths(bits)[np.minimum(np.arange(count), 4096)]


def _widths(bits: int, known: dict = {}) -> np.ndarray:  # noqa: B006  a cache
    if bits not in known:
        entries = (1 << bits) + 2 + np.maximum(np.arange(4097) - 1, 0)
        known[bits] = np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, bits + 1, 12)
    return known[bits]


def lzw_codes(data: bytes, bits: int = 8) -> list[list[int]]:
    """The codes of data in runs; a clear code stands before each run."""
    runs, codes, known, free = [], [], {}, (1 << bits) + 2
    if not data:
        return [[]]
    emit, get = codes.append, known.get
    prefix = data[0]
    for b in memoryview(data)[1:]:
        key = prefix << 8 | b
        code = get(key)
        if code is not None:
            prefix = code
            continue
        emit(prefix)
        if free < 4096:
            known[key] = free
            free += 1
        else:
            runs.append(codes)
            codes, known, free = [], {}, (1 << bits) + 2
            emit, get = codes.append, known.get
        prefix = b
    emit(prefix)
    runs.append(codes)
    return runs


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """A GIF code stream, not yet cut into blocks."""
    codes, widths, clear = [], [], 1 << bits
    runs = lzw_codes(data, bits)
    first = bits + 1
    for i, run in enumerate(runs):
        own = np.array([*run, clear if i + 1 < len(runs) else clear + 1], np.int64)
        codes.append(own)
        widths.append(code_widths(len(own), bits))
    all_codes, all_widths = np.concatenate([[clear], *codes]), np.concatenate([[first], *widths])
    place = np.arange(12)
    flags = (all_codes[:, None] >> place & 1).astype(np.uint8)[place < all_widths[:, None]]
    return np.packbits(flags, bitorder="little").tobytes()


def lzw_decode(stream: bytes, bits: int, expected: int) -> bytes:
    """The samples of a code stream; at most expected of them."""
    clear, end = 1 << bits, (1 << bits) + 1
    base = clear + 2
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    at, last, out = 0, len(stream) * 8, bytearray()
    while len(out) < expected:
        if at + bits + 1 > last:
            break
        # codes up to the next clear or end code; 12-bit codes may go on past a full table
        codes: list[int] = []
        stop = False
        while True:
            widths = _widths(bits)[np.minimum(np.arange(len(codes), len(codes) + 4200), 4096)]
            begin = at + np.cumsum(widths) - widths
            begin = begin[begin + widths <= last]
            if not len(begin):
                stop = True
                break
            widths = widths[: len(begin)]
            byte = begin >> 3
            got = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (begin & 7) & ((1 << widths) - 1)
            marks = np.flatnonzero((got == clear) | (got == end))
            if len(marks):
                codes += got[: marks[0]].tolist()
                at = int(begin[marks[0]] + widths[marks[0]])
                stop = got[marks[0]] == end
                break
            codes += got.tolist()
            at = int(begin[-1] + widths[-1])
        starts = [len(out)]
        put = starts.append
        size = starts[0]
        for code in codes:
            if code < clear:
                out.append(code)
                size += 1
            else:
                first, after = starts[code - base], starts[code - base + 1]
                if after < size:
                    out += out[first : after + 1]
                else:  # the entry that this very code completes
                    out += out[first:after]
                    out.append(out[first])
                size += after + 1 - first
            put(size)
        if stop:
            break
    return bytes(out[:expected])


def blocks(data: bytes) -> bytes:
    """Data cut into sub-blocks, with the closing empty one."""
    parts = [bytes((len(data[i : i + 255]),)) + data[i : i + 255] for i in range(0, len(data), 255)]
    return b"".join([*parts, b"\0"])


def encode_gif(samples: bytes, row: int = ROW, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """8-bit samples as grey frames, in order; their number must be a multiple of row."""
    per_frame = row * frame_rows
    screen = min(frame_rows, len(samples) // row)
    out = [b"GIF89a", struct.pack("<HHBBB", row, screen, 0xF7, 0, 0), GREY, NETSCAPE_LOOP]
    for at in range(0, len(samples), per_frame):
        part = samples[at : at + per_frame]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, row, len(part) // row, 0))
        out += [b"\x08", blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


def _joined(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def decode_gif(data: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[Frame]:
    """The frames of a GIF one after the other, composed; raises ValueError where the file is broken.

    A canvas or a frame of more than most_pixels is refused, whatever it holds.
    """
    try:
        yield from _decode(data, most_pixels)
    except (IndexError, struct.error) as e:
        raise ValueError(f"broken GIF: {e}") from e


def _decode(data: bytes, most_pixels: int) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF header")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    # the cleared canvas is transparent, as all current decoders have it
    if width * height > most_pixels:
        raise ValueError(f"canvas of {width} x {height} pixels")
    canvas, count = np.zeros((height, width, 4), np.uint8), 0
    clock, delay, disposal, hidden = 0, 0, 0, None
    while (kind := data[at]) != 0x3B:
        if kind == 0x21:
            label = data[at + 1]
            body, at = _joined(data, at + 2)
            if label == 0xF9:
                packed, cs, index = struct.unpack_from("<BHB", body)
                delay, disposal, hidden = cs * 10, packed >> 2 & 7, index if packed & 1 else None
        elif kind == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at, palette = at + 10, shared
            if flags & 0x80:
                palette, at = _palette(data, at, flags)
            if palette is None:
                raise ValueError("no palette")
            if w * h > most_pixels:
                raise ValueError(f"frame of {w} x {h} pixels")
            bits = data[at]
            if not 2 <= bits <= 8:
                raise ValueError(f"code size {bits}")
            stream, at = _joined(data, at + 1)
            raw = lzw_decode(stream, bits, w * h)
            if len(raw) < w * h:
                raise ValueError("too few samples")
            samples = np.frombuffer(raw, np.uint8).reshape(h, w)
            if flags & 0x40:
                order = np.concatenate([np.arange(a, h, s) for a, s in PASSES])
                straight = np.empty_like(samples)
                straight[order] = samples
                samples = straight
            before = canvas.copy() if disposal == 3 else None
            view = canvas[top : top + h, left : left + w]
            seen = samples[: view.shape[0], : view.shape[1]]
            if len(palette) < 256 and seen.size and int(seen.max()) >= len(palette):
                raise ValueError("sample outside the palette")
            if hidden is None:
                view[..., :3] = palette[seen]
                view[..., 3] = 255
            else:
                shown = seen != hidden
                view[..., :3][shown] = palette[np.where(shown, seen, 0)][shown]
                view[..., 3][shown] = 255
            yield Frame(count, clock, delay, left, top, disposal, samples, canvas.copy())
            clock, count = clock + delay, count + 1
            if disposal == 2:
                view[...] = 0
            elif before is not None:
                canvas = before
            delay, disposal, hidden = 0, 0, None
        else:
            raise ValueError(f"unknown block {kind}")


def colour_histogram(rgba: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Counts of opaque pixels per channel and bin: shape (3, bins)."""
    flat = rgba.reshape(-1, 4)
    if not (opaque := flat[:, 3] > 0).all():
        flat = flat[opaque]
    if (flat[:, 0] == flat[:, 1]).all() and (flat[:, 0] == flat[:, 2]).all():
        return np.tile(np.bincount(flat[:, 0].astype(np.int64) * bins >> 8, minlength=bins), (3, 1))
    return np.stack([np.bincount(flat[:, c].astype(np.int64) * bins >> 8, minlength=bins) for c in range(3)])


FRAMES_SCHEMA = (
    "key long, frame int, start_ms long, delay_ms long, width int, height int, disposal int, samples binary, rgba binary, "
    "hist_r array<long>, hist_g array<long>, hist_b array<long>, error string"
)


def timed_frames(images: DataFrame, key: str, column: str) -> DataFrame:
    """One row per frame of each GIF in column, with start time, composed picture and histograms.

    A null or broken image gives the frames before the break, and then a row with its error.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FRAMES_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        kinds += [pa.list_(pa.int64())] * 3 + [pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            rows, held = [], 0
            for key_, image in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    if (data := image.as_py()) is None:
                        raise ValueError("no image")
                    for f in decode_gif(data):
                        hist = colour_histogram(f.rgba).tolist()
                        rows.append((key_.as_py(), f.index, f.start_ms, f.delay_ms, f.rgba.shape[1], f.rgba.shape[0], f.disposal, f.samples.tobytes(), f.rgba.tobytes(), *hist, None))
                        held += f.rgba.size
                        if held >= BATCH_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                except ValueError as e:
                    rows.append((key_.as_py(), *[None] * 11, str(e)))
            yield batch_of(rows)

    return images.select(images[key].cast("long").alias("key"), images[column].alias("image")).mapInArrow(decode, FRAMES_SCHEMA)


def padded(data: bytes, unit: int = ROW) -> bytes:
    """Data and spaces up to a positive multiple of unit."""
    return data + b" " * (max(1, -(-len(data) // unit)) * unit - len(data))


def stored_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the GIF that holds each document's text."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, media, held, done = batch.column(0), [], [], 0, 0
            for value in batch.column(1):
                text = value.as_py()
                media.append(encode_gif(padded(text)))
                sizes.append(len(text))
                held += len(media[-1])
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([ids[done : done + len(sizes)], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                    done, sizes, media, held = done + len(sizes), [], [], 0
            yield pa.RecordBatch.from_arrays([ids[done:], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", utf8().alias("text")).mapInArrow(store, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def digests(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back: payload and media digests and a feature of the frames."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(2):
                media = value.as_py()
                payload, size, tail, frames, ms = hashlib.sha256(), 0, b"", 0, 0
                hist = np.zeros((3, BINS), np.int64)
                for f in decode_gif(media):
                    samples = f.samples.tobytes()
                    payload.update(samples)
                    size, tail, frames, ms = size + len(samples), (tail + samples[-16:])[-16:], frames + 1, ms + f.delay_ms
                    hist += colour_histogram(f.rgba[: f.samples.shape[0]])
                feature = f"frames={frames};ms={ms};" + ";".join(f"{c}={','.join(map(str, h))}" for c, h in zip("rgb", hist.tolist(), strict=True))
                rows.append((size, payload.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(materialise(stored_texts(table(spark, sf_dir, "documents")), "gif"))
