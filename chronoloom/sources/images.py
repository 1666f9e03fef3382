"""Frames' images: a PNG decoder, and the small grey images by which frames are compared.

All bit depths, colour types and filters are read, also interlaced. Rows that are filtered
hang on the pixels to their left and above. Those whose filter looks one way only are
restored as wholes; the others byte by byte in small images, and in large ones, where it
takes less, all pixels of a diagonal at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from chronoloom.sinks.recording_files import located

# The format's signature, its channels by colour type, and the seven passes of interlaced images.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Weights of red, green and blue, of 65,536; the compared size; and when two frames are alike.
GREY = (19_595, 38_470, 7_471)
SIDE, ALIKE = 64, 0.02
#: Pixels of an image at most; larger ones count as broken.
MOST_PIXELS = 1 << 26
#: Bytes that are restored one by one in the time that a diagonal takes at least.
DIAGONAL = 400


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, content) of a file's chunks up to its end; ValueError where they are cut short or altered."""
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG")
    at = len(SIGNATURE)
    while True:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut short")
        size, kind = struct.unpack_from(">I4s", data, at)
        content, end = data[at + 8 : at + 8 + size], at + 12 + size
        if end > len(data) or zlib.crc32(content, zlib.crc32(kind)) != int.from_bytes(data[end - 4 : end], "big"):
            raise ValueError(f"chunk {kind!r} is broken")
        yield kind, content
        if kind == b"IEND":
            return
        at = end


def restored(rows: np.ndarray, filters: np.ndarray, step: int) -> np.ndarray:
    """Unfiltered bytes of rows (height, width in bytes); step: bytes from a pixel to the next."""
    height, width = rows.shape
    if (filters > 4).any():
        raise ValueError("unknown filter")
    if not filters.any():
        return rows
    if np.count_nonzero(filters > 2) * width <= DIAGONAL * (height + width // step):
        return restored_by_rows(rows, filters, step)
    # one row above and one pixel to the left, of zeros
    out = np.zeros((height + 1, width // step + 1, step), np.int16)
    given = rows.reshape(height, -1, step).astype(np.int16)
    columns = given.shape[1]
    for diagonal in range(height + columns - 1):
        y = np.arange(max(0, diagonal - columns + 1), min(height, diagonal + 1))
        x = diagonal - y
        kind = filters[y][:, None]
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        by_left, by_up, by_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], 0)
        out[y + 1, x + 1] = (given[y, x] + guess) & 255
    return out[1:, 1:].reshape(height, width).astype(np.uint8)


def restored_by_rows(rows: np.ndarray, filters: np.ndarray, step: int) -> np.ndarray:
    """restored() row after row."""
    out, above = np.empty_like(rows), np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(filters.tolist()):
        if kind == 0:
            out[y] = rows[y]
        elif kind == 1:
            np.cumsum(rows[y].reshape(-1, step), axis=0, dtype=np.uint8, out=out[y].reshape(-1, step))
        elif kind == 2:
            np.add(rows[y], above, out=out[y])
        else:
            out[y] = np.frombuffer((by_mean if kind == 3 else by_nearest)(rows[y].tobytes(), above.tobytes(), step), np.uint8)
        above = out[y]
    return out


def by_mean(given: bytes, above: bytes, step: int) -> bytearray:
    """A row whose bytes were told from the mean of the left and the upper one."""
    out = bytearray(step)
    for i, (x, up) in enumerate(zip(given, above, strict=True)):
        out.append((x + ((out[i] + up) >> 1)) & 255)
    return out[step:]


def by_nearest(given: bytes, above: bytes, step: int) -> bytearray:
    """A row whose bytes were told from the left, upper or upper left one, whichever is nearest to left + upper - upper left."""
    out = bytearray(step)
    for i, (x, up, corner) in enumerate(zip(given, above, bytes(step) + above, strict=False)):
        left = out[i]
        by_left, by_up, by_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
        out.append((x + (left if by_left <= by_up and by_left <= by_corner else up if by_up <= by_corner else corner)) & 255)
    return out[step:]


def scanned(data: bytes, width: int, height: int, depth: int, channels: int) -> tuple[np.ndarray, bytes]:
    """Samples (height, width, channels) of the rows at the beginning of data, and what follows them."""
    size, step = -(-width * channels * depth // 8), max(1, channels * depth // 8)
    if len(data) < height * (size + 1):
        raise ValueError("rows are missing")
    lines = np.frombuffer(data, np.uint8, height * (size + 1)).reshape(height, size + 1)
    plain = restored(lines[:, 1:], lines[:, 0], step)
    if depth == 16:
        samples = plain.reshape(height, -1, 2)[..., 0]  # the higher byte
    elif depth == 8:
        samples = plain
    else:
        bits = np.unpackbits(plain, axis=1).reshape(height, -1, depth)
        samples = bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)
    return samples[:, : width * channels].reshape(height, width, channels), data[height * (size + 1) :]


def grey_png(data: bytes) -> np.ndarray:
    """A PNG's grey samples (height, width), 8 bits each; without its transparency. ValueError where it is broken."""
    head, palette, packed = None, None, []
    for kind, content in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"PLTE":
            palette = np.frombuffer(content, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(content)
    if head is None:
        raise ValueError("no header")
    width, height, depth, colour, method, filtering, interlaced = head
    if depth not in DEPTHS.get(colour, ()) or method or filtering or interlaced > 1 or not 0 < width * height <= MOST_PIXELS or (colour == 3 and palette is None):
        raise ValueError("a header that is not known")
    channels = CHANNELS[colour]
    inflate = zlib.decompressobj()
    try:
        plain = inflate.decompress(b"".join(packed), 2 * (width * channels * 2 + 16) * height + (1 << 16))
    except zlib.error as e:
        raise ValueError(str(e)) from None
    if not interlaced:
        samples, _ = scanned(plain, width, height, depth, channels)
    else:
        samples = np.zeros((height, width, channels), np.uint8)
        for x, y, dx, dy in PASSES:
            w, h = -(-(width - x) // dx), -(-(height - y) // dy)
            if w > 0 and h > 0:
                samples[y::dy, x::dx], plain = scanned(plain, w, h, depth, channels)
    if colour == 3:
        if samples.max() >= len(palette):
            raise ValueError("a colour beyond the palette")
        samples = palette[samples[..., 0]]
    elif depth < 8:
        samples = samples * (255 // ((1 << depth) - 1))
    if samples.shape[2] >= 3:
        return ((samples[..., :3].astype(np.int64) @ np.array(GREY) + 0x8000) >> 16).astype(np.uint8)
    return samples[..., 0]


def reduced(samples: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Grey samples as an image of side x side, each sample the mean of the area that it stands for."""
    for axis in (0, 1):
        size = samples.shape[axis]
        sums = np.concatenate([np.zeros_like(samples.take([0], axis), np.float64), np.cumsum(samples, axis, np.float64)], axis)
        edges = np.arange(side + 1) * (size / side)
        whole = np.minimum(edges.astype(int), size - 1)
        part = (edges - whole).reshape((-1, 1) if axis == 0 else (1, -1))
        at = sums.take(whole, axis) + (sums.take(whole + 1, axis) - sums.take(whole, axis)) * part
        samples = np.diff(at, axis=axis) / (size / side)
    return np.floor(samples + 0.5).astype(np.uint8)


def small(data: bytes | None) -> bytes | None:
    """An image's compared form; null for one that is missing or broken."""
    try:
        return None if data is None else reduced(grey_png(bytes(data))).tobytes()
    except (ValueError, struct.error):
        return None


def small_of_file(path: str | None) -> bytes | None:
    try:
        files, inside = located(path or "")
        with files.open_input_file(inside) as file:
            return small(file.read())
    except (OSError, ValueError):
        return None


def with_small(frames: DataFrame, image: str = "image", out: str = "small", by_path: bool = False) -> DataFrame:
    """frames with their images' compared form, a binary column of SIDE * SIDE grey samples, instead of the images or, by_path, beside the paths of their files."""
    kept = [f for f in frames.schema if by_path or f.name != image]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` binary"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.Series([(small_of_file if by_path else small)(x) for x in batch[image]], index=batch.index, dtype=object)
            yield (batch if by_path else batch.drop(columns=image)).assign(**{out: found})

    return frames.mapInPandas(run, schema)


def alike(most: float = ALIKE) -> Callable:
    """For folds.memo_skip over with_small(): the mean difference, 0 to 1, lies below most; what is broken is like nothing."""

    def similar(one, many):
        if one is None:
            return [False] * len(many)
        known = [i for i, x in enumerate(many) if x is not None]
        out = np.zeros(len(many), bool)
        if known:
            stack = np.frombuffer(b"".join(many[i] for i in known), np.uint8).reshape(len(known), -1).astype(np.int64)
            apart = np.abs(stack - np.frombuffer(one, np.uint8).astype(np.int64)).sum(1)
            out[known] = apart / (stack.shape[1] * 255) < most
        return out

    return similar


def png(samples: np.ndarray, filters: np.ndarray | None = None) -> bytes:
    """Grey samples (height, width) as a PNG; filters: each row's, 0 to 4."""
    height, width = samples.shape
    wide = np.zeros((height + 1, width + 1), np.int16)
    wide[1:, 1:] = samples
    left, up, corner, here = wide[1:, :-1], wide[:-1, 1:], wide[:-1, :-1], wide[1:, 1:]
    by_left, by_up, by_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    nearest = np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))
    kind = np.zeros(height, np.uint8) if filters is None else filters.astype(np.uint8)
    guess = np.select([(kind == k)[:, None] for k in (1, 2, 3, 4)], [left, up, (left + up) >> 1, nearest], 0)
    rows = np.concatenate([kind[:, None], ((here - guess) & 255).astype(np.uint8)], 1)
    chunk = lambda name, content: struct.pack(">I", len(content)) + name + content + struct.pack(">I", zlib.crc32(content, zlib.crc32(name)))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")
