"""Sound in WAV files: spans are cut out of them by offset, in the task that needs them.

Only a file's header and the bytes of a span are read, so a long recording's chunks go to
many tasks and none of them loads the file.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoloom.sinks.recording_files import located

# The formats of samples, by their number in the file.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
MICROSECONDS = 1_000_000
#: Bytes of sound from which on a task hands on the spans it has cut.
AT_ONCE = 4 << 20


class Sound(NamedTuple):
    """Where a file's samples lie, and how they are stored."""

    kind: int
    channels: int
    rate: int
    width: int
    begin: int
    frames: int


def header(file: BinaryIO, size: int) -> Sound:
    """A WAV file's layout; ValueError where it is none. A data chunk that claims more than there is ends with the file."""
    file.seek(0)
    riff, _, wave = struct.unpack("<4sI4s", file.read(12).ljust(12, b"\0"))
    if riff not in (b"RIFF", b"RF64") or wave != b"WAVE":
        raise ValueError("no WAV file")
    at, told = 12, None
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            content = file.read(min(length, 40))
            if len(content) < 16:
                raise ValueError("a format that is cut short")
            kind, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", content)
            if kind == EXTENSIBLE and len(content) >= 26:
                (kind,) = struct.unpack_from("<H", content, 24)
            if not channels or not rate or (kind, bits) not in ((PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)) or align != channels * bits // 8:
                raise ValueError(f"samples of format {kind} with {bits} bits are not known")
            told = (kind, channels, rate, bits // 8)
        elif name == b"data":
            if told is None:
                raise ValueError("samples before their format")
            held = min(length if length != 0xFFFFFFFF else size, size - at - 8)
            return Sound(*told, at + 8, held // (told[1] * told[3]))
        at += 8 + length + length % 2
    raise ValueError("no samples")


def samples(file: BinaryIO, sound: Sound, first: int, last: int) -> np.ndarray:
    """The frames from first up to last as 16-bit samples, the channels' mean."""
    first, last = max(0, min(first, sound.frames)), max(0, min(last, sound.frames))
    size = sound.channels * sound.width
    file.seek(sound.begin + first * size)
    raw = np.frombuffer(file.read(max(0, last - first) * size), np.uint8).reshape(-1, sound.channels, sound.width)
    if sound.kind == FLOAT:
        values = np.clip(raw.copy().view(f"<f{sound.width}")[..., 0].astype(np.float64), -1, 1) * 32767
    elif sound.width == 1:
        values = (raw[..., 0].astype(np.int64) - 128) << 8
    else:
        # the two highest bytes of each
        values = raw[..., -2:].copy().view("<i2")[..., 0].astype(np.int64)
    return np.floor(values.mean(axis=1) + 0.5).clip(-32768, 32767).astype("<i2")


def place(us: int, rate: int) -> int:
    """The first frame that begins at a time or after it; so spans that meet share no frame and leave none out."""
    return -(-us * rate // MICROSECONDS)


def span(file: BinaryIO, size: int, start_us: int, length_us: int) -> tuple[int, bytes]:
    """(rate, samples) of a span of a file, 16-bit little-endian mono."""
    sound = header(file, size)
    return sound.rate, samples(file, sound, place(start_us, sound.rate), place(start_us + length_us, sound.rate)).tobytes()


def cut(source: str | bytes, start_us: int, length_us: int) -> tuple[int, bytes]:
    """span() of the file at a path, or of a file's content."""
    if not isinstance(source, str):
        return span(io.BytesIO(source), len(source), start_us, length_us)
    files, inside = located(source)
    with files.open_input_file(inside) as file:
        return span(file, file.size(), start_us, length_us)


def with_sound(chunks: DataFrame, source: str = "path") -> DataFrame:
    """chunks (source, media_start, media_len and others) with rate, samples and error: the sound of each, or why there is none.

    source is a file's path or, as binary, its content, which is for short files: it comes with every chunk.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema), "rate int", "samples binary", "error string"])

    def one(given: str | bytes | None, start: int, length: int) -> tuple:
        try:
            if given is None:
                raise ValueError("no file")
            return (*cut(given, int(start), int(length)), None)
        except (OSError, ValueError) as e:
            return None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, start, length = (batch.column(batch.schema.names.index(name)) for name in (source, "media_start", "media_len"))
            begin = 0
            while begin < batch.num_rows:
                # as many spans at once as hold some megabytes, since each may hold minutes of sound
                end, held, found = begin, 0, []
                while end < batch.num_rows and held < AT_ONCE:
                    found.append(one(given[end].as_py(), start[end].as_py(), length[end].as_py()))
                    held += len(found[-1][1] or b"")
                    end += 1
                columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.slice(begin, end - begin).columns, *columns], [*batch.schema.names, "rate", "samples", "error"])
                begin = end

    return chunks.mapInArrow(run, schema)


def wav(values: np.ndarray, rate: int = 16_000) -> bytes:
    """16-bit mono samples as a WAV file."""
    data = values.astype("<i2").tobytes()
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, PCM, 1, rate, 2 * rate, 2, 16)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + 8 + len(data), b"WAVE") + form + struct.pack("<4sI", b"data", len(data)) + data
