"""PNG images and WAV files made byte by byte, read by the library's decoders."""

import io
import random
import struct
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import chunking, folds
from chronoloom.sources import audio, images

S = 1_000_000


def chunk(name, content):
    return struct.pack(">I", len(content)) + name + content + struct.pack(">I", zlib.crc32(name + content))


def filtered(rows, step, kinds):
    """Rows of bytes as the format stores them, pixel by pixel."""
    out, above = b"", bytes(len(rows[0]))
    for row, kind in zip(rows, kinds, strict=True):
        line = bytearray([kind])
        for i, x in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out, above = out + bytes(line), row
    return out


def stored(width, height, depth, colour, values, kinds, palette=None, passes=((0, 0, 1, 1),)):
    """A PNG of values[y][x][channel], written bit by bit."""
    channels, data = images.CHANNELS[colour], b""
    for x0, y0, dx, dy in passes:
        rows = []
        for y in range(y0, height, dy):
            bits = "".join(f"{v:0{depth}b}" for x in range(x0, width, dx) for v in values[y][x])
            if bits:
                bits += "0" * (-len(bits) % 8)
                rows.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)))
        if rows:
            data += filtered(rows, max(1, channels * depth // 8), [kinds[i % len(kinds)] for i in range(len(rows))])
    packed = zlib.compress(data)
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(len(passes) > 1))), chunk(b"tEXt", b"k\0v")]
    parts += [chunk(b"PLTE", bytes(palette))] if palette else []
    return images.SIGNATURE + b"".join([*parts, chunk(b"IDAT", packed[:9]), chunk(b"IDAT", packed[9:]), chunk(b"IEND", b"")])


@pytest.mark.parametrize("passes", [((0, 0, 1, 1),), images.PASSES])
@pytest.mark.parametrize(("colour", "depth"), [(c, d) for c, depths in images.DEPTHS.items() for d in depths])
def test_png_of_every_kind(colour, depth, passes):
    rng = random.Random(depth * 10 + colour)
    width, height, top = rng.randint(1, 13), rng.randint(1, 11), (1 << depth) - 1
    values = [[[rng.randint(0, top) for _ in range(images.CHANNELS[colour])] for _ in range(width)] for _ in range(height)]
    palette = [rng.randint(0, 255) for _ in range(3 * (top + 1))] if colour == 3 else None

    def grey(pixel):
        if colour == 3:
            pixel = palette[3 * pixel[0] : 3 * pixel[0] + 3]
        else:
            pixel = [v >> 8 if depth == 16 else v * 255 // top for v in pixel]
        return (pixel[0] * 19595 + pixel[1] * 38470 + pixel[2] * 7471 + 0x8000) >> 16 if colour in (2, 3, 6) else pixel[0]

    got = images.grey_png(stored(width, height, depth, colour, values, [rng.randint(0, 4) for _ in range(5)], palette, passes))
    assert got.tolist() == [[grey(p) for p in row] for row in values]


def test_png_writer_and_broken_files():
    rng = np.random.default_rng(4)
    samples = rng.integers(0, 256, (40, 33)).astype(np.uint8)
    data = images.png(samples, np.arange(40) % 5)
    assert np.array_equal(images.grey_png(data), samples)
    broken = [b"", data[:-5], data[:60] + bytes([data[60] ^ 1]) + data[61:], b"GIF89a" + data, data.replace(b"IHDR", b"IHDX"), images.SIGNATURE + chunk(b"IEND", b"")]
    assert [images.small(x) for x in [*broken, None]] == [None] * 7 and len(images.small(data)) == 4096
    for head in ((0, 5, 8, 0, 0, 0, 0), (5, 5, 3, 0, 0, 0, 0), (5, 5, 8, 3, 0, 0, 0), (1 << 20, 1 << 20, 8, 0, 0, 0, 0), (5, 5, 8, 0, 0, 0, 2)):
        with pytest.raises(ValueError, match="header"):
            images.grey_png(images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", *head)) + chunk(b"IEND", b""))


@pytest.mark.parametrize("size", [(64, 64), (128, 192), (100, 70), (10, 200), (1, 1)])
def test_reduction_is_the_mean_of_areas(size):
    samples = np.random.default_rng(1).integers(0, 256, size).astype(np.uint8)
    wide = np.kron(samples.astype(float), np.ones((64, 64)))  # each sample as 64 x 64, so that areas are whole
    want = wide.reshape(64, size[0], 64, size[1]).mean(axis=(1, 3))
    assert np.abs(images.reduced(samples) - want).max() <= 0.5 + 1e-6


def test_frames_compared_by_their_images(spark):
    flat = np.full((50, 80), 100, np.uint8)
    spot, other = flat.copy(), flat + 6
    spot[:3, :3] = 250
    shots = [flat, spot, other, other, None, None, flat, flat + 5, flat]
    rows = [("v", i, i * S, i == 8, None if x is None else bytearray(images.png(x))) for i, x in enumerate(shots)]
    frames = spark.createDataFrame(rows, "video string, ord long, t_us long, is_keyframe boolean, image binary")
    out = folds.memo_skip(images.with_small(frames), images.alike(), "small")
    # 5 / 255 lies below 0.02, 6 / 255 does not; what is broken is like nothing
    assert [r.source_ord for r in out.orderBy("ord").collect()] == [0, 0, 2, 2, 4, 5, 6, 6, 8]
    assert list(images.alike(5.1 / 255)(bytes(4), [bytes([5, 5, 5, 5]), bytes([6, 6, 6, 6]), None])) == [True, False, False]


def wav(values, rate=16_000, width=2):
    """values (frames, channels) as a file of the standard library's writer."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(values.shape[1])
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(values.tobytes())
    return out.getvalue()


@pytest.mark.parametrize("rate", [16_000, 44_100, 11_025])
def test_spans_tile_a_file_sample_for_sample(spark, tmp_path, rate):
    sound = np.random.default_rng(rate).integers(-30_000, 30_000, (rate * 7 + 123, 1)).astype("<i2")
    (tmp_path / "a.wav").write_bytes(wav(sound, rate))
    duration = len(sound) * S // rate + 1
    videos = spark.createDataFrame([("a", duration, f"file://{tmp_path}/a.wav"), ("b", S, f"{tmp_path}/none.wav"), ("c", S, None)], "video string, duration_us long, path string")
    spans = chunking.chunk_spans(videos, 1_700_001, 300_000).join(videos.select("video", "path"), "video")
    own = spans.withColumns({"media_start": F.col("chunk_start"), "media_len": F.col("chunk_end") - F.col("chunk_start")})
    got = audio.with_sound(own).orderBy("video", "k").collect()
    assert b"".join(bytes(r.samples) for r in got if r.video == "a") == sound.tobytes() and {r.rate for r in got if r.video == "a"} == {rate}
    assert all(r.samples is None and r.error for r in got if r.video != "a")
    for r in audio.with_sound(spans.filter("video = 'a'")).collect():
        first, last = (-(-us * rate // S) for us in (r.media_start, r.media_start + r.media_len))
        assert bytes(r.samples) == sound[first:last].tobytes()


def test_channels_are_mixed_and_widths_read():
    two = np.array([[100, 201], [-32768, -32768], [32767, 1]], "<i2")
    read = lambda data: audio.samples(io.BytesIO(data), audio.header(io.BytesIO(data), len(data)), 0, 99).tolist()
    assert read(wav(two)) == [151, -32768, 16384]
    assert read(wav(np.array([[0], [128], [255]], np.uint8), width=1)) == [-32768, 0, 32512]
    assert read(wav(np.array([[1 << 16, -(1 << 16)]], "<i4"), width=4)) == [0]
    head = lambda kind, bits, data, extra=b"": b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<IHHIIHH", 16 + len(extra), kind, 1, 8000, 0, bits // 8, bits) + extra + b"data" + struct.pack("<I", 0xFFFFFFFF) + data
    assert read(head(3, 32, struct.pack("<3f", 0, 1, -2))) == [0, 32767, -32767]
    assert read(head(0xFFFE, 16, struct.pack("<2h", 5, -6), struct.pack("<HHIH14s", 22, 16, 0, 1, b""))) == [5, -6]
    for data in (b"", b"RIFF", head(7, 8, b"x"), wav(two)[:30], wav(two).replace(b"fmt ", b"fmx ")):
        with pytest.raises(ValueError):
            audio.header(io.BytesIO(data), len(data))


@pytest.mark.parametrize(("height", "width", "step"), [(1, 1, 1), (9, 64, 1), (7, 30, 3), (12, 48, 6), (3, 8, 8)])
def test_rows_and_diagonals_restore_alike(monkeypatch, height, width, step):
    rng = np.random.default_rng(height)
    rows, filters = rng.integers(0, 256, (height, width)).astype(np.uint8), (np.arange(height) % 5 + rng.integers(0, 5)) % 5
    monkeypatch.setattr(images, "DIAGONAL", -1)
    by_diagonals = images.restored(rows, filters, step)
    assert (images.restored_by_rows(rows, filters, step) == by_diagonals).all()
    monkeypatch.setattr(images, "DIAGONAL", 400)
    monkeypatch.setattr(images, "by_nearest", lambda *a: bytes(width))
    monkeypatch.setattr(images, "by_mean", lambda *a: bytes(width))
    small = images.restored(rows, np.full(height, 4), step)
    assert not small.any()  # restored row after row


def test_spans_of_sound_pass_no_data_frame(spark):
    from chronoloom.plans import ports

    plan = ports.sound_spans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan and "ArrowEvalPython" not in plan
