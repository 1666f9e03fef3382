"""Recordings: frames, scene changes, audio. The decoders are external programs, called once per row in Python workers."""

from __future__ import annotations

import hashlib
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.stretches import STRETCH_IDS, numbered
from chronoloom.operators.temporal import nearest_keyframes

# Defaults of the decoders.
FPS, SCENE_THRESHOLD, LONG_EDGE = 0.5, 0.08, 1024
TIMEOUTS = {"probe": 60, "frames": 3600, "audio": 1800}
PTS = r"pts_time:([0-9]+(?:\.[0-9]+)?)"
SAMPLE_RATE, TAIL = 16_000, 600
PROGRAMS = ("ffmpeg", "ffprobe")


class ProgramFailed(RuntimeError):
    """An external program that ended with a code other than 0, or with none as its time was up; tail is the end of what it said."""

    def __init__(self, program: str, code: int | None, tail: str = ""):
        super().__init__(f"{program} ran out of time" if code is None else f"{program} ended with {code}: {tail}")
        self.program, self.code, self.tail = program, code, tail


def run_program(command: list[str], timeout: float) -> subprocess.CompletedProcess:
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as process:
        try:
            out, said = process.communicate(timeout=timeout)
        except subprocess.TimeoutExpired:
            process.kill()
            raise ProgramFailed(command[0], None) from None
    if process.returncode:
        raise ProgramFailed(command[0], process.returncode, said.decode("utf-8", "replace")[-TAIL:])
    return subprocess.CompletedProcess(command, 0, out, said)


def scene_times(log: Column) -> Column:
    """Scene changes, in seconds, that a decoder's log names."""
    return F.transform(F.regexp_extract_all(log, F.lit(PTS), F.lit(1)), lambda x: x.cast("double"))


def frames_command(path: str, pattern: str, fps: float = FPS, edge: int = LONG_EDGE) -> list[str]:
    scale = f"scale='min({edge},iw)':'min({edge},ih)':force_original_aspect_ratio=decrease"
    return ["ffmpeg", "-y", "-i", path, "-vf", f"fps={fps},{scale}", pattern]


def scene_command(path: str, threshold: float = SCENE_THRESHOLD) -> list[str]:
    return ["ffmpeg", "-i", path, "-vf", f"select='gt(scene,{threshold})',showinfo", "-f", "null", "-"]


def audio_command(path: str, out: str, start: float | None = None, length: float | None = None) -> list[str]:
    span = [] if start is None else ["-ss", f"{start}", "-t", f"{length}"]
    return ["ffmpeg", "-y", *span, "-i", path, "-vn", "-ac", "1", "-ar", str(SAMPLE_RATE), out]


def probed(videos: DataFrame, run=run_program) -> DataFrame:
    """videos (video, path) with has_audio (false where probing fails) and duration_us (null then)."""

    @F.pandas_udf("streams string, duration string")
    def asked(paths: pd.Series) -> pd.DataFrame:
        def one(path: str, *show: str) -> str | None:
            try:
                return run(["ffprobe", "-v", "error", *show, "-of", "csv=p=0", path], TIMEOUTS["probe"]).stdout.decode("utf-8", "replace")
            except Exception:  # whatever the program or its stand-in raises
                return None

        streams = [one(p, "-select_streams", "a", "-show_entries", "stream=codec_type") for p in paths]
        return pd.DataFrame({"streams": streams, "duration": [one(p, "-show_entries", "format=duration") for p in paths]})

    out = videos.select("video", "path", asked("path").alias("__said"))
    return out.select("video", "path", tells_audio(F.col("__said.streams")).alias("has_audio"), told_duration(F.col("__said.duration")).alias("duration_us"))


def tells_audio(streams: Column) -> Column:
    """Whether a probe names an audio stream; a failed one does not."""
    return F.coalesce(streams.contains("audio"), F.lit(False))


def told_duration(said: Column) -> Column:
    """Microseconds of the seconds that a probe tells, null where it tells none."""
    return F.round(F.trim(said).try_cast("double") * 1_000_000).cast("long")


def listed_frames(files: DataFrame, fps: float = FPS) -> DataFrame:
    """Frames of files (video, path) as a decoder numbers them: by the number in their names, from 0, with their times. Files without one are no frames."""
    number = F.regexp_extract("path", r"([0-9]+)\.[A-Za-z]+$", 1).try_cast("long")
    files = files.withColumn("__number", number).filter(F.col("__number").isNotNull())
    out = numbered(files, "idx", order=["__number", "path"], width=STRETCH_IDS).drop("__number")
    return out.withColumn("t_us", F.round(F.col("idx") * (1e6 / fps)).cast("long"))


def decoded_frames(videos: DataFrame, directory: str, fps: float = FPS, run=run_program) -> DataFrame:
    """Frames (video, idx, t_us, path) of videos (video, path): a decoder writes each one's into a folder under directory, which all tasks share.

    Files of earlier runs are removed first. A video that fails has no frames.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for video, path in zip(batch["video"], batch["path"], strict=True):
                place = Path(directory) / hashlib.sha256(str(video).encode()).hexdigest()[:16]
                place.mkdir(parents=True, exist_ok=True)
                for old in place.glob("frame_*.png"):
                    old.unlink()
                try:
                    run(frames_command(path, str(place / "frame_%06d.png"), fps), TIMEOUTS["frames"])
                except Exception:  # whatever the program or its stand-in raises
                    continue
                yield pd.DataFrame({"video": video, "path": sorted(map(str, place.glob("frame_*.png")))}).astype({"path": "object"})

    return listed_frames(videos.select("video", "path").mapInPandas(decode, f"video {videos.schema['video'].dataType.simpleString()}, path string"), fps)


def extracted_sound(videos: DataFrame, directory: str, run=run_program) -> DataFrame:
    """videos (video, path) with sound: the WAV file under directory, which all tasks share, that a decoder made of each; null where it fails."""

    @F.pandas_udf("string")
    def extract(videos: pd.Series, paths: pd.Series) -> pd.Series:
        def one(video: str, path: str) -> str | None:
            out = Path(directory) / f"{hashlib.sha256(str(video).encode()).hexdigest()[:16]}.wav"
            out.parent.mkdir(parents=True, exist_ok=True)
            try:
                run(audio_command(path, str(out)), TIMEOUTS["audio"])
            except Exception:  # whatever the program or its stand-in raises
                return None
            return str(out)

        return pd.Series([one(*x) for x in zip(videos, paths, strict=True)], dtype=object)

    return videos.withColumn("sound", extract("video", "path"))


def scene_logs(videos: DataFrame, threshold: float = SCENE_THRESHOLD, run=run_program) -> DataFrame:
    """What a decoder says of the scene changes in videos (video, path); null where it fails."""

    @F.pandas_udf("string")
    def said(paths: pd.Series) -> pd.Series:
        def one(path: str) -> str | None:
            try:
                return run(scene_command(path, threshold), TIMEOUTS["frames"]).stderr.decode("utf-8", "replace")
            except Exception:  # whatever the program or its stand-in raises
                return None

        return paths.map(one)

    return videos.select("video", said("path").alias("log"))


def frame_grid(videos: DataFrame, fps: float = FPS) -> DataFrame:
    """The uniform frames of videos (video, duration_us): idx and t_us."""
    step = 1e6 / fps
    last = F.greatest(F.floor(F.col("duration_us") / step), F.lit(0)).cast("long")
    out = videos.select("video", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("idx"))
    return out.withColumn("t_us", F.round(F.col("idx") * step).cast("long"))


def keyframes(frames: DataFrame, logs: DataFrame, fps: float = FPS) -> DataFrame:
    """frames with is_keyframe, from decoder logs (video, log)."""
    scenes = logs.select("video", F.explode(scene_times(F.col("log"))).alias("s")).select("video", F.round(F.col("s") * 1e6).cast("long").alias("scene_us"))
    return nearest_keyframes(frames, scenes, round(1e6 / fps))
