"""Compositions: observations, descriptions and transcripts to work-log entries."""

from __future__ import annotations

import shutil
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom import models
from chronoloom.functions import text
from chronoloom.operators import folds, runs, temporal
from chronoloom.operators.segments import reliable
from chronoloom.schemas import DESCRIPTIONS
from chronoloom.schemas import names as schema_names
from chronoloom.sinks.scratch import written
from chronoloom.sinks.worklogs import frame_name

TOLERANCE_US, MARGIN_US, GRACE_US = 2_000_000, 15_000_000, 3_000_000
#: The most no-speech probability and the least log probability of speech that is kept.
SPEECH = (0.6, -1.0)


def merged(descriptions: DataFrame, ocr: DataFrame, segments: DataFrame, tolerance_us: int = TOLERANCE_US) -> DataFrame:
    """Entries: nearest lines, runs collapsed, then end times, then speech (in this order)."""
    near = temporal.nearest_within(descriptions, ocr, tolerance_us, ["lines"])
    empty = F.array().cast("array<string>")
    entries = near.withColumn("ocr", F.coalesce(text.normalized_lines(F.col("near_lines")), empty)).drop("near_lines")
    entries = runs.with_ends(runs.collapse_runs(entries), runs.timeline_ends(ocr))
    out = temporal.attach_speech(entries, segments, text.speech_line(F.col("speaker"), F.col("text")))
    return out.withColumns({"summary": F.lit(None).cast("string"), "frame": F.lit(None).cast("string")})


def enriched(descriptions: DataFrame, ocr: DataFrame) -> DataFrame:
    """descriptions (one per frame, same video and ord as its lines) corrected by what the lines show."""
    lines = ocr.select("video", "ord", F.col("lines").alias("__lines"))
    out = descriptions.join(lines, ["video", "ord"], "left")
    out = out.withColumn("__seen", text.screen_context(text.normalized_lines(F.coalesce("__lines", F.array().cast("array<string>")))))
    out = out.withColumn("__e", text.enriched(F.col("__seen"), F.col("app"), F.col("resource"), F.col("location")))
    return out.withColumns({c: F.col(f"__e.{c}") for c in ("app", "resource", "location")}).drop("__e", "__seen", "__lines")


def observations(frames: DataFrame, ocr: DataFrame) -> DataFrame:
    """What keyframes say of speakers: name labels and the number of lines."""
    keys = frames.filter("is_keyframe").select("video", F.col("idx").alias("ord"))
    lines = text.normalized_lines(F.col("lines"))
    return ocr.join(keys, ["video", "ord"]).select("video", "t_us", "ord", text.name_labels(lines).alias("names"), F.size(lines).alias("line_count"))


def to_describe(frames: DataFrame, ocr: DataFrame, segments: DataFrame, gate: folds.GateConfig | None) -> DataFrame:
    """Keyframes worth a model call, with their lines and the speech around them."""
    keys = frames.filter("is_keyframe").select("video", F.col("idx").alias("ord"), "t_us", "path").join(ocr.select("video", "ord", "lines"), ["video", "ord"])
    keys = keys.withColumn("lines", text.normalized_lines(F.col("lines")))
    if gate is not None:
        keys = folds.change_gate(keys.withColumn("tokens", text.line_tokens(F.col("lines"))), gate).filter("selected").drop("tokens", "selected")
    return temporal.overlapping(keys, segments, MARGIN_US, F.col("text"))


def with_images(entries: DataFrame, frames: DataFrame) -> DataFrame:
    """entries with frame: the name that the copy of their own frame's image bears; null without one."""
    named = frames.filter("path IS NOT NULL").select("video", F.col("idx").alias("ord"), frame_name(F.col("t_us"), F.col("idx")).alias("__image"))
    return entries.join(named, ["video", "ord"], "left").withColumn("frame", F.col("__image")).drop("__image")


def copied(entries: DataFrame, frames: DataFrame, directory: str) -> DataFrame:
    """entries whose images lie in directory/<video>/<frame>; where copying fails the entry stays without one, and warning says why."""
    source = frames.select("video", F.col("idx").alias("ord"), F.col("path").alias("__path"))

    @F.pandas_udf("string")
    def copy(videos: pd.Series, paths: pd.Series, names: pd.Series) -> pd.Series:
        def one(video, path, name):
            if name is None:
                return None
            try:
                target = Path(directory) / str(video) / name
                target.parent.mkdir(parents=True, exist_ok=True)
                shutil.copyfile(path, target)
            except OSError as e:
                return f"{path}: {type(e).__name__}"
            return None

        return pd.Series([one(*x) for x in zip(videos, paths, names, strict=True)], dtype=object)

    out = entries.join(source, ["video", "ord"], "left").withColumn("warning", copy("video", "__path", "frame")).drop("__path")
    return out.withColumn("frame", F.when(F.col("warning").isNull(), F.col("frame")))


def generate(
    frames: DataFrame, segments: DataFrame, recognise: Callable, describe: Callable, *, template: str = "%s\n%s", summarise: Callable | None = None,
    gate: folds.GateConfig | None = None, keyframes_only: bool = False, similar: Callable | None = None, value: str = "path", attribute: bool = False, remove_fillers: bool = True,
    tolerance_us: int = TOLERANCE_US, grace_us: int = GRACE_US, speech: tuple[float, float] | None = SPEECH, images: str | None = None, told: dict | None = None,
) -> DataFrame:
    """Work logs of all recordings in frames (schemas.FRAMES) and segments (schemas.SEGMENTS), as entries.

    The model ports are factories (see models). Lines are recognised for keyframes only,
    or for frames that similar(value, values) tells from the last recognised one.
    Unreliable speech is left out, speakers are taken from the screen if attribute, and
    keyframes that pass the gate are described, enriched, merged, pictured, summarised.
    What the models say is written to the shared folder, so that none is asked twice.
    speech: the most no-speech probability and the least log probability of a segment that is
    kept, None for all segments. images: a folder that the entries' images are copied to;
    without it entries name none. told gets the run's counts: what was read, described,
    copied and summarised, and how often that failed.
    """
    told = {} if told is None else told
    frames = frames.withColumn("ord", F.col("idx"))
    seen = models.recognise(recognise)
    lines = folds.keyframes_only(frames, seen) if keyframes_only else folds.recognised(folds.memo_skip(frames, similar, value), seen)
    read = {"frames": F.count("*"), "frames_unread": F.count_if("unread")}
    ocr = written(lines.select("video", "ord", "t_us", "lines", "unread"), "lines", told, **read).drop("unread")
    said = reliable(segments, remove_fillers, *speech) if speech else segments
    if attribute:
        said = temporal.attributed(said, observations(frames, ocr), grace_us)
    asked = to_describe(frames, ocr, said, gate).withColumn("prompt", models.prompt(template, F.col("lines"), F.col("texts")))
    described = models.describe(asked, describe).withColumnRenamed("app_guess", "app").select(*schema_names(DESCRIPTIONS))
    failed = F.col("action").startswith(models.FAILED.partition("{")[0])
    described = written(described, "described", told, descriptions=F.count("*"), descriptions_failed=F.count_if(failed))
    described = written(enriched(described, ocr), "enriched")
    entries = merged(described, ocr, said, tolerance_us)
    if images is not None:
        entries = copied(with_images(entries, frames), frames, images)
        bad = F.col("warning").isNotNull()
        entries = written(entries, "pictured", told, images=F.count("frame"), images_failed=F.count_if(bad), images_first_failure=F.min("warning")).drop("warning")
    else:
        entries = written(entries, "entries")
    if summarise:
        asked = F.coalesce(F.size("speech"), F.lit(0)) >= models.LEAST_LINES_TO_SUMMARISE
        counts = {"summaries": F.count_if(asked), "summaries_failed": F.count_if(asked & F.col("summary").isNull())}
        entries = written(models.summarise(entries, summarise), "summarised", told, **counts)
    return entries


def without_frames(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """videos whose decoding gave no frame, and so no work log; callers report them."""
    return videos.join(frames.select("video").distinct(), "video", "left_anti")
