"""From recordings to work logs: decoding, speech, and the run over frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom import models, schemas
from chronoloom.operators import chunking, folds, segments
from chronoloom.plans import worklog
from chronoloom.sinks.scratch import written
from chronoloom.sinks.worklogs import check_stems
from chronoloom.sources import audio, images, media


@dataclass(frozen=True)
class Options:
    """What a run is told; ValueError where values make no sense."""

    fps: float = media.FPS
    scene_threshold: float = media.SCENE_THRESHOLD
    chunk_minutes: float = 30.0
    keyframes_only: bool = False
    gate: folds.GateConfig | None = None
    attribute: bool = False
    remove_fillers: bool = True
    #: Whether doubtful speech is left out, and from which probabilities on it is doubtful.
    filter_speech: bool = True
    most_no_speech: float = worklog.SPEECH[0]
    least_logprob: float = worklog.SPEECH[1]
    #: Seconds: how far a frame's lines may be, and how soon after speech begins the speaker may be shown.
    tolerance: float = worklog.TOLERANCE_US / 1e6
    switch_tolerance: float = worklog.GRACE_US / 1e6
    #: Below which mean difference, 0 to 1, a frame is like the last one read; 0 reads every frame.
    alike: float = images.ALIKE
    #: Whether images are copied beside the logs. Off, as they may show what should not be kept.
    save_frames: bool = False

    def __post_init__(self):
        for wrong, what in (
            (self.fps <= 0, "fps must be above 0"),
            (not 0 <= self.scene_threshold <= 1, "scene_threshold must lie between 0 and 1"),
            (self.chunk_minutes < 0, "chunk_minutes must not be negative"),
            (self.gate is not None and not 0 <= self.gate.skip_from_jaccard <= 1, "the gate's similarity must lie between 0 and 1"),
            (not 0 <= self.most_no_speech <= 1, "most_no_speech must lie between 0 and 1"),
            (self.least_logprob > 0, "least_logprob must not be above 0"),
            (self.tolerance < 0 or self.switch_tolerance < 0, "a tolerance must not be negative"),
            (not 0 <= self.alike <= 1, "alike must lie between 0 and 1"),
            (self.gate is not None and self.gate.least_gap_us > self.gate.most_gap_us, "the gate's least gap must not exceed its greatest"),
        ):
            if wrong:
                raise ValueError(what)


#: Of screens that one works on every changed frame is read and every keyframe described; of meetings keyframes are read, and described where they changed.
PRESETS = {"screencast": Options(), "meeting": Options(keyframes_only=True, gate=folds.GateConfig())}


def preset(mode: str, **changes) -> Options:
    """A mode's options with changes; those that are None stay the mode's."""
    return replace(PRESETS[mode], **{k: v for k, v in changes.items() if v is not None})


@dataclass(frozen=True)
class Ports:
    """Factories of the models; without a transcriber or a summariser these steps are left out.

    transcribe is asked with a path and a span, hear with the samples of a span that was cut
    out of the recording's sound. similar compares values of paths; without it images are compared.
    """

    recognise: Callable
    describe: Callable
    transcribe: Callable | None = None
    summarise: Callable | None = None
    similar: Callable | None = None
    hear: Callable | None = None


@dataclass(frozen=True)
class Run:
    """What a run gave: entries, and what it could not do.

    unseen are the videos that gave no frame; lost has a row for every video whose sound was
    heard, with its failed chunks and their ranges; counts are those of worklog.generate().
    """

    entries: DataFrame
    unseen: DataFrame
    lost: DataFrame
    counts: dict[str, int | str | None]

    def warnings(self, most: int = 100) -> list[str]:
        """What a user should know, a line each, of at most so many videos a kind."""
        out = [f"no frame in {r['path']}" for r in self.unseen.orderBy("video").limit(most).collect()]
        for r in self.lost.filter("n_failed > 0").orderBy("video").limit(most).collect():
            ranges = ", ".join("-".join(f"{int(us) / 1e6:g}" for us in span.split("-")) for span in r["lost"].split(","))
            out.append(f"no speech of {r['video']} could be heard" if r["all_failed"] else f"speech of {r['video']} is lost in {ranges} seconds")
        for failed, of, what in (("frames_unread", "frames", "frames could not be read"), ("descriptions_failed", "descriptions", "descriptions failed"), ("images_failed", "images", "images could not be copied"), ("summaries_failed", "summaries", "summaries failed")):
            if self.counts.get(failed):
                out.append(f"{self.counts[failed]} {what}, of {self.counts[of] + (self.counts[failed] if of == 'images' else 0)}")
        return out


def spoken(videos: DataFrame, ports: Ports, directory: str, options: Options, run=media.run_program) -> tuple[DataFrame, DataFrame]:
    """Segments (schemas.SEGMENTS) of the videos that have sound, heard in chunks, and chunking.failed_chunks() of these."""
    heard = written(media.probed(videos, run), "probed").filter("has_audio AND duration_us IS NOT NULL")
    chunks = chunking.chunk_spans(heard, round(options.chunk_minutes * 60e6)).join(heard.select("video", "path"), "video")
    if ports.hear:
        sound = written(media.extracted_sound(heard.select("video", "path"), directory, run), "sound").select("video", F.col("sound").alias("path"))
        found = written(models.heard(audio.with_sound(chunks.drop("path").join(sound, "video")), ports.hear), "heard")
    else:
        found = written(models.transcribe(chunks, ports.transcribe), "heard")
    at = ["video", "chunk_start", "chunk_end"]
    silent = chunks.select(*at).join(found.filter("failed").select(*at).withColumn("failed", F.lit(True)), at, "left")
    lost = chunking.failed_chunks(silent.withColumn("failed", F.coalesce("failed", F.lit(False))))
    own = segments.normalized(chunking.owned(found.filter("NOT failed")).drop("failed")).withColumn("speaker", F.lit(None).cast("string"))
    numbered = own.withColumn("ord", F.xxhash64("start_us", "end_us", "text"))
    return numbered.select(*schemas.names(schemas.SEGMENTS)), lost


def worklogs(videos: DataFrame, directory: str, ports: Ports, options: Options = PRESETS["screencast"], run=media.run_program, images_to: str | None = None) -> Run:
    """Entries of videos (video string, path), and what failed. directory is shared by all tasks and gets the frames.

    images_to: the folder that images are copied to, <video>/frames, where the options say so.

    ValueError if two recordings would share an output folder.
    """
    spark = videos.sparkSession
    check_stems(videos)
    frames = written(media.decoded_frames(videos, directory, options.fps, run), "frames")
    logs = written(media.scene_logs(videos, options.scene_threshold, run), "scenes")
    frames = written(media.keyframes(frames, logs, options.fps).select(*schemas.names(schemas.FRAMES)), "keyframes")
    if ports.transcribe or ports.hear:
        said, lost = spoken(videos, ports, directory, options, run)
    else:
        said = spark.createDataFrame([], schemas.SEGMENTS)
        lost = spark.createDataFrame([], "video string, n_chunks long, n_failed long, lost string, all_failed boolean")
    similar, value, seen = ports.similar, "path", frames
    if similar is None and options.alike and not options.keyframes_only:
        similar, value, seen = images.alike(options.alike), "small", written(images.with_small(frames, "path", by_path=True), "small")
    counts: dict = {}
    entries = worklog.generate(
        seen, said, ports.recognise, ports.describe, summarise=ports.summarise, gate=options.gate, keyframes_only=options.keyframes_only, similar=similar, value=value,
        attribute=options.attribute, remove_fillers=options.remove_fillers, tolerance_us=round(options.tolerance * 1e6), grace_us=round(options.switch_tolerance * 1e6),
        speech=(options.most_no_speech, options.least_logprob) if options.filter_speech else None, images=images_to if options.save_frames else None, told=counts,
    )
    return Run(entries, worklog.without_frames(videos, frames), lost, counts)
