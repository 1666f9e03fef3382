"""Two commands: work logs from recordings, and search in stored logs.

    python -m chronoloom.cli log OUT VIDEO... --recognise pkg.module:factory --describe pkg.module:factory
    python -m chronoloom.cli index FOLDER LOG... --embed pkg.module:factory --model NAME
    python -m chronoloom.cli query FOLDER TEXT --embed pkg.module:factory --model NAME

Models are given as factories (see chronoloom.models). Wrong values and missing files end
with one line and exit code 1 or 2.
"""

from __future__ import annotations

import argparse
import importlib
import os
import shutil
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chronoloom import models
from chronoloom.operators.folds import GateConfig
from chronoloom.plans import recordings
from chronoloom.sinks import index_store, worklogs
from chronoloom.sources import media
from chronoloom.sources.worklogs import read_worklogs, search_documents

FORMATS = ("jsonl", "md", "manual")


def factory(name: str) -> Callable:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="chronoloom")
    commands = out.add_subparsers(dest="command", required=True)
    log = commands.add_parser("log")
    log.add_argument("out")
    log.add_argument("videos", nargs="+")
    log.add_argument("--mode", choices=sorted(recordings.PRESETS), default="screencast")
    log.add_argument("--format", choices=FORMATS, action="append")
    for name in ("recognise", "describe"):
        log.add_argument(f"--{name}", type=factory, required=True)
    for name in ("transcribe", "hear", "summarise", "similar"):
        log.add_argument(f"--{name}", type=factory)
    for name in ("fps", "scene-threshold", "chunk-minutes", "gate-similarity", "gate-least-gap", "gate-most-gap", "most-no-speech", "least-logprob", "tolerance", "switch-tolerance", "alike"):
        log.add_argument(f"--{name}", type=float)
    for name in ("keyframes-only", "attribute", "remove-fillers", "filter-speech", "save-frames"):
        log.add_argument(f"--{name}", action=argparse.BooleanOptionalAction)
    for command, what in (("index", "logs"), ("query", "text")):
        add = commands.add_parser(command)
        add.add_argument("folder")
        add.add_argument(what, nargs="+" if what == "logs" else None)
        add.add_argument("--embed", type=factory, required=True)
        add.add_argument("--model", required=True)
        if command == "query":
            add.add_argument("-k", type=int, default=5)
    return out


def options(args: argparse.Namespace) -> recordings.Options:
    """The mode's options with what was given; any gate value switches the gate on."""
    given = {"skip_from_jaccard": args.gate_similarity, "least_gap_us": args.gate_least_gap and round(args.gate_least_gap * 1e6), "most_gap_us": args.gate_most_gap and round(args.gate_most_gap * 1e6)}
    given = {k: v for k, v in given.items() if v is not None}
    return recordings.preset(
        args.mode, gate=GateConfig(**given) if given else None, fps=args.fps, scene_threshold=args.scene_threshold, chunk_minutes=args.chunk_minutes,
        keyframes_only=args.keyframes_only, attribute=args.attribute, remove_fillers=args.remove_fillers, filter_speech=args.filter_speech,
        save_frames=args.save_frames, most_no_speech=args.most_no_speech, least_logprob=args.least_logprob, tolerance=args.tolerance, switch_tolerance=args.switch_tolerance, alike=args.alike,
    )


def ready(videos: list[str], programs: tuple[str, ...] = media.PROGRAMS) -> None:
    """FileNotFoundError where a recording or a program that decodes it is not there, before anything runs."""
    for path in videos:
        if "://" not in path and not os.path.isfile(path):
            raise FileNotFoundError(f"no recording at {path}")
    for program in programs:
        if shutil.which(program) is None:
            raise FileNotFoundError(f"{program} is not installed")


def log(spark: SparkSession, args: argparse.Namespace) -> None:
    stem = lambda p: p.rpartition("/")[2].rpartition(".")[0] or p.rpartition("/")[2]
    told = options(args)
    videos = spark.createDataFrame([(stem(p), p) for p in args.videos], "video string, path string")
    ports = recordings.Ports(args.recognise, args.describe, args.transcribe, args.summarise, args.similar and args.similar(), args.hear)
    ready(args.videos)
    run = recordings.worklogs(videos, f"{args.out}/.decoded", ports, told, images_to=args.out)
    kinds = [k for k in args.format or FORMATS[:2] if k != "manual" or len(args.videos) == 1]  # a manual is of one recording
    worklogs.write_recordings(run.entries, args.out, kinds)
    for line in run.warnings():
        print(line, file=sys.stderr)


def index(spark: SparkSession, args: argparse.Namespace) -> None:
    documents = models.embed(search_documents(read_worklogs(spark, *args.logs)), "text", args.embed)
    index_store.save(index_store.build(documents), args.folder, args.model)


def query(spark: SparkSession, args: argparse.Namespace) -> None:
    stored = index_store.load(spark, args.folder, args.model)
    (vector,) = args.embed()([models.QUERY_PREFIX + args.text])
    found = index_store.search(stored, list(vector), args.k)
    line = worklogs.hit_line(F.col("rank"), F.col("score"), F.col("t"), F.col("t_end"), F.col("source"), F.col("app_guess"), F.col("action"))
    for row in found.orderBy("rank").select(line.alias("line")).collect():
        print(row["line"])


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("chronoloom").getOrCreate()
    try:
        {"log": log, "index": index, "query": query}[args.command](spark, args)
    except (FileNotFoundError, ValueError) as e:
        print(str(e).splitlines()[0], file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
