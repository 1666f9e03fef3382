"""Ports to models: injected callables that Python workers run in Arrow batches.

A port is a factory of a callable, so that a model loads once per worker and not per row;
workers know a factory by its content, wherever it was unpickled.
A model that fails gives its failure as data: other rows go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.reply import FIELDS, parsed

# Texts that models are asked with, and what stands for a failure.
DOCUMENT_PREFIX, QUERY_PREFIX = "検索文書: ", "検索クエリ: "
NO_TEXT, NO_SPEECH = "(テキストなし)", "(発話なし)"
FAILED = "（VLM呼び出し失敗: {}）"
RETRYABLE = ("TimeoutException", "TimeoutError")
ATTEMPTS = 2
LEAST_LINES_TO_SUMMARISE = 3

_loaded: dict[str, tuple[Callable, Callable]] = {}


def content_key(factory: Callable) -> str:
    """What a factory is: the digest of its code and of what it holds."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def loaded(factory: Callable[[], Callable], key: str) -> Callable:
    """The factory's callable, made once per worker for each key; the factory is held beside it."""
    if key not in _loaded:
        _loaded[key] = (factory, factory())
    return _loaded[key][1]


def attempted(call: Callable, *args, attempts: int = ATTEMPTS, retry: Collection[str] = RETRYABLE):
    """The call's result. An error whose class, or a base of it, bears a name in retry is tried again, attempts times in all."""
    for left in reversed(range(attempts)):
        try:
            return call(*args)
        except Exception as e:
            again = not set(retry).isdisjoint(kind.__name__ for kind in type(e).mro())
            if not (left and again):
                raise
    return None


def answered(call: Callable, *args, attempts: int = ATTEMPTS) -> str:
    """The call's text; where it comes back empty, as from a model that has just started, it is asked again, attempts times in all."""
    for _ in range(attempts):
        content = attempted(call, *args) or ""
        if content.strip():
            break
    return content


def recognise(factory: Callable[[], Callable[[str], list[str]]]) -> Callable[[DataFrame], DataFrame]:
    """Adds lines to frames with a path; null where the model fails."""

    key = content_key(factory)

    @F.pandas_udf("array<string>")
    def lines(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(factory, key)

        def one(path):
            try:
                return [str(x) for x in attempted(model, path)]
            except Exception:
                return None

        for batch in paths:
            yield batch.map(one)

    return lambda frames: frames.withColumn("lines", lines("path"))


def prompt(template: str, lines: Column, speech: Column) -> Column:
    """A template's two places (%s) filled with lines and speech."""
    seen, said = F.array_join(lines, "\n"), F.array_join(speech, "\n")
    return F.format_string(template, F.when(seen != "", seen).otherwise(NO_TEXT), F.when(said != "", said).otherwise(NO_SPEECH))


def summary_prompt(task: str, lines: Column) -> Column:
    """What a summariser is asked: its task, then the lines."""
    return F.concat(F.lit(f"{task}\n\n"), F.array_join(lines, "\n"))


def describe(frames: DataFrame, factory: Callable[[], Callable[[str, str], str]]) -> DataFrame:
    """frames (path, prompt) with the five fields of the model's reply; an empty one is asked for again, a failed call is an action that says so."""

    key = content_key(factory)

    @F.pandas_udf("content string, error string")
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = loaded(factory, key)
        for paths, prompts in batches:
            rows = []
            for path, text in zip(paths, prompts, strict=True):
                try:
                    rows.append((answered(model, path, text), None))
                except Exception as e:
                    rows.append((None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["content", "error"])

    out = frames.withColumn("__reply", ask("path", "prompt")).withColumn("__fields", parsed(F.coalesce("__reply.content", F.lit(""))))
    failed = F.format_string(FAILED.replace("{}", "%s"), F.col("__reply.error"))
    for f in FIELDS:
        value = F.col(f"__fields.{f}")
        out = out.withColumn(f, F.when(F.col("__reply.error").isNotNull(), failed if f == "action" else F.lit(None)).otherwise(value))
    return out.drop("__reply", "__fields")


def transcribe(chunks: DataFrame, factory: Callable[[], Callable[[str, int, int], list[dict]]]) -> DataFrame:
    """Segments of chunks (video, path, chunk_start, chunk_end, media_start, media_len), in absolute time.

    A chunk that fails gives one row with failed set, so that lost ranges can be told.
    """
    key = content_key(factory)
    return _segments(chunks, lambda: loaded(factory, key), lambda c: c.path, ["path"])


def _segments(chunks: DataFrame, load: Callable[[], Callable], source: Callable, columns: list[str]) -> DataFrame:
    """Segments as load()'s callable hears them in source(chunk), from media_start on and for media_len."""
    schema = "video string, chunk_start long, chunk_end long, failed boolean, start_us long, end_us long, text string, no_speech_prob double, avg_logprob double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            rows = []
            for c in batch.itertuples(index=False):
                try:
                    found = attempted(model, source(c), c.media_start, c.media_len)
                    rows += [(c.video, c.chunk_start, c.chunk_end, False, s["start_us"] + c.media_start, s["end_us"] + c.media_start, s["text"], s.get("no_speech_prob"), s.get("avg_logprob")) for s in found]
                except Exception:
                    rows.append((c.video, c.chunk_start, c.chunk_end, True, None, None, None, None, None))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
            yield out.astype({"start_us": "Int64", "end_us": "Int64", "no_speech_prob": "Float64", "avg_logprob": "Float64"})

    return chunks.select("video", *columns, "chunk_start", "chunk_end", "media_start", "media_len").mapInPandas(run, schema)


def heard(chunks: DataFrame, factory: Callable[[], Callable[[np.ndarray, int], list[dict]]]) -> DataFrame:
    """transcribe() for models that take 16-bit samples and their rate: chunks have rate and samples, null where there is no sound to be had."""
    key = content_key(factory)

    def spans() -> Callable:
        model = loaded(factory, key)

        def hear(sound: tuple, start: int, length: int) -> list[dict]:
            rate, samples = sound
            if samples is None:
                raise ValueError("no sound")
            return model(np.frombuffer(samples, "<i2"), int(rate))

        return hear

    return _segments(chunks, spans, lambda c: (c.rate, c.samples), ["rate", "samples"])


def summarise(entries: DataFrame, factory: Callable[[], Callable[[list[str]], str | None]]) -> DataFrame:
    """entries with a summary of their speech where there are lines enough; only those rows reach the model."""

    key = content_key(factory)

    @F.pandas_udf("string")
    def sentence(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(factory, key)

        def one(x):
            try:
                said = (attempted(model, list(x)) or "").strip()
            except Exception:
                return None
            return said or None

        for batch in lines:
            yield batch.map(one)

    enough = F.coalesce(F.size("speech"), F.lit(0)) >= LEAST_LINES_TO_SUMMARISE
    asked = entries.filter(enough).withColumn("__s", sentence("speech"))
    asked = asked.withColumn("summary", F.coalesce("__s", "summary")).drop("__s")
    return asked.unionByName(entries.filter(~enough))


def embed(texts: DataFrame, column: str, factory: Callable[[], Callable[[list[str]], list]], prefix: str = DOCUMENT_PREFIX) -> DataFrame:
    """texts with embedding, a batch at a time."""

    key = content_key(factory)

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(factory, key)
        for batch in batches:
            yield pd.Series([[float(y) for y in x] for x in model([prefix + t for t in batch])], index=batch.index, dtype=object)

    return texts.withColumn("embedding", vectors(column))
