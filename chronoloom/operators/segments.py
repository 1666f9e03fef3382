"""Transcript segments: normalisation, confidences, dialects of recognisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import text


def normalized(segments: DataFrame) -> DataFrame:
    """Text stripped, blank rows dropped, start not negative, end not before start."""
    out = segments.withColumn("text", text.strip(F.col("text"))).filter(F.col("text") != "")
    out = out.withColumn("start_us", F.greatest(F.lit(0), F.col("start_us")))
    return out.withColumn("end_us", F.greatest("end_us", "start_us"))


def avg_logprob(tokens: Column) -> Column:
    """Mean log probability of tokens (text, p); special ones and those without a probability do not count."""
    good = F.filter(tokens, lambda t: t["p"].isNotNull() & (t["p"] > 0) & ~F.coalesce(t["text"].startswith("[_"), F.lit(False)))
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda n, t: n + F.ln(t["p"])) / F.size(good))


def reliable(segments: DataFrame, remove_fillers: bool = True, most_no_speech: float = 0.6, least_logprob: float = -1.0) -> DataFrame:
    """Segments worth keeping; has text, no_speech_prob and avg_logprob."""
    kept = segments.filter(text.is_reliable(F.col("text"), F.col("no_speech_prob"), F.col("avg_logprob"), most_no_speech, least_logprob))
    if not remove_fillers:
        return kept
    # only what is left, and may be nothing but fillers, goes to Python
    asked = F.when(~F.col("text").rlike("[A-Za-z0-9]"), F.col("text"))
    return kept.filter(~F.coalesce(text.is_filler_only(text.nfkc(asked)), F.lit(False)))


CPP_SCHEMA = "struct<transcription: array<struct<offsets: struct<`from`: bigint, `to`: bigint>, text: string, tokens: array<struct<text: string, p: double>>>>>"
DICT_SCHEMA = "struct<segments: array<struct<start: double, `end`: double, text: string, no_speech_prob: double, avg_logprob: double>>>"


def from_cpp_json(rows: DataFrame, column: str) -> DataFrame:
    """Segments of results whose offsets are milliseconds; other columns stay."""
    parsed = rows.withColumn("__s", F.explode(F.from_json(column, CPP_SCHEMA)["transcription"])).drop(column)
    return parsed.select(
        *[c for c in parsed.columns if c != "__s"], (F.col("__s.offsets.from") * 1000).alias("start_us"), (F.col("__s.offsets.to") * 1000).alias("end_us"),
        F.col("__s.text").alias("text"), F.lit(None).cast("double").alias("no_speech_prob"), avg_logprob(F.coalesce(F.col("__s.tokens"), F.array().cast("array<struct<text:string,p:double>>"))).alias("avg_logprob"),
    )


def from_dict_json(rows: DataFrame, column: str) -> DataFrame:
    """Segments of results whose times are seconds, whether from a dictionary or from attributes."""
    parsed = rows.withColumn("__s", F.explode(F.from_json(column, DICT_SCHEMA)["segments"])).drop(column)
    micro = lambda c: F.round(c * 1_000_000).cast("long")
    return parsed.select(
        *[c for c in parsed.columns if c != "__s"], micro(F.col("__s.start")).alias("start_us"), micro(F.col("__s.end")).alias("end_us"),
        "__s.text", "__s.no_speech_prob", "__s.avg_logprob",
    )
