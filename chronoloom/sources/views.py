"""Timeline views over the standard tables, for queries and benchmarks; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as described screens: a user's stream is a video."""
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("video"), F.col("event_id").alias("ord"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), F.col("event_type").alias("action"),
        k.alias("k"), F.floor(k / 50).cast("long").alias("resource"), F.when(k % 3 != 0, F.concat(F.lit("p"), (k % 2).cast("string"))).alias("location"),
        F.when(k % 7 != 0, F.col("event_type")).alias("app"), (k % 4 != 0).alias("is_keyframe"),
    )


DESCRIPTIONS = """d AS (
  SELECT user_id AS video, event_id AS ord, epoch_us(ts) AS t_us, event_type AS action, k, (k // 50)::BIGINT AS resource,
         CASE WHEN k % 3 <> 0 THEN 'p' || (k % 2)::VARCHAR END AS location, CASE WHEN k % 7 <> 0 THEN event_type END AS app, k % 4 <> 0 AS is_keyframe
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
)"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as observed lines: a source is a video."""
    return read(spark, sf_dir, "documents").select(
        F.col("source").alias("video"), F.col("doc_id").alias("ord"), (F.col("doc_id") * 500_000).alias("t_us"), F.split("text", "\n").alias("lines"), (F.col("doc_id") % 3 == 0).alias("is_keyframe")
    )


OBSERVED = "o AS (SELECT source AS video, doc_id AS ord, doc_id * 500000 AS t_us, string_split(text, chr(10)) AS lines, doc_id % 3 = 0 AS is_keyframe, text FROM documents)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as transcripts: a conversation is a video."""
    turn, conv = F.col("turn"), F.col("conv_id")
    return read(spark, sf_dir, "conversations").select(
        conv.alias("video"), turn.alias("ord"), (turn * 10_000_000 - 15_000_000).alias("start_us"), (turn * 10_000_000 - 15_000_000 + (conv % 5 - 1) * 4_000_000).alias("end_us"),
        F.col("text"), F.when(F.col("role") != "system", F.col("role")).alias("speaker"),
        F.when((conv + turn) % 3 != 0, ((conv * 7 + turn * 13) % 100) / 100).alias("no_speech_prob"), F.when((conv + turn) % 4 != 0, -((conv * 11 + turn * 17) % 250) / 100).alias("avg_logprob"),
    )


SEGMENTS = """s AS (
  SELECT conv_id AS video, turn AS ord, turn * 10000000 - 15000000 AS start_us, turn * 10000000 - 15000000 + (conv_id % 5 - 1) * 4000000 AS end_us, text,
         CASE WHEN role <> 'system' THEN role END AS speaker,
         CASE WHEN (conv_id + turn) % 3 <> 0 THEN ((conv_id * 7 + turn * 13) % 100)::DOUBLE / 100 END AS no_speech_prob,
         CASE WHEN (conv_id + turn) % 4 <> 0 THEN -((conv_id * 11 + turn * 17) % 250)::DOUBLE / 100 END AS avg_logprob
  FROM conversations
)"""


def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as screens: a line that a window would show (by turns a title bar, the address, a note of both, a place), then the page's own lines."""
    i, stem = F.col("page_id"), F.concat(F.lit("p"), F.col("page_id").cast("string"))
    shown = (
        F.when(i % 4 == 0, F.concat(stem, F.lit(".pdf - Preview"))).when(i % 4 == 1, F.col("url"))
        .when(i % 4 == 2, F.concat(F.lit("see "), F.col("url"), F.lit(" and "), stem, F.lit(".md - Word")))
        .otherwise(F.concat(F.lit("Page "), (i % 9).cast("string"), F.lit(" of 9")))
    )
    return read(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.array(shown), F.split("html", "\n")).alias("lines"))


SCREENS = """s AS (SELECT page_id, url, list_concat([CASE page_id % 4 WHEN 0 THEN 'p' || page_id::VARCHAR || '.pdf - Preview' WHEN 1 THEN url
  WHEN 2 THEN 'see ' || url || ' and p' || page_id::VARCHAR || '.md - Word' ELSE 'Page ' || (page_id % 9)::VARCHAR || ' of 9' END], string_split(html, chr(10))) AS lines FROM pages)"""
