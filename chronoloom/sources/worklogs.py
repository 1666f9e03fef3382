"""Stored work logs: one JSON object a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoloom.functions.text import search_text
from chronoloom.operators.stretches import FIRST, STRETCH_IDS, numbered
from chronoloom.schemas import WORKLOG, names
from chronoloom.sinks.scratch import written

#: Splits of files whose line counts may be broadcast; beyond it they meet the lines in a shuffled join.
BROADCAST_SPLITS = 10_000


def split_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, split, nth, value): all lines of the files; nth orders the lines of a split, which begins at that byte of its file."""
    text = spark.read.text(list(paths), lineSep="\n")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return text.select(
        path.alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"), F.regexp_replace("value", "\r$", "").alias("value")
    )


def read_lines(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(file, line, value) of all lines, numbered from 1 in each file, and a row a split of what was counted, with its first malformed line.

    A file is read by as many tasks as it has splits. Each counts its lines; the sums of
    those before it, one row a split, turn places in a split into places in the file.
    """
    lines = split_lines(spark, *paths)
    bad = (F.trim("value") != "") & F.try_parse_json("value").isNull()
    counts = lines.groupBy("file", "split").agg(F.count("*").alias("held"), F.min("nth").alias("first"), F.min(F.when(bad, F.col("nth"))).alias("bad"))
    earlier = F.sum("held").over(Window.partitionBy("file").orderBy("split").rowsBetween(FIRST, -1))
    splits = written(counts.withColumn("earlier", F.coalesce(earlier, F.lit(0))), "splits")
    known = splits.select("file", "split", (F.col("earlier") + 1 - F.col("first")).alias("__more"))
    known = F.broadcast(known) if splits.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS else known
    return lines.join(known, ["file", "split"]).select("file", (F.col("nth") + F.col("__more")).alias("line"), "value"), splits


def read_worklogs(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of the files with ``file`` and ``line`` (from 1). Blank lines are skipped; a malformed one raises ValueError naming file and line."""
    lines, splits = read_lines(spark, *paths)
    bad = splits.filter("bad IS NOT NULL").select("file", (F.col("earlier") + F.col("bad") - F.col("first") + 1).alias("line")).orderBy("file", "line").first()
    if bad:
        raise ValueError(f"malformed record at {bad['file']}:{bad['line']}")
    return parsed_lines(lines.filter(F.trim("value") != ""))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Records of lines (value, and others, which stay); blank ones must be gone."""
    parsed = lines.withColumn("__r", F.from_json("value", WORKLOG)).drop("value")
    return parsed.select(*[c for c in parsed.columns if c != "__r"], *[f"__r.{c}" for c in names(WORKLOG)])


def malformed(lines: DataFrame) -> DataFrame:
    """Those of lines (value) that are no JSON."""
    return lines.filter(F.try_parse_json("value").isNull())


def search_documents(records: DataFrame) -> DataFrame:
    """What is searched: doc_id is the log's folder, its file and the record's place; source is the folder."""
    parts = F.split("file", "/")
    source, name = F.element_at(parts, -2), F.element_at(parts, -1)
    records = numbered(records, "__nth", "file", ["line"], STRETCH_IDS)
    empty = F.array().cast("array<string>")
    body = search_text(*[F.col(c) for c in ("action", "app_guess", "resource", "location", "focus")], F.coalesce("speech", empty), F.coalesce("ocr", empty))
    return records.select(
        F.concat(source, F.lit("/"), name, F.lit(":"), F.col("__nth").cast("string")).alias("doc_id"), body.alias("text"), source.alias("source"),
        F.coalesce("t", F.lit("00:00:00")).alias("t"), "t_end", "duration_seconds", "app_guess", F.coalesce("action", F.lit("")).alias("action"),
    )
