"""Long inputs in chunks with halos, and the ownership rule that removes what halos repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_US, OVERLAP_US = 1_800_000_000, 30_000_000


def chunk_spans(durations: DataFrame, chunk_us: int = CHUNK_US, overlap_us: int = OVERLAP_US) -> DataFrame:
    """One row per chunk of each video (video, duration_us): what it owns, and what it reads with its halo."""
    d = F.col("duration_us")
    if chunk_us <= 0:
        return durations.select("video", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("chunk_start"), d.alias("chunk_end"), F.lit(0).cast("long").alias("media_start"), d.alias("media_len"))
    last = F.greatest(F.ceil(d / chunk_us) - 1, F.lit(0)).cast("long")
    k = F.col("k")
    out = durations.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    out = out.withColumns({"chunk_start": k * chunk_us, "chunk_end": F.least((k + 1) * chunk_us, d)})
    start, end = F.greatest(F.col("chunk_start") - overlap_us, F.lit(0)), F.least(F.col("chunk_end") + overlap_us, d)
    return out.select("video", "k", "chunk_start", "chunk_end", start.alias("media_start"), (end - start).alias("media_len"))


def owned(segments: DataFrame) -> DataFrame:
    """Segments that start in what their chunk owns; they have start_us, chunk_start and chunk_end."""
    return segments.filter((F.col("start_us") >= F.col("chunk_start")) & (F.col("start_us") < F.col("chunk_end")))


def failed_chunks(chunks: DataFrame) -> DataFrame:
    """Per video: chunks, failed ones, the lost ranges in order, and whether all failed. chunks has failed."""
    lost = F.array_sort(F.collect_list(F.when(F.col("failed"), F.struct("chunk_start", "chunk_end"))))
    text = F.array_join(F.transform(lost, lambda x: F.concat(x["chunk_start"].cast("string"), F.lit("-"), x["chunk_end"].cast("string"))), ",")
    return chunks.groupBy("video").agg(
        F.count("*").alias("n_chunks"), F.count_if("failed").alias("n_failed"), text.alias("lost"), F.every("failed").alias("all_failed")
    )
