"""Joins of two timelines on time.

A join's unit of work is a stretch of a video and never a whole one: matches within a
bounded distance meet in time buckets of that width, and as-of joins, whose look-back has
no bound, union both sides, sort stretches and carry the last right row over their borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoloom.functions.text import without_adjacent_repeats
from chronoloom.operators.stretches import FIRST, LAST, place_of


def nearest_within(left: DataFrame, right: DataFrame, tolerance_us: int, right_cols: list[str]) -> DataFrame:
    """left with right_cols of the nearest right row at most tolerance_us away, null if none.

    Of equally near rows the earlier one, then the one first in order, is taken. left and
    right have video, t_us and ord; (video, ord) is unique on the left.
    """
    width = max(1, tolerance_us)
    l = left.select("video", "ord", "t_us", F.explode(F.array(*[F.floor(F.col("t_us") / width) + d for d in (-1, 0, 1)])).alias("__bucket"))
    r = right.select("video", F.col("t_us").alias("__rt"), F.col("ord").alias("__ro"), F.struct(*[F.col(c).alias(c) for c in right_cols]).alias("__r"), F.floor(F.col("t_us") / width).alias("__bucket"))
    apart = F.abs(F.col("t_us") - F.col("__rt"))
    near = l.join(r, ["video", "__bucket"]).filter(apart <= tolerance_us)
    best = near.groupBy("video", "ord").agg(F.min_by("__r", F.struct(apart, "__rt", "__ro")).alias("__best"))
    out = left.join(best, ["video", "ord"], "left")
    return out.select(left["*"], *[F.col(f"__best.{c}").alias(f"near_{c}") for c in right_cols])


def overlapping(left: DataFrame, right: DataFrame, margin_us: int, value: Column) -> DataFrame:
    """left with texts: value of every right interval that touches [t - margin, t + margin], in order of start.

    right has video, ord, start_us and end_us. Both sides fall into buckets twice the
    margin wide, or wider by powers of two for longer intervals; a pair counts in the
    first bucket that both share. The driver gets the powers in use, 45 at most.
    """
    base = max(2 * margin_us, 1)
    # an interval meets in buckets of about its own length, so that it falls into three at most
    length = F.greatest(F.col("end_us") - F.col("start_us"), F.lit(1))
    right = right.withColumn("__level", F.greatest(F.ceil(F.log2(length / F.lit(base))), F.lit(0)).cast("int"))
    levels = sorted(r[0] for r in right.select("__level").distinct().collect() if r[0] is not None) or [0]
    first = lambda a: F.floor(a / (F.lit(base) * F.pow(F.lit(2.0), F.col("__level")))).cast("long")
    l = left.select("video", "ord", "t_us", F.explode(F.array(*map(F.lit, levels))).alias("__level")).withColumn("__from", first(F.col("t_us") - margin_us))
    l = l.withColumn("__bucket", F.explode(F.sequence(F.col("__from"), first(F.col("t_us") + margin_us))))
    r = right.select("video", "__level", F.col("ord").alias("__ro"), "start_us", "end_us", value.alias("__v"), first(F.col("start_us")).alias("__rfrom"))
    r = r.withColumn("__bucket", F.explode(F.sequence(F.col("__rfrom"), F.greatest(first(F.col("end_us")), F.col("__rfrom")))))
    touch = (F.col("start_us") <= F.col("t_us") + margin_us) & (F.col("end_us") >= F.col("t_us") - margin_us)
    pairs = l.join(r, ["video", "__level", "__bucket"]).filter(touch & (F.col("__bucket") == F.greatest("__from", "__rfrom")))
    parts = F.array_sort(F.collect_list(F.struct("start_us", "__ro", "__v")))
    texts = pairs.groupBy("video", "ord").agg(F.transform(parts, lambda p: p["__v"]).alias("texts"))
    return left.join(texts, ["video", "ord"], "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))


def as_of(left: DataFrame, right: DataFrame, columns: list[str], forward_us: int | None = None, at: str = "t_us") -> DataFrame:
    """left with __back and, if asked for, __ahead: structs of right's columns, null where there is no such row.

    __back is the last right row not after ``at``; __ahead the first one in (at, at +
    forward_us]. right has video, t_us and ord; rows of it without a time are never found,
    and rows of left without one find nothing. A null video is a timeline like others.
    """
    kept = left.columns
    l = left.select("video", F.col(at).alias("__t"), F.lit(1).alias("__side"), F.col("ord").alias("__o"), F.struct(*kept).alias("__l"), F.lit(None).alias("__r"))
    payload = F.struct(F.col("t_us").alias("__rt"), *[F.col(c).alias(c) for c in columns])
    r = right.filter(F.col("t_us").isNotNull()).select("video", F.col("t_us").alias("__t"), F.lit(0).alias("__side"), F.col("ord").alias("__o"), F.lit(None).alias("__l"), payload.alias("__r"))
    both = r.unionByName(l).withColumn("__at", place_of("video", "__t"))
    place, found = F.struct("__t", "__side", "__o"), F.col("__side") == 0
    borders = both.groupBy("__at").agg(F.max_by("__r", F.when(found, place)).alias("__last"), F.min_by("__r", F.when(found, place)).alias("__next"))
    along = Window.partitionBy("__at.key").orderBy("__at.stretch")
    borders = borders.withColumn("__carried", F.last("__last", ignorenulls=True).over(along.rowsBetween(FIRST, -1)))
    borders = borders.withColumn("__coming", F.first("__next", ignorenulls=True).over(along.rowsBetween(1, LAST))).drop("__last", "__next")
    w = Window.partitionBy("__at").orderBy("__t", "__side", "__o")
    out = both.withColumn("__back", F.last("__r", ignorenulls=True).over(w.rowsBetween(FIRST, 0)))
    out = out.withColumn("__ahead", F.first("__r", ignorenulls=True).over(w.rowsBetween(1, LAST)) if forward_us is not None else F.lit(None))
    out = out.filter(F.col("__side") == 1).join(borders, "__at").withColumn("__back", F.coalesce("__back", "__carried"))
    out = out.withColumn("__back", F.when(F.col("__t").isNotNull(), F.col("__back")))
    if forward_us is not None:
        out = out.withColumn("__ahead", F.coalesce("__ahead", "__coming"))
    ahead = F.when(F.col("__ahead.__rt") <= F.col("__t") + forward_us, F.col("__ahead")).alias("__ahead") if forward_us is not None else F.lit(None).alias("__ahead")
    return out.select("__l.*", "__back", ahead)


def attach_speech(entries: DataFrame, segments: DataFrame, line: Column) -> DataFrame:
    """entries with speech: the lines of segments that start in [t, next t); the first entry also takes earlier ones.

    segments has video, ord and start_us; line is computed over it. Repeats of the line
    before are left out. One as-of join, then one aggregate by entry.
    """
    starts = segments.select("video", "ord", F.col("start_us").alias("t_us"), line.alias("__line"))
    placed = as_of(starts, entries.select("video", "t_us", "ord"), ["ord"])
    first = entries.groupBy("video").agg(F.min_by("ord", F.struct("t_us", "ord")).alias("__first"))
    first = first.withColumnRenamed("video", "__video")
    placed = placed.join(first, F.col("video").eqNullSafe(F.col("__video"))).select("video", F.coalesce("__back.ord", "__first").alias("__entry"), "t_us", "ord", "__line")
    parts = F.array_sort(F.collect_list(F.struct("t_us", "ord", "__line")))
    speech = placed.groupBy("video", "__entry").agg(F.transform(parts, lambda p: p["__line"]).alias("__lines"))
    speech = speech.select("video", F.col("__entry").alias("ord"), without_adjacent_repeats(F.col("__lines")).alias("speech"))
    speech = speech.select(F.struct("video", "ord").alias("__at"), "speech")
    return entries.withColumn("__at", F.struct("video", "ord")).join(speech, "__at", "left").drop("__at").withColumn("speech", F.coalesce("speech", F.array().cast("array<string>")))


def attributed(segments: DataFrame, observations: DataFrame, grace_us: int = 3_000_000, most_lines: int = 8) -> DataFrame:
    """segments with speaker: the only name of the observation in force at start_us.

    In force is the first observation within the grace after the start, else the last
    before. The guards (one name, not too many lines) hold for that one; there is no
    falling back. observations has video, t_us, ord, names and line_count. A segment
    without one keeps its own speaker.
    """
    found = as_of(segments, observations, ["names", "line_count"], grace_us, at="start_us")
    chosen = F.coalesce(F.col("__ahead"), F.col("__back"))
    name = F.when((chosen["line_count"] <= most_lines) & (F.size(chosen["names"]) == 1), F.element_at(chosen["names"], 1))
    own = F.col("speaker") if "speaker" in segments.columns else F.lit(None).cast("string")
    return found.withColumn("speaker", F.coalesce(name, own)).drop("__back", "__ahead")


def nearest_keyframes(frames: DataFrame, scenes: DataFrame, step_us: int) -> DataFrame:
    """frames (video, idx on a grid of step_us) with is_keyframe: frame 0 and the frame nearest each scene, ties to the lower one.

    On a grid the nearest index is arithmetic, so this is one equi-join.
    """
    most = frames.groupBy("video").agg(F.max("idx").alias("__most"))
    nearest = F.ceil((F.col("scene_us") - F.lit(step_us / 2)) / F.lit(float(step_us))).cast("long")
    hits = scenes.join(most, "video").select("video", F.least(F.greatest(nearest, F.lit(0)), "__most").alias("idx"))
    hits = hits.distinct().withColumn("__hit", F.lit(True))
    out = frames.join(hits, ["video", "idx"], "left")
    return out.withColumn("is_keyframe", (F.col("idx") == 0) | F.coalesce("__hit", F.lit(False))).drop("__hit")
