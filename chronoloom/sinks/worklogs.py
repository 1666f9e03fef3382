"""Work logs as JSON lines, as Markdown and as a manual.

Lines and sections are made by column expressions. The files of many recordings are written
by write_recordings() in one job; a single log may be streamed to the driver in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import text
from chronoloom.operators.runs import dwell_by_app
from chronoloom.operators.stretches import numbered
from chronoloom.sinks import recording_files
from chronoloom.sinks.files import write_atomic

SECOND = 1e6


def json_line(e=F.col) -> Column:
    """An entry as JSON with all twelve keys, nulls included."""
    when = lambda c: F.when(e(c).isNotNull(), text.hms(e(c) / SECOND))
    return F.to_json(
        F.struct(
            when("t_us").alias("t"), when("end_us").alias("t_end"), (e("duration_us") / SECOND).alias("duration_seconds"), e("app").alias("app_guess"),
            *[e(c).alias(c) for c in ("resource", "location", "focus", "ocr", "speech", "summary", "frame", "action")],
        ),
        {"ignoreNullFields": "false"},
    )


def _image() -> Column:
    return F.when(F.length("frame") > 0, F.concat(F.lit("!["), text.hms(F.col("t_us") / SECOND), F.lit("]("), F.col("frame"), F.lit(")\n")))


def _section() -> Column:
    heading = text.heading(F.col("t_us") / SECOND, F.col("end_us") / SECOND, F.col("duration_us") / SECOND, F.col("app"), F.col("resource"), F.col("location"))
    said = F.array_join(F.transform("speech", lambda x: F.concat(F.lit("🗣️ "), x)), "\n")
    seen = F.array_join(F.transform("ocr", lambda x: F.concat(F.lit("- `"), x, F.lit("`"))), "\n")
    return F.concat_ws(
        "\n", heading, F.lit(""), _image(), F.when(F.length("summary") > 0, F.concat(F.lit("🧭 "), F.col("summary"), F.lit("\n"))), F.when(F.size("speech") > 0, F.concat(said, F.lit("\n"))),
        F.when(F.length("focus") > 0, F.concat(F.lit("👁 "), F.col("focus"))), F.col("action"), F.when(F.size("ocr") > 0, F.concat(F.lit("\n"), seen)), F.lit(""),
    )


def _step() -> Column:
    title = text.step_title(F.col("action"))
    n = F.col("nth")
    more = F.when(F.regexp_replace("action", "。+$", "") != F.regexp_replace(title, "…+$", ""), F.col("action"))
    return F.concat_ws(
        "\n", F.concat(F.lit("## Step "), n.cast("string"), F.lit(": "), title), F.lit(""), _image(), text.target_line(F.col("app"), F.col("resource"), F.col("location")),
        F.when(F.length("focus") > 0, F.concat(F.lit("👁 "), F.col("focus"))), more, F.lit(""),
    )


def _in_order(entries: DataFrame, line: Column) -> Iterator[str]:
    """The lines one after the other; the driver holds one partition of them."""
    rows = entries.select("t_us", "ord", line.alias("line")).orderBy("t_us", "ord").select("line").toLocalIterator()
    return (r[0] for r in rows)


def _parted(lines: Iterator[str]) -> Iterator[str]:
    """Lines with line feeds between them."""
    for i, line in enumerate(lines):
        yield f"\n{line}" if i else line


def write_jsonl(entries: DataFrame, path: str | Path) -> None:
    write_atomic(path, chain(_parted(_in_order(entries, json_line())), ["\n"]))


APP_TABLE = "\n## アプリ別滞在時間\n\n| アプリ | 滞在時間 |\n|---|---|\n"


def app_table(entries: DataFrame) -> str:
    rows = dwell_by_app(entries).orderBy(F.desc("total_us"), "first_ord").select("app", text.duration_ja(F.col("total_us") / SECOND)).collect()
    return APP_TABLE + "".join(f"| {a} | {d} |\n" for a, d in rows) if rows else ""


def write_markdown(entries: DataFrame, path: str | Path) -> None:
    write_atomic(path, chain(["# 作業ログ\n\n"], _parted(_in_order(entries, _section())), [app_table(entries)]))


def write_manual(entries: DataFrame, path: str | Path, source: str) -> None:
    steps = numbered(entries, "nth").withColumn("nth", F.col("nth") + 1)
    write_atomic(path, chain([f"# {source} 手順書\n\n"], _parted(_in_order(steps, _step()))))


def parts_of_logs(entries: DataFrame, kinds: Sequence[str] = ("jsonl", "md")) -> DataFrame:
    """(file, place, nth, part) of every recording's files, <video>/worklog.jsonl, worklog.md and manual.md, as one table.

    place 0 is a file's head, 1 its entries by nth, 2 its tail. The text is what
    write_jsonl(), write_markdown() and write_manual() write for one recording.
    """
    name = {"jsonl": "worklog.jsonl", "md": "worklog.md", "manual": "manual.md"}
    steps = numbered(entries.filter(F.col("video").isNotNull()), "nth").withColumn("nth", F.col("nth") + 1)
    apart = F.when(F.col("nth") > 1, "\n").otherwise("")
    body = {"jsonl": F.concat(json_line(), F.lit("\n")), "md": F.concat(apart, _section()), "manual": F.concat(apart, _step())}
    of = lambda kind: F.concat("video", F.lit(f"/{name[kind]}"))
    written = F.explode(F.array(*[F.struct(of(k).alias("file"), F.lit(1).alias("place"), F.col("nth"), body[k].alias("part")) for k in kinds]))
    out = steps.select(written.alias("p")).select("p.*")
    heads = {"md": F.lit("# 作業ログ\n\n"), "manual": F.concat(F.lit("# "), F.col("video"), F.lit(" 手順書\n\n"))}
    videos, first = entries.filter(F.col("video").isNotNull()).select("video").distinct(), F.lit(0).cast("long")
    for kind in set(kinds) & heads.keys():
        out = out.unionByName(videos.select(of(kind).alias("file"), F.lit(0).alias("place"), first.alias("nth"), heads[kind].alias("part")))
    if "md" in kinds:
        spent = dwell_by_app(entries.filter(F.col("video").isNotNull()), "video")
        row = F.concat(F.lit("| "), F.col("app"), F.lit(" | "), text.duration_ja(F.col("total_us") / SECOND), F.lit(" |\n"))
        rows = F.array_sort(F.collect_list(F.struct((-F.col("total_us")).alias("total"), "first_ord", row.alias("row"))))
        tails = spent.groupBy("video").agg(F.concat(F.lit(APP_TABLE), F.array_join(F.transform(rows, lambda r: r["row"]), "")).alias("part"))
        out = out.unionByName(tails.select(of("md").alias("file"), F.lit(2).alias("place"), first.alias("nth"), "part"))
    return out


def write_recordings(entries: DataFrame, folder: str | Path, kinds: Sequence[str] = ("jsonl", "md")) -> None:
    """The named files of all recordings, written by one job; none of them is seen in part."""
    recording_files.save(parts_of_logs(entries, kinds), str(folder), "place", "nth")


def frame_name(t_us: Column, idx: Column) -> Column:
    """A frame's file name; the index keeps frames of one second apart."""
    return F.concat(F.lit("frames/frame_"), F.translate(text.hms(t_us / SECOND), ":", ""), F.lit("_"), idx.cast("string"), F.lit(".png"))


def check_stems(videos: DataFrame) -> None:
    """ValueError if two paths would share an output folder."""
    stem = F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"\.[^.]*$", "")
    twice = [r["stem"] for r in videos.groupBy(stem.alias("stem")).count().filter("count > 1").orderBy("stem").limit(10).collect()]
    if twice:
        raise ValueError(f"several recordings are named {', '.join(twice)}")


def write_partitioned(entries: DataFrame, path: str) -> None:
    """All recordings' lines, a folder each: <path>/video=<video>/part-*.txt, in order within and between files; a long one has several."""
    lines = entries.select("video", "t_us", "ord", json_line().alias("value"))
    lines.repartitionByRange("video", "t_us", "ord").sortWithinPartitions("video", "t_us", "ord").select("video", "value").write.partitionBy("video").text(path)


def hit_line(rank: Column, score: Column, t: Column, end: Column, source: Column, app: Column, action: Column) -> Column:
    span = F.concat(t, F.coalesce(F.concat(F.lit("〜"), end), F.lit("")))
    return F.concat(rank.cast("string"), F.format_string(". [%.3f] ", score), span, F.lit("  "), source, F.coalesce(F.concat(F.lit("  "), text.truthy(app)), F.lit("")), F.lit("\n   "), action)
