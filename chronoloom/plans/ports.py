"""Queries over sources, sinks and model ports, with stand-in models whose answers SQL can tell."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronoloom import models
from chronoloom.functions import backends, text, vectors
from chronoloom.operators import chunking, folds, stretches
from chronoloom.plans import worklog
from chronoloom.plans.queries import CHUNKS, ENTRIES, HMS, HOURS, SQL, entries, query, spans
from chronoloom.plans.screens import BARE_SQL, GAP, LABEL_SQL, trim_sql
from chronoloom.sinks import index_store, worklogs
from chronoloom.sinks.scratch import shared_folder
from chronoloom.sources import audio, images, media, views
from chronoloom.sources.views import DESCRIPTIONS, SEGMENTS
from chronoloom.sources.worklogs import malformed, parsed_lines, read_worklogs

# --- stored logs --------------------------------------------------------------------------


def logged(spark, sf_dir):
    """Entries as lines of a stored log."""
    none = F.lit(None).cast("string")
    e = entries(spark, sf_dir).withColumns({"resource": F.col("resource").cast("string"), "focus": none, "summary": none, "frame": none})
    e = e.withColumns({"ocr": F.array(F.lit("x")), "speech": F.array(F.concat(F.lit("言う「"), "action", F.lit("」")))})
    return e.select("video", "ord", worklogs.json_line().alias("value"))


@query(f"""{ENTRIES} SELECT video, ord, {HMS.format("t_us // 1000000")} AS t, {HMS.format("end_us // 1000000")} AS t_end, (end_us - t_us)::DOUBLE / 1000000 AS duration_seconds, app AS app_guess, resource::VARCHAR AS resource,
location, NULL::VARCHAR AS focus, 1::BIGINT AS n_ocr, '言う「' || action || '」' AS said, action FROM e""")
def jsonl_round_trip(spark, sf_dir):
    out = parsed_lines(logged(spark, sf_dir))
    return out.select("video", "ord", "t", "t_end", "duration_seconds", "app_guess", "resource", "location", "focus", F.size("ocr").cast("long").alias("n_ocr"), F.get("speech", F.lit(0)).alias("said"), "action")


@query(f"{ENTRIES} SELECT video, ord FROM e WHERE ord % 10 = 3")
def jsonl_malformed(spark, sf_dir):
    lines = logged(spark, sf_dir)
    broken = F.when(F.col("ord") % 10 == 3, F.substring("value", F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    return malformed(lines.withColumn("value", broken)).select("video", "ord")


@query(f"{ENTRIES} SELECT video, count(*) AS n_entries FROM e GROUP BY video")
def entry_counts(spark, sf_dir):
    return entries(spark, sf_dir).groupBy("video").agg(F.count("*").alias("n_entries"))


@query(f"{ENTRIES} SELECT video, ord, row_number() OVER (PARTITION BY video ORDER BY t_us, ord) - 1 AS place FROM e")
def entry_order(spark, sf_dir):
    return stretches.numbered(entries(spark, sf_dir).select("video", "t_us", "ord"), "place").select("video", "ord", "place")


HITS = SQL["cosine_topk"].replace("round(score, 5) AS score", "score")


@query(f"""WITH h AS ({HITS}) SELECT query_id, vec_id, rank::VARCHAR || '. [' || printf('%.3f', score) || '] ' || {HMS.format("vec_id")} || CASE WHEN vec_id % 3 > 0 THEN '〜' || {HMS.format("(vec_id + 9)")} ELSE '' END || '  s' || (vec_id % 5)::VARCHAR
 || CASE WHEN vec_id % 2 = 0 THEN '  Word' ELSE '' END || chr(10) || '   a' || vec_id::VARCHAR AS line FROM h""")
def search_hits(spark, sf_dir):
    e = views.read(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    i = F.col("vec_id")
    end = F.when(i % 3 > 0, text.hms(i + 9))
    line = worklogs.hit_line(F.col("rank"), F.col("score"), text.hms(i), end, F.concat(F.lit("s"), (i % 5).cast("string")), F.when(i % 2 == 0, "Word").otherwise(""), F.concat(F.lit("a"), i.cast("string")))
    return vectors.top_k(e, asked, 5).select("query_id", "vec_id", line.alias("line"))


@query("""SELECT vec_id, round(v[1] / n, 5) AS first, 2::BIGINT AS n_left FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12) AS n FROM embeddings)""")
def index_round_trip(spark, sf_dir):
    """The index saved twice, and loaded; n_left: what lies in its folder (the manifest, one generation)."""
    place, e = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", views.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    for rows in (e.filter("doc_id % 2 = 0"), e):
        index_store.save(index_store.build(rows), place, "m")
    left = len(index_store.names(spark, place))
    found = index_store.load(spark, place, "m")
    return found.select(F.col("doc_id").alias("vec_id"), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"), F.lit(left).cast("long").alias("n_left"))


# --- recordings ---------------------------------------------------------------------------


@query(f"WITH {DESCRIPTIONS} SELECT video, ord, 2::BIGINT AS n, k * 4 + 0.25::DOUBLE AS total FROM d")
def scene_times(spark, sf_dir):
    k = F.col("k").cast("string")
    log = F.concat(F.lit("[showinfo] n:0 pts:7 pts_time:"), k, F.lit(".25 pos:1\n[x] pts_time:"), (F.col("k") * 3).cast("string"), F.lit(" end\npts_time:-"))
    times = media.scene_times(log)
    return views.descriptions(spark, sf_dir).select("video", "ord", F.size(times).cast("long").alias("n"), F.aggregate(times, F.lit(0.0), lambda n, x: n + x).alias("total"))


@query(f"WITH {DESCRIPTIONS} SELECT video, ord, k % 3 = 0 AS has_audio, CASE WHEN k % 4 <> 0 THEN k * 1000000 + 500000 END AS duration_us FROM d")
def media_probe(spark, sf_dir):
    k = F.col("k")
    streams = F.when(k % 3 == 0, "audio\n").when(k % 3 == 1, "")
    said = F.when(k % 4 == 0, "N/A\n").otherwise(F.concat(k.cast("string"), F.lit(".5\n")))
    return views.descriptions(spark, sf_dir).select("video", "ord", media.tells_audio(streams).alias("has_audio"), media.told_duration(F.regexp_replace(said, "\n", "")).alias("duration_us"))


@query("SELECT source AS video, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) * 2000000 AS t_us FROM documents")
def listed_frames(spark, sf_dir):
    path = F.concat(F.lit("/frames/"), "source", F.lit("/frame_"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".png"))
    files = views.read(spark, sf_dir, "documents").select(F.col("source").alias("video"), path.alias("path"), "doc_id")
    return media.listed_frames(files).select("video", "doc_id", "idx", "t_us")


@query("""WITH p AS (SELECT label, vec_id, list_transform(embedding, lambda x: least(greatest(floor((x::DOUBLE + 1) * 127), 0), 255)) AS v FROM embeddings), b AS (SELECT *, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM p)
SELECT label, vec_id, round(list_sum(list_transform(list_zip(v, w), lambda p: abs(p[1] - p[2]))) / (len(v) * 255), 6)::DOUBLE AS diff FROM b WHERE w IS NOT NULL""")
def histogram_diff(spark, sf_dir):
    grey = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 127), F.lit(0)), F.lit(255)).cast("int"))
    v = stretches.beside(views.read(spark, sf_dir, "embeddings").withColumn("v", grey), before=["v"], key="label", order=["vec_id"], width=stretches.STRETCH_IDS).filter("__before IS NOT NULL")
    v = v.withColumn("h", vectors.difference_histogram(F.col("v"), F.col("__before.v")))
    return v.select("label", "vec_id", F.round(vectors.histogram_mean(F.col("h")), 6).alias("diff"))


# --- ports --------------------------------------------------------------------------------


def frames(spark, sf_dir):
    """documents as frames: a source is a video, and the document its own picture, whose text a path leads to."""
    i = F.col("doc_id")
    return views.read(spark, sf_dir, "documents").select(
        F.col("source").alias("video"), i.alias("idx"), i.alias("ord"), (i * 500_000).alias("t_us"), F.concat(i.cast("string"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("path"),
        (i % 3 == 0).alias("is_keyframe"), "text", "lang"
    )


def reader():
    """Reads a picture's lines; every seventh fails, every fifth is late at first."""
    late = set()

    def read(path):
        number, _, text = path.partition("\n")
        n = int(number)
        if n % 7 == 0:
            raise ValueError(path)
        if n % 5 == 0 and path not in late:
            late.add(path)
            raise TimeoutError(path)
        return text.split("\n")

    return read


@query("SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN text END AS lines FROM documents")
def port_recognise(spark, sf_dir):
    out = models.recognise(reader)(frames(spark, sf_dir))
    return out.select(F.col("ord").alias("doc_id"), F.when(F.col("lines").isNotNull(), F.array_join("lines", "\n")).alias("lines"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 7 <> 0 THEN text ELSE '' END AS lines FROM documents")
def keyframes_only(spark, sf_dir):
    out = folds.keyframes_only(frames(spark, sf_dir), models.recognise(reader))
    return out.select(F.col("ord").alias("doc_id"), F.array_join("lines", "\n").alias("lines"))


@query("""WITH f AS (SELECT doc_id, source, lang IS DISTINCT FROM lag(lang) OVER w OR doc_id % 3 = 0 OR row_number() OVER w = 1 AS own FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
s AS (SELECT doc_id, max(CASE WHEN own THEN doc_id END) OVER (PARTITION BY source ORDER BY doc_id) AS s FROM f)
SELECT s.doc_id, CASE WHEN s.s % 7 <> 0 THEN d.text ELSE '' END AS lines FROM s JOIN documents d ON d.doc_id = s.s""")
def memo_recognised(spark, sf_dir):
    """Frames of one language are alike: keyframes and the first one of each run are read."""
    skipped = folds.memo_skip(frames(spark, sf_dir), lambda one, many: [one == x for x in many], "lang")
    return folds.recognised(skipped, models.recognise(reader)).select(F.col("ord").alias("doc_id"), F.array_join("lines", "\n").alias("lines"))


def teller():
    """Tells how long the prompt is; every eleventh frame fails."""

    def tell(path, prompt):
        if int(path.partition("\n")[0]) % 11 == 0:
            raise KeyError(path)
        return f'```json\n{{"app_guess": "App", "focus": "null", "action": "{len(prompt)}"}}\n```'

    return tell


@query(f"""SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN 'App' END AS app_guess, NULL::VARCHAR AS focus,
CASE WHEN doc_id % 11 = 0 THEN '{models.FAILED.replace("{}", "KeyError")}' ELSE (CASE WHEN text = '' THEN length('{models.NO_TEXT}') ELSE length(text) END + 1 + CASE WHEN doc_id % 2 = 0 THEN length('{models.NO_SPEECH}') ELSE 3 END)::VARCHAR END AS action FROM documents""")
def port_describe(spark, sf_dir):
    empty = F.array().cast("array<string>")
    said = F.when(F.col("ord") % 2 == 0, empty).otherwise(F.array(F.lit("a"), F.lit("b")))
    asked = frames(spark, sf_dir).withColumn("prompt", models.prompt("%s|%s", F.split("text", "\n"), said))
    return models.describe(asked, teller).select(F.col("ord").alias("doc_id"), "app_guess", "focus", "action")


@query("SELECT conv_id, turn, length('要約せよ' || chr(10) || chr(10) || text || chr(10) || role)::BIGINT AS n FROM conversations")
def summary_prompt(spark, sf_dir):
    asked = models.summary_prompt("要約せよ", F.array("text", "role"))
    return views.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(asked).cast("long").alias("n"))


def listener():
    """Hears two segments in a stretch, at its beginning and its middle; every fifth chunk fails."""

    def hear(path, start, length):
        if path == "bad":
            raise RuntimeError(path)
        return [{"start_us": 0, "end_us": 10, "text": path}, {"start_us": length // 2, "end_us": length, "text": "b", "no_speech_prob": 0.5, "avg_logprob": -1}]

    return hear


@query(f"""{CHUNKS}, x AS (SELECT *, (video + k) % 5 = 0 AS failed FROM c)
SELECT video::VARCHAR AS video, chunk_start, true AS failed, NULL::BIGINT AS start_us, NULL::BIGINT AS end_us, NULL::VARCHAR AS text, NULL::DOUBLE AS avg_logprob FROM x WHERE failed
UNION ALL SELECT video::VARCHAR, chunk_start, false, media_start, media_start + 10, 'good', NULL FROM x WHERE NOT failed
UNION ALL SELECT video::VARCHAR, chunk_start, false, media_start + media_len // 2, media_start + media_len, 'b', -1.0 FROM x WHERE NOT failed""")
def port_transcribe(spark, sf_dir):
    chunks = spans(spark, sf_dir)[2].withColumn("path", F.when((F.col("video") + F.col("k")) % 5 == 0, "bad").otherwise("good"))
    out = models.transcribe(chunks.withColumn("video", F.col("video").cast("string")), listener)
    return out.select("video", "chunk_start", "failed", "start_us", "end_us", "text", "avg_logprob")


def counter():
    return lambda lines: f" {len(lines)} " if len(lines) != 4 else " "


@query(f"WITH x AS ({SQL['attach_speech']}) SELECT video, ord, CASE WHEN n_lines >= 3 AND n_lines <> 4 THEN n_lines::VARCHAR ELSE 'kept' END AS summary FROM x")
def port_summarise(spark, sf_dir):
    from chronoloom.plans.queries import attach_speech

    rows = attach_speech(spark, sf_dir).withColumn("speech", F.when(F.col("n_lines") > 0, F.split("speech", r"\|")).otherwise(F.array().cast("array<string>")))
    return models.summarise(rows.select("video", "ord", "speech", F.lit("kept").alias("summary")), counter).select("video", "ord", "summary")


def measurer():
    return lambda texts: [[len(t), t.count("e")] for t in texts]


@query(f"SELECT doc_id, length('{models.DOCUMENT_PREFIX}' || text)::DOUBLE AS n, length(text) - length(replace(text, 'e', ''))::DOUBLE AS e FROM documents")
def port_embed(spark, sf_dir):
    out = models.embed(views.read(spark, sf_dir, "documents").select("doc_id", "text"), "text", measurer)
    return out.select("doc_id", F.get("embedding", F.lit(0)).cast("double").alias("n"), (F.get("embedding", F.lit(1)).cast("double")).alias("e"))


@query(f"""WITH {DESCRIPTIONS} SELECT video, ord, CASE WHEN k % 4 = 0 THEN '{backends.DEFAULT_SERVED_MODEL}' WHEN k % 4 = 1 THEN 'org/name:r' || k::VARCHAR WHEN k % 4 = 2 THEN action ELSE '{backends.DEFAULT_SERVED_MODEL}' END AS model,
CASE WHEN k % 3 = 0 THEN greatest(1, least(4, (k % 20) // 2))::INT ELSE 1 END AS workers,
CASE WHEN k % 3 <> 2 THEN (['faster', 'mlx'])[1 + (k % 3)::INT] WHEN k % 2 = 0 AND k % 5 < 3 AND k % 7 > 2 THEN 'cpp' ELSE 'faster' END AS backend FROM d""")
def backend_choice(spark, sf_dir):
    k = F.col("k")
    model = F.when(k % 4 == 0, F.concat(F.lit("m:"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("org/name:r"), k.cast("string"))).when(k % 4 == 2, F.col("action")).otherwise("a:b:c")
    backend = F.when(k % 3 == 0, "faster").when(k % 3 == 1, "mlx").otherwise("auto")
    system, machine = F.when(k % 2 == 0, "Darwin").otherwise("Linux"), F.when(k % 5 < 3, "arm64").otherwise("x86_64")
    return views.descriptions(spark, sf_dir).select(
        "video", "ord", backends.routed_model(model).alias("model"), backends.worker_count(backend, k % 20).alias("workers"), backends.resolved_backend(backend, system, machine, k % 7 > 2).alias("backend")
    )


# --- compositions -------------------------------------------------------------------------


@query(f"""WITH o AS (SELECT doc_id, source, {LABEL_SQL} AS label, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id % 3 = 0),
x AS (SELECT doc_id, unnest(list_concat([label], lines)) AS x FROM o), b AS (SELECT doc_id, {trim_sql("x")} AS t, upper(regexp_replace({trim_sql("x")}, '{GAP}', '', 'g')) AS loud, {BARE_SQL} AS y FROM x)
SELECT doc_id, count(*) FILTER (t <> '') AS line_count, count(DISTINCT y) FILTER (loud NOT IN ('MINOTETAKER', 'AINOTETAKER', 'NOTETAKER', 'YOU', 'あなた', 'ミーティング', '参加者', '全員') AND (
 (regexp_matches(y, '^[A-Z]{{2}}$') AND y NOT IN ('AI', 'HD', 'CC', 'ON', 'PC', 'TV', 'OK', 'NG')) OR (regexp_matches(y, '^[一-鿿]{{1,4}}(?:・|{GAP})?[一-鿿]{{1,4}}$') AND length(regexp_replace(y, '(?:・|{GAP})', '', 'g')) BETWEEN 2 AND 5))) AS n_names FROM b GROUP BY 1""")
def speaker_observations(spark, sf_dir):
    from chronoloom.plans.screens import shown_label

    f = frames(spark, sf_dir)
    lines = F.concat(F.array(shown_label(F.col("idx"), F.split_part(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(" "), F.lit(1)))), F.split("text", "\n"))
    out = worklog.observations(f.select("video", "idx", "is_keyframe"), f.select("video", "ord", "t_us", lines.alias("lines")))
    return out.select(F.col("ord").alias("doc_id"), F.col("line_count").cast("long").alias("line_count"), F.size("names").cast("long").alias("n_names"))


NEAR_US = 2 * HOURS
MERGED = f"""WITH {DESCRIPTIONS}, v AS (SELECT * FROM d WHERE action = 'view'), lagged AS (
  SELECT *, lag(resource) OVER w AS lr, lag(location) OVER w AS ll, row_number() OVER w AS nth FROM v WINDOW w AS (PARTITION BY video ORDER BY t_us, ord)
), c AS (SELECT * FROM lagged WHERE nth = 1 OR NOT (resource IS NOT DISTINCT FROM lr AND location IS NOT DISTINCT FROM ll)), m AS (SELECT video, max(t_us) AS te FROM d WHERE action = 'error' GROUP BY video),
e AS (SELECT c.*, lead(c.t_us) OVER (PARTITION BY c.video ORDER BY c.t_us, c.ord) AS nxt, row_number() OVER (PARTITION BY c.video ORDER BY c.t_us, c.ord) AS n2 FROM c),
o AS (SELECT e.video, e.ord, arg_min('l' || b.k::VARCHAR, (abs(e.t_us - b.t_us), b.t_us, b.ord)) AS ocr FROM e JOIN d b ON b.video = e.video AND b.action = 'error' AND abs(e.t_us - b.t_us) <= {NEAR_US} GROUP BY 1, 2),
p AS (SELECT e.video, e.ord, s.t_us, s.ord AS so, CASE WHEN s.k % 3 = 0 THEN 'S: ' ELSE '' END || 'k' || (s.k % 2)::VARCHAR AS line FROM e JOIN d s ON s.video = e.video AND s.action = 'click' AND (s.t_us >= e.t_us OR e.n2 = 1) AND (e.nxt IS NULL OR s.t_us < e.nxt)),
q AS (SELECT *, lag(line) OVER (PARTITION BY video, ord ORDER BY t_us, so) AS before FROM p),
x AS (SELECT video, ord, string_agg(line, '|' ORDER BY t_us, so) AS speech FROM q WHERE line IS DISTINCT FROM before GROUP BY 1, 2)
SELECT e.video, e.ord, coalesce(nxt, CASE WHEN te IS NOT NULL THEN greatest(e.t_us, te) END) AS end_us, coalesce(o.ocr, '') AS ocr, coalesce(x.speech, '') AS speech
FROM e LEFT JOIN m ON m.video = e.video LEFT JOIN o ON o.video = e.video AND o.ord = e.ord LEFT JOIN x ON x.video = e.video AND x.ord = e.ord"""


@query(MERGED)
def merge_timeline(spark, sf_dir):
    d = views.descriptions(spark, sf_dir)
    ocr = d.filter("action = 'error'").select("video", "ord", "t_us", F.array(F.concat(F.lit(" l"), F.col("k").cast("string")), F.lit(" ")).alias("lines"))
    said = d.filter("action = 'click'").select("video", "ord", F.col("t_us").alias("start_us"), F.when(F.col("k") % 3 == 0, "S").alias("speaker"), F.concat(F.lit("k"), (F.col("k") % 2).cast("string")).alias("text"))
    out = worklog.merged(d.filter("action = 'view'").drop("k", "is_keyframe"), ocr, said, NEAR_US)
    return out.select("video", "ord", "end_us", F.array_join("ocr", "|").alias("ocr"), F.array_join("speech", "|").alias("speech"))


def screen_reader():
    """A picture shows a title or a place, by turns a name, and its text's digest."""
    import hashlib

    def read(path):
        number, _, text = path.partition("\n")
        return [*(["report.xlsx - Excel", "QX"] if int(number) % 2 else ["3 / 7 ページ"]), hashlib.md5(text.encode()).hexdigest()]

    return read


@query(f"""WITH {SEGMENTS}, k AS (SELECT source AS video, doc_id, doc_id * 500000 AS t_us, doc_id % 2 = 1 AS odd, md5(text) AS h, row_number() OVER w AS nth, lead(doc_id * 500000) OVER w AS nxt FROM documents WHERE doc_id % 3 = 0 WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
z AS (SELECT source AS video, max(doc_id) * 500000 AS te FROM documents GROUP BY 1),
r AS (SELECT 'src' || (video % 20)::VARCHAR AS video, video * 100 + ord AS so, (video * 8 + ord) * 500000 + 250000 AS began, text, speaker FROM s
 WHERE CASE WHEN no_speech_prob IS NOT NULL AND avg_logprob IS NOT NULL THEN NOT (no_speech_prob > 0.6 AND avg_logprob < -1.0) WHEN avg_logprob IS NOT NULL THEN avg_logprob >= -1.0 ELSE true END),
a AS (SELECT r.*, (SELECT arg_min(odd, t_us) FROM k WHERE k.video = r.video AND k.t_us > r.began AND k.t_us <= r.began + 3000000) AS ahead, (SELECT arg_max(odd, t_us) FROM k WHERE k.video = r.video AND k.t_us <= r.began) AS back FROM r),
n AS (SELECT video, so, began, CASE WHEN coalesce(ahead, back) THEN 'QX: ' || text WHEN speaker IS NOT NULL THEN speaker || ': ' || text ELSE text END AS line FROM a),
p AS (SELECT k.video, k.doc_id, n.began, n.so, line FROM n JOIN k ON k.video = n.video AND (n.began >= k.t_us OR k.nth = 1) AND (k.nxt IS NULL OR n.began < k.nxt)),
q AS (SELECT *, lag(line) OVER (PARTITION BY video, doc_id ORDER BY began, so) AS before FROM p),
x AS (SELECT video, doc_id, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY began, so)) AS said FROM q WHERE line IS DISTINCT FROM before GROUP BY 1, 2)
SELECT k.video, k.doc_id, CASE WHEN odd THEN 'Excel' ELSE 'App' END AS app, CASE WHEN odd THEN 'report.xlsx' END AS resource, CASE WHEN NOT odd THEN '3 / 7 ページ' END AS location, 'seen ' || k.doc_id::VARCHAR AS action,
coalesce(nxt, greatest(t_us, te)) AS end_us, CASE WHEN odd THEN 'report.xlsx - Excel|QX|' ELSE '3 / 7 ページ|' END || h AS ocr, coalesce(n, 0) AS n_said, coalesce(said, md5('')) AS said, CASE WHEN n >= 3 AND n <> 4 THEN n::VARCHAR END AS summary
FROM k JOIN z USING (video) LEFT JOIN x USING (video, doc_id)""")
def generated_worklog(spark, sf_dir):
    """The whole run, from frames and speech to entries, with stand-in models: speech is filtered, attributed and summarised, and every keyframe is described."""

    def describer():
        return lambda path, prompt: '{"app_guess": "App", "action": "seen ' + path.partition("\n")[0] + '"}'

    heard, conv, turn = views.segments(spark, sf_dir), F.col("video"), F.col("ord")
    at = (conv * 8 + turn) * 500_000 + 250_000
    said = heard.select(
        F.concat(F.lit("src"), (conv % 20).cast("string")).alias("video"), (conv * 100 + turn).alias("ord"), at.alias("start_us"), at.alias("end_us"), "text", "no_speech_prob", "avg_logprob", "speaker"
    )
    out = worklog.generate(frames(spark, sf_dir).drop("text", "ord", "lang"), said, screen_reader, describer, summarise=counter, attribute=True)
    return out.select(
        "video", F.col("ord").alias("doc_id"), "app", "resource", "location", "action", "end_us", F.array_join("ocr", "|").alias("ocr"),
        F.size("speech").cast("long").alias("n_said"), F.md5(F.array_join("speech", "\n").cast("binary")).alias("said"), "summary",
    )


# --- files and formats --------------------------------------------------------------------


@query(f"{ENTRIES} SELECT video::VARCHAR AS video, row_number() OVER (PARTITION BY video ORDER BY t_us, ord) AS line, {HMS.format('t_us // 1000000')} AS t, (end_us - t_us)::DOUBLE / 1000000 AS duration_seconds, action FROM e")
def recordings_round_trip(spark, sf_dir):
    """The logs of all recordings written as named files by one job, and read back line by line."""
    none, place = F.lit(None).cast("string"), f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    e = entries(spark, sf_dir).withColumns({"video": F.col("video").cast("string"), "resource": F.col("resource").cast("string"), "focus": none, "summary": none, "frame": none})
    worklogs.write_recordings(e.withColumns({"ocr": F.array(F.lit("x")), "speech": F.array(F.col("action"))}), place, ["jsonl", "md"])
    read = read_worklogs(spark, f"{place}/*/worklog.jsonl")
    return read.select(F.element_at(F.split("file", "/"), -2).alias("video"), "line", "t", "duration_seconds", "action")


BYTES = "documents_bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents)"


def _pictures(batches):
    """Texts as PNG images of 64 samples a row, with all filters, and what the decoder reads of them."""
    for batch in batches:
        rows = []
        for text in batch["text"]:
            raw = text.encode()
            plain = np.frombuffer(raw.ljust(max(1, -(-len(raw) // 64)) * 64), np.uint8).reshape(-1, 64)
            grey = images.grey_png(images.png(plain, (np.arange(len(plain)) + len(raw)) % 5)).astype(np.int64)
            rows.append((grey.shape[0], int(grey.sum()), int((grey.ravel() * np.arange(1, grey.size + 1)).sum())))
        yield batch[["doc_id"]].assign(**{name: [r[i] for r in rows] for i, name in enumerate(("height", "total", "weighed"))})


@query(f"""WITH {BYTES}, p AS (SELECT doc_id, greatest(1, (len(b) + 63) // 64) AS height, list_concat(b, list_transform(range(greatest(1, (len(b) + 63) // 64) * 64 - len(b)), lambda x: 32::BIGINT)) AS b FROM documents_bytes)
SELECT doc_id, height, list_sum(b)::BIGINT AS total, list_sum(list_transform(b, lambda x, i: x * i))::BIGINT AS weighed FROM p""")
def png_samples(spark, sf_dir):
    docs = views.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInPandas(_pictures, "doc_id long, height long, total long, weighed long")


SPAN_US = 1_000_000


@query(f"""WITH {BYTES}, p AS (SELECT doc_id, CASE WHEN len(b) % 2 = 1 THEN list_append(b, 32) ELSE b END AS b FROM documents_bytes),
s AS (SELECT doc_id, unnest(range(len(b) // 2)) AS i, b FROM p), v AS (SELECT doc_id, i, b[2 * i + 1] + 256 * CASE WHEN b[2 * i + 2] > 127 THEN b[2 * i + 2] - 256 ELSE b[2 * i + 2] END AS x FROM s)
SELECT doc_id, i // 16000 AS k, count(*) AS n, sum(x)::BIGINT AS total, 16000 AS rate FROM v GROUP BY 1, 2""")
def sound_spans(spark, sf_dir):
    """Texts as sound, two bytes a sample, cut into seconds."""

    def recorded(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # a few files at once
                part = batch.slice(at, 256)
                raw = [x.as_py() for x in part.column(1)]
                files = [audio.wav(np.frombuffer(x.ljust(len(x) + len(x) % 2), "<i2")) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary())], ["video", "file"])

    def summed(batches):
        for batch in batches:
            read = (np.frombuffer(x.as_py(), "<i2") for x in batch.column(3))
            sums = [(len(x), int(x.sum(dtype=np.int64))) for x in read]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1)), batch.column(2)], ["doc_id", "k", "n", "total", "rate"])

    docs = views.read(spark, sf_dir, "documents").filter(F.length("text") > 0).select(F.col("doc_id").alias("video"), "text")
    size = F.octet_length("text")
    spans_ = chunking.chunk_spans(docs.select("video", F.ceil((size + size % 2) / 2 * 62.5).alias("duration_us")), SPAN_US, 0)
    files = docs.select("video", F.col("text").cast("binary")).mapInArrow(recorded, f"video {docs.schema['video'].dataType.simpleString()}, file binary")
    cut = audio.with_sound(spans_.join(files, "video"), "file").select(F.col("video").alias("doc_id"), "k", "rate", "samples")
    return cut.mapInArrow(summed, f"doc_id {docs.schema['video'].dataType.simpleString()}, k long, n long, total long, rate int")
