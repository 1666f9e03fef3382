"""Every query by name: the Spark plan and, beside it, DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import text, vectors
from chronoloom.operators import chunking, folds, labels, runs, segments, stretches, temporal
from chronoloom.sources import views
from chronoloom.sources.views import DESCRIPTIONS, OBSERVED, SEGMENTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- runs ---------------------------------------------------------------------------

ENTRIES = f"""WITH {DESCRIPTIONS}, lagged AS (
  SELECT *, lag(action) OVER w AS la, lag(resource) OVER w AS lr, lag(location) OVER w AS ll, row_number() OVER w AS nth FROM d WINDOW w AS (PARTITION BY video ORDER BY t_us, ord)
), c AS (
  SELECT * FROM lagged WHERE nth = 1 OR NOT (action IS NOT DISTINCT FROM la AND resource IS NOT DISTINCT FROM lr AND location IS NOT DISTINCT FROM ll)
), e AS (
  SELECT c.*, coalesce(lead(t_us) OVER (PARTITION BY c.video ORDER BY t_us, ord), greatest(t_us, te)) AS end_us FROM c JOIN (SELECT video, max(t_us) AS te FROM d GROUP BY video) m ON c.video = m.video
)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.descriptions(spark, sf_dir)
    return runs.with_ends(runs.collapse_runs(d), runs.timeline_ends(d))


@query(f"""{ENTRIES} SELECT coalesce(nullif(app, ''), '（不明）') AS app, sum(end_us - t_us)::BIGINT AS total_us, count(*) AS n_entries, min(ord) AS first_ord
FROM e WHERE end_us - t_us > 0 GROUP BY 1""")
def dwell_by_app(spark, sf_dir):
    return runs.dwell_by_app(entries(spark, sf_dir)).orderBy(F.desc("total_us"), "first_ord")


@query(f"{ENTRIES} SELECT video, ord, t_us, action, resource, location FROM c")
def collapse_runs(spark, sf_dir):
    return runs.collapse_runs(views.descriptions(spark, sf_dir)).select("video", "ord", "t_us", "action", "resource", "location")


@query(f"{ENTRIES} SELECT video, ord, t_us, end_us, end_us - t_us AS duration_us FROM e")
def entry_windows(spark, sf_dir):
    return entries(spark, sf_dir).select("video", "ord", "t_us", "end_us", "duration_us")


# --- temporal joins -----------------------------------------------------------------

HOURS = 3_600_000_000


@query(f"""WITH {DESCRIPTIONS}, p AS (
  SELECT a.video, a.ord, b.ord AS near_ord, b.k AS near_k, row_number() OVER (PARTITION BY a.video, a.ord ORDER BY abs(a.t_us - b.t_us), b.t_us, b.ord) AS nth
  FROM d a LEFT JOIN d b ON a.video = b.video AND b.action = 'error' AND abs(a.t_us - b.t_us) <= {6 * HOURS} WHERE a.action = 'view'
) SELECT video, ord, near_ord, near_k FROM p WHERE nth = 1""")
def nearest_ocr(spark, sf_dir):
    d = views.descriptions(spark, sf_dir)
    out = temporal.nearest_within(d.filter("action = 'view'"), d.filter("action = 'error'"), 6 * HOURS, ["ord", "k"])
    return out.select("video", "ord", "near_ord", "near_k")


@query(f"""WITH {DESCRIPTIONS}, w AS (
  SELECT video, ord, t_us, lead(t_us) OVER (PARTITION BY video ORDER BY t_us, ord) AS nxt, row_number() OVER (PARTITION BY video ORDER BY t_us, ord) AS nth FROM d WHERE action = 'view'
), p AS (
  SELECT w.video, w.ord, s.t_us, s.ord AS so, 'k' || (s.k % 2)::VARCHAR AS line FROM w JOIN d s ON s.video = w.video AND s.action = 'click'
   AND (s.t_us >= w.t_us OR w.nth = 1) AND (w.nxt IS NULL OR s.t_us < w.nxt)
), q AS (
  SELECT *, lag(line) OVER (PARTITION BY video, ord ORDER BY t_us, so) AS before FROM p
) SELECT w.video, w.ord, count(q.so) AS n_lines, coalesce(string_agg(q.line, '|' ORDER BY q.t_us, q.so), '') AS speech
FROM w LEFT JOIN q ON q.video = w.video AND q.ord = w.ord AND q.line IS DISTINCT FROM q.before GROUP BY 1, 2""")
def attach_speech(spark, sf_dir):
    d = views.descriptions(spark, sf_dir)
    said = d.filter("action = 'click'").withColumn("start_us", F.col("t_us"))
    out = temporal.attach_speech(d.filter("action = 'view'").select("video", "ord", "t_us"), said, F.concat(F.lit("k"), (F.col("k") % 2).cast("string")))
    return out.select("video", "ord", F.size("speech").cast("long").alias("n_lines"), F.array_join("speech", "|").alias("speech"))


@query(f"""WITH {DESCRIPTIONS} SELECT a.video, a.ord, coalesce(string_agg(b.ord::VARCHAR, ',' ORDER BY b.t_us, b.ord), '') AS texts
FROM d a LEFT JOIN d b ON a.video = b.video AND b.action = 'click' AND b.t_us <= a.t_us + {3 * HOURS} AND b.t_us + b.k * 60000000 >= a.t_us - {3 * HOURS}
WHERE a.action = 'view' GROUP BY 1, 2""")
def speech_near(spark, sf_dir):
    d = views.descriptions(spark, sf_dir)
    said = d.filter("action = 'click'").withColumns({"start_us": F.col("t_us"), "end_us": F.col("t_us") + F.col("k") * 60_000_000})
    out = temporal.overlapping(d.filter("action = 'view'").select("video", "ord", "t_us"), said, 3 * HOURS, F.col("ord").cast("string"))
    return out.select("video", "ord", F.array_join("texts", ",").alias("texts"))


SPEAKERS = f"""WITH {DESCRIPTIONS}, ob AS (
  SELECT video, t_us, ord, k % 3 AS n_names, k % 12 AS line_count, 'n' || (k % 5)::VARCHAR AS name FROM d WHERE action = 'view'
), f AS (
  SELECT s.video, s.ord, s.k, (SELECT arg_min(struct_pack(a := n_names, b := line_count, c := name), (o.t_us, o.ord)) FROM ob o WHERE o.video = s.video AND o.t_us > s.t_us AND o.t_us <= s.t_us + {2 * HOURS}) AS ahead,
         (SELECT arg_max(struct_pack(a := n_names, b := line_count, c := name), (o.t_us, o.ord)) FROM ob o WHERE o.video = s.video AND o.t_us <= s.t_us) AS back
  FROM d s WHERE s.action = 'click'
), z AS (
  SELECT video, ord, k, CASE WHEN coalesce(ahead, back).b <= 8 AND coalesce(ahead, back).a = 1 THEN coalesce(ahead, back).c END AS speaker FROM f
)"""


def speakers(spark, sf_dir):
    d = views.descriptions(spark, sf_dir)
    name, n = F.concat(F.lit("n"), (F.col("k") % 5).cast("string")), F.col("k") % 3
    names = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(name)).otherwise(F.array(name, F.lit("other")))
    seen = d.filter("action = 'view'").select("video", "t_us", "ord", names.alias("names"), (F.col("k") % 12).alias("line_count"))
    return temporal.attributed(d.filter("action = 'click'").select("video", "ord", "k", F.col("t_us").alias("start_us")), seen, 2 * HOURS)


@query(f"{SPEAKERS} SELECT video, ord, speaker FROM z")
def speaker_asof(spark, sf_dir):
    return speakers(spark, sf_dir).select("video", "ord", "speaker")


#: Who really spoke, as a record tells: a name with its reading, every now and then another one.
LABELS = f"""l AS (SELECT video, t_us, ord, CASE WHEN k % 4 = 0 THEN ' n' || (k % 5)::VARCHAR || '（よみ）' WHEN k % 4 = 1 THEN 'n' || ((k + 1) % 5)::VARCHAR ELSE 'x' || (k % 5)::VARCHAR END AS name FROM d WHERE action = 'purchase' OR k % 6 = 0)"""


def official(spark, sf_dir):
    k = F.col("k")
    name = lambda head, n, tail="": F.concat(F.lit(head), (n % 5).cast("string"), F.lit(tail))
    names = F.when(k % 4 == 0, name(" n", k, "（よみ）")).when(k % 4 == 1, name("n", k + 1)).otherwise(name("x", k))
    return views.descriptions(spark, sf_dir).filter("action = 'purchase' OR k % 6 = 0").select("video", "t_us", "ord", names.alias("name"))


MATCHED = f"""{SPEAKERS}, {LABELS}, m AS (
  SELECT z.video, z.ord, z.speaker, (SELECT arg_max(name, (l.t_us, l.ord)) FROM l WHERE l.video = z.video AND l.t_us <= s.t_us + 2000000) AS label FROM z JOIN d s ON s.video = z.video AND s.ord = z.ord
), b AS (SELECT *, split_part(regexp_replace(label, '\\s+', '', 'g'), '（', 1) AS bare FROM m),
w AS (SELECT *, speaker IS NOT NULL AND label IS NOT NULL AS aligned, contains(speaker, bare) OR contains(bare, speaker) OR left(speaker, 2) = left(bare, 2) AS same FROM b)"""


@query(f"{MATCHED} SELECT video, ord, speaker, label FROM w")
def label_alignment(spark, sf_dir):
    said = speakers(spark, sf_dir)
    return labels.labelled(said, official(spark, sf_dir)).select("video", "ord", "speaker", "label")


@query(f"""{MATCHED} SELECT video, count(*) AS n, count(speaker) AS n_named, count_if(aligned)::BIGINT AS n_aligned, count_if(aligned AND same)::BIGINT AS n_matched,
round(CASE WHEN count_if(aligned) > 0 THEN count_if(aligned AND same)::DOUBLE / count_if(aligned) ELSE 0 END, 6)::DOUBLE AS precision FROM w GROUP BY video""")
def attribution_precision(spark, sf_dir):
    out = labels.precision(labels.labelled(speakers(spark, sf_dir), official(spark, sf_dir)), "video")
    return out.withColumn("precision", F.round("precision", 6))


@query(f"""WITH {DESCRIPTIONS}, r AS (SELECT app, k::DOUBLE / nullif(k % 10, 0) AS ratio FROM d) SELECT coalesce(nullif(app, ''), '（不明）') AS app, round(median(ratio), 6) AS median_ratio, count(ratio) AS n FROM r GROUP BY 1""")
def median_ratio(spark, sf_dir):
    d = views.descriptions(spark, sf_dir).withColumn("ratio", F.when(F.col("k") % 10 != 0, F.col("k") / (F.col("k") % 10)))
    app = F.coalesce(text.truthy(F.col("app")), F.lit(text.UNKNOWN_APP)).alias("app")
    return d.groupBy(app).agg(F.round(F.median("ratio"), 6).alias("median_ratio"), F.count("ratio").alias("n"))


HMS = "printf('%02d:%02d:%02d', ({0}) // 3600, ({0}) // 60 % 60, ({0}) % 60)"


@query(f"""WITH {OBSERVED} SELECT e.video, e.ord, CASE WHEN f.ord IS NOT NULL THEN 'frames/frame_' || replace({HMS.format("e.t_us // 1000000")}, ':', '') || '_' || e.ord::VARCHAR || '.png' END AS frame_image
FROM o e LEFT JOIN (SELECT * FROM o WHERE ord % 2 = 0) f ON e.video = f.video AND e.ord = f.ord WHERE e.is_keyframe""")
def frame_join(spark, sf_dir):
    o = views.observed(spark, sf_dir).select("video", "ord", "t_us", "is_keyframe")
    frames = o.filter("ord % 2 = 0").select("video", "ord", F.lit(True).alias("found"))
    name = F.concat(F.lit("frames/frame_"), F.translate(text.hms(F.col("t_us") / 1e6), ":", ""), F.lit("_"), F.col("ord").cast("string"), F.lit(".png"))
    return o.filter("is_keyframe").join(frames, ["video", "ord"], "left").select("video", "ord", F.when(F.col("found"), name).alias("frame_image"))


@query("""WITH f AS (SELECT source AS video, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents), n AS (SELECT video, max(idx) AS most FROM f GROUP BY video),
sc AS (SELECT source AS video, (doc_id * 700001) % ((most + 1) * 2000000) AS scene_us FROM documents JOIN n ON n.video = source WHERE doc_id % 7 = 0),
h AS (SELECT DISTINCT sc.video, (SELECT arg_min(idx, (abs(f.idx * 2000000 - scene_us), f.idx)) FROM f WHERE f.video = sc.video) AS idx FROM sc)
SELECT f.video, f.idx, f.idx = 0 OR h.idx IS NOT NULL AS is_keyframe FROM f LEFT JOIN h ON f.video = h.video AND f.idx = h.idx""")
def keyframe_mark(spark, sf_dir):
    docs = views.read(spark, sf_dir, "documents").select(F.col("source").alias("video"), "doc_id")
    frames = stretches.numbered(docs, "idx", order=["doc_id"], width=stretches.STRETCH_IDS).select("video", "idx")
    most = frames.groupBy("video").agg(F.max("idx").alias("most"))
    scenes = docs.filter("doc_id % 7 = 0").join(most, "video").select("video", ((F.col("doc_id") * 700_001) % ((F.col("most") + 1) * 2_000_000)).alias("scene_us"))
    return temporal.nearest_keyframes(frames, scenes, 2_000_000)


# --- folds --------------------------------------------------------------------------

MEMO_AT = 0.13


@query(f"""WITH RECURSIVE k AS (
  SELECT label AS video, vec_id AS ord, vec_id % 11 = 0 AS is_keyframe, embedding AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS nth FROM embeddings
), g AS (
  SELECT video, ord, nth, ord AS source_ord, v AS lv FROM k WHERE nth = 1
  UNION ALL
  SELECT video, ord, nth, CASE WHEN own THEN ord ELSE source_ord END, CASE WHEN own THEN v ELSE lv END FROM (
    SELECT k.video, k.ord, k.nth, k.v, g.source_ord, g.lv, k.is_keyframe OR list_sum(list_transform(list_zip(k.v, g.lv), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) / len(k.v) >= {MEMO_AT} AS own
    FROM g JOIN k ON k.video = g.video AND k.nth = g.nth + 1)
) SELECT video, ord, source_ord FROM g""")
def memo_skip(spark, sf_dir):
    v = views.read(spark, sf_dir, "embeddings").select(F.col("label").alias("video"), F.col("vec_id").alias("t_us"), F.col("vec_id").alias("ord"), (F.col("vec_id") % 11 == 0).alias("is_keyframe"), "embedding")
    return folds.memo_skip(v, folds.nearby(MEMO_AT), "embedding").select("video", "ord", "source_ord")


@query("""WITH p AS (SELECT label, vec_id, embedding AS v, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT label, vec_id, round(list_sum(list_transform(list_zip(v, b), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) / len(v), 5) AS diff FROM p WHERE b IS NOT NULL""")
def mean_abs_diff(spark, sf_dir):
    v = stretches.beside(views.read(spark, sf_dir, "embeddings"), before=["embedding"], key="label", order=["vec_id"], width=stretches.STRETCH_IDS).filter("__before IS NOT NULL")
    return v.select("label", "vec_id", F.round(vectors.mean_abs_diff(F.col("embedding"), F.col("__before.embedding")), 5).alias("diff"))


# --- chunks -------------------------------------------------------------------------

CHUNK, HALO = 86_400_000_000, 3_600_000_000
CHUNKS = f"""WITH {DESCRIPTIONS}, n AS (SELECT video, max(t_us) - min(t_us) AS duration_us, min(t_us) AS t0 FROM d GROUP BY video), c AS (
  SELECT video, t0, k, k * {CHUNK} AS chunk_start, least((k + 1) * {CHUNK}, duration_us) AS chunk_end, greatest(k * {CHUNK} - {HALO}, 0) AS media_start,
         least(least((k + 1) * {CHUNK}, duration_us) + {HALO}, duration_us) - greatest(k * {CHUNK} - {HALO}, 0) AS media_len
  FROM n, unnest(range(greatest((duration_us + {CHUNK} - 1) // {CHUNK}, 1))) AS u(k))"""


def spans(spark, sf_dir):
    d = views.descriptions(spark, sf_dir)
    n = d.groupBy("video").agg((F.max("t_us") - F.min("t_us")).alias("duration_us"), F.min("t_us").alias("t0"))
    return d, n, chunking.chunk_spans(n, CHUNK, HALO)


@query(f"{CHUNKS} SELECT video, k, chunk_start, chunk_end, media_start, media_len FROM c")
def chunk_spans(spark, sf_dir):
    return spans(spark, sf_dir)[2]


@query(f"WITH {DESCRIPTIONS}, n AS (SELECT video, max(t_us) - min(t_us) AS du, min(t_us) AS t0 FROM d GROUP BY video) SELECT video, ord, t_us - t0 AS start_us FROM d JOIN n USING (video) WHERE t_us - t0 < du")
def chunk_ownership(spark, sf_dir):
    d, n, c = spans(spark, sf_dir)
    rows = d.join(n, "video").select("video", "ord", (F.col("t_us") - F.col("t0")).alias("at"), "duration_us")
    # each chunk reads its halo: a row is read by the chunk that owns it and by neighbours within the overlap
    k = F.floor(F.col("at") / CHUNK)
    read = rows.withColumn("k", F.explode(F.array_distinct(F.array(F.floor((F.col("at") - HALO) / CHUNK), k, F.floor((F.col("at") + HALO) / CHUNK)))))
    heard = read.join(c, ["video", "k"]).withColumn("start_us", F.col("at") - F.col("media_start")).withColumn("start_us", F.col("start_us") + F.col("media_start"))
    return chunking.owned(heard).select("video", "ord", "start_us")


@query(f"""{CHUNKS} SELECT video, count(*) AS n_chunks, count_if((video + k) % 5 = 0)::BIGINT AS n_failed,
coalesce(string_agg(CASE WHEN (video + k) % 5 = 0 THEN chunk_start::VARCHAR || '-' || chunk_end::VARCHAR END, ',' ORDER BY chunk_start), '') AS lost, bool_and((video + k) % 5 = 0) AS all_failed FROM c GROUP BY video""")
def failed_chunks(spark, sf_dir):
    return chunking.failed_chunks(spans(spark, sf_dir)[2].withColumn("failed", (F.col("video") + F.col("k")) % 5 == 0))


# --- segments -----------------------------------------------------------------------


@query(f"WITH {SEGMENTS} SELECT video, ord, greatest(start_us, 0) AS start_us, greatest(end_us, greatest(start_us, 0)) AS end_us, length(trim(text, chr(32) || chr(10) || chr(9) || chr(13)))::BIGINT AS n FROM s WHERE trim(text, chr(32) || chr(10) || chr(9) || chr(13)) <> ''")
def segment_normalize(spark, sf_dir):
    return segments.normalized(views.segments(spark, sf_dir)).select("video", "ord", "start_us", "end_us", F.length("text").cast("long").alias("n"))


FILLER_SQL = "regexp_matches(regexp_replace({0}, '[、。，．,.!！?？\\s　]+', '', 'g'), '^(?:えーと|えっと|あのー|あの|うーん|ふーん|なるほど|はい|うん|ええ|えー|あー|おー|ほう|まあ)+$')"
VERBAL_SQL = "regexp_matches({0}, '[\\p{{L}}\\p{{N}}]')"
#: Turns as a recogniser would hear them: every seventh is nothing but fillers, every eleventh only signs.
HEARD = "CASE WHEN (video + ord) % 7 = 0 THEN 'はい、' || repeat('うん', ((video + ord) % 3)::INT) || '。' WHEN (video + ord) % 11 = 0 THEN regexp_replace(text, '[\\p{L}\\p{N}]+', '', 'g') ELSE text END"


def heard(spark, sf_dir):
    at = F.col("video") + F.col("ord")
    fillers = F.concat(F.lit("はい、"), F.repeat(F.lit("うん"), (at % 3).cast("int")), F.lit("。"))
    said = F.when(at % 7 == 0, fillers).when(at % 11 == 0, F.regexp_replace("text", r"[\p{L}\p{N}]+", "")).otherwise(F.col("text"))
    return views.segments(spark, sf_dir).withColumn("text", said)


@query(f"""WITH {SEGMENTS}, u AS (SELECT * REPLACE ({HEARD} AS text) FROM s) SELECT video, ord FROM u WHERE {VERBAL_SQL.format("text")} AND NOT {FILLER_SQL.format("text")} AND CASE
  WHEN no_speech_prob IS NOT NULL AND avg_logprob IS NOT NULL THEN NOT (no_speech_prob > 0.6 AND avg_logprob < -1.0) WHEN avg_logprob IS NOT NULL THEN avg_logprob >= -1.0 ELSE true END""")
def segment_filter(spark, sf_dir):
    return segments.reliable(heard(spark, sf_dir)).select("video", "ord")


@query(f"WITH {SEGMENTS}, u AS (SELECT * REPLACE ({HEARD} AS text) FROM s) SELECT video, ord, {VERBAL_SQL.format('text')} AS verbal FROM u")
def verbal_filter(spark, sf_dir):
    return heard(spark, sf_dir).select("video", "ord", text.has_verbal_content(F.col("text")).alias("verbal"))


@query(f"WITH {SEGMENTS}, u AS (SELECT * REPLACE ({HEARD} AS text) FROM s) SELECT video, ord, {FILLER_SQL.format('text')} AS filler FROM u")
def filler_filter(spark, sf_dir):
    return heard(spark, sf_dir).select("video", "ord", text.is_filler_only(text.nfkc(F.col("text"))).alias("filler"))


@query(f"WITH {SEGMENTS} SELECT video, ord, CASE WHEN length(speaker) > 0 THEN speaker || ': ' || text ELSE text END AS line FROM s")
def speech_lines(spark, sf_dir):
    return views.segments(spark, sf_dir).select("video", "ord", text.speech_line(F.col("speaker"), F.col("text")).alias("line"))


@query(f"WITH {OBSERVED} SELECT ord, len(k)::BIGINT AS n_lines, array_to_string(k, '|') AS lines FROM (SELECT ord, list_filter(lines, lambda x, i: i = 1 OR x <> lines[i - 1]) AS k FROM o)")
def dedupe_adjacent(spark, sf_dir):
    out = views.observed(spark, sf_dir).select("ord", text.without_adjacent_repeats(F.col("lines")).alias("lines"))
    return out.select("ord", F.size("lines").cast("long").alias("n_lines"), F.array_join("lines", "|").alias("lines"))


PY_TRIM = "regexp_replace({0}, '^[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g')"


@query(f"WITH {OBSERVED} SELECT ord, array_to_string(list_filter(list_transform(lines, lambda x: {PY_TRIM.format('x')}), lambda x: x <> ''), '|') AS lines FROM o")
def normalized_lines(spark, sf_dir):
    return views.observed(spark, sf_dir).select("ord", F.array_join(text.normalized_lines(F.col("lines")), "|").alias("lines"))


TOKEN_SQL = (
    "list_sort(list_distinct(list_filter(flatten(list_transform(list_filter(list_transform(lines, lambda x: "
    + PY_TRIM.format("x")
    + "), lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^[0-9:./\\- ]*$')), lambda x: regexp_split_to_array(x, '[\\s\\x1c-\\x1f\\x{85}\\p{Z}]+'))), lambda w: w <> '')))"
)


@query(f"WITH {OBSERVED} SELECT ord, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT ord, {TOKEN_SQL} AS t FROM o)")
def ocr_tokens(spark, sf_dir):
    out = views.observed(spark, sf_dir).select("ord", F.array_sort(text.line_tokens(F.col("lines"))).alias("t"))
    return out.select("ord", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens"))


@query(f"""WITH RECURSIVE {OBSERVED}, k AS (
  SELECT video, ord, t_us, {TOKEN_SQL} AS tokens, row_number() OVER (PARTITION BY video ORDER BY t_us, ord) AS nth FROM o WHERE is_keyframe
), g AS (
  SELECT video, ord, nth, true AS selected, t_us AS lt, tokens AS lk FROM k WHERE nth = 1
  UNION ALL
  SELECT video, ord, nth, selected, CASE WHEN selected THEN t_us ELSE lt END, CASE WHEN selected THEN tokens ELSE lk END FROM (
    SELECT k.video, k.ord, k.nth, k.t_us, k.tokens, g.lt, g.lk,
           CASE WHEN k.t_us - g.lt >= 120000000 THEN true WHEN k.t_us - g.lt < 10000000 THEN false WHEN (len(k.tokens) = 0) <> (len(g.lk) = 0) THEN true
                WHEN len(list_distinct(list_concat(k.tokens, g.lk))) < 3 THEN false
                ELSE len(list_intersect(k.tokens, g.lk))::DOUBLE / len(list_distinct(list_concat(k.tokens, g.lk))) < 0.85 END AS selected
    FROM g JOIN k ON k.video = g.video AND k.nth = g.nth + 1)
) SELECT video, ord, selected FROM g""")
def change_gate(spark, sf_dir):
    o = views.observed(spark, sf_dir).filter("is_keyframe")
    return folds.change_gate(o.select("video", "t_us", "ord", text.line_tokens(F.col("lines")).alias("tokens"))).select("video", "ord", "selected")


@query(f"""WITH {OBSERVED}, t AS (SELECT video, ord, {TOKEN_SQL} AS t FROM o), p AS (SELECT ord, t, lag(t) OVER (PARTITION BY video ORDER BY ord) AS b FROM t)
SELECT ord, round(CASE WHEN len(t) = 0 AND len(b) = 0 THEN 1.0 ELSE len(list_intersect(t, b))::DOUBLE / len(list_distinct(list_concat(t, b))) END, 6)::DOUBLE AS jaccard FROM p WHERE b IS NOT NULL""")
def token_jaccard(spark, sf_dir):
    out = views.observed(spark, sf_dir).select("video", "ord", text.line_tokens(F.col("lines")).alias("t"))
    out = stretches.beside(out, before=["t"], order=["ord"], width=stretches.STRETCH_IDS).filter("__before IS NOT NULL")
    return out.select("ord", F.round(text.token_jaccard(F.col("t"), F.col("__before.t")), 6).alias("jaccard"))


# --- urls and resources ---------------------------------------------------------------

CORE = "regexp_replace(regexp_extract(url, '^[^?#]*'), '[.,;:]+$', '')"


@query(f"SELECT page_id, CASE WHEN length({CORE}) <= 40 THEN {CORE} ELSE substr({CORE}, 1, 39) || '…' END AS shown FROM pages")
def sanitize_url(spark, sf_dir):
    return views.read(spark, sf_dir, "pages").select("page_id", text.sanitize_url(F.col("url"), 40).alias("shown"))


@query("SELECT page_id, CASE WHEN contains(h, '.') THEN h END AS domain FROM (SELECT page_id, split_part(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE url END, '/', 1) AS h FROM pages)")
def url_domain(spark, sf_dir):
    return views.read(spark, sf_dir, "pages").select("page_id", text.url_domain(F.col("url")).alias("domain"))


@query("SELECT conv_id AS video, turn * 1000000 AS start_us, turn * 1000000 + 720000 AS end_us, text FROM conversations")
def asr_json_flatten(spark, sf_dir):
    c = views.read(spark, sf_dir, "conversations")
    part = F.struct(F.struct((F.col("turn") * 1000).alias("from"), (F.col("turn") * 1000 + 720).alias("to")).alias("offsets"), F.col("text"))
    told = c.groupBy(F.col("conv_id").alias("video")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(part)).alias("transcription"))).alias("result"))
    return segments.from_cpp_json(told, "result").select("video", "start_us", "end_us", "text")


@query("""SELECT vec_id, round(list_sum(list_transform(p, lambda x: ln(x))) / len(p), 5) AS avg_logprob
FROM (SELECT vec_id, list_filter(list_transform(embedding, lambda x: x::DOUBLE), lambda x: x > 0) AS p FROM embeddings)""")
def avg_logprob(spark, sf_dir):
    tokens = F.transform("embedding", lambda x, i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("text"), x.cast("double").alias("p")))
    return views.read(spark, sf_dir, "embeddings").select("vec_id", F.round(segments.avg_logprob(tokens), 5).alias("avg_logprob"))


# --- search ---------------------------------------------------------------------------


@query(f"""{ENTRIES} SELECT e.ord, concat_ws(chr(10), '作業: ' || action, 'アプリ: ' || app, '対象: ' || resource::VARCHAR || CASE WHEN location IS NULL THEN '' ELSE '（' || location || '）' END,
 '発話: ' || nullif(substr(array_to_string(string_split(text, chr(10)), '。'), 1, 400), ''), '画面: ' || nullif(substr(array_to_string(string_split(text, chr(10)), ' / '), 1, 200), '')) AS text
FROM e LEFT JOIN documents ON doc_id = ord""")
def search_document(spark, sf_dir):
    o = views.observed(spark, sf_dir).select("ord", "lines")
    e = entries(spark, sf_dir).join(o, "ord", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    out = text.search_text(F.col("action"), F.col("app"), F.col("resource").cast("string"), F.col("location"), F.lit(None).cast("string"), F.col("lines"), F.col("lines"))
    return e.select("ord", out.alias("text"))


@query("SELECT source || '/worklog.jsonl:' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::VARCHAR AS id, doc_id FROM documents WHERE trim(text) <> ''")
def doc_ids(spark, sf_dir):
    docs = views.read(spark, sf_dir, "documents").filter("trim(text) <> ''")
    docs = stretches.numbered(docs, "nth", key="source", order=["doc_id"], width=stretches.STRETCH_IDS)
    return docs.select(F.concat("source", F.lit("/worklog.jsonl:"), F.col("nth").cast("string")).alias("id"), "doc_id")


@query("SELECT vec_id, round(v[1] / n, 5) AS first, round(v[-1] / n, 5) AS last FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12) AS n FROM embeddings)")
def l2_normalize(spark, sf_dir):
    v = views.read(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.element_at("v", 1), 5).alias("first"), F.round(F.element_at("v", -1), 5).alias("last"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(e.embedding, lambda x: x::DOUBLE)) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def cosine_topk(spark, sf_dir):
    e = views.read(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vectors.top_k(e, asked, 5).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


# --- rendering ------------------------------------------------------------------------

DURATION_SQL = "CASE WHEN ({0}) = 0 THEN '0秒' ELSE CASE WHEN ({0}) >= 3600 THEN (({0}) // 3600)::VARCHAR || '時間' ELSE '' END || CASE WHEN ({0}) // 60 % 60 > 0 THEN (({0}) // 60 % 60)::VARCHAR || '分' ELSE '' END || CASE WHEN ({0}) % 60 > 0 THEN (({0}) % 60)::VARCHAR || '秒' ELSE '' END END"


@query(f"WITH {DESCRIPTIONS} SELECT ord, {HMS.format('k * 997')} AS t FROM d")
def fmt_hms(spark, sf_dir):
    return views.descriptions(spark, sf_dir).select("ord", text.hms(F.col("k") * 997).alias("t"))


@query(f"WITH {DESCRIPTIONS} SELECT ord, {DURATION_SQL.format('k * 61')} AS t FROM d")
def fmt_duration(spark, sf_dir):
    return views.descriptions(spark, sf_dir).select("ord", text.duration_ja(F.col("k") * 61).alias("t"))


PLACE = "CASE WHEN k % 4 = 0 THEN 'ファイル（p1）' WHEN k % 4 = 1 THEN 'file' END"


@query(f"""{ENTRIES} SELECT ord, '## ' || {HMS.format("t_us // 1000000 % 360000")} || CASE WHEN end_us - t_us <> 0 THEN '〜' || {HMS.format("(t_us // 1000000 % 360000) + (end_us - t_us) // 1000000")} || '（' || {DURATION_SQL.format("(end_us - t_us) // 1000000")} || '）' ELSE '' END
 || coalesce(' — ' || app, '') || coalesce(' — ' || {PLACE} || CASE WHEN location IS NOT NULL AND NOT contains(translate({PLACE}, '（）　', '() '), location) THEN '（' || location || '）' ELSE '' END, '') AS heading FROM e""")
def md_heading(spark, sf_dir):
    k = F.col("k")
    place = F.when(k % 4 == 0, "ファイル（p1）").when(k % 4 == 1, "file")
    t = F.floor(F.col("t_us") / 1_000_000) % 360_000
    d = F.floor(F.col("duration_us") / 1_000_000)
    heading = text.heading(t, t + d, F.col("duration_us") / 1e6, F.col("app"), place, F.col("location"))
    return entries(spark, sf_dir).select("ord", heading.alias("heading"))


@query("SELECT stem, count(*) AS n FROM (SELECT regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM pages) GROUP BY 1 HAVING count(*) > 1")
def dup_stems(spark, sf_dir):
    stem = F.regexp_replace(F.regexp_extract("url", "[^/]*$", 0), r"\.[^.]*$", "")
    return views.read(spark, sf_dir, "pages").groupBy(stem.alias("stem")).agg(F.count("*").alias("n")).filter("n > 1")
