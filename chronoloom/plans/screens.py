"""Queries over what screens show and what models reply, on the tables' own text, with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions import reply, text
from chronoloom.operators import stretches
from chronoloom.plans.queries import PY_TRIM, query
from chronoloom.sources import views
from chronoloom.sources.views import SCREENS

GAP = r"[\s\x1c-\x1f\x{85}\p{Z}]"
FILE_SQL = r"(?i)([\p{L}\p{N}_\-()（）&．.]+\.(?:xlsx?|pptx?|docx?|pdf|csv|numbers|key|pages|md|txt|py|ts|js|json|yaml|yml|html))"
URL_SQL = r"(https?://[^\s\x1c-\x1f\x{85}\p{Z}]+|(?:[\p{L}\p{N}_-]+\.)+(?:com|jp|net|org|io|dev|ai)(?:/[^\s\x1c-\x1f\x{85}\p{Z}]*)?)"
BAR_SQL = rf"^(.+?){GAP}*[-–—]{GAP}*([A-Za-z][\p{{L}}\p{{N}}_ .]*)$"
PLACES_SQL = (rf"スライド{GAP}*\p{{Nd}}+{GAP}*/{GAP}*\p{{Nd}}+", rf"\p{{Nd}}+{GAP}*/{GAP}*\p{{Nd}}+{GAP}*ページ", rf"(?i)Page{GAP}+\p{{Nd}}+{GAP}+of{GAP}+\p{{Nd}}+", r"^Sheet\p{Nd}+$")


def trim_sql(x: str) -> str:
    return PY_TRIM.format(x)


PLACE_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract({trim_sql('x')}, '{p}'), '')" for p in PLACES_SQL) + ")"
#: The first file name of line x, and whether an address of the line holds it.
NAME_SQL = f"regexp_extract(x, '{FILE_SQL}', 1)"
INSIDE_SQL = f"len(list_filter(regexp_extract_all(x, '{URL_SQL}'), lambda u: strpos(x, u) > 0 AND strpos(x, u) <= strpos(x, n) AND strpos(x, n) + length(n) <= strpos(x, u) + length(u))) > 0"
CORE_SQL = "regexp_replace(regexp_extract({0}, '^[^?#]*'), '[.,;:]+$', '')"
SEEN = f"""{SCREENS}, lines AS (SELECT page_id, i, lines[i] AS x FROM s, unnest(range(1, len(lines) + 1)) AS u(i)),
named AS (SELECT page_id, i, x, {NAME_SQL} AS n FROM lines),
f AS (SELECT page_id, arg_min(n, i) AS name, arg_min(x, i) AS line FROM named WHERE n <> '' AND NOT {INSIDE_SQL} GROUP BY 1),
a AS (SELECT page_id, arg_min(u, i) AS url FROM (SELECT page_id, i, regexp_extract(x, '{URL_SQL}', 1) AS u FROM lines) WHERE u <> '' GROUP BY 1),
p AS (SELECT page_id, arg_min(place, i) AS location FROM (SELECT page_id, i, {PLACE_SQL} AS place FROM lines) WHERE place IS NOT NULL GROUP BY 1),
seen AS (SELECT s.page_id, s.url AS page_url, nullif({trim_sql(f"regexp_extract({trim_sql('f.line')}, '{BAR_SQL}', 2)")}, '') AS app,
  coalesce(f.name, CASE WHEN length({CORE_SQL.format("a.url")}) <= 60 THEN {CORE_SQL.format("a.url")} ELSE left({CORE_SQL.format("a.url")}, 59) || '…' END) AS resource, p.location
  FROM s LEFT JOIN f USING (page_id) LEFT JOIN a USING (page_id) LEFT JOIN p USING (page_id))"""


@query(f"WITH {SEEN} SELECT page_id, app, resource, location FROM seen")
def screen_context(spark, sf_dir):
    out = views.screens(spark, sf_dir).select("page_id", text.screen_context(F.col("lines")).alias("c"))
    return out.select("page_id", "c.app", "c.resource", "c.location")


@query(f"WITH {SCREENS} SELECT page_id, list_filter(list_transform(lines, lambda x: {PLACE_SQL}), lambda y: y IS NOT NULL)[1] AS location FROM s")
def find_location(spark, sf_dir):
    return views.screens(spark, sf_dir).select("page_id", text.find_location(F.col("lines")).alias("location"))


# What a model guessed of a page: by turns the address's domain, a phrase, a name with its place, a fragment.
GUESS_SQL = """CASE page_id % 5 WHEN 0 THEN 'Title of ' || split_part(split_part(page_url, '://', 2), '/', 1) WHEN 1 THEN 'web page ' || page_id::VARCHAR
 WHEN 2 THEN 'notes (there)' WHEN 3 THEN 'ab' || (page_id % 50)::VARCHAR ELSE 'plan（Page ' || (page_id % 9)::VARCHAR || ' of 9）' END"""
GUESSED = f"""{SEEN}, g AS (SELECT *, {GUESS_SQL} AS guess, CASE WHEN page_id % 3 = 0 THEN 'there' END AS guess_at FROM seen),
q AS (SELECT *, CASE WHEN regexp_matches(guess, '(?i)^(?:a |the )?(?:web ?page|screenshot|untitled|unknown|browser (?:tab|window))([^\\p{{L}}\\p{{N}}_]|$)') OR regexp_matches(guess, '^[A-Za-z0-9]{{1,4}}$') THEN NULL ELSE guess END AS good,
  split_part(regexp_replace(resource, '^.*?://', ''), '/', 1) AS domain FROM g),
w AS (SELECT *, coalesce(location, guess_at) AS spot, CASE WHEN resource IS NULL THEN good
  WHEN length(good) > 0 AND regexp_full_match(resource, '{URL_SQL}') AND contains(domain, '.') AND contains(good, domain) THEN good ELSE resource END AS what FROM q),
e AS (SELECT page_id, guess, guess_at, coalesce(app, 'guess') AS app, spot AS location,
  CASE WHEN coalesce(spot, '') = '' THEN what WHEN ends_with(rtrim(what), '(' || spot || ')') OR ends_with(rtrim(what), '（' || spot || '）') THEN rtrim(left(rtrim(what), length(rtrim(what)) - length(spot) - 2)) ELSE what END AS resource FROM w)"""


def guessed(spark, sf_dir):
    i = F.col("page_id")
    guess = (
        F.when(i % 5 == 0, F.concat(F.lit("Title of "), text.url_domain(F.col("url")))).when(i % 5 == 1, F.concat(F.lit("web page "), i.cast("string"))).when(i % 5 == 2, "notes (there)")
        .when(i % 5 == 3, F.concat(F.lit("ab"), (i % 50).cast("string"))).otherwise(F.concat(F.lit("plan（Page "), (i % 9).cast("string"), F.lit(" of 9）")))
    )
    out = views.screens(spark, sf_dir).select("page_id", guess.alias("guess"), F.when(i % 3 == 0, "there").alias("guess_at"), text.screen_context(F.col("lines")).alias("seen"))
    return out.withColumn("e", text.enriched(F.col("seen"), F.lit("guess"), F.col("guess"), F.col("guess_at")))


@query(f"WITH {GUESSED} SELECT page_id, app, resource, location FROM e")
def enrich(spark, sf_dir):
    return guessed(spark, sf_dir).select("page_id", "e.app", "e.resource", "e.location")


@query(f"WITH {GUESSED} SELECT page_id % 20 AS part, count(*) AS n, count_if(resource IS DISTINCT FROM guess OR location IS DISTINCT FROM guess_at)::BIGINT AS n_changed, count_if(coalesce(contains(resource, '?'), false))::BIGINT AS n_symptoms FROM e GROUP BY 1")
def replay_diff(spark, sf_dir):
    changed = ~F.col("e.resource").eqNullSafe(F.col("guess")) | ~F.col("e.location").eqNullSafe(F.col("guess_at"))
    return guessed(spark, sf_dir).groupBy((F.col("page_id") % 20).alias("part")).agg(
        F.count("*").alias("n"), F.count_if(changed).alias("n_changed"), F.count_if(F.col("e.resource").contains("?")).alias("n_symptoms")
    )


# --- names, resources and steps from documents --------------------------------------------

FIRST_LINE, FIRST_WORD = "split_part(text, chr(10), 1)", "split_part(split_part(text, chr(10), 1), ' ', 1)"


def documents(spark, sf_dir):
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    return views.read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", line.alias("line"), F.split_part(line, F.lit(" "), F.lit(1)).alias("word"))


@query(f"""WITH v AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN {FIRST_WORD} WHEN 1 THEN 'A webpage ' || {FIRST_WORD} WHEN 2 THEN 'Unknown' || lower({FIRST_WORD}) ELSE {FIRST_LINE} END AS v FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(v, '(?i)^(?:a |the )?(?:web ?page|screenshot|untitled|unknown|browser (?:tab|window))([^\\p{{L}}\\p{{N}}_]|$)') OR regexp_matches(v, '^[A-Za-z0-9]{{1,4}}$') THEN NULL ELSE v END AS resource FROM v""")
def resource_gate(spark, sf_dir):
    d, i = documents(spark, sf_dir), F.col("doc_id")
    value = F.when(i % 4 == 0, F.col("word")).when(i % 4 == 1, F.concat(F.lit("A webpage "), F.col("word"))).when(i % 4 == 2, F.concat(F.lit("Unknown"), F.lower("word"))).otherwise(F.col("line"))
    return d.select("doc_id", text.clean_resource(value).alias("resource"))


def end_sql(x: str) -> str:
    return f"regexp_replace({x}, '{GAP}+$', '')"


@query(f"""WITH v AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS place, CASE doc_id % 4 WHEN 0 THEN {FIRST_WORD} || ' (' || lang || ')' WHEN 1 THEN {FIRST_WORD} || '（' || lang || '） ' WHEN 2 THEN {FIRST_LINE} ELSE {FIRST_WORD} || ' (' || source || ')' END AS v FROM documents)
SELECT doc_id, CASE WHEN place IS NULL THEN v WHEN ends_with({end_sql("v")}, '(' || place || ')') OR ends_with({end_sql("v")}, '（' || place || '）')
 THEN {end_sql(f"left({end_sql('v')}, length({end_sql('v')}) - length(place) - 2)")} ELSE v END AS resource FROM v""")
def strip_suffix(spark, sf_dir):
    d, i = documents(spark, sf_dir), F.col("doc_id")
    inside = lambda a, c, b: F.concat(F.col("word"), F.lit(a), F.col(c), F.lit(b))
    value = F.when(i % 4 == 0, inside(" (", "lang", ")")).when(i % 4 == 1, inside("（", "lang", "） ")).when(i % 4 == 2, F.col("line")).otherwise(inside(" (", "source", ")"))
    return d.select("doc_id", text.strip_location_suffix(value, F.when(i % 5 != 0, F.col("lang"))).alias("resource"))


# A label that a meeting window would show for a document, then all of its lines.
LABEL_SQL = f"""CASE doc_id % 7 WHEN 0 THEN upper(left({FIRST_WORD}, 2)) WHEN 1 THEN '田中' || substr('一二三四五六七', 1 + (doc_id % 6)::INT, 1) || '（タナカ）' WHEN 2 THEN '鈴木さん'
 WHEN 3 THEN '山田・' || substr('東西南北', 1 + (doc_id % 4)::INT, 1) WHEN 4 THEN ' You ' WHEN 5 THEN '会議資料の確認' ELSE '参加者' END"""
PLAIN_SQL = trim_sql(f"regexp_replace({trim_sql('x')}, '[（(][ァ-ヴー]+[）)]$', '')")
BARE_SQL = f"CASE WHEN ends_with({PLAIN_SQL}, 'さん') AND length({PLAIN_SQL}) > 2 THEN left({PLAIN_SQL}, length({PLAIN_SQL}) - 2) ELSE {PLAIN_SQL} END"


@query(f"""WITH o AS (SELECT doc_id, unnest(list_concat([{LABEL_SQL}], string_split(text, chr(10)))) AS x FROM documents), b AS (SELECT doc_id, upper(regexp_replace({trim_sql("x")}, '{GAP}', '', 'g')) AS loud, {BARE_SQL} AS y FROM o),
n AS (SELECT DISTINCT doc_id, y FROM b WHERE loud NOT IN ('MINOTETAKER', 'AINOTETAKER', 'NOTETAKER', 'YOU', 'あなた', 'ミーティング', '参加者', '全員') AND (
 (regexp_matches(y, '^[A-Z]{{2}}$') AND y NOT IN ('AI', 'HD', 'CC', 'ON', 'PC', 'TV', 'OK', 'NG')) OR
 (regexp_matches(y, '^[一-鿿]{{1,4}}(?:・|{GAP})?[一-鿿]{{1,4}}$') AND length(regexp_replace(y, '(?:・|{GAP})', '', 'g')) BETWEEN 2 AND 5)))
SELECT d.doc_id, coalesce(string_agg(y, ',' ORDER BY y), '') AS names FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1""")
def name_labels(spark, sf_dir):
    d = documents(spark, sf_dir)
    names = text.name_labels(F.concat(F.array(shown_label(F.col("doc_id"), F.col("word"))), F.split("text", "\n")))
    return d.select("doc_id", F.array_join(F.array_sort(names), ",").alias("names"))


def shown_label(i, word):
    at = lambda letters, n: F.substring(F.lit(letters), (i % n + 1).cast("int"), F.lit(1))
    return (
        F.when(i % 7 == 0, F.upper(F.substring(word, 1, 2))).when(i % 7 == 1, F.concat(F.lit("田中"), at("一二三四五六七", 6), F.lit("（タナカ）"))).when(i % 7 == 2, "鈴木さん")
        .when(i % 7 == 3, F.concat(F.lit("山田・"), at("東西南北", 4))).when(i % 7 == 4, " You ").when(i % 7 == 5, "会議資料の確認").otherwise("参加者")
    )


ACTION_SQL = f"CASE doc_id % 3 WHEN 0 THEN {FIRST_LINE} WHEN 1 THEN {FIRST_WORD} || '。' || {FIRST_LINE} ELSE {FIRST_WORD} || '。' END"
TITLE = trim_sql("split_part(a, '。', 1)")
TITLE_SQL = f"CASE WHEN length({TITLE}) <= 40 THEN {TITLE} ELSE left({TITLE}, 39) || '…' END"


@query(f"WITH l AS (SELECT doc_id, source, {ACTION_SQL} AS a FROM documents) SELECT doc_id, '## Step ' || row_number() OVER (PARTITION BY source ORDER BY doc_id)::VARCHAR || ': ' || {TITLE_SQL} AS title, CASE WHEN rtrim(a, '。') <> rtrim({TITLE_SQL}, '…') THEN a END AS body FROM l")
def manual_steps(spark, sf_dir):
    i = F.col("doc_id")
    action = F.when(i % 3 == 0, F.col("line")).when(i % 3 == 1, F.concat("word", F.lit("。"), "line")).otherwise(F.concat("word", F.lit("。")))
    l = stretches.numbered(documents(spark, sf_dir).select("doc_id", "source", action.alias("a")), "nth", key="source", order=["doc_id"], width=stretches.STRETCH_IDS)
    title = text.step_title(F.col("a"))
    body = F.when(F.regexp_replace("a", "。+$", "") != F.regexp_replace(title, "…+$", ""), F.col("a"))
    return l.select("doc_id", F.concat(F.lit("## Step "), (F.col("nth") + 1).cast("string"), F.lit(": "), title).alias("title"), body.alias("body"))


# --- replies, made from what was said -----------------------------------------------------

FALL = reply.FALLBACK_ACTION
SAY = "split_part(text, chr(10), 1)"


def replies(spark, sf_dir):
    """conversations as a model's replies, by turns: JSON, fenced JSON, JSON cut off, plain text, a JSON list, nothing."""
    c = views.read(spark, sf_dir, "conversations").withColumn("say", F.split_part("text", F.lit("\n"), F.lit(1)))
    i = F.col("conv_id") + F.col("turn")
    whole = F.to_json(F.struct(F.col("role").alias("app_guess"), F.concat(F.lit(" "), "say", F.lit(" ")).alias("action"), F.when(i % 4 == 0, "none").otherwise("text").alias("focus")))
    cut = F.concat(F.lit('{"app_guess": "'), "role", F.lit('", "resource": "a.md", "action": "'), F.substring(F.regexp_replace("say", r'["\\]', ""), 1, 20))
    content = (
        F.when(i % 6 == 0, whole).when(i % 6 == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(i % 6 == 2, cut).when(i % 6 == 3, F.col("text"))
        .when(i % 6 == 4, F.to_json(F.array("say"))).otherwise(F.lit(" \n "))
    )
    return c.select("conv_id", "turn", content.alias("content"), "text")


def null_sql(x: str) -> str:
    return f"CASE WHEN lower({trim_sql(x)}) IN ('', 'null', 'none') THEN NULL ELSE {trim_sql(x)} END"


@query(f"""WITH r AS (SELECT *, (conv_id + turn) % 6 AS kind, {SAY} AS say FROM conversations)
SELECT conv_id, turn, CASE WHEN kind IN (0, 1, 2) THEN {null_sql("role")} END AS app_guess, CASE WHEN kind = 2 THEN 'a.md' END AS resource, NULL::VARCHAR AS location,
 CASE WHEN kind IN (0, 1) AND (conv_id + turn) % 4 <> 0 THEN {null_sql("text")} END AS focus,
 coalesce(CASE WHEN kind IN (0, 1) THEN {null_sql("say")} WHEN kind = 3 THEN nullif({trim_sql("text")}, '') WHEN kind = 4 THEN to_json([say])::VARCHAR END, '{FALL}') AS action FROM r""")
def parse_reply(spark, sf_dir):
    out = replies(spark, sf_dir)
    told = out.select("conv_id", "turn", "text", reply.parsed(F.col("content")).alias("r"))
    focus = F.when(F.col("r.focus") == "text", reply.normalize_null(F.col("text")))
    return told.select("conv_id", "turn", "r.app_guess", "r.resource", "r.location", focus.alias("focus"), "r.action")


PAIRS = "'\"(app_guess|resource|location|focus|action)\"\\s*:\\s*\"((?:[^\"\\\\]|\\\\.)*)\"'"
SALVAGE_SQL = f"(list_filter(list_zip(regexp_extract_all(c, {PAIRS}, 1), regexp_extract_all(c, {PAIRS}, 2)), lambda p: p[1] = '{{0}}')[-1])[2]"


@query(f"""WITH r AS (SELECT conv_id, turn, '{{"app_guess": "' || role || '", "x": "' || regexp_replace({SAY}, '["\\\\]', '', 'g') || '", "action": "' || left(regexp_replace({SAY}, '["\\\\]', '', 'g'), 9) || '", "action": "' || left(regexp_replace({SAY}, '["\\\\]', '', 'g'), 5) || '", "focus": "' AS c FROM conversations)
SELECT conv_id, turn, {null_sql("a")} AS app_guess, coalesce({null_sql("b")}, '{FALL}') AS action FROM (SELECT conv_id, turn, {SALVAGE_SQL.format("app_guess")} AS a, {SALVAGE_SQL.format("action")} AS b FROM r)""")
def salvage_json(spark, sf_dir):
    say = F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), r'["\\]', "")
    parts = [F.lit('{"app_guess": "'), F.col("role"), F.lit('", "x": "'), say, F.lit('", "action": "'), F.substring(say, 1, 9), F.lit('", "action": "'), F.substring(say, 1, 5), F.lit('", "focus": "')]
    out = views.read(spark, sf_dir, "conversations").select("conv_id", "turn", reply.salvaged(F.concat(*parts)).alias("r"))
    return out.select("conv_id", "turn", "r.app_guess", "r.action")


@query(f"SELECT conv_id, turn, {null_sql('v')} AS value FROM (SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN ' NONE ' WHEN 1 THEN chr(10) || 'Null' WHEN 2 THEN '  ' ELSE ' ' || text || chr(9) END AS v FROM conversations)")
def normalize_null(spark, sf_dir):
    i = F.col("conv_id") + F.col("turn")
    value = F.when(i % 5 == 0, " NONE ").when(i % 5 == 1, "\nNull").when(i % 5 == 2, "  ").otherwise(F.concat(F.lit(" "), "text", F.lit("\t")))
    return views.read(spark, sf_dir, "conversations").select("conv_id", "turn", reply.normalize_null(value).alias("value"))


@query(f"""SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 <> 3 THEN nullif({trim_sql("text")}, '') END AS content FROM conversations""")
def chat_reply(spark, sf_dir):
    i, message = F.col("conv_id") + F.col("turn"), F.struct("role", F.col("text").alias("content"))
    one, many = F.to_json(F.struct(message.alias("message"))), F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    told = F.when(i % 4 < 2, one).when(i % 4 == 2, many).otherwise('{"message": {"content": " "}}')
    return views.read(spark, sf_dir, "conversations").select("conv_id", "turn", reply.reply_content(told).alias("content"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS lines FROM documents")
def ocr_result(spark, sf_dir):
    page = F.struct(F.split("text", "\n").alias("rec_texts"))
    result = F.when(F.col("doc_id") % 9 == 0, "[]").otherwise(F.to_json(F.array(page, F.struct(F.array(F.lit("second page")).alias("rec_texts")))))
    return views.read(spark, sf_dir, "documents").select("doc_id", F.array_join(reply.recognised_lines(result), "\n").alias("lines"))
