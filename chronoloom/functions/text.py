"""Text rules over observed lines, as Column expressions.

Patterns are Java regular expressions with Unicode classes spelled out: ``\\w``, ``\\s`` and
``strip`` mean the Unicode kinds everywhere, and case-insensitive means ``(?iu)``.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"

# Words, patterns and limits that results depend on.
FILLERS = ("えーと", "えっと", "あのー", "あの", "うーん", "ふーん", "なるほど", "はい", "うん", "ええ", "えー", "あー", "おー", "ほう", "まあ")
PUNCTUATION = r"[、。，．,.!！?？\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
FILE = r"(?iu)([\p{L}\p{N}_\-()（）&．.]+\.(?:xlsx?|pptx?|docx?|pdf|csv|numbers|key|pages|md|txt|py|ts|js|json|yaml|yml|html))"
TITLE_BAR = rf"^(.+?){SPACE}*[-–—]{SPACE}*([A-Za-z][\p{{L}}\p{{N}}_ .]*)$"
URL = r"(https?://[^\s\x{1c}-\x{1f}\x{85}\p{Z}]+|(?:[\p{L}\p{N}_-]+\.)+(?:com|jp|net|org|io|dev|ai)(?:/[^\s\x{1c}-\x{1f}\x{85}\p{Z}]*)?)"
LOCATIONS = (
    rf"(スライド{SPACE}*\p{{Nd}}+{SPACE}*/{SPACE}*\p{{Nd}}+)",
    rf"(\p{{Nd}}+{SPACE}*/{SPACE}*\p{{Nd}}+{SPACE}*ページ)",
    rf"(?iu)(Page{SPACE}+\p{{Nd}}+{SPACE}+of{SPACE}+\p{{Nd}}+)",
    r"^(Sheet\p{Nd}+)$",
)
BOILERPLATE = r"(?iu)^(?:a |the )?(?:web ?page|screenshot|untitled|unknown|browser (?:tab|window))(?![\p{L}\p{N}_])"
NAME_DENIED = ("MINOTETAKER", "AINOTETAKER", "NOTETAKER", "YOU", "あなた", "ミーティング", "参加者", "全員")
INITIALS_DENIED = ("AI", "HD", "CC", "ON", "PC", "TV", "OK", "NG")
UNKNOWN_APP = "（不明）"
URL_LIMIT, FRAGMENT_LIMIT, TITLE_LIMIT = 60, 4, 40
LEAST_LINE = 3


def strip(c: Column) -> Column:
    """Without white space at either end, as Unicode has it."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def truthy(c: Column) -> Column:
    """Null where empty."""
    return F.when(F.length(c) > 0, c)


def normalized_lines(lines: Column) -> Column:
    return F.filter(F.transform(lines, strip), lambda x: x != "")


def has_verbal_content(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{N}]")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which no built-in function does."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def is_filler_only(normalized: Column) -> Column:
    """Only filler words and punctuation; the text must be in NFKC already."""
    return F.regexp_replace(normalized, PUNCTUATION, "").rlike(f"^(?:{'|'.join(FILLERS)})+$")


def is_reliable(text: Column, no_speech: Column, logprob: Column, most_no_speech: float = 0.6, least_logprob: float = -1.0, filler: Column | None = None) -> Column:
    """Whether a segment is kept; both probabilities speak together, the log probability also alone."""
    both = no_speech.isNotNull() & logprob.isNotNull()
    out = F.when(~has_verbal_content(text), False)
    if filler is not None:
        out = out.when(filler, False)
    return (
        out.when(both, ~((no_speech > most_no_speech) & (logprob < least_logprob)))
        .when(logprob.isNotNull(), logprob >= least_logprob)
        .otherwise(True)
    )


def line_tokens(lines: Column) -> Column:
    """The set of words of lines that are long enough and more than digits."""
    kept = F.filter(F.transform(lines, strip), lambda x: (F.length(x) >= LEAST_LINE) & ~x.rlike(r"^[0-9:./\- ]*$"))
    words = F.flatten(F.transform(kept, lambda x: F.split(x, f"{SPACE}+")))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def sanitize_url(url: Column, limit: int = URL_LIMIT) -> Column:
    core = F.regexp_replace(F.regexp_extract(url, "^[^?#]*", 0), "[.,;:]+$", "")
    return F.when(F.length(core) <= limit, core).otherwise(F.concat(F.substring(core, 1, limit - 1), F.lit("…")))


def url_domain(url: Column) -> Column:
    """What stands before the first slash, without a scheme; null without a dot. Bare domains are urls here."""
    core = F.regexp_replace(url, "^(?s).*?://", "")
    domain = F.split_part(core, F.lit("/"), F.lit(1))
    return F.when(domain.contains("."), domain)


def clean_resource(value: Column) -> Column:
    """Null where a model's resource is a phrase it fills in or a fragment."""
    fragment = value.rlike(rf"^[A-Za-z0-9]{{1,{FRAGMENT_LIMIT}}}$")
    return F.when(~(value.rlike(BOILERPLATE) | fragment), value)


def strip_location_suffix(resource: Column, location: Column) -> Column:
    """resource without its location in parentheses at the end; unchanged where there is none."""
    trimmed = F.regexp_replace(resource, f"{SPACE}+$", "")
    out = F.when(F.coalesce(F.length(location), F.lit(0)) == 0, resource)
    for opening, closing in ("()", "（）"):
        suffix = F.concat(F.lit(opening), location, F.lit(closing))
        cut = F.substring(trimmed, F.lit(1), F.length(trimmed) - F.length(suffix))
        out = out.when(trimmed.endswith(suffix), F.regexp_replace(cut, f"{SPACE}+$", ""))
    return out.otherwise(resource)


def _first(lines: Column, found) -> Column:
    """The first non-null result over lines."""
    return F.get(F.filter(F.transform(lines, found), lambda x: x.isNotNull()), F.lit(0))


def _file_found(line: Column) -> Column:
    """A line, the first file name in it, and where that begins."""
    return F.struct(line.alias("line"), F.regexp_extract(line, FILE, 1).alias("name"), (F.regexp_instr(line, F.lit(FILE)) - 1).alias("begin"))


def _file_outside_urls(x: Column) -> Column:
    """A found file name, null where it lies inside a url.

    A url's place is the length of all that stands before it: the parts between urls and
    the urls themselves, in turn.
    """
    gaps, urls = F.split(x["line"], URL, -1), F.regexp_extract_all(x["line"], F.lit(URL), F.lit(0))
    end = x["begin"] + F.length(x["name"])
    spans = F.transform(urls, lambda u, i: F.struct(
        F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda n, g: n + F.length(g)).alias("gap"),
        F.aggregate(F.slice(urls, F.lit(1), i), F.lit(0), lambda n, g: n + F.length(g)).alias("before"), F.length(u).alias("size"),
    ))
    inside = F.exists(spans, lambda s: (s["gap"] + s["before"] <= x["begin"]) & (end <= s["gap"] + s["before"] + s["size"]))
    return F.struct(x["line"].alias("line"), F.when(~inside, x["name"]).alias("name"))


def _named_files(lines: Column) -> Column:
    """(line, name) of the lines with a file name; the costly rules see only lines with a dot."""
    likely = F.filter(lines, lambda x: x.contains("."))
    found = F.filter(F.transform(likely, _file_found), lambda x: x["begin"] >= 0)
    return F.filter(F.transform(found, _file_outside_urls), lambda x: x["name"].isNotNull())


def file_in_line(line: Column) -> Column:
    """The first file name of a line, null where it lies inside a url."""
    return F.get(_named_files(F.array(line)), F.lit(0))["name"]


def find_location(lines: Column) -> Column:
    """The first location that a line shows; only lines with a decimal digit can."""
    likely = F.filter(lines, lambda x: x.rlike(r"\p{Nd}"))
    return _first(F.transform(likely, strip), lambda x: F.coalesce(*[truthy(F.regexp_extract(x, p, 1)) for p in LOCATIONS]))


def screen_context(lines: Column) -> Column:
    """app, resource and location that lines show: the first line with a file name, else the first url."""

    def context(file: Column) -> Column:
        app = truthy(F.regexp_extract(strip(file["line"]), TITLE_BAR, 2))
        url = _first(F.filter(lines, lambda x: x.contains(".") | x.contains("://")), lambda x: truthy(F.regexp_extract(x, URL, 1)))
        resource = F.coalesce(file["name"], F.when(file["name"].isNull(), sanitize_url(url)))
        return F.struct(truthy(strip(app)).alias("app"), resource.alias("resource"), find_location(lines).alias("location"))

    # as the single element of an array the file is found once, however often it is named
    return F.get(F.transform(F.array(F.get(_named_files(lines), F.lit(0))), context), F.lit(0))


def merge_resource(seen: Column, guessed: Column) -> Column:
    """The seen resource, but the guessed one where it confirms the seen url's domain; guesses pass the quality gate."""
    guess = clean_resource(guessed)
    confirmed = (F.length(guess) > 0) & seen.rlike(f"^(?:{URL})$") & guess.contains(url_domain(seen))
    return F.when(seen.isNull(), guess).when(confirmed, guess).otherwise(seen)


def enriched(seen: Column, app: Column, resource: Column, location: Column) -> Column:
    """A description's app, resource and location, overridden by what its screen_context shows.

    Pass a column that holds the context, not the expression: it is used several times.
    """
    where = F.coalesce(truthy(seen["location"]), location)
    what = merge_resource(seen["resource"], resource)
    return F.struct(
        F.coalesce(truthy(seen["app"]), app).alias("app"), F.when(what.isNotNull(), strip_location_suffix(what, where)).alias("resource"), where.alias("location")
    )


def _staged(lines: Column, *steps) -> Column:
    """lines through one transform a step: what a step makes is computed once, however often the next one names it."""
    for step in steps:
        lines = F.transform(lines, step)
    return lines


def _without_reading(line: Column) -> Column:
    """A stripped line, and the same without a reading in parentheses behind it."""
    return F.struct(line.alias("line"), F.when(line.rlike("[）)]$"), strip(F.regexp_replace(line, r"[（(][ァ-ヴー]+[）)]$", ""))).otherwise(line).alias("plain"))


def _without_title(x: Column) -> Column:
    plain = x["plain"]
    return F.struct(x["line"].alias("line"), F.when(plain.endswith("さん") & (F.length(plain) > 2), F.regexp_replace(plain, "さん$", "")).otherwise(plain).alias("plain"))


def _named(x: Column) -> Column:
    plain = x["plain"]
    letters = F.length(F.regexp_replace(plain, rf"(?:・|{SPACE})", ""))
    name = (
        F.when(plain.rlike("^[A-Z]{2}$"), F.when(~plain.isin(*INITIALS_DENIED), plain))
        .when(plain.rlike(rf"^[一-鿿]{{1,4}}(?:・|{SPACE})?[一-鿿]{{1,4}}$") & letters.between(2, 5), plain)
    )
    return F.when(name.isNotNull() & ~F.upper(F.regexp_replace(x["line"], SPACE, "")).isin(*NAME_DENIED), name)


def name_labels(lines: Column) -> Column:
    """The people whose labels lines are: of lines that begin like a name, the rest of the rules tell."""
    likely = F.filter(lines, lambda x: x.rlike(rf"^{SPACE}*(?:[A-Z]{{2}}|[一-鿿])"))
    found = _staged(likely, strip, _without_reading, _without_title, _named)
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def person_name(line: Column) -> Column:
    """The person whose label a line is, null if it is none."""
    return F.get(name_labels(F.array(line)), F.lit(0))


def speech_line(speaker: Column, text: Column) -> Column:
    return F.when(F.length(speaker) > 0, F.concat(speaker, F.lit(": "), text)).otherwise(text)


def without_adjacent_repeats(lines: Column) -> Column:
    return F.filter(lines, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(lines, i - 1)))


def hms(seconds: Column) -> Column:
    """Whole seconds as HH:MM:SS, hours unbounded."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def duration_ja(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    h, m, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.concat_ws(
        "", F.when(h > 0, F.concat(h.cast("string"), F.lit("時間"))), F.when(m > 0, F.concat(m.cast("string"), F.lit("分"))),
        F.when((rest > 0) | (s == 0), F.concat(rest.cast("string"), F.lit("秒"))),
    )


def is_redundant_location(resource: Column, location: Column) -> Column:
    a, b = (strip(F.translate(c, "（）　", "() ")) for c in (resource, location))
    return a.contains(b) | b.contains(a)


def step_title(action: Column) -> Column:
    first = strip(F.split_part(action, F.lit("。"), F.lit(1)))
    return F.when(F.length(first) <= TITLE_LIMIT, first).otherwise(F.concat(F.substring(first, 1, TITLE_LIMIT - 1), F.lit("…")))


def search_text(action: Column, app: Column, resource: Column, location: Column, focus: Column, speech: Column, ocr: Column) -> Column:
    """The labelled text that a search document embeds; empty fields leave no line."""
    where = F.when(F.length(location) > 0, F.concat(F.lit("（"), location, F.lit("）"))).otherwise("")
    said, seen = F.array_join(speech, "。"), F.array_join(ocr, " / ")
    return F.concat_ws(
        "\n", F.concat(F.lit("作業: "), truthy(action)), F.concat(F.lit("アプリ: "), truthy(app)), F.concat(F.lit("対象: "), truthy(resource), where),
        F.concat(F.lit("注視: "), truthy(focus)), F.concat(F.lit("発話: "), truthy(F.substring(said, 1, 400))), F.concat(F.lit("画面: "), truthy(F.substring(seen, 1, 200))),
    )


def heading(t: Column, end: Column, duration: Column, app: Column, resource: Column, location: Column) -> Column:
    """A work-log entry's Markdown heading; times in seconds."""
    span = F.when(end.isNotNull() & (duration != 0), F.concat(F.lit("〜"), hms(end), F.lit("（"), duration_ja(duration), F.lit("）"))).otherwise("")
    where = F.when((F.length(location) > 0) & ~is_redundant_location(resource, location), F.concat(F.lit("（"), location, F.lit("）"))).otherwise("")
    return F.concat(
        F.lit("## "), hms(t), span, F.coalesce(F.concat(F.lit(" — "), truthy(app)), F.lit("")), F.coalesce(F.concat(F.lit(" — "), truthy(resource), where), F.lit(""))
    )


def target_line(app: Column, resource: Column, location: Column) -> Column:
    parts = F.concat_ws(" — ", truthy(app), truthy(resource))
    where = F.coalesce(F.concat(F.lit("（"), truthy(location), F.lit("）")), F.lit(""))
    return F.when(F.length(parts) > 0, F.concat(F.lit("対象: "), parts, where))
