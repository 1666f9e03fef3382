"""Model replies: JSON with or without fences, cut off, or plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoloom.functions.text import strip

FIELDS = ("app_guess", "resource", "location", "focus", "action")

# Texts and patterns that results depend on.
FALLBACK_ACTION = "（この画面の説明を生成できませんでした）"
FENCE = r"^```[a-zA-Z]*\n|\n?```$"
PAIR = r'"(app_guess|resource|location|focus|action)"\s*:\s*"((?:[^"\\]|\\.)*)"'


def normalize_null(value: Column) -> Column:
    """A string stripped; null where it is blank or says null or none."""
    bare = strip(value)
    return F.when((bare != "") & ~F.lower(bare).isin("null", "none"), bare)


def salvaged(text: Column) -> Column:
    """Fields that a pattern finds in broken JSON; of repeats the last counts; escapes stay as they are."""
    keys, values = (F.regexp_extract_all(text, F.lit(PAIR), F.lit(i)) for i in (1, 2))
    pairs = F.reverse(F.arrays_zip(keys.alias("k"), values.alias("v")))

    def field(name: str) -> Column:
        hits = F.filter(pairs, lambda p: p["k"] == name)
        return normalize_null(F.when(F.size(hits) > 0, F.element_at(hits, 1)["v"]))

    return F.struct(*[(F.coalesce(field(f), F.lit(FALLBACK_ACTION)) if f == "action" else field(f)).alias(f) for f in FIELDS])


def parsed(content: Column) -> Column:
    """The five fields of a reply. JSON that is not an object counts as plain text."""
    clean = strip(F.regexp_replace(strip(content), FENCE, ""))
    variant = F.try_parse_json(clean)
    is_object = F.schema_of_variant(variant).startswith("OBJECT")

    def field(name: str) -> Column:
        value = F.try_variant_get(variant, f"$.{name}", "variant")
        text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(variant, f"$.{name}", "string"))
        return normalize_null(text)

    saved = salvaged(clean)
    plain = (clean != "") & ~(variant.isNotNull() & is_object) & ~(variant.isNull() & clean.startswith("{"))

    def pick(name: str) -> Column:
        out = F.when(variant.isNotNull() & is_object, field(name)).when(variant.isNull() & clean.startswith("{"), saved[name])
        if name == "action":
            return F.coalesce(F.when(plain, clean).otherwise(out), F.lit(FALLBACK_ACTION)).alias(name)
        return out.alias(name)

    return F.struct(*[pick(f) for f in FIELDS])


def reply_content(reply: Column) -> Column:
    """What a chat server's reply (JSON) says, stripped: of ``message`` or of the first of ``choices``; null where it is blank or missing."""
    variant = F.try_parse_json(reply)
    said = [F.try_variant_get(variant, f"$.{path}.content", "string") for path in ("message", "choices[0].message")]
    bare = strip(F.coalesce(*said))
    return F.when(bare != "", bare)


def recognised_lines(result: Column) -> Column:
    """The lines of a recogniser's result (JSON): the first page's ``rec_texts`` as strings; none without a page."""
    pages = F.from_json(result, "array<struct<rec_texts: array<string>>>")
    return F.coalesce(F.get(pages, F.lit(0))["rec_texts"], F.array().cast("array<string>"))
