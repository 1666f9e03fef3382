"""Language identification by rank-order profiles.

A text's words (runs of letters, lower-cased) are taken with a space on either side, and
all their n-grams of one to three characters are counted. The most frequent ones, in
order, are its profile; a language's profile is that of all its learning documents
together. The distance of a document to a language is how far its n-grams are out of
place: for each, the difference of its two ranks, or the profile's full length where the
language has it not. The nearest language is predicted; its score is one less the distance
over the greatest possible one.

An n-gram is one integer (21 bits a character), which also breaks ties of frequency; equally
near languages are taken in order of their names. Tasks count n-grams per language and
pass on sums; profiles are PROFILE rows a language and reach the documents by broadcast, so
many languages at once that it holds at most BROADCAST_GRAMS of them: texts stay in place.

Edge cases: null and empty texts and those without a letter are ``und`` with score 0, as is
every text where nothing was learnt; rows without lang, and languages whose documents have
no letter, are not learnt; a null id is never held out; repeated rows are rows of their own;
an empty table gives an empty result; long texts are counted in parts, which
part a word of more than half a million letters, too.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoloom.llm.common import table, utf8, worker_cache

FOLDS, HELD_FOLD = 5, 0
UNKNOWN = "und"
#: N-grams in a profile, of a language and of a document.
PROFILE = 400
LONGEST = 3
BITS, SPACE = 21, 32
#: Characters of a long text that are counted at once.
PIECE = 1 << 19
WORD_END = re.compile(r"[\W\d_]")
BROADCAST_GRAMS = 1 << 20
#: N-grams of a language that a task holds before it passes them on, and documents' characters that it counts together.
KEPT, TOGETHER = 1 << 21, 1 << 15

Grams = tuple[np.ndarray, np.ndarray]


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_FOLD, F.lit(False))


def letters() -> np.ndarray:
    """Whether each code point is a letter; kept by the worker."""
    cache = worker_cache("language")
    if "letters" not in cache:
        cache["letters"] = np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])
    return cache["letters"]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in stretches that end before a character that is no letter or, in words longer than a stretch, anywhere."""
    begin = 0
    while begin < len(text):
        found = WORD_END.search(text, begin + size, begin + 2 * size)
        end = found.start() if found else begin + 2 * size
        yield text[begin:end]
        begin = end


def all_grams(text: str, is_letter: np.ndarray) -> np.ndarray:
    """All n-grams of a text's words, repeats included. Words are parted by one space; the spaces end no gram of a single character and lie in the middle of none."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le"), "<u4")
    of_word = is_letter[codes]
    kept = of_word.copy()
    kept[:-1] |= of_word[1:]
    kept[1:] |= of_word[:-1]
    one = np.where(of_word, codes, SPACE)[kept].astype(np.int64)
    # between two words stand one or two spaces, of which n-grams take one each
    two = one[:-1] << BITS | one[1:]
    three = two[:-1] << BITS | one[2:]
    return np.concatenate([one[one != SPACE], two[two != SPACE << BITS | SPACE], three[one[1:-1] != SPACE]])


def summed(parts: list[Grams]) -> Grams:
    """Counts of equal n-grams added up, in order of the n-grams."""
    grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(place, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)


def text_grams(text: str, is_letter: np.ndarray) -> Grams:
    """The n-grams of a whole text in their order as integers, and how often each occurs."""
    parts: list[Grams] = []
    for piece in pieces(text.lower()):
        grams = all_grams(piece, is_letter)
        grams.sort()
        first = np.flatnonzero(np.diff(grams, prepend=-1))
        parts.append((grams[first], np.diff(first, append=len(grams))))
        if len(parts) > 8:
            parts = [summed(parts)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return parts[0] if len(parts) == 1 else summed(parts)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order of rank; equally frequent ones in their order as integers."""
    order = counts * len(grams) - np.arange(len(grams))
    if len(grams) > size:
        first = np.argpartition(-order, size)[:size]
        grams, order = grams[first], order[first]
    return grams[np.argsort(-order)]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) as tasks have counted them; docs has lang and text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, waiting, held = letters(), {}, {}

        def add_up(lang: str) -> None:
            parts = held.setdefault(lang, [])
            parts.append(text_grams("\n".join(waiting.pop(lang)), is_letter))
            if len(parts) >= 64:
                parts[:] = [summed(parts)]

        def batch_of(lang: str) -> pa.RecordBatch:
            grams, n = summed(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts = waiting.setdefault(lang, [])
                texts.append(text.as_py().decode("utf-8", "replace"))
                if sum(map(len, texts)) > TOGETHER:
                    add_up(lang)
                    if sum(len(g) for g, _ in held[lang]) > KEPT:
                        yield batch_of(lang)
        for lang in list(waiting):
            add_up(lang)
        for lang in list(held):
            yield batch_of(lang)

    return docs.select("lang", utf8().alias("text")).mapInArrow(count, "lang string, gram long, n long")


def profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, rank, gram): the profile of each language, ranks from 0. docs has lang and text."""
    counts = gram_counts(docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return total.withColumn("rank", rank).filter(F.col("rank") < size).select("lang", "rank", "gram")


def profile_blocks(found: DataFrame, size: int = PROFILE, limit: int = BROADCAST_GRAMS) -> Iterator[dict[str, np.ndarray]]:
    """The profiles of so many languages at once, in order of their names, that they are at most limit n-grams."""
    block: dict[str, list[int]] = {}
    for r in found.orderBy("lang", "rank").toLocalIterator():
        if r["lang"] not in block and len(block) >= max(1, limit // size):
            yield {k: np.array(v, np.int64) for k, v in block.items()}
            block = {}
        block.setdefault(r["lang"], []).append(r["gram"])
    if block:
        yield {k: np.array(v, np.int64) for k, v in block.items()}


class Ranks:
    """The ranks of n-grams in several languages' profiles."""

    def __init__(self, block: dict[str, np.ndarray], size: int = PROFILE):
        self.size, self.names = size, sorted(block)
        self.grams = np.unique(np.concatenate([block[n] for n in self.names]))
        self.places = np.full((len(self.names), len(self.grams) + 1), -1, np.int32)
        for row, name in zip(self.places, self.names, strict=True):
            row[np.searchsorted(self.grams, block[name])] = np.arange(len(block[name]))

    def nearest(self, profile: np.ndarray) -> tuple[int, str]:
        """The least out-of-place distance of a document's profile, and the first language that has it."""
        at = np.searchsorted(self.grams, profile)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != profile] = len(self.grams)
        places = self.places[:, at]
        distance = np.where(places < 0, self.size, np.abs(places - np.arange(len(profile)))).sum(axis=1)
        best = int(distance.argmin())
        return int(distance[best]), self.names[best]


def identify(docs: DataFrame, found: DataFrame, key: str = "doc_id", size: int = PROFILE, limit: int = BROADCAST_GRAMS) -> DataFrame:
    """(key, lang_pred, score) of every document; found are the profiles. docs has key and text."""
    kind, spark = docs.schema[key].dataType.simpleString(), docs.sparkSession
    out = docs.select(F.col(key).alias("key"), utf8().alias("text"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(None).cast("long").alias("distance"), F.lit(0).cast("long").alias("grams"))
    schema = f"key {kind}, text binary, lang_pred string, distance long, grams long"
    blocks = list(profile_blocks(found, size, limit)) or [{}]
    for nth, block in enumerate(blocks):
        if not block:
            continue
        last, shared = nth == len(blocks) - 1, spark.sparkContext.broadcast(block)

        def match(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            is_letter, ranks = letters(), Ranks(shared.value, size)
            for batch in batches:
                rows = []
                for text, lang, so_far in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    profile = ranked(*text_grams(text.as_py().decode("utf-8", "replace"), is_letter), size)
                    if len(profile):
                        distance, name = ranks.nearest(profile)
                        if so_far is None or distance < so_far:
                            so_far, lang = distance, name
                    rows.append((lang, so_far, len(profile)))
                texts = pa.nulls(len(rows), pa.binary()) if last else batch.column(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), texts, *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64())))], ["key", "text", "lang_pred", "distance", "grams"])

        out = out.mapInArrow(match, schema)
    score = F.when(F.col("grams") > 0, 1 - F.col("distance") / (F.col("grams") * F.lit(size))).otherwise(0.0)
    return out.select(F.col("key").alias(key), "lang_pred", F.coalesce(score, F.lit(0.0)).alias("score"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; profiles are of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    learnt = profiles(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, learnt).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
