"""Ranked search, cross-tokenizer alignment and language identification against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronoloom.llm import alignment, language, lengths, ranking
from tests.llm.conftest import ITEMS, documents
from tests.parity import assert_same

DOCS = documents()
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def by_text(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, str(x)) for x in r])


# --- ranked search ---------------------------------------------------------------


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked_by_hand(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    rows, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in held:
            m = 25 + 75 * sum(c.values()) * rows // total if total else 0
            score = sum(n * math.floor(1000 * math.log((2 * rows + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in Counter(terms(text)).items() if c[t])
            if score:
                found.append((-score, doc is None, doc, score))
        out += [(item, rank, doc, score) for rank, (_, _, doc, score) in enumerate(sorted(found, key=lambda f: f[:2] + (f[2] or 0,))[:k], 1)]
    return out


def test_op11_brute_force(spark, sf):
    want = ranked_by_hand([(r[0], r[1]) for r in DOCS], ITEMS)
    got = ranking.op11_ranking(spark, sf).select("item_id", "rank", "doc_id", "score").collect()
    assert want and by_text(got) == by_text(want)


def test_op11_sql_on_odd_rows(spark, sf):
    assert_same(ranking.op11_ranking(spark, sf), ranking.OP11_SQL.replace("ORDER BY score DESC, doc_id, r", "ORDER BY score DESC, doc_id NULLS LAST, r"), sf)


def test_op11_small_blocks_of_documents_and_items(spark, sf, monkeypatch):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    items = [(i, " ".join(rng.choice("abcdefghijz") for _ in range(rng.randint(0, 9)))) for i in range(25)]
    monkeypatch.setattr(ranking, "ITEMS", 4)
    monkeypatch.setattr(ranking, "TERMS", 7)
    index = ranking.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(40)).cache()
    assert index.filter("term IS NULL").count() > 10
    got = ranking.search(index, spark.createDataFrame(items, "item_id long, text string"), k=3).collect()
    assert by_text(got) == by_text(ranked_by_hand(docs, items, 3))


def test_op11_block_ends_by_documents_and_by_bytes(monkeypatch):
    import pyarrow as pa

    block = ranking.Block(3, 30)
    monkeypatch.setattr(ranking, "BLOCK_DOCS", 2)
    block.add(pa.array([1]), b"a b")
    assert not block.full()
    block.add(pa.array([2]), b"...")
    assert not block.full() and len(block.keys) == 1
    block.add(pa.array([3]), b"c")
    assert block.full()
    monkeypatch.setattr(ranking, "BLOCK_DOCS", 9)
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 4)
    assert block.full()


@pytest.mark.parametrize("seed", range(5))
def test_op11_sliced_arithmetic(seed):
    rng = np.random.default_rng(seed)
    docs = int(rng.integers(1, 300))
    adder, want = ranking.Adder(44, -(-docs // 64)), np.zeros(docs, np.int64)
    for _ in range(6):
        places = np.sort(rng.choice(docs, int(rng.integers(1, docs + 1)), replace=False))
        impact, factor = rng.integers(0, 1 << 20, len(places)), int(rng.integers(1, 9000))
        bits = np.concatenate([impact >> i & 1 for i in range(20)]).astype(np.uint8)
        adder.add(ranking.times(ranking.dense(places.astype("<u2").tobytes(), np.packbits(bits, bitorder="little").tobytes(), docs), factor))
        want[places] += impact * factor
    ordered = sorted([(i, int(n)) for i, n in enumerate(want) if n], key=lambda x: (-x[1], x[0]))
    for k in (1, 10, docs + 1):
        assert ranking.best(adder.total(), k) == ordered[:k]


# --- alignment -------------------------------------------------------------------


def aligned_by_hand(texts):
    """Per text: (n_a, n_b, groups, links as pairs of ids), whole texts encoded and byte ranges compared."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {c: i for c, i in alignment.byte_symbols().items()}
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelt = [bytes(back[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if any(b"".join(s) != (" " + text).encode() for s in spelt):
            out.append(None)
            continue
        ranges = []
        for tokens in spelt:
            ends = np.cumsum([len(t) for t in tokens]).tolist()
            ranges.append(list(zip([0, *ends[:-1]], ends, strict=True)))
        links, j = [], 0
        for i, (s, e) in enumerate(ranges[0]):
            while ranges[1][j][1] <= s:
                j += 1
            at = j
            while at < len(ranges[1]) and ranges[1][at][0] < e:
                links.append((ids[0][i], ids[1][at]))
                at += 1
        cuts = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups, before = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(x) for x, (s, e) in zip(side, r, strict=True) if before <= s and e <= cut) for side, r in zip(ids, ranges, strict=True)))
            before = cut
        out.append((len(ids[0]), len(ids[1]), groups, links))
    return out


SMALL = [r for r in DOCS if len(r[1] or "") < 3000]


def digests(rows):
    found = aligned_by_hand([r[1] for r in rows])
    counts = Counter(p for f in found if f for p in set(f[3]))
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    return [
        (r[0], len(range(f[0])), f[1], len(f[2]), len(f[3]), sum(counts[p] == top[p[0]] for p in f[3]), sum(counts[p] for p in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()) if f else (r[0], 0, 0, 0, 0, 0, 0, "")
        for r, f in zip(rows, found, strict=True)
    ]


@pytest.mark.parametrize("pairs", [1 << 21, 10])
def test_op12_brute_force(spark, tmp_path, pairs):
    odd = [(500, "a▁b"), (501, " two  spaces\r\nand\ttabs \n"), (502, "</s><s> \x00 <0x41>"), (503, "\n"), (504, " "), (505, "rare space 　 x\x85y"), (506, "\r"), (507, "🙂é" * 50)]
    rows = [(r[0], r[1]) for r in SMALL] + odd
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_a", "2 AS row", "3 AS codes", "4 AS groups").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = alignment.op12_alignment(spark, str(tmp_path), pairs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert by_text(got) == by_text(digests(rows))


def test_op12_chunks_align_as_whole_texts():
    rng, both = random.Random(1), alignment.Aligner()
    assert both.parts and both.ranked
    alphabet = [*"ab  e\n\r\t'.,;(){}é日▁<s>0\xa0  ß\x0b\x0c\x00\x85\x1c🙂ﬁ", "the ", " is\r\n", "<|endoftext|>", "</s>", "  ", "<0x41>"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14)))
        assert next(iter(both.texts([text]))) == both.align([f" {text}"])[0], repr(text)


def test_op12_long_texts_and_forgetting(monkeypatch):
    both = alignment.Aligner()
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    texts = ["a b c d e f", "x" * 200_000, " " * 120_000, "e f g h", "a x"]
    once = [next(iter(both.texts([t]))) for t in texts]
    assert list(both.texts(texts)) == once and [a.tokens for a in once] == [both.align([f" {t}"])[0].tokens for t in texts]


def test_op9_long_white_space_is_counted_as_the_tokenizer_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    for text in ["a" + " " * 20_000 + "b", " " * 300_000, "x\n" + "\n" * 15_000 + " y  z", "\u3000" * 12_000 + "q\xa0", "\t" * 12_000 + "w" + " " * 11_000]:
        assert lengths.token_length(text, lengths.byte_encoding(), {}) == len(whole.encode(text, add_special_tokens=False).ids)


def test_op12_other_coder_gives_the_same_ids():
    both = alignment.Aligner()
    for text in [" It's 3.14, isn't it?\n\n  naïve", " 日本語 🙂 \t x"]:
        assert both.ranked.encode_ordinary(text) == both.a.encode(text, add_special_tokens=False).ids


def test_op12_groups_as_text(spark):
    out = alignment.aligned(spark.createDataFrame([(1, "ab cd"), (2, None)], "doc_id long, text string"), with_groups=True).orderBy("doc_id").collect()
    assert out[0]["groups"] == ";".join(aligned_by_hand(["ab cd"])[0][2]) and out[1]["groups"] == ""


# --- language --------------------------------------------------------------------


def grams(text):
    counts = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" "):
        counts.update(word)
        for n in (2, 3):
            counts.update(f" {word} "[i : i + n] for i in range(len(word) + 3 - n) if word)
    return counts


def profile(counts, size=language.PROFILE):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], sum(ord(c) << 21 * (len(x[0]) - 1 - i) for i, c in enumerate(x[0]))))[:size]]


def test_op13_brute_force(spark, tmp_path):
    rng = random.Random(9)
    said = {"en": "the of and ing tion", "de": "der die und ung heit ß", "fr": "le la é tion eau", None: "zzz"}
    rows = [(i, "".join(rng.choice(said[lang].split()) + rng.choice(["", " ", ". ", "\n", "1"]) for _ in range(rng.randint(1, 60))), lang) for i in range(200) for lang in [rng.choice(list(said))]]
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 .. ²", "xx"), (903, "一", "zh"), (905, "w" * 3000, "en"), (None, "the of", "fr"), (7, rows[7][1], rows[7][2])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS key", "3 AS grams", "4 AS rank").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    learnt, want = defaultdict(Counter), []
    for key, text, lang in rows:
        if lang is not None and (key is None or zlib.crc32(str(key).encode()) % 5):
            learnt[lang] += grams(text)
    places = {lang: {g: i for i, g in enumerate(profile(c))} for lang, c in learnt.items() if c}
    for key, text, _ in rows:
        own = profile(grams(text))
        near = min((sum(abs(i - p[g]) if g in p else language.PROFILE for i, g in enumerate(own)), lang) for lang, p in places.items())
        want.append((key, key is not None and zlib.crc32(str(key).encode()) % 5 == 0, near[1] if own else "und", round(1 - near[0] / (len(own) * language.PROFILE), 9) if own else 0.0))
    got = language.op13_language(spark, str(tmp_path)).select("doc_id", "held_out", "lang_pred", "score").collect()
    assert by_text((*r[:3], round(r[3], 9)) for r in got) == by_text(want)


def test_op13_many_languages_in_blocks(spark):
    docs = spark.createDataFrame([(i, w * 5, lang) for i, (w, lang) in enumerate([("abc ", "a"), ("bcd ", "b"), ("cde ", "c"), ("abc ", "d")])], "doc_id long, text string, lang string")
    found = language.profiles(docs)
    for limit in (1, 800, 1 << 20):
        assert [tuple(r) for r in language.identify(docs, found, limit=limit).orderBy("doc_id").collect()] == [(0, "a", 1.0), (1, "b", 1.0), (2, "c", 1.0), (3, "a", 1.0)]


def test_op13_nothing_learnt(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language.identify(docs, language.profiles(docs)).collect()] == [(1, "und", 0.0)]


def test_op13_long_texts_in_parts(monkeypatch):
    is_letter, text = language.letters(), "ab cde, fgh i " * 50
    whole = language.text_grams(text, is_letter)
    parts = [language.text_grams(p, is_letter) for p in language.pieces(text, 7)]
    grams_, counts = language.summed(parts)
    assert "".join(language.pieces(text, 7)) == text and np.array_equal(grams_, whole[0]) and np.array_equal(counts, whole[1])


def test_op13_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = language.op13_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
