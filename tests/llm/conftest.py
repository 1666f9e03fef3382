import random

import pytest

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were".split()
BAD = "idiot moron scum trash".split()


def prose(rng, n, toxic=False):
    words = [rng.choice(WORDS) + rng.choice(["", "ing", "er", "tion"]) for _ in range(n)]
    if toxic:
        for _ in range(max(2, n // 20)):
            words[rng.randrange(n)] = rng.choice(BAD)
    return " ".join(words)


def documents():
    """(doc_id, text, lang, source, n_chars) with every odd case: nulls, empties, long words and texts, copies, repeated rows."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(5, 300), i % 4 == 0), "en", f"src{i % 5}") for i in range(160)]
    rows += [(200, None, None, None), (201, "", "en", "src0"), (202, " \n\t ", "en", "src1"), (203, "x" * 5000, "en", "src2"), (204, "日本語 テキスト\nです\nです", "ja", None)]
    rows += [(205, prose(rng, 20_000), "en", "src0"), (206, "one two", "en", "src3"), (207, "One TWO <|endoftext|> <|ENDOFTEXT|> it's 3.14 Ünï ☃", "en", "src3")]
    rows += [(300 + i, rows[7][1], "en", "src0") for i in range(30)] + [(7, rows[7][1], "en", "src2")]
    rows += [(None, "no id here", "en", "src4"), (None, None, "en", "src4"), (400, "a a a b " * 40, "en", "src4"), (401, "###$$ " * 60, "en", "src4")]
    return [(*r, len(r[1] or "")) for r in rows]


def labels():
    good = [(i, 1, int(i % 4 == 0)) for i in range(0, 160)]
    return [*good, (401, 0, 0), (400, 0, 0), (5, None, None), (None, 1, 1), (3, 1, 0), (9999, 1, 1)]


PAGES = [(i, f"http://h/{i} x", f"<p>{i % 7}</p>") for i in range(30)] + [(100, None, None), (101, "u", ""), (102, "u", None), (5, "http://h/5 x", "<p>5</p>"), (None, "u", "<p>5</p>"), (103, "u", "é\n\r\n\r\n" * 4000)]

ITEMS = [(1, "the having WAS, the the One"), (2, None), (3, ""), (4, "one two"), (5, "日本語 テキスト no-such-term"), (None, "id here"), (4, "xx b a"), (6, "it's 3.14 ünï Ünï ☃"), (7, "... ---")]


@pytest.fixture(scope="session")
def sf(spark, tmp_path_factory):
    """A folder of tables with odd rows and with columns whose names clash with the operators' own."""
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long")
    extra = docs.selectExpr("*", "'x' AS score", "1 AS size", "2 AS kept", "3 AS fp", "'t' AS target", "4 AS __size")
    extra.repartition(3).write.parquet(f"{d}/documents.parquet")
    marks = spark.createDataFrame(labels(), "doc_id long, quality int, toxic int")
    marks.selectExpr("*", "'x' AS text", "1 AS score", "true AS good", "2 AS __toxic").write.parquet(f"{d}/labels.parquet")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    pages.selectExpr("*", "1 AS key", "'z' AS payload", "'r' AS record", "3 AS refers_to").write.parquet(f"{d}/pages.parquet")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    items.selectExpr("*", "'x' AS term", "1 AS score", "2 AS doc_id", "3 AS rank").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="session")
def empty_sf(spark, sf, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d
