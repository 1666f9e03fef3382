import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoloom.functions import reply, text, vectors
from chronoloom.operators import chunking, folds, runs, segments, stretches, temporal

S = 1_000_000


def pick(spark, expr, kind, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_collapse_treats_nulls_as_equal_and_keeps_first(spark):
    rows = [("v", 1, 10, "a", None, None), ("v", 2, 20, "a", None, None), ("v", 3, 30, "a", "r", None), ("v", 4, 40, "a", None, None), ("w", 5, 5, None, None, None)]
    df = spark.createDataFrame(rows, "video string, ord long, t_us long, action string, resource string, location string")
    assert [r.ord for r in runs.collapse_runs(df).orderBy("ord").collect()] == [1, 3, 4, 5]


def test_ends_and_dwell(spark):
    df = spark.createDataFrame([("v", 1, 300 * S, "A"), ("v", 2, 750 * S, "B"), ("w", 3, 900 * S, None)], "video string, ord long, t_us long, app string")
    ends = spark.createDataFrame([("v", 800 * S), ("w", 100 * S)], "video string, timeline_end_us long")
    out = runs.with_ends(df, ends)
    assert [(r.end_us, r.duration_us) for r in out.orderBy("ord").collect()] == [(750 * S, 450 * S), (800 * S, 50 * S), (900 * S, 0)]
    assert {r.app: r.total_us for r in runs.dwell_by_app(out).collect()} == {"A": 450 * S, "B": 50 * S}
    none = runs.with_ends(df, ends.filter("false")).orderBy("ord").collect()
    assert [r.end_us for r in none] == [750 * S, None, None]


def test_nearest_takes_earlier_of_equals_and_respects_tolerance(spark):
    left = spark.createDataFrame([("v", 1, 10 * S), ("v", 2, 99 * S)], "video string, ord long, t_us long")
    right = spark.createDataFrame([("v", 7, 9 * S, "early"), ("v", 8, 11 * S, "late"), ("v", 9, 8 * S, "far")], "video string, ord long, t_us long, x string")
    out = temporal.nearest_within(left, right, S, ["x"]).orderBy("ord").collect()
    assert [r.near_x for r in out] == ["early", None]


def test_speech_before_first_entry_goes_to_it(spark):
    entries = spark.createDataFrame([("v", 1, 10 * S), ("v", 2, 20 * S), ("w", 3, 0)], "video string, ord long, t_us long")
    said = spark.createDataFrame([("v", 1, 1 * S, "a"), ("v", 2, 15 * S, "b"), ("v", 3, 16 * S, "b"), ("v", 4, 20 * S, "c"), ("x", 5, 1, "lost")], "video string, ord long, start_us long, text string")
    out = temporal.attach_speech(entries, said, F.col("text")).orderBy("ord").collect()
    assert [r.speech for r in out] == [["a", "b"], ["c"], []]


def test_overlap_is_inclusive(spark):
    left = spark.createDataFrame([("v", 1, 100 * S)], "video string, ord long, t_us long")
    right = spark.createDataFrame([("v", i, a * S, b * S) for i, (a, b) in enumerate([(0, 85), (0, 84), (115, 120), (116, 117), (0, 500)])], "video string, ord long, start_us long, end_us long")
    out = temporal.overlapping(left, right, 15 * S, F.col("ord").cast("string")).collect()
    assert out[0].texts == ["0", "4", "2"]


def test_speaker_guard_comes_after_choice(spark):
    said = spark.createDataFrame([("v", 1, 10 * S), ("v", 2, 20 * S), ("v", 3, 30 * S), ("v", 4, 1 * S)], "video string, ord long, start_us long")
    seen = spark.createDataFrame([("v", 5 * S, 1, ["A"], 2), ("v", 12 * S, 2, ["B"], 2), ("v", 19 * S, 3, ["C"], 9), ("v", 29 * S, 4, ["D", "E"], 1)], "video string, t_us long, ord long, names array<string>, line_count int")
    out = temporal.attributed(said, seen).orderBy("ord").collect()
    assert [r.speaker for r in out] == ["B", None, None, None]


def test_gate_truth_table():
    c, a, b = folds.GateConfig(), frozenset("abc"), frozenset("xyz")
    case = lambda now, tokens, last: folds.ChangeGate(c, *((last[0] * S, last[1]) if last else ())).selects(now * S, tokens)
    assert case(0, a, None)
    assert case(125, a, (0, a))
    assert not case(5, b, (0, a))
    assert case(20, frozenset(), (0, a))
    assert not case(20, frozenset("a"), (0, frozenset("b")))
    assert case(20, b, (0, a))
    assert not case(20, frozenset(range(20)), (0, frozenset(range(21))))


def test_folds_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(f"v{i % 3}", i, i * 7 * S, [rng.choice("abcdefg") for _ in range(rng.randint(0, 6))], rng.random() < 0.1) for i in range(200)]
    df = spark.createDataFrame(rows, "video string, ord long, t_us long, tokens array<string>, is_keyframe boolean").repartition(5)
    state, want = {}, {}
    for v, i, t, k, _ in rows:
        k = set(k)
        if v not in state or t - state[v][0] >= 120 * S:
            want[i] = True
        elif t - state[v][0] < 10 * S:
            want[i] = False
        elif not k or not state[v][1]:
            want[i] = bool(k) != bool(state[v][1])
        else:
            both = k | state[v][1]
            want[i] = len(both) >= 3 and len(k & state[v][1]) / len(both) < 0.85
        if want[i]:
            state[v] = (t, k)
    assert {r.ord: r.selected for r in folds.change_gate(df).collect()} == want
    got = folds.memo_skip(df, lambda one, many: [len(one) == len(x) for x in many], "tokens")
    last, source = {}, {}
    for v, i, _, k, key in rows:
        if v not in last or key or len(last[v][1]) != len(k):
            last[v] = (i, k)
        source[i] = last[v][0]
    assert {r.ord: r.source_ord for r in got.collect()} == source


@pytest.mark.parametrize("step", [1, 7, 55, 130, 900])
def test_gate_of_a_long_video_in_stretches_equals_one_loop(spark, step):
    rng, t, rows = random.Random(step), 0, []
    for i in range(400):
        t += rng.randint(0, 2 * step) * S
        rows.append((None if i % 2 else "v", i, t, [rng.choice("abcd") for _ in range(rng.randint(0, 5))]))
    rows += [("v", 500, None, ["a"]), ("v", 501, None, None), (None, 502, 3 * S, None)]
    df = spark.createDataFrame(rows, "video string, ord long, t_us long, tokens array<string>").repartition(5)
    want, gates = {}, {}
    for v, i, at, tokens in sorted(rows, key=lambda r: (r[2] is not None, r[2], r[1])):
        gate = gates.setdefault(v, folds.ChangeGate(folds.GateConfig()))
        want[i] = at is not None and gate.selects(at, tokens or ())
    assert {r.ord: r.selected for r in folds.change_gate(df, width=120 * S).collect()} == want
    assert {r.ord: r.selected for r in folds.change_gate(df).collect()} == want


def test_folds_of_one_video_use_many_tasks(spark):
    df = spark.range(4000).select(F.lit("v").alias("video"), F.col("id").alias("ord"), (F.col("id") * 30 * S).alias("t_us"), F.array(F.col("id").cast("string")).alias("tokens"), (F.col("id") % 100 == 0).alias("is_keyframe"))
    gate = folds.change_gate(df).withColumn("task", F.spark_partition_id())
    memo = folds.memo_skip(df, lambda one, many: [True] * len(many), "tokens").withColumn("task", F.spark_partition_id())
    assert gate.select("task").distinct().count() == memo.select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize(("alike", "keys"), [(lambda i: i, 10**9), (lambda i: 0, 10**9), (lambda i: i // 37, 10**9), (lambda i: 0, 2), (lambda i: i // 3, 50)])
def test_memo_compares_each_frame_a_few_times(spark, alike, keys):
    rows = [("v", i, i * S, i % keys == 0, alike(i)) for i in range(1, 2000)]
    compared = spark.sparkContext.accumulator(0)

    def similar(one, many):
        compared.add(len(many))
        return many == one

    got = folds.memo_skip(spark.createDataFrame(rows, "video string, ord long, t_us long, is_keyframe boolean, x long").repartition(5), similar, "x").collect()
    last, want = None, {}
    for _, i, _, key, x in rows:
        last = (i, x) if last is None or key or x != last[1] else last
        want[i] = last[0]
    assert {r.ord: r.source_ord for r in got} == want and compared.value < 3 * len(rows)


def test_rows_of_null_videos_and_times_stay(spark):
    rows = [("v", 1, 5 * S, "a"), ("v", 2, 9 * S, "b"), (None, 3, 1 * S, "a"), (None, 4, 4000 * S, "b"), ("v", 5, None, "c")]
    df = spark.createDataFrame(rows, "video string, ord long, t_us long, x string")
    assert sorted(r.ord for r in runs.collapse_runs(df, ["x"]).collect()) == [1, 2, 3, 4, 5]
    assert {r.ord: r.n for r in stretches.numbered(df, "n").collect()} == {3: 0, 4: 1, 5: 0, 1: 1, 2: 2}
    ends = spark.createDataFrame([("v", 20 * S), (None, 5000 * S)], "video string, timeline_end_us long")
    assert {r.ord: r.end_us for r in runs.with_ends(df, ends).collect()} == {5: 5 * S, 1: 9 * S, 2: 20 * S, 3: 4000 * S, 4: 5000 * S}
    found = temporal.as_of(df, spark.createDataFrame([(None, 0, 3 * S, "n"), ("v", 1, 6 * S, "m"), ("v", 2, None, "never")], "video string, ord long, t_us long, y string"), ["y"], 5 * S)
    assert {r.ord: (r["__back"] and r["__back"].y, r["__ahead"] and r["__ahead"].y) for r in found.collect()} == {1: (None, "m"), 2: ("m", None), 3: (None, "n"), 4: ("n", None), 5: (None, None)}
    # the same rows as plain windows over whole videos give
    w = Window.partitionBy("video").orderBy("t_us", "ord")
    plain = {r.ord: (r.n, r.e) for r in df.select("ord", (F.row_number().over(w) - 1).alias("n"), F.lead("t_us").over(w).alias("e")).collect()}
    assert {r.ord: r.n for r in stretches.numbered(df, "n").collect()} == {k: n for k, (n, _) in plain.items()}
    assert {r.ord: r["__after"] and r["__after"].t_us for r in stretches.beside(df, after=["t_us"]).collect()} == {k: e for k, (_, e) in plain.items()}


def test_chunks_tile_and_own_once(spark):
    d = spark.createDataFrame([("a", 3900 * S), ("b", 3600 * S), ("c", 10 * S)], "video string, duration_us long")
    out = chunking.chunk_spans(d, 1800 * S, 10 * S).orderBy("video", "k").collect()
    assert [(r.video, r.chunk_start // S, r.chunk_end // S, r.media_start // S, r.media_len // S) for r in out] == [
        ("a", 0, 1800, 0, 1810), ("a", 1800, 3600, 1790, 1820), ("a", 3600, 3900, 3590, 310), ("b", 0, 1800, 0, 1810), ("b", 1800, 3600, 1790, 1810), ("c", 0, 10, 0, 10),
    ]
    assert chunking.chunk_spans(d, 0).count() == 3


def test_segment_rules(spark):
    rows = [(0, " a ", -5, -9, 0.9, -2.0), (1, "  ", 0, 1, None, None), (2, "!", 0, 1, 0.01, -0.1), (3, "b", 3, 1, 0.9, None), (4, "c", 0, 1, None, -2.5), (5, "d", 0, 1, 0.6, -2.0), (6, "はい", 0, 1, None, None), (7, "ﾊｲ。", 0, 1, None, None)]
    df = spark.createDataFrame(rows, "ord long, text string, start_us long, end_us long, no_speech_prob double, avg_logprob double")
    assert {r.ord for r in segments.reliable(df).collect()} == {3, 5, 7}
    assert {r.ord for r in segments.reliable(df, remove_fillers=False).collect()} == {3, 5, 6, 7}
    out = {r.ord: (r.text, r.start_us, r.end_us) for r in segments.normalized(df).collect()}
    assert out[0] == ("a", 0, 0) and out[3] == ("b", 3, 3) and 1 not in out


def test_asr_dialects(spark):
    import json

    cpp = json.dumps({"transcription": [{"offsets": {"from": 0, "to": 2720}, "text": "x", "tokens": [{"text": "[_BEG_]", "p": 0.1}, {"text": "a", "p": 0.5}, {"text": "b", "p": 0}]}]})
    row = segments.from_cpp_json(spark.createDataFrame([("v", cpp)], "video string, r string"), "r").first()
    assert (row.start_us, row.end_us, round(row.avg_logprob, 4)) == (0, 2_720_000, -0.6931)
    plain = json.dumps({"segments": [{"start": 1.5, "end": 2, "text": "y", "no_speech_prob": 0.1}]})
    row = segments.from_dict_json(spark.createDataFrame([("v", plain)], "video string, r string"), "r").first()
    assert (row.start_us, row.end_us, row.text, row.avg_logprob) == (1_500_000, 2_000_000, "y", None)


def test_unicode_space(spark):
    assert pick(spark, text.strip, "string", "　a\t", "\x1c b \x85", " ", None) == ["a", "b", "", None]


def test_urls(spark):
    long = "https://example.com/" + "a" * 60
    assert pick(spark, text.sanitize_url, "string", "https://a.jp/x?q=1#z", "https://a.jp/x.,", long) == ["https://a.jp/x", "https://a.jp/x", long[:59] + "…"]
    assert pick(spark, text.url_domain, "string", "https://a.jp/x", "a.jp/x", "nodot/x") == ["a.jp", "a.jp", None]


def test_names(spark):
    assert pick(spark, text.person_name, "string", "田中太郎", "二村紀花（ニムラノリカ）", "田中さん", "AB", "HD", "ABC", "参加者", "会議の資料", "", "さん") == ["田中太郎", "二村紀花", "田中", "AB", None, None, None, None, None, None]


def test_formats(spark):
    assert pick(spark, text.hms, "double", 3723.9, 360000.0) == ["01:02:03", "100:00:00"]
    assert pick(spark, text.duration_ja, "double", 0.0, 45.0, 450.0, 3720.0, 3600.0) == ["0秒", "45秒", "7分30秒", "1時間2分", "1時間"]


def test_replies(spark):
    got = pick(spark, reply.parsed, "string", '```json\n{"app_guess": " X ", "action": "none"}\n```', '{"focus": "f", "action": "do', "text", "[1]", None)
    assert [(r.app_guess, r.focus, r.action) for r in got] == [("X", None, reply.FALLBACK_ACTION), (None, "f", reply.FALLBACK_ACTION), (None, None, "text"), (None, None, "[1]"), (None, None, reply.FALLBACK_ACTION)]


def test_stretches_equal_whole_videos(spark):
    rng = random.Random(7)
    rows = sorted({("v" if rng.random() < 0.7 else "w", rng.randrange(40) * 1000 * S) for _ in range(300)})
    rows = [(v, i, t, rng.choice("ab")) for i, (v, t) in enumerate(rows)] + [(None, 900, 5, "a")]
    df = spark.createDataFrame(rows, "video string, ord long, t_us long, x string")
    got = {r.ord: (r["__before"], r["__after"]) for r in stretches.beside(df, before=["ord", "x"], after=["ord"], width=3_000 * S).filter("video IS NOT NULL").collect()}
    nth = {r.ord: r.n for r in stretches.numbered(df, "n", width=3_000 * S).collect()}
    for v in "vw":
        own = [r for r in rows if r[0] == v]
        for n, r in enumerate(own):
            before, after = got[r[1]]
            assert nth[r[1]] == n
            assert (before and tuple(before)) == ((own[n - 1][1], own[n - 1][3]) if n else None)
            assert (after and after.ord) == (own[n + 1][1] if n + 1 < len(own) else None)
    assert nth[900] == 0 and len(nth) == len(rows)


def test_as_of_over_empty_stretches(spark):
    left = spark.createDataFrame([("v", 1, 0), ("v", 2, 9 * 3600 * S), ("v", 3, 9 * 3600 * S + 5), ("w", 4, 1)], "video string, ord long, t_us long")
    right = spark.createDataFrame([("v", 7, 10, "a"), ("v", 8, 3600 * S - 1, "b"), ("v", 9, 20 * 3600 * S, "c")], "video string, ord long, t_us long, x string")
    out = temporal.as_of(left, right, ["x"], forward_us=11 * 3600 * S - 3).orderBy("ord").collect()
    assert [(r["__back"] and r["__back"].x, r["__ahead"] and r["__ahead"].x) for r in out] == [(None, "a"), ("b", None), ("b", "c"), (None, None)]


def test_overlap_without_margin_and_with_long_intervals(spark):
    left = spark.createDataFrame([("v", i, t) for i, t in enumerate([0, 5, 10**9, 10**12])], "video string, ord long, t_us long")
    spans = [(0, 0), (5, 4), (3, 10**12), (0, 10**15), (10**9, 10**9 + 1), (6, 10**9 - 1)]
    right = spark.createDataFrame([("v", i, a, b) for i, (a, b) in enumerate(spans)], "video string, ord long, start_us long, end_us long")
    for margin in (0, 1, 1000):
        out = temporal.overlapping(left, right, margin, F.col("ord").cast("string")).orderBy("ord").collect()
        for r in out:
            want = sorted((a, i) for i, (a, b) in enumerate(spans) if a <= r.t_us + margin and b >= r.t_us - margin)
            assert r.texts == [str(i) for _, i in want]


def test_keyframes_only(spark):
    frames = spark.createDataFrame([("v", 1, True), ("v", 2, False), ("v", 3, None)], "video string, ord long, is_keyframe boolean")
    out = folds.keyframes_only(frames, lambda f: f.withColumn("lines", F.array(F.lit("x")))).orderBy("ord").collect()
    assert [r.lines for r in out] == [["x"], [], []]


@pytest.mark.parametrize(("held", "k"), [(1 << 21, 3), (50, 3), (50, 1), (50, 500)])
def test_top_k_equals_brute_force_with_ties(spark, monkeypatch, held, k):
    rng = np.random.default_rng(5)
    base = rng.integers(-2, 3, (40, 3)).astype(float)
    rows = [(f"d{i:03}", [float(x) for x in base[i % 40]]) for i in rng.permutation(300).tolist()] + [("none", None), (None, [1.0, 0.0, 0.0])]
    asked = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(25)] + [(99, None)]
    monkeypatch.setattr(vectors, "HELD", held)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(vectors, "BLOCK_DOCUMENTS", 13)
    monkeypatch.setattr(vectors, "QUERY_BYTES", 24 * 10)
    out = vectors.top_k(spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(4), spark.createDataFrame(asked, "query_id long, query_vector array<double>"), k).collect()
    one = lambda v: np.array(v) / max(np.sqrt(np.dot(v, v)), 1e-12)
    want = []
    for q, v in asked[:-1]:
        found = sorted((-round(float(one(v) @ one(x)), 12) + 0.0, i) for i, x in rows if x is not None and i is not None)
        want += [(q, i, rank, -s) for rank, (s, i) in enumerate(found[:k], 1)]
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in out) == sorted(w[:3] for w in want)
    assert all(abs(dict(((w[0], w[1]), w[3]) for w in want)[r.query_id, r.vec_id] - r.score) < 1e-9 for r in out)


def test_top_k_of_nothing_and_wrong_dimensions(spark):
    docs, asked = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>"), spark.createDataFrame([(1, [1.0, 0.0, 2.0])], "query_id long, query_vector array<double>")
    assert vectors.top_k(docs, asked.limit(0), 3).count() == vectors.top_k(docs, asked, 0).count() == 0
    with pytest.raises(Exception, match="dimension"):
        vectors.top_k(docs, asked, 1).collect()
    with pytest.raises(ValueError):
        vectors.top_k(docs, asked, -1)


def test_histogram_counts_each_difference(spark):
    rows = [([0, 255, 7, 7], [0, 0, 9, 5]), ([], []), (None, [1]), ([3], [1, 2])]
    out = spark.createDataFrame(rows, "a array<int>, b array<int>").coalesce(1).select(vectors.difference_histogram("a", "b").alias("h"))
    got = [r.h and {i: n for i, n in enumerate(r.h) if n} for r in out.collect()]
    assert got == [{0: 1, 255: 1, 2: 2}, {}, None, {2: 1}]
    assert out.select(vectors.histogram_mean(F.col("h"))).first()[0] == pytest.approx(259 / 4 / 255)


def test_a_block_of_documents_leaves_few_candidates():
    rng = np.random.default_rng(1)
    scores = np.round(rng.random((40, 900)), 2)
    scores[:, 7] = np.nan
    best = vectors.Best(40, 5, parts=4)
    for at in (0, 450):
        best.see(scores[:, at : at + 450], np.arange(at, at + 450).astype(object))
    assert best.size < 40 * 40 and best.room * 4 <= vectors.HELD
    best.settle()
    for q in range(40):
        want = sorted((-s, i) for i, s in enumerate(scores[q].tolist()) if s == s)[:5]
        assert sorted(zip((-best.score[best.query == q]).tolist(), best.ids[best.query == q].tolist(), strict=True)) == want
