"""Every operator's query against brute force over a table of odd rows, and over empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import common, gif, graph, lattice, lengths, mixing, packing, quality, registry, sharding, simhash, toxicity, warc
from tests.llm.conftest import PAGES, documents, labels, prose
from tests.parity import assert_same

DOCS = documents()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_empty_tables(spark, empty_sf, name):
    assert registry.QUERIES[name](spark, empty_sf).count() == 0


@pytest.mark.parametrize("name", list(registry.SQL))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert_same(registry.QUERIES[name](spark, sf), registry.SQL[name], sf)


# --- shared ----------------------------------------------------------------------


def test_intermediate_tables_are_removed(spark, sf):
    import glob

    place = common.shared_dir(spark).removeprefix("file://")
    quality.op5_quality(spark, sf).collect()
    assert glob.glob(f"{place}/*")
    kept = common.concluded(spark, lambda: simhash.op2_simhash(spark, sf), "kept")
    common.release(spark, [kept._chronoloom_path])
    assert [p for p in glob.glob(f"{place}/*")] == [kept._chronoloom_path.removeprefix("file://")] and kept.count() == len(DOCS)
    common.discard(kept)
    assert not glob.glob(f"{place}/*")


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "app"
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert common.shared_dir(Session()) == "hdfs://x/y/chronoloom-app"


# --- op1 --------------------------------------------------------------------------


def test_op1_round_trip(spark, sf):
    want = Counter()
    for i, text, *_ in DOCS:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    got = gif.op1_gif(spark, sf).collect()
    text = {}
    for i, t, *_ in DOCS:
        text.setdefault(i, (t or "").encode())
    for r in got:
        if r.doc_id in text and (r.doc_id != 7 and r.doc_id is not None):
            payload = gif.padded(text[r.doc_id])
            bins = ",".join(str(sum(b >> 4 == k for b in payload)) for k in range(16))
            frames = -(-len(payload) // (192 * 320))
            assert r.feature == f"frames={frames};ms={frames * 40};r={bins};g={bins};b={bins}"
            media = gif.encode_gif(payload)
            assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({r.media_sha256 for r in got}) == len({r.payload_sha256 for r in got})


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 5000, bytes(range(256)) * 40, random.Random(1).randbytes(70_000), b"\0" * 100_000])
def test_lzw(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data
    low = bytes(b & 3 for b in data)
    assert gif.lzw_decode(gif.lzw_encode(low, 2), 2, len(low)) == low


def build(frames, width=4, height=4, shared=b"\x00\x00\x00\xff\x00\x00\x00\xff\x00\x00\x00\xff"):
    import struct

    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x81, 0, 0), shared]
    for left, top, w, h, samples, disposal, delay, hidden, interlaced, own in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (hidden is not None), delay, hidden or 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, left, top, w, h, (0x40 if interlaced else 0) | (0x81 if own else 0)) + (own or b""))
        out.append(b"\x02" + gif.blocks(gif.lzw_encode(bytes(samples), 2)))
    return b"".join([*out, b"\x3b"])


def test_disposal_transparency_and_time():
    full, dot = [1] * 16, [2, 0, 0, 2]
    frames = list(gif.decode_gif(build([(0, 0, 4, 4, full, 1, 10, None, False, None), (1, 1, 2, 2, dot, 3, 5, 0, False, None), (0, 0, 1, 1, [3], 2, 7, None, False, None), (3, 3, 1, 1, [2], 0, 1, None, False, None)])))
    assert [(f.start_ms, f.delay_ms) for f in frames] == [(0, 100), (100, 50), (150, 70), (220, 10)]
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert frames[1].rgba[1, 1].tolist() == green and frames[1].rgba[1, 2].tolist() == red  # hidden samples show what lies below
    assert frames[2].rgba[1, 1].tolist() == red and frames[2].rgba[0, 0].tolist() == blue  # restored to previous
    assert frames[3].rgba[0, 0].tolist() == [0, 0, 0, 0] and frames[3].rgba[3, 3].tolist() == green  # cleared
    assert gif.colour_histogram(frames[0].rgba)[0].tolist() == [0] * 15 + [16]


def test_interlace_and_own_palette():
    rows = [r for a, s in gif.PASSES for r in range(a, 4, s)]
    frames = list(gif.decode_gif(build([(0, 0, 1, 4, [r % 4 for r in rows], 0, 0, None, True, b"\x01\x01\x01\x02\x02\x02\x03\x03\x03\x04\x04\x04")], 1, 4)))
    assert frames[0].samples.ravel().tolist() == [0, 1, 2, 3] and frames[0].rgba[:, 0, 0].tolist() == [1, 2, 3, 4]


def test_broken_images_are_rows(spark):
    good = gif.encode_gif(b"x" * 192)
    huge = b"GIF89a\xff\xff\xff\xff\x80\x00\x00" + bytes(6) + b"\x3b"
    wide = b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + bytes(6) + b"\x2c\x00\x00\x00\x00\xff\xff\xff\xff\x00\x02\x00\x3b"
    strange = b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + bytes(6) + b"\x2c\x00\x00\x00\x00\x01\x00\x01\x00\x00\x0c\x01\x00\x00\x3b"
    images = [good, good[:-30], None, b"GIF89a", huge, wide, strange, build([(0, 0, 4, 4, [1] * 16, 0, 0, None, False, None)])[:-1]]
    df = spark.createDataFrame([(i, m and bytearray(m)) for i, m in enumerate(images)], "id long, m binary")
    out = defaultdict(list)
    for r in gif.timed_frames(df, "id", "m").collect():
        out[r.key].append((r.frame, r.error))
    assert out[0] == [(0, None)] and all(len(out[k]) == 1 and out[k][0][1] for k in range(1, 7))
    assert "65535 x 65535" in out[4][0][1] and "65535 x 65535" in out[5][0][1]
    assert [f for f, _ in out[7]] == [0, None] and out[7][1][1]  # the frame before the break stays


def test_images_made_elsewhere():
    # two files published with descriptions of the format: 10 x 10 in four colours, and a transparent pixel
    sample = bytes.fromhex("4749463839610A000A00910000FFFFFFFF00000000FF00000021F90400000000002C000000000A000A00000216" + "8C2D99872A1CDC33A00275EC95FAA8DE608C04914C01003B")
    (frame,) = gif.decode_gif(sample)
    rows = [[1] * 5 + [2] * 5] * 3 + [[1] * 3 + [0] * 4 + [2] * 3] * 2 + [[2] * 3 + [0] * 4 + [1] * 3] * 2 + [[2] * 5 + [1] * 5] * 3
    assert frame.samples.tolist() == rows
    assert frame.rgba[0, 0].tolist() == [255, 0, 0, 255] and frame.rgba[0, 9].tolist() == [0, 0, 255, 255] and frame.rgba[4, 4].tolist() == [255, 255, 255, 255]
    pixel = bytes.fromhex("47494638396101000100800000000000FFFFFF21F90401000000002C00000000010001000002024401003B")
    (frame,) = gif.decode_gif(pixel)
    assert frame.rgba.tolist() == [[[0, 0, 0, 0]]]


# --- op2 --------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    w = words(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values):
    """{value: smallest value reachable}, over links of at most 3 bits."""
    above = {v: v for v in values}

    def top(v):
        while above[v] != v:
            v = above[v]
        return v

    ordered = sorted(values)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 3 and top(a) != top(b):
                above[max(top(a), top(b))] = min(top(a), top(b))
    return {v: top(v) for v in values}


def test_op2_brute_force(spark, sf):
    fps = [(i, brute_fingerprint(t)) for i, t, *_ in DOCS]
    root = brute_components({f for _, f in fps})
    least = defaultdict(lambda: math.inf)
    for i, f in fps:
        least[root[f]] = min(least[root[f]], math.inf if i is None else i)
    want = Counter((i, f"{f:016x}", None if least[root[f]] == math.inf else least[root[f]]) for i, f in fps)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op2_simhash(spark, sf).collect()) == want


def test_op2_links_at_every_distance(spark):
    rng = random.Random(2)
    values = set()
    for _ in range(150):
        base = rng.getrandbits(64)
        values.add(base)
        for d in (1, 2, 3, 4, 3, 3):
            values.add(base ^ sum(1 << b for b in rng.sample(range(64), d)))
    root = brute_components(values)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    df = spark.createDataFrame([(s, v % 10**15) for v, s in signed.items()], "fp long, ident long")
    ids = defaultdict(list)
    for v in values:
        ids[root[v]].append(v % 10**15)
    got = {r.fp: r.group_id for r in simhash.grouped(df, "ident").collect()}
    assert got == {s: min(ids[root[v]]) for v, s in signed.items()}


def test_spread_join_equals_a_join(spark):
    rows = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(5000)], "k long, v long")
    named = rows.groupBy("k").agg(F.count("*").alias("__n"), F.min("v").alias("m")).filter("k % 2 = 1")
    want = Counter((r.k, r.v, r.m) for r in rows.join(named.drop("__n"), "k").collect())
    for salt in (F.monotonically_increasing_id(), F.xxhash64("v")):
        joined = common.spread_join(rows, named, "k", salt)
        assert joined.columns == ["k", "v", "m"] and Counter(map(tuple, joined.collect())) == want


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5), (5, 5), (None, 3), (61, 60)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(62)} | {1000 + i: 1000 for i in range(50)}


def test_components_broadcast_little(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)]
    edges = spark.createDataFrame(edges, "a long, b long")

    def broadcasts():
        return spark.sparkContext.broadcast(0)._jbroadcast.id()

    first = broadcasts()
    graph.components(edges).count()
    assert broadcasts() - first < 140  # each takes 4 MB of the driver's heap; with hubs broadcast in every join there were over 200

# --- op3 --------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, held = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in held]
        rest = total - sum(2 * sizes[s] for s in held)
        level = rest / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in held else level * weight[s] for s in order}
        held |= above


def test_op3_targets_and_copies(spark, sf):
    size = defaultdict(int)
    for _, t, _, s, _ in DOCS:
        size[s] += len(words(t))
    target = brute_targets(size)
    got = mixing.op3_mixing(spark, sf).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(words(t))) for i, t, *_ in DOCS)
    taken, spread = Counter(), Counter()
    for r in got:
        source = next(s for s, v in size.items() if v == r.source_size)
        assert abs(r.target - target[source]) < 1e-6 and r.taken <= 2 * r.size
        rate = r.target / r.source_size if r.source_size else 0
        assert r.size == 0 or r.taken // r.size in (math.floor(rate), math.ceil(rate))
        taken[source] += r.taken
        spread[source] += rate % 1 * (1 - rate % 1) * r.size**2
    for s in size:
        assert abs(taken[s] - target[s]) <= 4 * math.sqrt(spread[s])
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.op3_mixing(spark, sf).collect()), key=str)


def test_op3_draws_each_document_by_itself(spark):
    rows = [(i, "a b c " * (1 + i % 7), f"s{i % 3}") for i in range(3000)]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string, source string")

    def copies(r, goals):
        out = mixing.with_copies(frame(r).withColumn("__size", mixing.words_in()), goals)
        return {x.doc_id: x["__copies"] for x in out.collect()}

    goals = mixing.rates(frame(rows).withColumn("__size", mixing.words_in()))
    whole = copies(rows, goals)
    rate = {r["__source"]: r["__rate"] for r in goals[0].collect()}
    for s in range(3):
        own = [c for i, c in whole.items() if i % 3 == s]
        f = rate[f"s{s}"]
        assert abs(sum(own) / len(own) - f) < 4 * math.sqrt(f % 1 * (1 - f % 1) / len(own)) + 1e-9
    # neither fewer documents nor the join for many sources changes a draw
    assert copies(rows[::5], goals) == {i: c for i, c in whole.items() if i % 5 == 0}
    assert copies(rows, (goals[0], mixing.BROADCAST_ROWS + 1)) == whole


# --- op4 --------------------------------------------------------------------------


def test_op4_tiles_documents_and_sequences(spark, sf):
    tokenizer = packing.word_tokenizer()
    want = Counter()
    for i, t, *_ in DOCS:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i, len(ids), ids.tobytes()] += 1
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.packed(docs).collect()
    bins, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        bins[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    total = padding = 0
    for own in bins.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= 2048
        total, padding = total + end, padding + (0 if end.bit_count() == 1 else 2048 - end)
    assert padding < 0.02 * total
    for (i, n), pieces in parts.items():
        copies = sum(c for (a, b, _), c in want.items() if (a, b) == (i, n))
        assert sum(len(x) for _, x in pieces) == 4 * n * copies
        if copies == 1:
            ids = next(d for a, b, d in want if (a, b) == (i, n))
            assert b"".join(x for _, x in sorted(pieces)) == ids
    assert set(parts) == {(i, n) for i, n, _ in want}


def test_op4_ids_of_odd_words():
    tokenizer, rng = packing.word_tokenizer(), random.Random(6)
    marks = ["H\u0331 h\u0331", "J\u030c", "T\u0344", "W\u030a w\u030a", "The A\u0301 THE"]  # composed only when small
    signs = ["it's", "it'.", "we'll'll", "a.b.", "3.14,", "\u2603.", "\u2603\u2603%%", "\u0130.", "\u0130", "stra\u00dfe!?", "\u00f7.", "caf\u00e9&&&", "cafe\u0301.", "\u00aa,", "\u0153uf.", "...", "<|x|>", "<|EndOfText|>", "a\u00a0b.", "a\x1cb,", "\u65e5\u672c."]
    letters = [f"a{chr(c)}. {chr(c)}, {chr(c)}x{chr(c)}%% X{chr(c)}" for c in range(1, 0x600)]
    mixed = ["".join(rng.choice("abE\u00e9\u00df\u0331'.%1 \n") for _ in range(40)) for _ in range(300)]
    texts = ["", " \n", *marks, *signs, *letters, *mixed]
    known = {}
    for _ in range(2):  # new words, then known ones
        found = packing.encode([t.encode() for t in texts], tokenizer, known, 7)
        wrong = [t for t, ids in zip(texts, found, strict=True) if ids.tolist() != [*tokenizer.encode(t, add_special_tokens=False).ids, 7]]
        assert not wrong
    broken = b"ab\xff. \xc3 caf\xc3"
    assert packing.encode([broken], tokenizer, known)[0].tolist() == [*tokenizer.encode(broken.decode("utf-8", "replace"), add_special_tokens=False).ids, 1]


def test_op4_letters_are_coded_once(monkeypatch):
    tokenizer, known, coded = packing.word_tokenizer(), {}, []
    learn = packing.learn
    monkeypatch.setattr(packing, "learn", lambda words, t: coded.extend(words) or learn(words, t))
    packing.encode([b"these those", b"These. those,%% these&&&", b"x" * 5000], tokenizer, known)
    packing.encode([b"THOSE?! these"], tokenizer, known)
    assert sorted(coded) == sorted([b"these", b"those", b"x" * 5000, b"", b".", b",%%", b"&&&", b"?!"])
    assert max(map(len, known)) < 5000
    monkeypatch.setattr(packing, "REMEMBERED", 9)
    want = packing.encode([b"a b c d e f g"], tokenizer, {})
    assert packing.encode([b"a b c d e f g"], tokenizer, known)[0].tolist() == want[0].tolist()
    assert len(known) <= 9 and set(b"abcdefg") <= {w[0] for w in known if w}


def test_classes_hold_fixed_counts():
    placed = []
    p = packing.Packer(lambda s, o, piece: placed.append((s, o, len(piece[2]))))
    for n in [1024] * 3 + [600] * 4 + [100] * 45:
        p.add((0, 0, np.zeros(n, "<u4")))
    full = Counter(s for s, _, _ in placed)
    assert sorted(full.values()) == [2, 3, 20, 20]
    p.finish()
    assert sum(n for _, _, n in placed) == 3 * 1024 + 4 * 600 + 4500
    assert packing.cut(3000) == [2048, 512, 256, 128, 56] and packing.cut(1) == [1]


# --- op5 --------------------------------------------------------------------------


def test_op5_base_measures(spark, sf):
    want = Counter()
    for i, t, *_ in DOCS:
        w, t = words(t), t or ""
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        times = Counter(windows)
        covered = {j + k for j, x in enumerate(windows) if times[x] > 1 for k in range(3)}
        lines, seen = 0, set()
        for x in t.split("\n"):
            if words(x):
                lines += x in seen
                seen.add(x)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), lines, len(covered), failed] += 1
    got = quality.op5_quality(spark, sf).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_op5_parts_labelled_documents(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, prose(rng, 120) if i % 3 else " ".join(w.upper() + "!!" for w in prose(rng, 120).split())) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    got = quality.judged(docs, labels).collect()
    assert all(r.kept == (r.doc_id % 3 > 0) for r in got if not r.base_failed)
    assert {r.doc_id for r in quality.keep(docs, labels).collect()} == {r.doc_id for r in got if r.kept}
    assert all(r.kept != r.base_failed for r in quality.judged(docs, labels.limit(0)).collect())


def test_op5_ratio_and_threshold_equal_brute_force(spark, sf):
    known = {}

    def bucket(*tokens):
        if tokens not in known:
            single, pairs, _ = quality.ngram_buckets([b" ".join(tokens)])
            known[tokens] = int(single[0] if len(tokens) == 1 else pairs[0])
        return known[tokens]

    def grams(t):
        found = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\x20\x09-\x0D]+", (t or "").encode())
        return [bucket(x) for x in found] + [bucket(a, b) for a, b in zip(found, found[1:], strict=False)]

    marks = defaultdict(list)
    for i, q, _ in labels():
        if i is not None and q is not None:
            marks[i].append(q)
    good = {i: min(q) == 1 for i, q in marks.items()}
    corpus, trusted, own = Counter(), Counter(), []
    for i, t, *_ in DOCS:
        own.append((i, grams(t)))
        corpus.update(own[-1][1])
        if good.get(i):
            trusted.update(own[-1][1])
    size = 1 << quality.BUCKET_BITS
    share = lambda c, b: (c[b] + quality.SMOOTHING) / (sum(c.values()) + quality.SMOOTHING * size)
    ratio = {b: math.log(share(trusted, b)) - math.log(share(corpus, b)) for b in corpus}
    score = defaultdict(list)
    for i, g in own:
        score[i].append(sum(ratio[b] for b in g) / max(len(g), 1))
    got = quality.judged(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert all(any(math.isclose(r.score, s, abs_tol=1e-7) for s in score[r.doc_id]) for r in got)
    # the threshold: every step tried, the middle of the longest run of best ones
    rated = [(r.score, good[r.doc_id]) for r in got if not r.base_failed and r.doc_id in good]
    if {g for _, g in rated} == {True, False}:
        steps = [math.floor(s * quality.STEPS_PER_UNIT) for s, _ in rated]
        n = Counter(g for _, g in rated)
        value = {k: sum((s >= k) / n[True] if g else (s < k) / n[False] for s, (_, g) in zip(steps, rated, strict=True)) for k in range(min(steps), max(steps) + 2)}
        best = {k for k, v in value.items() if math.isclose(v, max(value.values()))}
        assert round(got[0].threshold * quality.STEPS_PER_UNIT) in best
        assert all(r.kept == (not r.base_failed and r.score >= r.threshold) for r in got)


def test_threshold_equals_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, rng.gauss(0.5 if i % 3 else -0.2, 0.3), i % 11 == 0) for i in range(400)]
    scores = spark.createDataFrame(rows, "doc_id long, score double, base_failed boolean")
    marks = spark.createDataFrame([(i, bool(i % 3)) for i in range(0, 400, 2)], "doc_id long, good boolean")
    rated = [(math.floor(s * quality.STEPS_PER_UNIT), bool(i % 3)) for i, s, f in rows if not f and i % 2 == 0]
    n = Counter(g for _, g in rated)
    value = {k: round(sum((s >= k) / n[True] if g else (s < k) / n[False] for s, g in rated), 9) for k in range(min(rated)[0], max(rated)[0] + 2)}
    runs, run = [], []
    for k in sorted(value):
        if value[k] == max(value.values()):
            run.append(k)
        elif run:
            runs.append(run)
            run = []
    run = max([*runs, run], key=len)
    assert quality.best_threshold(scores, marks) == run[len(run) // 2] / quality.STEPS_PER_UNIT
    assert quality.best_threshold(scores, marks.filter("good")) is None


def test_ngram_counts_equal_a_loop(spark, sf):
    texts = [(t or "").encode() for _, t, *_ in DOCS]
    want = Counter()
    for t in texts:
        found = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\x20\x09-\x0D]+", t)
        want.update(found)
    single, _, at = quality.ngram_buckets(texts, 30)
    assert len(single) == sum(want.values()) and len(np.unique(single)) == len(want)
    assert at[-1] == len(single)
    assert quality.ngram_counts(spark.read.parquet(f"{sf}/documents.parquet")).sum() == sum(2 * n - 1 for n in np.diff(at) if n)


# --- op6 --------------------------------------------------------------------------


def test_op6_brute_force(spark, sf):
    first = {}
    for i, _, html in PAGES:
        h = html or ""
        first[h] = max(first.get(h, -1), -1 if i is None else i)
    got = warc.op6_arc_to_warc(spark, sf).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len((h or "").encode()), warc.sha1_base32((h or "").encode())) for i, _, h in PAGES)
    by = defaultdict(list)
    for r in got:
        by[r.payload_digest].append(r)
    for rows in by.values():
        best = [r for r in rows if r.record_type == "response"]
        assert len(best) == 1 and best[0].refers_to is None
        assert all(r.refers_to == best[0].page_id for r in rows if r.record_type == "revisit")
        assert best[0].page_id == max(-1 if r.page_id is None else r.page_id for r in rows)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("zipped", [True, False])
def test_arc_versions(version, zipped):
    pack = warc.member if zipped else bytes
    bodies = [warc.http_response("é".encode(), 3), b"no http\n\nat all", b""]
    content = pack(warc.arc_version_block(version, "a.arc")) + b"".join(pack(warc.arc_record(version, "a.arc", 9, "http://x/ y", b)) for b in bodies)
    found = list(warc.read_arc(content))
    assert [r.content for r in found[1:]] == bodies and {r.version for r in found} == {version}
    assert found[1].fields["URL"] == "http://x/%20y" and len(found[1].fields) == len(warc.ARC_FIELDS[version])
    made = [warc.synthesised("a.arc", r) for r in found]
    assert [m.headers["WARC-Type"] for m in made] == ["warcinfo", "response", "resource", "resource"]
    assert made[1].headers["WARC-Date"] == "2020-01-01T00:00:00Z" and len({m.headers["WARC-Record-ID"] for m in made}) == 4
    again = list(warc.read_warc(b"".join(warc.warc_bytes(m) for m in made)))
    assert [(a.headers, a.block) for a in again] == [(m.headers, m.block) for m in made]
    for broken in (content[: len(content) // 2], b"x y z\n"):
        with pytest.raises(ValueError):
            list(warc.read_arc(broken))


def test_op6_sql_on_repeated_page_ids(spark, tmp_path):
    rows = [(5, "u", "x"), (5, "u", "x"), (4, "u", "x"), (None, "u", "x"), (7, "u", None), (7, "u", ""), (None, "u", "y")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert_same(warc.op6_arc_to_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), warc.OP6_SQL, str(tmp_path))


def test_op6_pages_with_the_url_of_a_version_block(spark):
    pages = spark.createDataFrame([(1, "filedesc://x", b"<p>a</p>"), (2, "http://h/2", b"<p>a</p>")], "key long, url string, payload binary")
    for zipped in (False, True):
        arcs = warc.write_arcs(pages.coalesce(1), zipped)
        rows = warc.read_warcs(warc.convert(arcs)).collect()
        assert sorted((r.key, r.record_type) for r in rows) == [(1, "revisit"), (2, "response")]


# --- op7 --------------------------------------------------------------------------


def test_op7_base(spark, sf):
    counts = Counter()
    for i, t, *_ in DOCS:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*words(lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, *_ in DOCS:
        own = [*words(lower(t)), None]
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        want[i, held, len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 6)] += 1
    got = lattice.op7_lattice(spark, sf).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 and r.mixed_score < 0 for r in got)


def brute_lattice(word, weights, counts=None, times=1):
    """The log marginal of word over weights {(begins, piece): weight}; adds expected pieces to counts. By tables of all spans."""
    n, longest = len(word), 40
    spans = [(a, b, (True, word[a:b])) for a in (0,) for b in range(0, min(n, longest) + 1)] + [(a, b, (False, word[a:b])) for a in range(n) for b in range(a + 1, min(n, a + longest) + 1)]
    spans = [(-1 if arc[0] else a, b, arc, math.log(weights[arc])) for a, b, arc in spans if arc in weights]
    reach, rest = {-1: 0.0}, {n: 0.0}
    for a, b, _, w in sorted(spans, key=lambda s: s[0]):
        if a in reach:
            reach[b] = np.logaddexp(reach.get(b, -math.inf), reach[a] + w)
    for a, b, _, w in sorted(spans, key=lambda s: -s[0]):
        if b in rest:
            rest[a] = np.logaddexp(rest.get(a, -math.inf), rest[b] + w)
    if counts is not None:
        for a, b, arc, w in spans:
            if a in reach and b in rest:
                counts[arc] += times * math.exp(reach[a] + w + rest[b] - reach[n])
    return reach[n]


def test_op7_scores_equal_brute_force(spark, sf):
    train, ends = Counter(), 0
    for i, t, *_ in DOCS:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(w.encode() for w in words(lower(t)))
            ends += 1
    arcs, weights = lattice.vocabulary()
    old = dict(zip(arcs, weights, strict=True))
    counts = Counter({a: lattice.SMOOTHING * w for a, w in old.items()})
    for w, times in train.items():
        brute_lattice(w, old, counts, times)
    total = sum(counts.values())
    learnt = {a: c / total for a, c in counts.items()}
    n, ln10 = sum(train.values()), math.log(10)
    end = (ends + 0.5) / (n + ends + 1)
    piece, mixed = {}, {}
    for w in {w.encode() for _, t, *_ in DOCS for w in words(lower(t))}:
        p = brute_lattice(w, learnt)
        piece[w] = p + math.log(1 - end)
        known = max(train[w] - lattice.DISCOUNT, 0) / n
        mixed[w] = np.logaddexp(math.log(known) if known else -math.inf, math.log(lattice.DISCOUNT * len(train) / n) + p) + math.log(1 - end)
    want = {}
    for i, t, *_ in DOCS:
        own = [w.encode() for w in words(lower(t))]
        want.setdefault(i, []).append(tuple((sum(m[w] for w in own) + math.log(end)) / ln10 for m in (piece, mixed)))
    for r in lattice.op7_lattice(spark, sf).collect():
        assert any(math.isclose(r.score, a, rel_tol=1e-5) and math.isclose(r.mixed_score, b, rel_tol=1e-5) for a, b in want[r.doc_id])


def test_op7_words_dealt_by_ranges_of_blocks_score_alike(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    keys = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]

    def found(range_blocks=None):
        return sorted(str((*(r[k] for k in keys), *(round(r[k], 4) for k in ("base_score", "score", "mixed_score")))) for r in lattice.score_documents(docs, range_blocks=range_blocks).collect())

    want = found()
    monkeypatch.setattr(lattice, "BLOCK_BYTES", 4000)
    cut = common.materialise(lattice.blocks(docs), "blocks")
    words, places = lattice.corpus_words(cut, 4)
    n = cut.filter("kind = 0").count()
    assert n > 20 and words.select("task").distinct().count() == 1
    # the commonest word stands in nearly all blocks, but in no row in more than about four times as many as dealt
    ends = [np.diff(np.r_[0, lattice.unpacked(bytes(r["ends"]))]).max() for r in places.collect()]
    assert max(ends) < n / 2
    assert found(4) == want


def test_op7_gathers_one_block_a_task(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK_BYTES", 400)
    docs = spark.createDataFrame([(i, f"w{i % 7} the of " * 9) for i in range(60)], "doc_id long, text string").repartition(3)
    cut = lattice.materialise(lattice.blocks(docs), "blocks")
    assert cut.select("block").distinct().count() > 6
    out = lattice.score_documents(docs)
    assert out.rdd.getNumPartitions() >= cut.select("block").distinct().count()
    got = {r.doc_id: r.score for r in out.collect()}
    assert len(got) == 60 and len({round(s, 6) for i, s in got.items() if i % 7 == 3}) == 1


def test_lattice_sums_all_segmentations():
    arcs, weights = lattice.vocabulary()
    model, by = lattice.Lattice(arcs, weights), dict(zip(arcs, weights, strict=True))

    def brute(word, at=0, begins=True):
        if at == len(word) and not begins:
            return 1.0
        return sum(by.get((begins, word[at:to]), 0) * brute(word, to, False) for to in range(at + (not begins), len(word) + 1) if (begins, word[at:to]) in by)

    for w in (b"a", b"the", b"loser", "été".encode(), b"q\xff"):
        assert math.isclose(model.forward(w)[-1], math.log(brute(w)), rel_tol=1e-9)
    assert abs(weights.sum() - 1) < 1e-9 and math.isfinite(model.forward(b"x" * 5000)[-1])
    counts = [0.0] * len(arcs)
    model.expect(b"the", 2, counts)
    assert math.isclose(sum(c * len(a[1]) for c, a in zip(counts, arcs, strict=True)), 6)


# --- op8 --------------------------------------------------------------------------


def test_op8_gradients(monkeypatch):
    monkeypatch.setattr(toxicity.np, "float32", np.float64)
    rng = np.random.default_rng(1)
    net = toxicity.Network.fresh(rng)
    x, windows = rng.standard_normal((5, toxicity.STATIC + toxicity.DIM)), rng.integers(0, 5, (3, 6))
    valid = np.ones((6, 3))
    valid[4:, 1] = 0
    label = np.array([1.0, 0, 1])
    grads, _, _ = toxicity.gradients(net, x, windows, valid, label)
    for k, g in grads.items():
        at = tuple(rng.integers(0, n) for n in net.p[k].shape)
        keep, losses = net.p[k][at], []
        for d in (1e-4, -1e-4):
            net.p[k][at] = keep + d
            losses.append(toxicity.gradients(net, x, windows, valid, label)[2])
        net.p[k][at] = keep
        assert abs((losses[0] - losses[1]) / 2e-4 - g.reshape(net.p[k].shape)[at]) < 1e-5


def test_op8_windows_cover_and_overlap():
    for n in (1, 63, 64, 127, 128, 129, 192, 193, 1000):
        starts = toxicity.window_starts(n)
        assert {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))
        assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def test_op8_held_out_accuracy(spark, sf):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(10, 200), i % 3 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = toxicity.fitted(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int"))
    score = {r.doc_id: r.score for r in toxicity.scored(docs, net).collect()}
    held = [i for i in score if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((score[i] >= 0.7) == (i % 3 == 0) for i in held) >= 0.97 * len(held)
    got = toxicity.op8_toxicity(spark, sf).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in DOCS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.score == 0 for r in got if r.doc_id in (200, 201, 202))


def test_op8_evidence_equals_a_loop():
    rng = random.Random(6)
    words = [f"w{i}".encode() for i in range(40)]
    docs = [np.array([rng.randrange(40) for _ in range(rng.randint(1, 60))], np.int32) for _ in range(50)]
    label = np.array([i % 3 == 0 for i in range(50)], int)
    part = np.arange(50) % toxicity.FOLDS
    net, coded, values, _ = toxicity.known_words(np.random.default_rng(0), words, docs, label, part)
    values = values * net.spread + net.middle

    def value(i, left_out):
        held, total = [0, 0], [0, 0]
        for d, y, p in zip(docs, label, part, strict=True):
            if p != left_out:
                own = set(d.tolist())
                held[y] += i in own
                total[y] += len(own)
        share = total[1] / sum(total)
        return math.log((held[1] + toxicity.PRIOR * share) / (sum(held) * share + toxicity.PRIOR * share))

    for d in (0, 1, 7, 49):
        for i, row in zip(docs[d], coded[d], strict=True):
            assert math.isclose(values[row, 0], value(i, part[d]), abs_tol=1e-5)
    whole = toxicity.features(words)
    found = net.word_value[net.words.rows(whole.word)]
    assert all(math.isclose(found[i], value(i, None), abs_tol=1e-5) for i in range(40))


def test_op8_index_and_ngrams():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2))
    ask = np.concatenate([keys[::3], keys[:50] + np.uint64(1), rng.integers(0, 1 << 63, 500).astype(np.uint64)])
    at = {int(k): i for i, k in enumerate(keys)}
    assert toxicity.Index(keys).rows(ask).tolist() == [at.get(int(k), len(keys)) for k in ask]
    assert toxicity.Index(keys[:0]).rows(ask[:3]).tolist() == [0, 0, 0]
    words_ = [b"a", b"ab", b"(Worthless!)", "été".encode(), b"...", b"worth"]
    f = toxicity.features(words_)
    at, grams = np.cumsum(f.size) - f.size, []
    for w, i, n in zip(words_, at, f.size, strict=True):
        marked = b"<" + (w.strip(toxicity.EDGE) or w) + b">"
        pieces = [marked[a : a + k] for a in range(len(marked)) for k in toxicity.GRAM_SIZES if a + k <= len(marked)]
        assert n == len(pieces)
        grams += zip(pieces, f.grams[i : i + n].tolist(), strict=True)
    assert len({p for p, _ in grams}) == len({h for _, h in grams}) == len(set(grams))


def test_op8_rare_words_say_nothing_and_known_builds_do():
    rng = random.Random(3)
    clean = [prose(rng, 60) for _ in range(160)]
    bad = [" ".join([*prose(rng, 30).split(), *(f"gru{rng.choice(['nk', 'mf', 'zt'])}{rng.randrange(900)}" for _ in range(4)), *prose(rng, 26).split()]) for _ in range(160)]
    net = toxicity.train([t.encode() for t in clean + bad], [0] * 160 + [1] * 160, steps=80)
    unseen = [" ".join(["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(60)]) for _ in range(30)]
    new = [prose(rng, 50) + " grunk9999 grumf8888 gruzt7777" for _ in range(30)]
    score = toxicity.score_texts(net, [t.encode() for t in unseen + new], {})
    assert (score[:30] < 0.7).all() and (score[30:] >= 0.7).mean() > 0.9


def test_op8_phrases_of_harmless_words():
    rng = random.Random(4)

    def doc(toxic):
        out = prose(rng, 60).split()
        for _ in range(4):
            i = rng.randrange(0, 56)
            out[i : i + 2] = ["go", "away"] if toxic else rng.choice([["away", "go"], ["go", "the"], ["the", "away"]])
        return " ".join(out).encode()

    net = toxicity.train([doc(i % 2) for i in range(600)], [i % 2 for i in range(600)], steps=300)
    found = toxicity.score_texts(net, [doc(i % 2) for i in range(200)], {}) >= 0.7
    assert sum(f == (i % 2) for i, f in enumerate(found)) >= 180


def test_op8_labels_without_documents_change_nothing(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    strange = spark.range(10**6, 10**6 + 200_000).selectExpr("id AS doc_id", "1 AS quality", "int(id % 9 = 0) AS toxic")
    want = toxicity.training_rows(docs, labels)
    assert toxicity.training_rows(docs, labels.unionByName(strange, allowMissingColumns=True)) == want
    assert {y for _, y in want} == {0, 1} and all(t.split() for t, _ in want)
    assert toxicity.training_rows(docs.limit(0), labels) == []


def test_op8_long_documents_train_whole(spark):
    text = " ".join(f"w{i}" for i in range(20_000))
    rows = toxicity.training_rows(spark.createDataFrame([(1, text), (7, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, 1), (7, 0)], "doc_id long, toxic int"))
    assert sorted(rows) == [(b"a b", 0), (text.encode(), 1)]


def test_op8_sample_is_bounded_by_rows_and_bytes_of_whole_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 10 + f" {i}") for i in range(1, 40)] + [(41, "y" * 500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 42)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 60)
    rows = toxicity.training_rows(docs, labels, 6)
    held = dict(docs.select("text", "doc_id").collect())
    assert all(t.decode() in held for t, _ in rows)
    for kind in (0, 1):
        assert 3 <= sum(y == kind for _, y in rows) <= 6 and sum(len(t) for t, y in rows if y == kind) <= 60
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1 << 20)
    assert sum(y for _, y in toxicity.training_rows(docs, labels, 6)) == 6


# --- a text of megabytes -----------------------------------------------------------


def test_very_long_text(spark, tmp_path):
    rng = random.Random(11)
    text = prose(rng, 400_000)
    d = str(tmp_path)
    spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "short one", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    raw = text.encode()
    row = next(r for r in gif.op1_gif(spark, d).collect() if r.doc_id == 1)
    assert (row.n_bytes, row.payload_sha256) == (len(raw), hashlib.sha256(gif.padded(raw)).hexdigest())
    assert next(r for r in simhash.op2_simhash(spark, d).collect() if r.doc_id == 1).fingerprint == f"{brute_fingerprint(text):016x}"
    assert next(r for r in mixing.op3_mixing(spark, d).collect() if r.doc_id == 1)["size"] == 400_000
    pieces = [r for r in packing.op4_packing(spark, d).collect() if r.doc_id == 1]
    assert sum(r.length for r in pieces) == pieces[0].doc_tokens > 400_000
    assert next(r for r in quality.op5_quality(spark, d).collect() if r.doc_id == 1).n_words == 400_000
    assert next(r for r in lattice.op7_lattice(spark, d).collect() if r.doc_id == 1).n_tokens == 400_001
    assert next(r for r in toxicity.op8_toxicity(spark, d).collect() if r.doc_id == 1).score == 0  # labels of one kind train nothing
    assert max(r.length for r in lengths.op9_length_histogram(spark, d).collect()) > 400_000
    assert next(r for r in sharding.op10_virtual_slots(spark, d).collect() if r.doc_id == 1)["size"] == len(raw) + 8


# --- op9, op10 --------------------------------------------------------------------


def test_op9_brute_force(spark, sf):
    encoding = lengths.byte_encoding()
    n = [len(encoding.encode_ordinary(t or "")) for _, t, *_ in DOCS]
    found = lengths.op9_length_histogram(spark, sf)
    rows = found.orderBy("length").collect()
    assert {r.length: r.n_docs for r in rows} == Counter(n)
    for r in rows:
        assert (r.docs_at_least, r.tokens_at_least, r.truncated_tokens) == (sum(x >= r.length for x in n), sum(x for x in n if x >= r.length), sum(min(x, r.length) for x in n))
    for limit in (0, 1, 37, 10**6):
        assert lengths.truncated_total(found, limit) == sum(min(x, limit) for x in n)
    assert lengths.length_quantile(found, 0.5) == sorted(n)[-(-len(n) // 2) - 1]


def test_op9_rare_white_space():
    encoding = lengths.byte_encoding()
    for t in ("a  b", "a 　b", "x\x1c y", "a\n\n b  c \n", "  ", "a\r\nb"):
        assert lengths.token_length(t, encoding, {}) == len(encoding.encode_ordinary(t))


def test_op10_law(spark, sf):
    got = sharding.op10_virtual_slots(spark, sf).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in DOCS)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) <= set(range(24)) and {r.law for r in got} == {"bytes"}
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())


def shares(rows, shards):
    out = [0] * shards
    for r in rows:
        out[r.shard] += r["size"]
    return out


def test_op10_bytes_are_near_equal(spark, tmp_path):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, "x" * int(rng.paretovariate(1.3) * 40)) for i in range(6000)], "doc_id long, text string")
    got = sharding.shard_documents(docs).collect()
    loads, slots = shares(got, 24), Counter()
    for r in got:
        slots[r.virtual_slot] += r["size"]
    heavy = [n for n in slots.values() if n > sum(loads) / 24]
    rest = sorted(loads)[: 24 - len(heavy)]
    assert max(rest) - min(rest) <= 0.01 * sum(rest) / len(rest)
    # ties of equal sizes
    docs = spark.createDataFrame([(i, "same") for i in range(4800)], "doc_id long, text string")
    loads = shares(sharding.shard_documents(docs).collect(), 24)
    assert max(loads) <= 1.02 * min(loads)


@pytest.mark.parametrize("means", [0, 3, 10])
def test_op10_goes_on_past_a_slot_heavier_than_a_shard(means):
    rng = random.Random(2)
    sizes = [rng.randint(200, 300) for _ in range(4096)]
    sizes[77] = means * sum(sizes) // 24 or sizes[77]
    slot_map = sharding.rebalanced(sharding.even_map(24), sizes)
    loads = [sum(n for n, o in zip(sizes, slot_map.owner, strict=True) if o == shard) for shard in range(24)]
    rest = [n for shard, n in enumerate(loads) if not means or shard != slot_map.owner[77]]
    assert max(rest) - min(rest) <= 0.003 * sum(rest) / len(rest)
    assert not means or loads[slot_map.owner[77]] <= sizes[77] + 300


def test_op10_edits_the_stored_map(spark, tmp_path):
    docs = lambda n: spark.createDataFrame([(i, "x" * (i % 90)) for i in range(n)], "doc_id long, text string")
    path = str(tmp_path / "maps")
    runs = [sharding.shard_documents(docs(n), k, 256, path).collect() for n, k in ((3000, 4), (3000, 4), (3300, 4), (3300, 5))]
    assert [{r.map_version for r in run} for run in runs] == [{2}, {2}, {3}, {4}]
    one, _, more, wider = [{r.virtual_slot: r.shard for r in run} for run in runs]
    assert sum(one[s] != more[s] for s in one) <= 40
    # a new shard takes about its share of slots, and the others keep the rest
    assert sum(more[s] != wider[s] for s in more) <= 256 / 5 * 1.6
    loads = shares(runs[-1], 5)
    assert max(loads) <= 1.03 * sum(loads) / 5
    assert sharding.load_map(spark, path).version == 4 and sharding.load_map(spark, path, 1) == sharding.even_map(4, 256)
    with pytest.raises(ValueError, match="5 shards"):
        sharding.shard_documents(docs(10), 3, 256, path)


def test_slot_maps(spark, tmp_path):
    rng = random.Random(1)
    sizes = [rng.randint(0, 1000) for _ in range(512)]
    loads = lambda m: [sum(s for s, o in zip(sizes, m.owner, strict=True) if o == k) for k in range(m.shards)]
    even = sharding.even_map(8, 512)
    one = sharding.rebalanced(even, sizes)
    assert max(loads(one)) <= 1.002 * sum(sizes) / 8 and sum(a != b for a, b in zip(even.owner, one.owner, strict=True)) <= 80
    grown = sharding.rebalanced(one, sizes, 9)
    assert sum(a != b for a, b in zip(one.owner, grown.owner, strict=True)) <= 512 / 9 * 1.6
    assert max(loads(grown)) <= 1.01 * sum(sizes) / 9 and grown.version == one.version + 1
    path = str(tmp_path / "map")
    for m in (one, grown):
        sharding.save_map(spark, m, path)
    assert sharding.load_map(spark, path) == grown and sharding.load_map(spark, path, one.version) == one
    with pytest.raises(Exception, match="(?i)exists"):
        sharding.save_map(spark, one, path)
