import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom import models, schemas
from chronoloom.plans import worklog
from chronoloom.sinks import files, index_store, worklogs
from chronoloom.sources import arrays, media
from chronoloom.sources.worklogs import read_worklogs, search_documents

S = 1_000_000


def entries(spark):
    rows = [
        ("v", 1, 0, 90 * S, 90 * S, "開く。見る", "Excel", "a.xlsx", "Sheet1", None, ["x"], ["A: b", "c", "d"], None, None),
        ("v", 2, 90 * S, None, None, "閉じる", None, "a（p1）", "p1", "f", [], [], "s", "frames/f.png"),
    ]
    return spark.createDataFrame(rows, schemas.ENTRIES)


def test_jsonl_round_trip(spark, tmp_path):
    path = tmp_path / "rec" / "worklog.jsonl"
    worklogs.write_jsonl(entries(spark), path)
    first = json.loads(path.read_text().splitlines()[0])
    assert list(first) == ["t", "t_end", "duration_seconds", "app_guess", "resource", "location", "focus", "ocr", "speech", "summary", "frame", "action"]
    assert first["t_end"] == "00:01:30" and first["focus"] is None
    path.write_text(path.read_text() + "\n\n")
    docs = search_documents(read_worklogs(spark, str(path))).orderBy("doc_id").collect()
    assert [d.doc_id for d in docs] == ["rec/worklog.jsonl:0", "rec/worklog.jsonl:1"]
    assert docs[0].text == "作業: 開く。見る\nアプリ: Excel\n対象: a.xlsx（Sheet1）\n発話: A: b。c。d\n画面: x"
    path.write_text('{"t": "00:00:00"}\n\n{broken\n')
    with pytest.raises(ValueError, match="worklog.jsonl:3"):
        read_worklogs(spark, str(path))


def test_lines_of_a_file_over_several_splits_have_their_numbers(spark, tmp_path):
    paths = [tmp_path / "rec" / "a.jsonl", tmp_path / "b c" / "b.jsonl"]
    rows = [[json.dumps({"t": f"{k}-{i}", "action": "x" * (i % 50)}) if i % 7 else "" for i in range(n)] for k, n in enumerate((900, 40))]
    for path, lines in zip(paths, rows, strict=True):
        path.parent.mkdir()
        path.write_bytes("\r\n".join(lines).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        read = read_worklogs(spark, *map(str, paths))
        assert read.rdd.getNumPartitions() > 5
        got = {(r.file.rpartition("/")[2], r.line): r.t for r in read.collect()}
        ids = sorted(r.doc_id for r in search_documents(read).collect())
        with open(paths[0], "ab") as f:
            f.write(b"\n[1\n\n")
        with pytest.raises(ValueError, match=r"a\.jsonl:901$"):
            read_worklogs(spark, *map(str, paths))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(p.name, i + 1): f"{k}-{i}" for k, (p, lines) in enumerate(zip(paths, rows, strict=True)) for i, line in enumerate(lines) if line}
    assert ids == sorted(f"{p.parent.name}/{p.name}:{i}" for p, lines in zip(paths, rows, strict=True) for i in range(sum(map(bool, lines))))


def test_markdown_and_manual(spark, tmp_path):
    worklogs.write_markdown(entries(spark), tmp_path / "w.md")
    out = (tmp_path / "w.md").read_text()
    assert "## 00:00:00〜00:01:30（1分30秒） — Excel — a.xlsx（Sheet1）\n" in out
    assert "## 00:01:30 — a（p1）\n" in out and "🗣️ A: b\n" in out and "| Excel | 1分30秒 |" in out
    worklogs.write_manual(entries(spark), tmp_path / "m.md", "rec")
    out = (tmp_path / "m.md").read_text()
    assert out.startswith("# rec 手順書\n\n## Step 1: 開く\n") and "対象: Excel — a.xlsx（Sheet1）\n開く。見る\n" in out and out.count("閉じる") == 1


def test_many_recordings_in_one_job_as_one_by_one(spark, tmp_path):
    one = entries(spark)
    many = one.withColumn("video", F.explode(F.array(*[F.lit(f"rec {i}") for i in range(300)]))).repartition(7)
    worklogs.write_recordings(many.unionByName(one.withColumn("video", F.lit(None).cast("string"))), tmp_path / "out", ["jsonl", "md", "manual"])
    worklogs.write_jsonl(one, tmp_path / "w.jsonl")
    worklogs.write_markdown(one, tmp_path / "w.md")
    want = {"worklog.jsonl": (tmp_path / "w.jsonl").read_text(), "worklog.md": (tmp_path / "w.md").read_text()}
    folders = list((tmp_path / "out").iterdir())
    assert len(folders) == 300
    for folder in folders:
        worklogs.write_manual(one, tmp_path / "m.md", folder.name) if folder.name == "rec 7" else None
        assert {p.name for p in folder.iterdir()} == {"worklog.jsonl", "worklog.md", "manual.md"}
        assert all((folder / name).read_text() == text for name, text in want.items())
    assert (tmp_path / "out" / "rec 7" / "manual.md").read_text() == (tmp_path / "m.md").read_text()


def test_a_failed_or_killed_task_leaves_no_half_file(spark, tmp_path):
    from chronoloom.sinks import recording_files

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f").write_text("old")
    rows = spark.range(40).select(F.concat(F.lit("abcd"[0]), F.lit("/f")).alias("file"), F.col("id"), F.when(F.col("id") == 35, F.raise_error(F.lit("broken"))).otherwise("x").alias("part"))
    with pytest.raises(Exception, match="broken"):
        recording_files.save(rows, str(tmp_path), "id")
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["f"] and (tmp_path / "a" / "f").read_text() == "old"
    # an attempt that was killed has left its hidden file: the job's commit removes it
    writer = recording_files.RecordingWriter(str(tmp_path))
    writer.write(iter([("a/f", "half")]))
    done = writer.write(iter([("a/f", "new "), ("a/f", "text"), ("b/g", None)]))
    assert (tmp_path / "a" / "f").read_text() == "old"
    writer.commit([done, None])
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["f", "g"] and (tmp_path / "a" / "f").read_text() == "new text"
    again = recording_files.RecordingWriter(f"file://{tmp_path}")
    with pytest.raises(ValueError, match="several tasks"):
        again.commit([again.write(iter([("a/f", "1")])), again.write(iter([("a/f", "2")]))])
    assert (tmp_path / "a" / "f").read_text() == "new text" and len(list((tmp_path / "a").iterdir())) == 1


def test_atomic_write_leaves_nothing_behind(tmp_path, monkeypatch):
    files.write_atomic(tmp_path / "f", "old")
    monkeypatch.setattr(os, "replace", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        files.write_atomic(tmp_path / "f", "new")
    assert [p.name for p in tmp_path.iterdir()] == ["f"] and (tmp_path / "f").read_text() == "old"


def test_index_generations(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.7, 0.7])], "doc_id string, embedding array<float>")
    index_store.save(index_store.build(docs), tmp_path, "m")
    found = index_store.search(index_store.load(spark, tmp_path, "m"), [1.0, 0.1], 2).collect()
    assert [(r.rank, r.doc_id) for r in found] == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError, match="model"):
        index_store.load(spark, tmp_path, "other")
    monkeypatch.setattr(files.Folder, "_rename", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        index_store.save(index_store.build(docs.limit(1)), tmp_path, "m")
    assert index_store.load(spark, tmp_path).count() == 3 and len(list(tmp_path.iterdir())) == 2
    part = next(tmp_path.glob("gen-*/*.parquet"))
    kept = part.read_bytes()
    for changed, what in ((kept[:-1] + b"x", "altered"), (None, "missing")):
        part.unlink() if changed is None else part.write_bytes(changed)
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
        with pytest.raises(ValueError, match=what):
            index_store.load(spark, tmp_path)
    part.write_bytes(kept)
    monkeypatch.undo()
    index_store.save(index_store.build(docs.limit(0)), tmp_path, "m")
    assert index_store.load(spark, tmp_path).count() == 0 and len(list(tmp_path.glob("gen-*"))) == 1
    manifest = json.loads((tmp_path / "manifest.json").read_text())
    assert sorted(p.name for p in tmp_path.iterdir()) == [manifest["generation"], "manifest.json"]
    for text, what in ((json.dumps(manifest | {"generation": "../x"}), "out of the index"), ("{", None), (json.dumps({"model": "m", "generation": "x"}), "manifest"), (json.dumps({"model": "m"}), "missing")):
        (tmp_path / "manifest.json").write_text(text)
        with pytest.raises(ValueError, match=what):
            index_store.load(spark, tmp_path)


def write_old_index(folder, ids=("old-a", "old-b"), kind=np.float32, save=np.savez):
    folder.mkdir(parents=True)
    save(folder / "vectors.npz", vectors=np.array([[1.0, 0.0], [0.6, 0.8]] + [[0.0, 1.0]] * (len(ids) - 2), kind)[: len(ids)])
    (folder / "documents.jsonl").write_text("".join(json.dumps({"doc_id": i, "text": "x", "source": "v", "t": "00:00:00", "action": "x"}) + "\n" * (1 + k % 2) for k, i in enumerate(ids)))
    (folder / "manifest.json").write_text(json.dumps({"model": "m", "dimension": 2, "count": len(ids)}))


def test_index_without_generations(spark, tmp_path, monkeypatch):
    for kind in (np.float32, np.float64):
        write_old_index(tmp_path / kind.__name__, kind=kind)
        stored = index_store.load(spark, tmp_path / kind.__name__, "m")
        assert [(r.doc_id, [round(x, 3) for x in r.embedding]) for r in stored.orderBy("doc_id").collect()] == [("old-a", [1.0, 0.0]), ("old-b", [0.6, 0.8])]
        assert [r.doc_id for r in index_store.search(stored, [0.0, 1.0], 1).collect()] == ["old-b"]
    folder = tmp_path / "float32"
    with pytest.raises(ValueError, match="model"):
        index_store.load(spark, folder, "other")
    monkeypatch.setattr(files.Folder, "_rename", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    new = index_store.build(spark.createDataFrame([("new", [1.0, 0.0])], "doc_id string, embedding array<float>"))
    with pytest.raises(OSError):
        index_store.save(new, folder, "m")
    assert {r.doc_id for r in index_store.load(spark, folder).collect()} == {"old-a", "old-b"}
    monkeypatch.undo()
    kept = (folder / "documents.jsonl").read_text()
    for lines, what in ((kept + json.dumps({"doc_id": "extra"}), "2 vectors, but 3 documents"), (kept + "{", "malformed")):
        (folder / "documents.jsonl").write_text(lines)
        with pytest.raises(ValueError, match=what):
            index_store.load(spark, folder)
    index_store.save(new, folder, "m")
    assert {p.name for p in folder.iterdir()} == {"manifest.json", json.loads((folder / "manifest.json").read_text())["generation"]}
    assert [r.doc_id for r in index_store.load(spark, folder).collect()] == ["new"]


def test_old_index_by_ranges_and_broken_arrays(spark, tmp_path, monkeypatch):
    ids = [f"d{i:03}" for i in range(200)]
    write_old_index(tmp_path / "i", ids)
    np.savez(tmp_path / "i" / "vectors.npz", other=np.zeros(3), vectors=np.arange(400, dtype=np.float32).reshape(200, 2))
    monkeypatch.setattr(arrays, "RANGE_BYTES", 100)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = index_store.load(spark, tmp_path / "i").orderBy("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.doc_id, r.embedding) for r in got] == [(i, [2.0 * k, 2.0 * k + 1]) for k, i in enumerate(ids)]
    path = tmp_path / "a.npy"
    for array in (np.zeros((2, 2), np.int64), np.zeros(4, np.float32), np.asfortranarray(np.ones((2, 3), np.float32))):
        np.save(path, array)
        with pytest.raises(ValueError, match="no matrix"):
            arrays.matrix(str(path))
    np.save(path, np.ones((3, 2), np.float32))
    whole = path.read_bytes()
    for broken in (b"", whole[:5], whole[:-1], whole[:10] + b"?" * 20 + whole[30:]):
        path.write_bytes(broken)
        with pytest.raises(ValueError):
            arrays.matrix(str(path))
    np.savez_compressed(tmp_path / "c.npz", vectors=np.ones((3, 2), np.float32))
    for name, what in (("vectors", "compressed"), ("none", "no array")):
        with pytest.raises(ValueError, match=what):
            arrays.matrix(str(tmp_path / "c.npz"), name)


def test_ports_isolate_failures(spark):
    def lines():
        def model(path):
            if "bad" in path:
                raise RuntimeError("no")
            return ["line", 5]

        return model

    frames = spark.createDataFrame([("v", 1, 1, "ok.png"), ("v", 2, 1, "bad.png"), ("v", 3, 3, "ok3.png")], "video string, ord long, source_ord long, path string")
    from chronoloom.operators.folds import recognised

    frames = frames.withColumn("source_ord", F.when(F.col("ord") == 2, 2).otherwise(F.col("source_ord")))
    out = recognised(frames, models.recognise(lines)).orderBy("ord").collect()
    assert [r.lines for r in out] == [["line", "5"], [], ["line", "5"]]

    def describer():
        def model(path, prompt):
            if "bad" in path:
                raise ValueError("x")
            return '{"action": "' + prompt + '"}'

        return model

    out = models.describe(frames.withColumn("prompt", F.lit("p")), describer).orderBy("ord").collect()
    assert [r.action for r in out] == ["p", "（VLM呼び出し失敗: ValueError）", "p"]

    def transcriber():
        def model(path, start, length):
            if start > 0:
                raise RuntimeError("lost")
            return [{"start_us": 5, "end_us": 6, "text": "hi"}]

        return model

    chunks = spark.createDataFrame([("v", "p", 0, 10, 0, 12), ("v", "p", 10, 20, 8, 12)], "video string, path string, chunk_start long, chunk_end long, media_start long, media_len long")
    out = models.transcribe(chunks, transcriber).orderBy("chunk_start").collect()
    assert [(r.failed, r.start_us) for r in out] == [(False, 5), (True, None)]
    out = models.summarise(entries(spark), lambda: lambda x: f" {len(x)} lines ").orderBy("ord").collect()
    assert [r.summary for r in out] == ["3 lines", "s"]
    out = models.embed(entries(spark).select("action"), "action", lambda: lambda texts: [[len(t)] for t in texts]).collect()
    assert all(len(r.embedding) == 1 for r in out)


def test_summarise_keeps_rows_without_speech(spark):
    rows = spark.createDataFrame([(1, None, "s"), (2, ["a"] * models.LEAST_LINES_TO_SUMMARISE, None)], "ord int, speech array<string>, summary string")
    out = models.summarise(rows, lambda: lambda x: "m").orderBy("ord").collect()
    assert [(r.ord, r.summary) for r in out] == [(1, "s"), (2, "m")]


def test_each_port_gets_its_own_model(spark):
    def port(n):
        return lambda: lambda texts: [[float(n)] for _ in texts]

    row = spark.createDataFrame([("a",)], "t string").coalesce(1)
    assert [models.embed(row, "t", port(n)).first().embedding for n in range(12)] == [[float(n)] for n in range(12)]
    assert all(models.loaded(f, models.content_key(f))(["x"]) == [[float(n)]] for n in range(200) for f in [port(n)])


def test_retry_on_timeouts_only():
    calls = []

    def slow():
        calls.append(1)
        if len(calls) == 1:
            raise TimeoutError
        return "ok"

    assert models.attempted(slow) == "ok"
    with pytest.raises(KeyError):
        models.attempted(lambda: {}["x"])


def test_media(spark):
    log = spark.createDataFrame([("v", "a pts_time:3.5 b\npts_time:10")], "video string, log string")
    assert log.select(media.scene_times(F.col("log"))).first()[0] == [3.5, 10.0]
    frames = media.frame_grid(spark.createDataFrame([("v", 11 * S)], "video string, duration_us long"))
    assert [r.t_us // S for r in frames.orderBy("idx").collect()] == [0, 2, 4, 6, 8, 10]
    marked = media.keyframes(frames, log).orderBy("idx").collect()
    assert [r.is_keyframe for r in marked] == [True, False, True, False, False, True]
    with pytest.raises(ValueError, match="x"):
        worklogs.check_stems(spark.createDataFrame([("/a/x.mp4",), ("/b/x.mov",)], "path string"))
    with pytest.raises(media.ProgramFailed, match="ended with 3"):
        media.run_program(["sh", "-c", "echo oh >&2; exit 3"], 5)
    with pytest.raises(media.ProgramFailed, match="out of time"):
        media.run_program(["sleep", "5"], 0.1)


def test_pipeline_end_to_end(spark):
    frames = spark.createDataFrame([("v", i, i * 2 * S, f"f{i}.png", i in (0, 3)) for i in range(6)], schemas.FRAMES)
    ocr = spark.createDataFrame([("v", i, i * 2 * S, ["report.xlsx - Excel", "田中太郎"] if i < 3 else ["https://a.com/x"]) for i in range(6)], schemas.OCR)
    said = spark.createDataFrame([("v", 1, 1 * S, 2 * S, "やります", None, None, None), ("v", 2, 7 * S, 8 * S, "次です", None, None, None)], schemas.SEGMENTS)
    from chronoloom.operators.temporal import attributed

    said = attributed(said, worklog.observations(frames, ocr))
    picked = worklog.to_describe(frames, ocr, said, None)
    described = picked.select("video", "ord", "t_us", F.lit("作業").alias("action"), F.lit(None).cast("string").alias("app"), F.lit("abcdef").alias("resource"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("focus"))
    out = worklog.merged(worklog.enriched(described, ocr), ocr, said).orderBy("ord").collect()
    assert [(r.app, r.resource, r.end_us // S, r.speech) for r in out] == [("Excel", "report.xlsx", 6, ["田中太郎: やります"]), (None, "https://a.com/x", 10, ["次です"])]
