import zlib
from collections import defaultdict

import corpus_pipeline
from chronoloom.llm import common, quality, simhash, toxicity


def test_stages_take_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "mixing", "packing"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = [tuple(r) for r in out.collect()]
        if name != "packing":
            assert out.columns == columns and set(rows) <= set(before)
        if name == "toxicity":
            net = toxicity.fitted(docs, labels)
            score = {r.doc_id: r.score for r in toxicity.scored(docs.filter("doc_id IS NOT NULL"), net).collect()}
            assert {r[0] for r in rows if r[0] is not None} == {i for i, s in score.items() if s < 0.7}
        if name == "quality":
            want = {r.doc_id for r in quality.judged(docs, labels).collect() if r.kept}
            assert {r[0] for r in rows} == want and want
        if name == "simhash":
            groups = defaultdict(list)
            for r in simhash.grouped(simhash.fingerprints(docs, "doc_id"), "doc_id").collect():
                groups[r.group_id].append(r.doc_id)
            assert sorted(r[0] for r in rows) == sorted(groups)
        kept.append(len(rows))
        docs = out
    assert kept[1] < kept[0] and kept[2] < kept[1] and kept[3] < kept[2]
    tokens = {r.doc_id: r.doc_tokens for r in docs.collect()}
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in docs.collect()) and len(tokens) > 0


def test_run_leaves_one_table(spark, sf):
    import glob

    common.release(spark)
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and len(glob.glob(common.shared_dir(spark).removeprefix("file://") + "/*")) == 1


def test_empty(spark, empty_sf):
    assert corpus_pipeline.run(spark, empty_sf).count() == 0


def test_workers_give_memory_back(monkeypatch):
    said = []
    monkeypatch.setattr(common, "give_back", lambda: said.append("back"))
    common.worker_cache("test before")["words"] = 1
    said.clear()
    task = common.thrifty("test", lambda batches: iter([*batches, common.worker_cache("test")]))
    assert list(task(iter([1, 2]))) == [1, 2, {}] and said == ["back", "back"]


def test_texts_are_handed_on_once(spark):
    docs = spark.createDataFrame([(1, "fine words " * 60), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for stage in (toxicity, quality):
        out = stage.keep(docs, labels)
        assert "__text" not in out._jdf.queryExecution().analyzed().toString()
        assert {r.doc_id for r in out.collect()} <= {1, 2, 3} and out.columns == docs.columns
    assert sorted(r.doc_id for r in toxicity.keep(docs, labels).collect()) == [1, 2, 3]


def test_utf8_of_a_column():
    import pyarrow as pa

    for kind in (pa.string(), pa.large_string()):
        assert common.utf8_of(pa.array(["é", None, ""], kind)).to_pylist() == ["é".encode(), b"", b""]
