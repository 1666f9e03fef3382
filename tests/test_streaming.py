from pyspark.sql import functions as F

from chronoloom.operators.runs import collapse_runs
from chronoloom.streaming import timelines

SCHEMA = "video string, ord long, t_us long, action string, resource string, location string"


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_collapse_equals_batch(spark, tmp_path):
    rows = [(f"v{i % 2}", i, i * 10, "ab"[i // 5 % 2], None if i % 7 else "r", None) for i in range(40)]
    for n in range(2):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, timelines.collapsed_stream(stream), "collapsed")
    want = collapse_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.ord for r in got} == {r.ord for r in want}


def test_dwell_windows(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "A", 5), ("2024-01-01 00:02:00", None, 7), ("2024-01-01 00:12:00", "A", 1), ("2024-01-01 02:00:00", "A", 1)]
    df = spark.createDataFrame(rows, "ts string, app string, duration_us long").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = run(spark, timelines.dwell_stream(stream), "dwell", "update")
    assert sorted((r.app, r.total_us) for r in got) == [("A", 1), ("A", 1), ("A", 5), ("（不明）", 7)]
