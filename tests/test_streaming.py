"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from weblens.operators.state import changes
from weblens.session import table
from weblens.streaming import events as E

DATA = "/root/testdata/sf0.001"


def run(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, tmp_path):
    batch = table(spark, DATA, "events")
    batch.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return batch, E.read(spark, str(tmp_path / "in"), batch.schema)


def test_window_counts(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    got = run(spark, E.window_counts(stream, "400 days"), "windows", "complete", tmp_path)
    want = batch.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in got.select("window.start", "event_type", "n").collect()} == {tuple(r) for r in want.select("window.start", "event_type", "n").collect()}


def test_watch_state_matches_batch(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    content = F.when(F.col("event_type") != "error", F.col("event_type"))
    got = run(spark, E.watch_changes(stream.withColumn("content", content)), "watch", "append", tmp_path)
    want = changes(batch.withColumn("content", content), "user_id", "ts", "event_id", "content")
    assert {tuple(r) for r in got.select("event_id", "changed").collect()} == {tuple(r) for r in want.select("event_id", "changed").collect()}


def test_upsert_keeps_the_latest(spark, tmp_path):
    write = E.upsert_latest(str(tmp_path / "up"), "k", "t")
    write(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, t int, v string"), 0)
    write(spark.createDataFrame([(1, 2, "c"), (2, 0, "old")], "k int, t int, v string"), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "up/v1")).collect()) == [(1, 2, "c"), (2, 1, "b")]
