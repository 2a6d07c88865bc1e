"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblens.session import file_system, shared_path


def read(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """A stream of Parquet files with `ts` as a watermark can use it."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(stream: DataFrame, late: str = "1 hour", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by event-time window and type; rows later than `late` are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_counts(stream: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def first_deliveries(stream: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


_WATCH_STATE = T.StructType([T.StructField("last", T.StringType())])
_CHANGE = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("changed", T.BooleanType())])


def _watch(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    out = []
    for event_id, content in zip(rows["event_id"], rows["content"]):
        known = content is not None and not pd.isna(content)
        out.append((key[0], event_id, bool(known and last is not None and content != last)))
        last = content if known else last
    state.update((last,))
    yield pd.DataFrame(out, columns=[f.name for f in _CHANGE])


def watch_changes(stream: DataFrame) -> DataFrame:
    """Change detection with the last content of each key as state; errors (NULL content) keep it."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return stream.select("user_id", "event_id", "ts", "content").groupBy("user_id").applyInPandasWithState(_watch, _CHANGE, _WATCH_STATE, "append", GroupStateTimeout.NoTimeout)


def upsert_latest(path: str, key: str, order: str):
    """A foreachBatch sink: the newest row of each key, rewritten to a new version folder each batch; the version before stays until the next one is whole."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = f"{path}/v{number - 1}"
        fs, own = file_system(spark, old)
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(old)) if number and fs.exists(own) else batch
        rows.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("_r")).select("_r.*").write.mode("overwrite").parquet(f"{path}/v{number}")
        fs.delete(file_system(spark, f"{path}/v{number - 2}")[1], True)

    return write


_DUE_STATE = T.StructType([T.StructField("last", T.DoubleType())])
_DUE = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("due", T.BooleanType())])


def poll_due(stream: DataFrame, interval: float) -> DataFrame:
    """(user_id, event_id, due): a watch is due when it was never checked or `interval` seconds have passed since it last was; a check that is due always moves that time on."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["s", "event_id"])
        out = []
        for event_id, s in zip(rows["event_id"], rows["s"]):
            due = last is None or s - last >= interval
            last = s if due else last
            out.append((key[0], event_id, due))
        state.update((last,))
        yield pd.DataFrame(out, columns=[f.name for f in _DUE])

    timed = stream.select("user_id", "event_id", (F.unix_micros("ts") / 1e6).alias("s"))
    return timed.groupBy("user_id").applyInPandasWithState(step, _DUE, _DUE_STATE, "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all that lies before it, as a table in the shared folder."""
    spark = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, name + "-state")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
