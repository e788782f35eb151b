"""Streams of frames: a file source drained into a frame table, and episodes kept as state.

Episodes end where the key changes, which no time window expresses; so micro-batches only append frames, keyed by
batch id and therefore safe to repeat, and clips are formed from the table. Sessions as state are for watching a stream live.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..work import passing, work_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 16) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(sf_dir)


def append_once(path: str):
    """A foreachBatch sink that writes each batch under its own id, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything the stream holds now goes to path; a later call with the same checkpoint goes on from there."""
    stream.writeStream.foreachBatch(append_once(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drained_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of the events table, through a stream."""
    base = passing(spark, f"{work_dir(spark)}/stream/{uuid.uuid4().hex}")
    drain(event_stream(spark, sf_dir), f"{base}/frames", f"{base}/checkpoint")
    events = spark.read.parquet(f"{base}/frames").drop("batch")
    first = events.groupBy("user_id").agg(F.min("ts").alias("first"))
    met = events.join(first, "user_id").withColumn("i", F.col("ts") - F.col("first"))
    hours = F.expr("cast(extract(DAY FROM i) * 24 + extract(HOUR FROM i) AS long)")
    return met.select(F.col("user_id").alias("episode_index"), hours.alias("frame"), F.col("event_id").alias("arrival_seq"), F.col("event_type").alias("language"))


def _count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, first, last = state.get if state.exists else (0, None, None)
    for rows in batches:
        n += len(rows)
        low, high = int(rows["micros"].min()), int(rows["micros"].max())
        first, last = low if first is None else min(first, low), high if last is None else max(last, high)
    state.update((n, first, last))
    yield pd.DataFrame({"episode_index": [key[0]], "frames": [n], "last_frame": [(last - first) // 3_600_000_000]})


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_index, frames, last_frame) after all micro-batches: each episode's state is its count and time span."""
    base = passing(spark, f"{work_dir(spark)}/stream/{uuid.uuid4().hex}")
    rows = event_stream(spark, sf_dir).select(F.col("user_id").alias("episode_index"), F.expr("unix_micros(cast(ts AS timestamp))").alias("micros"))
    out = rows.groupBy("episode_index").applyInPandasWithState(_count, "episode_index long, frames long, last_frame long", "n long, first long, last long", "update", GroupStateTimeout.NoTimeout)
    sink = append_once(f"{base}/sessions")
    out.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    every = spark.read.parquet(f"{base}/sessions")
    last = every.groupBy("episode_index").agg(F.max_by(F.struct("frames", "last_frame"), "batch").alias("x"))
    return last.select("episode_index", "x.frames", "x.last_frame")
