"""Streaming queries run to completion over a folder of files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sightline.plans.registry import n, query, r6
from sightline.sources import views as S
from sightline.sources.shared import shared_dir
from sightline.sources.views import with_views
from sightline.streaming import sessions as T


def drained(spark, stream, mode: str):
    """The rows of a stream once all its files are read.

    Executors write each batch to a folder of its own in the shared folder, so no row passes through the driver and
    a repeated batch replaces itself. In complete mode a batch holds all rows so far: the last one counts.
    """
    path, batches = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", {}

    def keep(batch, number: int) -> None:
        batches[number] = f"{path}/rows-{number}"
        batch.write.mode("overwrite").parquet(batches[number])

    running = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*([batches[max(batches)]] if mode == "complete" else batches.values()))


def streamed(spark, sf_dir: str, name: str):
    schema = S.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM m)
    SELECT user_id, count(DISTINCT session) AS sessions, count(*) AS n FROM s GROUP BY user_id""")
def stream_sessions(spark, sf_dir):
    """Twelve-hour gap sessions of all users from a stream (complete mode: no row counts as late)."""
    out = drained(spark, T.sessions(streamed(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "12 hours", "365 days"), "complete")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query(with_views("""o AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY offset_s, event_id) AS i FROM frames), l AS (SELECT sequence_id, list(score ORDER BY offset_s, event_id) AS xs FROM frames GROUP BY sequence_id),
    e AS (SELECT o.sequence_id, list_reduce(xs[1:i], lambda a, x: a * 0.5::DOUBLE + x * 0.5::DOUBLE) AS ema FROM o JOIN l USING (sequence_id)) SELECT sequence_id, count(*) AS n, sum((ema >= 0.6)::INT)::BIGINT AS alarms, round(avg(ema), 6) AS mean FROM e GROUP BY sequence_id""", "frames"))  # fmt: skip
def stream_alarm(spark, sf_dir):
    """Smoothed alarms with keyed state over the frames of all sequences; one batch, as files have no order in time."""
    frames = S.frames(spark, sf_dir).select("sequence_id", "event_id", "offset_s", "score")
    path = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"
    frames.write.parquet(path)
    stream = spark.readStream.schema(frames.schema).parquet(path)
    out = drained(spark, T.alarms(stream, 1.0, 0.6), "append")
    return out.groupBy("sequence_id").agg(F.count("*").alias("n"), n(F.sum(F.col("alarm").cast("int")), "alarms"), r6(F.avg("ema"), "mean"))
