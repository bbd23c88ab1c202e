"""Streaming counterparts of the batch operators: event time with a stated bound on lateness.

Rows later than the watermark are dropped by Spark from state; route them aside first with :func:`late_rows` where
they must not be lost silently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATENESS = "10 seconds"


def volleys(launches: DataFrame, time: str = "ts", gap: str = "3 seconds", lateness: str = LATENESS) -> DataFrame:
    """Sessions of launches per robot: start, end (of the last launch) and count."""
    s = launches.withWatermark(time, lateness).groupBy("job_id", "robot_key", F.session_window(time, gap).alias("w"))
    return s.agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("launches")).drop("w")


def counts_per_second(sightings: DataFrame, time: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Tracks seen in each second of a job."""
    w = sightings.withWatermark(time, lateness).groupBy("job_id", F.window(time, "1 second").alias("w"))
    return w.agg(F.approx_count_distinct("track_id", 0.01).alias("tracks")).select("job_id", F.col("w.start").alias("second"), "tracks")


def running_totals(events: DataFrame) -> DataFrame:
    """Counts per team so far; for the update or complete output mode."""
    return events.where("team is not null").groupBy("team").agg(F.count_if(F.expr("event_type = 'shot_attempt'")).alias("attempts"), F.count_if(F.expr("event_type = 'shot_made'")).alias("made"))


def late_rows(batch: DataFrame, watermark: str, time: str = "ts") -> tuple[DataFrame, DataFrame]:
    """``(on_time, late)`` of a micro-batch against a watermark instant."""
    late = F.col(time) < F.lit(watermark).cast("timestamp")
    return batch.where(~late), batch.where(late)


def publish(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", every: str = "1 second"):
    """Write a stream to Parquet about once a second; files and offsets are committed together."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def upsert_latest(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second"):
    """Hand each micro-batch of updates to ``write(rows, epoch)``, which must be idempotent by epoch."""
    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
