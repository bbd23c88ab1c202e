"""What a viewer shows at given instants, and the lists of jobs and events around it.

Instants are a table ``asked (job_id, at)``, so any number of viewers and times is one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.operators.chains import spaced
from matchlake.operators.temporal import band_join

# Fixed values.
TRAIL_S, TRAIL_SLACK_S, SHOT_MARGIN_S, NEAR_EVENT_S, SAMPLE_GAP_S = 0.35, 0.001, 0.2, 0.6, 0.25


def paused(asked: DataFrame, gaps: DataFrame) -> DataFrame:
    """Adds ``paused``: the instant lies in a gap ``(job_id, start, end)``, whose end is left out; without an end it lasts.

    Both are sorted together once: an instant is paused if the latest end of all gaps begun so far lies after it.
    """
    end = F.coalesce(F.col("end").cast("double"), F.lit(float("inf")))
    begun = gaps.select("job_id", F.col("start").alias("_at"), F.lit(0).alias("_side"), end.alias("_end"))
    both = asked.withColumn("_at", F.col("at")).withColumn("_side", F.lit(1)).unionByName(begun, allowMissingColumns=True)
    latest = F.max("_end").over(Window.partitionBy("job_id").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("paused", F.coalesce(latest > F.col("_at"), F.lit(False))).where("_side = 1").select(*asked.columns, "paused")


def shot_trails(asked: DataFrame, shots: DataFrame) -> DataFrame:
    """Points of each shot in the TRAIL_S up to the instant, while the shot lasts, with a margin on both sides.

    ``shots (job_id, shot_id, launch_t_seconds, ball_track array<struct<t_seconds, x, y>>)``.
    """
    last = F.coalesce(F.try_element_at("ball_track", F.lit(-1))["t_seconds"], F.col("launch_t_seconds"))
    points = shots.select("job_id", "shot_id", (F.col("launch_t_seconds") - SHOT_MARGIN_S).alias("_from"), (last + SHOT_MARGIN_S).alias("_to"), F.explode("ball_track").alias("p"))
    points = points.select("job_id", "shot_id", "_from", "_to", F.col("p.t_seconds").alias("t"), "p.x", "p.y")
    pairs = band_join(asked, points, ["job_id"], "at", "t", TRAIL_S + TRAIL_SLACK_S)
    shown = pairs.where(F.col("at").between(F.col("_from"), F.col("_to")) & F.col("t").between(F.col("at") - TRAIL_S, F.col("at") + TRAIL_SLACK_S))
    return shown.select("job_id", "at", "shot_id", "t", "x", "y")


def near_events(boxes: DataFrame, events: DataFrame) -> DataFrame:
    """Events of a box's own track less than NEAR_EVENT_S from it: ``job_id, track_id, t, event_id, event_type``."""
    e = events.where("track_id is not null").select("job_id", "track_id", "event_id", "event_type", "t_seconds")
    pairs = band_join(boxes.select("job_id", "track_id", "t"), e, ["job_id", "track_id"], "t", "t_seconds", NEAR_EVENT_S)
    return pairs.where(F.abs(F.col("t") - F.col("t_seconds")) < NEAR_EVENT_S).select("job_id", "track_id", "t", "event_id", "event_type")


def placed_samples(boxes: DataFrame, length: float, width: float, teams: list[int] | None = None) -> DataFrame:
    """Boxes on the field, at least SAMPLE_GAP_S apart on their track, as shares of the field with the far side up.

    ``boxes (job_id, track_id, team, t, field_x, field_y)``.
    """
    b = boxes if teams is None else boxes.where(F.col("team").isin(teams))
    on = b.where(F.col("field_x").between(0, length) & F.col("field_y").between(0, width))
    kept = spaced(on, ["job_id", "track_id"], "t", SAMPLE_GAP_S - 1e-6)
    return kept.select("job_id", "track_id", "team", "t", (F.col("field_x") / length).alias("u"), (1 - F.col("field_y") / width).alias("v"))


def unplaced(boxes: DataFrame, length: float, width: float) -> DataFrame:
    """``job_id, observed, missing``: boxes seen, and those of them that have no place on the field."""
    on = F.col("field_x").between(0, length) & F.col("field_y").between(0, width)
    return boxes.groupBy("job_id").agg(F.count("*").alias("observed"), F.count_if(~F.coalesce(on, F.lit(False))).alias("missing"))


def playable(jobs: DataFrame) -> DataFrame:
    """Jobs whose media can be shown."""
    return jobs.where("duration > 0 and fps is not null and width is not null and height is not null")


def activity(jobs: DataFrame, key: str) -> DataFrame:
    """``key, jobs, latest``, most recently active first."""
    return jobs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("jobs"), F.max("created_at").alias("latest")).orderBy(F.desc_nulls_last("latest"), key)


def kinds(df: DataFrame, key: str) -> DataFrame:
    """``key, n``, most frequent first."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(key))


def built_summary(features: DataFrame) -> DataFrame:
    """Per group and in total (null): how many features are done and how many are to do; ``features (group, name, built)``."""
    done = F.coalesce(F.col("built"), F.lit(False))
    return features.rollup("group").agg(F.count_if(done).alias("done"), F.count_if(~done).alias("todo"))


def least_sure_first(tracks: DataFrame) -> DataFrame:
    """Tracks in the order a reviewer takes them: no confidence first, then the lowest."""
    return tracks.orderBy(F.asc_nulls_first("team_confidence"), "job_id", "track_id")
