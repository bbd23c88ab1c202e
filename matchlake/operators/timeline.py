"""Robot timelines: identity, resampled positions in the alliance frame, speed, phases, zones, launches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.exprs import alliance_frame, band_of_array, clock_at
from matchlake.operators.stats import alliance_of
from matchlake.operators.temporal import asof_nearest, resample, smooth_speed

RATE, BRIDGE_S, LAUNCH_TOLERANCE_S = 10.0, 0.6, 0.3


def identify(tracks: DataFrame, jobs: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """``job_id, track_id, team, alliance``: the corrected team, and the side of the track or else of the roster."""
    t = tracks.select("job_id", "track_id", "team", "alliance")
    if corrections is not None:
        c = corrections.select("job_id", "track_id", F.col("team").alias("new_team"), F.lit(True).alias("named"))
        t = t.join(c, ["job_id", "track_id"], "left").withColumn("team", F.when(F.col("named"), F.col("new_team")).otherwise(F.col("team"))).drop("new_team", "named")
    t = t.join(jobs.select("job_id", "match_id", "alliances"), "job_id", "left")
    return t.select("job_id", "match_id", "track_id", "team", F.coalesce("alliance", alliance_of(F.col("team"), F.col("alliances"))).alias("alliance"))


def resampled(tracks: DataFrame, rate: float = RATE) -> DataFrame:
    """``job_id, track_id, t, x, y`` on the grid, holes left out; unplaced instants keep null positions."""
    boxes = tracks.select("job_id", "track_id", F.explode("boxes").alias("b")).where("b.t is not null").select("job_id", "track_id", "b.t", F.col("b.field_x").alias("x"), F.col("b.field_y").alias("y"))
    gaps = tracks.select("job_id", "track_id", F.explode("gaps").alias("g")).select("job_id", "track_id", "g.start", "g.end")
    return resample(boxes, ["job_id", "track_id"], "t", ["x", "y"], rate, BRIDGE_S, gaps)


def robot_keys(identities: DataFrame, samples: DataFrame) -> DataFrame:
    """``job_id, track_id, robot_key``: tracks of one team are one robot unless a track overlaps what the robot has so far.

    The fold runs over one row per track of a team in a job, a handful, in track order.
    """
    spans = samples.groupBy("job_id", "track_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    rows = identities.select("job_id", "track_id", "team").join(spans, ["job_id", "track_id"], "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, lo, hi = [], None, None
        for r in pdf.sort_values("track_id").itertuples():
            if pd.notna(r.lo) and lo is not None and r.lo <= hi and lo <= r.hi:
                keys.append(f"team:{int(r.team)}#track:{r.track_id}")
                continue
            keys.append(f"team:{int(r.team)}")
            if pd.notna(r.lo):
                lo, hi = (r.lo, r.hi) if lo is None else (min(lo, r.lo), max(hi, r.hi))
        out = pdf.sort_values("track_id")[["job_id", "track_id"]].copy()
        return out.assign(robot_key=keys)

    teams = rows.where("team > 0").groupBy("job_id", "team").applyInPandas(fold, "job_id string, track_id int, robot_key string")
    alone = rows.where("team is null or team <= 0").select("job_id", "track_id", F.concat(F.lit("track:"), "track_id").alias("robot_key"))
    return teams.unionByName(alone)


def build(tracks: DataFrame, jobs: DataFrame, shots: DataFrame, seasons: DataFrame, geometry: DataFrame, clocks: DataFrame, corrections: DataFrame | None = None, rate: float = RATE) -> tuple[DataFrame, DataFrame]:
    """``(samples, launches)`` of every robot. ``clocks`` has ``job_id, start``; seasons and geometry are one row a year."""
    who = identify(tracks, jobs, corrections)
    raw = resampled(tracks, rate)
    keys = robot_keys(who, raw)
    rule = F.broadcast(seasons.select("season", "auto_seconds", "teleop_seconds", "endgame_seconds", F.coalesce("transition_seconds", F.lit(0.0)).alias("pause")))
    place = F.broadcast(geometry.select("season", "field_length_ft", "field_width_ft", "zones", "lanes"))
    job = jobs.select("job_id", "season").join(rule, "season", "left").join(place, "season", "left").join(clocks.select("job_id", "start"), "job_id", "left")
    first_side = F.first("alliance", ignorenulls=True).over(Window.partitionBy("job_id", "robot_key").orderBy("track_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    robots = keys.join(who, ["job_id", "track_id"]).withColumn("alliance", first_side)
    s = raw.join(robots, ["job_id", "track_id"]).join(job, "job_id", "left")
    s = s.withColumn("a", alliance_frame(F.col("x"), F.col("y"), F.col("alliance"), F.col("field_length_ft"), F.col("field_width_ft")))
    clock = lambda t: clock_at(t, F.coalesce("start", F.lit(0.0)), F.col("auto_seconds"), F.col("pause"), F.col("teleop_seconds"), F.col("endgame_seconds"))
    r3 = lambda c: F.bround(c, 3)
    s = s.withColumn("c", clock(F.col("t"))).withColumn("ax", r3("a.ax")).withColumn("ay", r3("a.ay")).withColumn("x", r3("x")).withColumn("y", r3("y"))
    s = smooth_speed(s, ["job_id", "robot_key"], "t", "x", "y", rate)
    samples = s.select(
        "job_id", "match_id", "robot_key", "team", "alliance", "t", "c.mt", "c.phase", "x", "y", "ax", "ay", "speed",
        band_of_array(F.col("ax"), F.col("zones"), "x_min", "x_max").alias("zone"), band_of_array(F.col("ay"), F.col("lanes"), "y_min", "y_max").alias("lane"),
    )
    fired = shots.where("launch_t_seconds is not null").select("job_id", F.col("robot_track_id").alias("track_id"), "shot_id", F.col("launch_t_seconds").alias("t"), "confidence")
    fired = fired.join(robots, ["job_id", "track_id"]).join(job, "job_id", "left").withColumn("c", clock(F.col("t")))
    near = asof_nearest(fired, samples, ["job_id", "robot_key"], "t", "t", LAUNCH_TOLERANCE_S, ["ax", "ay", "speed"], "mt")
    launches = near.select("job_id", "match_id", "robot_key", "team", "shot_id", "t", "c.mt", "c.phase", F.col("near_ax").alias("ax"), F.col("near_ay").alias("ay"), F.col("near_speed").alias("speed"), "confidence")
    return samples, launches


def _field(name: str):
    return lambda row: row[name]


def to_columns(samples: DataFrame) -> DataFrame:
    """One row per robot with parallel arrays of its samples, in order of time."""
    names = ["t", "mt", "phase", "x", "y", "ax", "ay", "speed", "zone", "lane"]
    rows = samples.groupBy("job_id", "match_id", "robot_key", "team", "alliance").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("s"))
    return rows.select("job_id", "match_id", "robot_key", "team", "alliance", *[F.transform("s", _field(n)).alias(n) for n in names])


def to_rows(columns: DataFrame) -> DataFrame:
    """The inverse of :func:`to_columns`."""
    names = ["t", "mt", "phase", "x", "y", "ax", "ay", "speed", "zone", "lane"]
    return columns.select("job_id", "match_id", "robot_key", "team", "alliance", F.explode(F.arrays_zip(*names)).alias("s")).select("job_id", "match_id", "robot_key", "team", "alliance", "s.*")
