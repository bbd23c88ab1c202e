"""Declared scouting metrics compiled to aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """``count`` of an event type (and goal), ``points`` of made shots, or ``median_seconds`` between events of a type."""

    id: str
    aggregation: str
    event_type: str | None = None
    goal: str | None = None


def problems(metrics: list[dict], ratings: list[dict], known: set[str]) -> list[str]:
    """What is wrong with a declaration: repeated ids, unknown types, empty ranges, weights that do not sum to 1."""
    out, ids = [], [m["id"] for m in [*metrics, *ratings]]
    out += [f"repeated id {i}" for i in sorted({i for i in ids if ids.count(i) > 1})]
    out += [f"unknown event type {m['event_type']}" for m in metrics if m.get("event_type") and m["event_type"] not in known]
    out += [f"empty range of {r['id']}" for r in ratings if r["min"] >= r["max"]]
    if ratings and abs(sum(r["weight"] for r in ratings) - 1) > 1e-6:
        out.append("weights do not sum to 1")
    return out


def _aggregate(m: Metric, points: Column) -> Column:
    hit = F.col("event_type") == (m.event_type or "shot_made")
    if m.goal is not None:
        hit = hit & (F.col("goal") == m.goal)
    if m.aggregation == "count":
        return F.count_if(hit)
    if m.aggregation == "points":
        return F.coalesce(F.sum(F.when(hit, points)), F.lit(0))
    if m.aggregation == "median_seconds":
        return F.median(F.when(hit, F.col("_since")))
    raise ValueError(f"unknown aggregation {m.aggregation}")


def evaluate(events: DataFrame, metrics: list[Metric], points: Column) -> DataFrame:
    """One row per team and match with a column per metric."""
    since = F.col("t_seconds") - F.lag("t_seconds").over(Window.partitionBy("team", "match_id", "event_type").orderBy("t_seconds", "event_id"))
    return events.where("team is not null").withColumn("_since", since).groupBy("team", "match_id").agg(*[_aggregate(m, points).alias(m.id) for m in metrics])


def rating(scores: DataFrame, ratings: list[dict]) -> DataFrame:
    """Weighted mean of ratings scaled to 0..1; a missing one leaves its weight out."""
    part = [F.when(F.col(r["id"]).isNotNull(), r["weight"] * (F.col(r["id"]) - r["min"]) / (r["max"] - r["min"])) for r in ratings]
    weight = [F.when(F.col(r["id"]).isNotNull(), F.lit(r["weight"])).otherwise(0.0) for r in ratings]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in part), F.lit(0.0))
    return scores.withColumn("rating", F.try_divide(total, sum(weight, F.lit(0.0))))


def forecast(per_match: DataFrame, order: str, metric: str, window: int = 3) -> DataFrame:
    """Adds ``forecast``: the mean of a team's last ``window`` matches up to each."""
    return per_match.withColumn("forecast", F.avg(metric).over(Window.partitionBy("team").orderBy(order).rowsBetween(1 - window, 0)))


def time_in_range(poses: DataFrame, goals: DataFrame, shooters: DataFrame, phase: Column, dt: float) -> DataFrame:
    """Expected points of robots from the time their paths spend within a goal's range, per phase.

    ``poses (robot_id, t, x, y)``, ``goals (goal, gx, gy, range_ft, points map<phase, double>)``,
    ``shooters (robot_id, alliance, goal, volley_interval_s, shots_per_volley, accuracy)``.
    """
    s = poses.join(shooters, "robot_id").join(goals, "goal").where(F.hypot(F.col("x") - F.col("gx"), F.col("y") - F.col("gy")) <= F.col("range_ft"))
    s = s.withColumn("phase", phase).withColumn("each", F.coalesce(F.try_element_at("points", F.col("phase")), F.lit(0.0)))
    t = s.groupBy("robot_id", "alliance", "phase", "volley_interval_s", "shots_per_volley", "accuracy", "each").agg((F.count("*") * dt).alias("seconds"))
    made = F.coalesce(F.try_divide("seconds", "volley_interval_s"), F.lit(0.0)) * F.col("shots_per_volley") * F.col("accuracy") * F.col("each")
    return t.groupBy("robot_id", "alliance").agg(F.bround(F.sum(made), 1).alias("points"), F.bround(F.sum("seconds"), 1).alias("time_in_range_s"))


def path_error(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Instants in common, mean and greatest distance of two paths ``(keys, t, x, y)``."""
    o = b.select(*keys, "t", F.col("x").alias("ox"), F.col("y").alias("oy"))
    d = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    return a.join(o, [*keys, "t"]).groupBy(*keys).agg(F.count("*").alias("n"), F.bround(F.avg(d), 3).alias("mean_ft"), F.bround(F.max(d), 3).alias("max_ft"))
