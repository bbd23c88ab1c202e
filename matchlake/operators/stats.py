"""Per-team statistics, score reconstruction, shot and goal counts; computed on demand, never stored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from matchlake.functions.aggregates import nearest_rank
from matchlake.functions.exprs import points_for, share
from matchlake.operators.temporal import paired_intervals

PAIRS = {"defense_seconds": ("defense_start", "defense_end"), "immobile_seconds": ("immobile_start", "immobile_end")}


def alliance_of(team: Column, alliances: Column) -> Column:
    """Side of a team in ``struct(red, blue)``, red first; null if in neither or unknown."""
    has = lambda side: F.coalesce(F.array_contains(alliances[side], team), F.lit(False))
    return F.when(has("red"), "red").when(has("blue"), "blue")


def in_confidence(events: DataFrame, least: float) -> DataFrame:
    """Events of at least a confidence, an unknown one counting as 0; apply after corrections."""
    return events.where(F.coalesce("confidence", F.lit(0.0)) >= least)


def team_stats(events: DataFrame, match_seconds: float | None = None, low_confidence: float = 0.5, across_matches: bool = False, by_match: bool = False) -> DataFrame:
    """One row per team, or per match and team with ``by_match``: cycles, shots, intervals, reloads, paired seconds, fouls, events of low confidence.

    A cycle runs from reload to reload, and an interval from attempt to attempt, within a match; with
    ``across_matches`` the times of all matches are pooled. Attempts are at least the shots made. Accuracy, median
    cycle and mean interval are null for none. An interval left open ends at ``match_seconds``, or never.
    """
    own = events.where("team is not null").withColumn("t", F.coalesce("t_seconds", F.lit(0.0)))
    scope, keys = ["team"] if across_matches else ["team", "match_id"], ["match_id", "team"] if by_match else ["team"]
    kind = F.when(F.col("event_type").isin("reload", "shot_attempt"), F.col("event_type"))
    gap = F.when(kind.isNotNull(), F.col("t") - F.lag("t").over(Window.partitionBy(*scope, kind).orderBy("t", "event_id")))
    of = lambda name: F.count_if(F.col("event_type") == name)
    cycle, interval = F.when(kind == "reload", F.col("gap")), F.when(kind == "shot_attempt", F.col("gap"))
    base = own.withColumn("gap", gap).groupBy(*keys).agg(
        F.count_distinct("match_id").alias("matches_played"), F.count(cycle).alias("cycles"), F.median(cycle).alias("avg_cycle_seconds"), F.min(cycle).alias("best_cycle_seconds"),
        F.greatest(of("shot_attempt"), of("shot_made")).alias("shot_attempts"), of("shot_made").alias("shots_made"), F.avg(interval).alias("avg_shot_interval_seconds"),
        of("reload").alias("reloads"), of("foul").alias("fouls"), F.count_if(F.coalesce("confidence", F.lit(0.0)) < low_confidence).alias("low_confidence_events"),
    )
    base = base.withColumn("shot_accuracy", share(F.col("shots_made"), F.col("shot_attempts"), None))
    close_at = F.lit(float("inf") if match_seconds is None else match_seconds)
    for name, (start, end) in PAIRS.items():
        spans = paired_intervals(own, scope, "t", F.col("event_type") == start, F.col("event_type") == end, close_at, ["event_id"])
        base = base.join(spans.groupBy(*keys).agg(F.sum("seconds").alias(name)), keys, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return base


def scoring(events: DataFrame, jobs: DataFrame, seasons: DataFrame) -> DataFrame:
    """Made shots with their side and points; a null team, goal or season scores nothing for anybody."""
    sides = jobs.where("alliances is not null").select("match_id", "season", "alliances").dropDuplicates(["match_id"])
    made = events.where("event_type = 'shot_made'").join(sides, "match_id").join(F.broadcast(seasons.select("season", "point_values")), "season", "left")
    return made.withColumn("side", alliance_of(F.col("team"), F.col("alliances"))).where("side is not null").withColumn("points", points_for(F.col("phase"), F.col("goal"), F.col("point_values")))


def reconstruct_score(events: DataFrame, jobs: DataFrame, seasons: DataFrame) -> DataFrame:
    """``match_id, red, blue`` points for every match with alliances, 0 where nothing was made."""
    score = scoring(events, jobs, seasons).groupBy("match_id").agg(*[F.sum(F.when(F.col("side") == s, F.col("points"))).alias(s) for s in ("red", "blue")])
    matches = jobs.where("alliances is not null").select("match_id").distinct()
    return matches.join(score, "match_id", "left").select("match_id", *[F.coalesce(s, F.lit(0)).alias(s) for s in ("red", "blue")])


def accuracy(reconstructed: DataFrame, official: DataFrame) -> DataFrame:
    """Reconstructed against official ``match_id, red, blue``; deltas, mean error and grade are null without the latter."""
    o = official.select("match_id", F.col("red").alias("official_red"), F.col("blue").alias("official_blue"))
    both = reconstructed.join(o, "match_id", "left").withColumn("delta_red", F.col("red") - F.col("official_red")).withColumn("delta_blue", F.col("blue") - F.col("official_blue"))
    error = (F.abs("delta_red") + F.abs("delta_blue")) / 2
    return both.withColumn("mean_error", error).withColumn("grade", F.when(error <= 3, "good").when(error <= 10, "fair").when(error.isNotNull(), "poor"))


def by_phase(events: DataFrame) -> DataFrame:
    """Attempts and made shots per team in each phase."""
    shots = events.where("team is not null and event_type in ('shot_attempt', 'shot_made')")
    return shots.groupBy("team").pivot("phase", ["auto", "teleop", "endgame", "unknown"]).agg(F.count_if(F.expr("event_type = 'shot_attempt'")).alias("attempts"), F.count_if(F.expr("event_type = 'shot_made'")).alias("made"))


def cycles(events: DataFrame) -> DataFrame:
    """``team, match_id, n, t, seconds``: every cycle of a team from reload to reload, numbered from 1 within its match."""
    w = Window.partitionBy("team", "match_id").orderBy("t", "event_id")
    reloads = events.where("team is not null and event_type = 'reload'").withColumn("t", F.coalesce("t_seconds", F.lit(0.0)))
    both = reloads.withColumn("seconds", F.col("t") - F.lag("t").over(w)).withColumn("n", (F.row_number().over(w) - 1).cast("int"))
    return both.where("seconds is not null").select("team", "match_id", "n", "t", "seconds")


def team_cycles(events: DataFrame, jobs: DataFrame, seasons: DataFrame) -> DataFrame:
    """``team, cycles, best_cycle_seconds, is_best, points``: ``is_best`` marks the teams with the shortest cycle of all that have one.

    ``points`` are those of a team's made shots in matches whose alliances name it, null for none.
    """
    own = cycles(events).groupBy("team").agg(F.count("*").alias("cycles"), F.min("seconds").alias("best_cycle_seconds"))
    scored = scoring(events, jobs, seasons).groupBy("team").agg(F.sum("points").alias("points"))
    best = own.agg(F.min("best_cycle_seconds").alias("_best"))
    teams = events.where("team is not null").select("team").distinct().join(own, "team", "left").join(scored, "team", "left")
    told = teams.join(F.broadcast(best)).withColumn("is_best", F.coalesce(F.col("best_cycle_seconds") == F.col("_best"), F.lit(False)))
    return told.select("team", F.coalesce("cycles", F.lit(0)).alias("cycles"), "best_cycle_seconds", "is_best", "points")


#: Density grids that a task holds.
GRIDS = 500
OUTCOMES = ("made", "missed", "unknown")


def shot_statistics(shots: DataFrame) -> DataFrame:
    """Per robot, and in total where ``robot`` is null: attempts and outcomes. Odd outcomes are unknown, no robot is ``unassigned``."""
    clean = shots.select("job_id", F.coalesce(F.col("robot_track_id").cast("string"), F.lit("unassigned")).alias("robot"), F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).otherwise("unknown").alias("outcome"))
    return clean.rollup("job_id", "robot").agg(F.count("*").alias("attempted"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]).where("job_id is not null")


def goal_statistics(entries: DataFrame) -> DataFrame:
    """Goal entries by region (with its first goal), by robot, and in total; ``level`` tells which."""
    e = entries.select("job_id", F.coalesce("region_id", F.lit("unknown")).alias("region"), F.coalesce(F.col("robot_track_id").cast("string"), F.lit("unassigned")).alias("robot"), "goal", "entry_id")
    named = F.col("robot") != "unassigned"
    sets = e.groupingSets([["job_id", "region"], ["job_id", "robot"], ["job_id"]], "job_id", "region", "robot")
    level = F.when(F.grouping("region") == 0, "region").when(F.grouping("robot") == 0, "robot").otherwise("total")
    return sets.agg(
        level.alias("level"), F.when(F.grouping("region") == 0, F.min_by("goal", "entry_id")).alias("goal"), F.count("*").alias("made"),
        F.count_if(named).alias("attributed"), F.count_if(~named).alias("unassigned"),
    )


def made_shots(entries: DataFrame, shots: DataFrame) -> DataFrame:
    """``job_id, t, robot_track_id`` of everything made, once: goal entries, and made shots that no entry refers to."""
    old = shots.where("outcome = 'made'").join(entries.where("shot_id is not null").select("job_id", "shot_id"), ["job_id", "shot_id"], "left_anti")
    a = entries.select("job_id", F.col("t_seconds").alias("t"), "robot_track_id")
    return a.unionByName(old.select("job_id", F.coalesce("outcome_t_seconds", "launch_t_seconds").alias("t"), "robot_track_id"))


def shot_events(shots: DataFrame, tracks: DataFrame, season_goals: list[str]) -> DataFrame:
    """Facts from shots: an attempt at launch, and for a made shot one at its outcome; a goal outside the season fails the job."""
    t = tracks.select("job_id", F.col("track_id").alias("robot_track_id"), "team")
    s = shots.join(t, ["job_id", "robot_track_id"], "left")
    legal = F.col("goal").isNull() | F.col("goal").isin(*season_goals) if season_goals else F.lit(True)
    goal = F.when(legal, F.col("goal")).otherwise(F.raise_error(F.concat(F.lit("goal not of this season: "), F.col("goal"))))
    row = lambda kind, at, g: F.struct(F.lit(kind).alias("event_type"), at.alias("t_seconds"), g.alias("goal"))
    attempt = row("shot_attempt", F.col("launch_t_seconds"), F.lit(None).cast("string"))
    made = row("shot_made", F.coalesce("outcome_t_seconds", "launch_t_seconds"), goal)
    rows = s.withColumn("e", F.explode(F.when(F.col("outcome") == "made", F.array(attempt, made)).otherwise(F.array(attempt))))
    key = F.sha2(F.concat_ws("|", "job_id", "shot_id", "e.event_type"), 256)
    return rows.select("job_id", key.alias("event_id"), "team", F.col("robot_track_id").alias("track_id"), "e.*", "confidence", F.lit("ball_scouting").alias("source"))


def price_percentile(df: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """Nearest-rank percentile of a value per key."""
    return nearest_rank(df, [key], value, q)


def density(points: DataFrame, keys: list[str], nx: int = 72, ny: int = 36, sigma: float = 1.6, reach: int = 5) -> DataFrame:
    """Gaussian density of unit-square points on a grid, 1 at each key's peak; each point reaches ``reach`` cells.

    Points are added to grids inside the tasks, so what is shuffled are cells, not points times cells. A task holds
    the grids of GRIDS keys and passes them on when another comes.
    """
    rows = points.where("x is not null and y is not null").select(*keys, F.col("x").cast("double"), F.col("y").cast("double"))
    kinds = StructType([*[rows.schema[k] for k in keys], *StructType.fromDDL("ix long, iy long, mass double").fields])
    arrow, around = to_arrow_schema(kinds), np.arange(-reach, reach + 1)

    def splat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids: dict[tuple, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for key, grid in grids.items():
                ix, iy = np.nonzero(grid)
                yield pa.RecordBatch.from_arrays([*[pa.array([k] * len(ix), f.type) for k, f in zip(key, arrow)], pa.array(ix), pa.array(iy), pa.array(grid[ix, iy])], schema=arrow)
            grids.clear()

        for batch in batches:
            g = np.stack([batch.column(len(keys)).to_numpy() * nx, batch.column(len(keys) + 1).to_numpy() * ny], axis=1)
            at = np.floor(g).astype(np.int64)[:, :, None] + around
            weight = np.exp(-((at + 0.5 - g[:, :, None]) ** 2) / (2 * sigma * sigma)) * ((at >= 0) & (at < np.array([nx, ny])[:, None]))
            at = np.clip(at, 0, np.array([nx, ny])[:, None] - 1)
            owners: dict[tuple, list[int]] = {}
            of = list(zip(*[batch.column(c).to_pylist() for c in range(len(keys))])) if keys else [()] * batch.num_rows
            for i, key in enumerate(of):
                owners.setdefault(key, []).append(i)
            for key, own in owners.items():
                if key not in grids and len(grids) >= GRIDS:
                    yield from flush()
                grid = grids.setdefault(key, np.zeros((nx, ny)))
                np.add.at(grid, (at[own, 0][:, :, None], at[own, 1][:, None, :]), weight[own, 0][:, :, None] * weight[own, 1][:, None, :])
        yield from flush()

    total = rows.mapInArrow(splat, kinds).groupBy(*keys, "ix", "iy").agg(F.sum("mass").alias("mass"))
    return total.withColumn("density", F.col("mass") / F.max("mass").over(Window.partitionBy(*keys)))
