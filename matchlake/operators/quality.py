"""Data quality: field rules, contract violations, orphans, duplicates, invariants of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENUMS: dict[str, tuple[str, ...]] = {
    "phase": ("auto", "teleop", "endgame", "unknown"),
    "event_type": ("match_start", "match_end", "auto_start", "teleop_start", "endgame_start", "shot_attempt", "shot_made", "shot_missed", "reload", "defense_start", "defense_end", "immobile_start", "immobile_end", "foul", "climb"),
    "source": ("model", "manual", "ball_scouting", "derived"),
    "alliance": ("red", "blue"), "scope": ("event", "track"), "action": ("create", "edit", "delete"),
    "status": ("queued", "running", "complete", "failed"), "reason": ("detection_lost", "occlusion", "out_of_frame", "shot_change"),
}
SHOTS = ("shot_attempt", "shot_made", "shot_missed")
MATCH_LEVEL = ("match_start", "match_end", "auto_start", "teleop_start", "endgame_start")


def _list(items: Sequence[Column]) -> Column:
    return F.array_compact(F.array(*items))


def member(name: str, values: Sequence[str], nullable: bool = True) -> Column:
    """A problem text if a value is outside its closed list."""
    bad = ~F.col(name).isin(*values) & F.col(name).isNotNull()
    return F.when(bad if nullable else bad | F.col(name).isNull(), F.concat(F.lit(f"{name}: "), F.coalesce(F.col(name).cast("string"), F.lit("null"))))


def event_problems(goals: Sequence[str] | None = None) -> Column:
    """All problems of an event row: closed lists, ranges, goals of the season, goals on shots only, match events without a robot."""
    rules = [member("event_type", ENUMS["event_type"], False), member("phase", ENUMS["phase"]), member("source", ENUMS["source"])]
    rules.append(F.when(~F.col("confidence").between(0, 1), F.lit("confidence out of range")))
    rules.append(F.when(F.col("t_seconds") < 0, F.lit("t_seconds negative")))
    rules.append(F.when(F.col("team") <= 0, F.lit("team not positive")))
    rules.append(F.when(F.col("goal").isNotNull() & ~F.col("event_type").isin(*SHOTS), F.lit("goal on something else than a shot")))
    if goals is not None:
        rules.append(F.when(F.col("goal").isNotNull() & ~F.col("goal").isin(*goals), F.concat(F.lit("goal: "), F.col("goal"))))
    robot = F.coalesce(F.col("team").cast("string"), F.col("track_id").cast("string"), F.col("field_x").cast("string"))
    rules.append(F.when(F.col("event_type").isin(*MATCH_LEVEL) & robot.isNotNull(), F.lit("match event with a robot")))
    return _list(rules)


def patch_problems(fields: str, allowed: Sequence[str], goals: Sequence[str] | None = None) -> Column:
    """Problems of a correction's ``map<string,string>``: unknown keys and values that do not parse or are outside their list."""
    m = F.col(fields)
    at = lambda k: F.element_at(m, F.lit(k))
    unknown = F.transform(F.array_except(F.map_keys(m), F.array(*map(F.lit, allowed))), lambda k: F.concat(F.lit("unknown field "), k))
    bad = [
        F.when(at("team").isNotNull() & at("team").try_cast("int").isNull(), F.lit("team is no number")),
        F.when(at("confidence").isNotNull() & ~F.coalesce(at("confidence").try_cast("double").between(0, 1), F.lit(False)), F.lit("confidence out of range")),
        F.when(at("event_type").isNotNull() & ~at("event_type").isin(*ENUMS["event_type"]), F.lit("event_type not known")),
        F.when(at("phase").isNotNull() & ~at("phase").isin(*ENUMS["phase"]), F.lit("phase not known")),
    ]
    if goals is not None:
        bad.append(F.when(at("goal").isNotNull() & ~at("goal").isin(*goals), F.lit("goal not of this season")))
    return F.concat(unknown, _list(bad))


def split(df: DataFrame, problems: Column) -> tuple[DataFrame, DataFrame]:
    """``(good, quarantined)``, the latter with their ``problems``."""
    marked = df.withColumn("problems", problems)
    return marked.where("size(problems) = 0").drop("problems"), marked.where("size(problems) > 0")


def violations(quarantined: DataFrame) -> DataFrame:
    """How often each problem occurs."""
    return quarantined.select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    return child.join(parent.select(*keys), list(keys), "left_anti")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unsorted(df: DataFrame, keys: Sequence[str], seq: str, time: str) -> DataFrame:
    """Rows whose time runs back against their sequence."""
    return df.withColumn("_before", F.lag(time).over(Window.partitionBy(*keys).orderBy(seq))).where(F.col(time) < F.col("_before")).drop("_before")


def boxes_in_gaps(tracks: DataFrame) -> DataFrame:
    """Boxes that lie strictly within one of their own track's gaps."""
    b = tracks.select("job_id", "track_id", "gaps", F.explode("boxes").alias("b"))
    return b.where(F.exists("gaps", lambda g: (g["start"] < F.col("b.t")) & (F.col("b.t") < g["end"]))).select("job_id", "track_id", F.col("b.t").alias("t"))


def run_report(events: DataFrame, tracks: DataFrame, jobs: DataFrame) -> DataFrame:
    """``check, n`` of the invariants of a run; all are 0 for a sound one."""
    roster = jobs.select("job_id", F.explode(F.concat("alliances.red", "alliances.blue")).alias("team"))
    checks = {
        "duplicate_event": duplicates(events, ["match_id", "event_id"]), "duplicate_track": duplicates(tracks, ["job_id", "track_id"]),
        "event_without_track": orphans(events.where("track_id is not null"), tracks, ["job_id", "track_id"]), "event_without_job": orphans(events, jobs, ["job_id"]),
        "box_in_gap": boxes_in_gaps(tracks), "team_not_in_roster": orphans(tracks.where("team is not null"), roster, ["job_id", "team"]),
    }
    out = None
    for name, df in checks.items():
        row = df.agg(F.lit(name).alias("check"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def lane_of_event() -> Column:
    """Display lane: a team, ``unattributed`` for a track without team, else ``match``."""
    return F.when(F.col("team").isNotNull(), F.col("team").cast("string")).when(F.col("track_id").isNotNull(), "unattributed").otherwise("match")


def inspector(low: float | None = None, corrected: bool = False, kinds: Sequence[str] = (), team: int | str | None = None) -> Column:
    """Filter of the event list; ``team`` may be ``none`` for events without one."""
    keep = F.lit(True)
    if low is not None:
        keep = keep & (F.coalesce("confidence", F.lit(0.0)) < low)
    if corrected:
        keep = keep & F.coalesce("corrected", F.lit(False))
    if kinds:
        keep = keep & F.col("event_type").isin(*kinds)
    if team is not None:
        keep = keep & (F.col("team").isNull() if team == "none" else F.col("team") == int(team))
    return keep
