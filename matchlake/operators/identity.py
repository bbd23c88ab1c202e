"""Who a track is: votes on colour and on read numbers, fragments of one robot, rosters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.folds import longest_common

MIN_SIMILARITY, MIN_READ_MARGIN, MIN_VOTES, MIN_CONFIDENCE, MIN_VOTE_MARGIN = 0.60, 0.15, 2.0, 0.55, 0.15
TRACK = ["job_id", "track_id"]


def similarity(read: pd.Series, candidate: pd.Series) -> pd.Series:
    """Longest common subsequence by the longer length; 0 for an empty side."""
    return pd.Series([longest_common(a, b) / max(len(a), len(b)) if a and b else 0.0 for a, b in zip(read, candidate)])


def alliance_votes(observations: DataFrame) -> DataFrame:
    """``alliance`` per track by at least 60 % of the frames that saw a colour, else null."""
    n = observations.where("alliance is not null").groupBy(*TRACK, "alliance").count()
    part = F.col("count") / F.sum("count").over(Window.partitionBy(*TRACK))
    won = n.withColumn("part", part).where("part >= 0.6").select(*TRACK, "alliance")
    return observations.select(*TRACK).distinct().join(won, TRACK, "left")


def strict_majority(votes: DataFrame, least: int = 3) -> DataFrame:
    """Colour of tracks with ``least`` votes or more and over half for one."""
    n = votes.where("alliance is not null").groupBy(*TRACK).agg(F.count("*").alias("n"), F.count_if(F.expr("alliance = 'red'")).alias("red"), F.count_if(F.expr("alliance = 'blue'")).alias("blue"))
    return n.where(F.col("n") >= least).select(*TRACK, F.when(F.col("red") * 2 > F.col("n"), "red").when(F.col("blue") * 2 > F.col("n"), "blue").alias("alliance"))


def team_votes(reads: DataFrame, roster: DataFrame) -> DataFrame:
    """``team, confidence`` per track from number reads ``(job_id, track_id, alliance, read)`` and ``roster (job_id, alliance, team)``.

    A read chooses among the (three or six) teams of its track's side; it counts if its best similarity is enough and
    clear of the next. A track takes the team with enough votes, a large enough share and margin, else null.
    """
    sim = F.pandas_udf(similarity, "double")
    numbered = reads.withColumn("read_id", F.monotonically_increasing_id())
    sided = numbered.where("alliance is not null").join(roster.select("job_id", "alliance", "team"), ["job_id", "alliance"])
    open_ = numbered.where("alliance is null").join(roster.select("job_id", "team").distinct(), "job_id")
    scored = sided.select(*TRACK, "read_id", "read", "team").unionByName(open_.select(*TRACK, "read_id", "read", "team")).withColumn("s", sim("read", F.col("team").cast("string")))
    w = Window.partitionBy("read_id").orderBy(F.desc("s"), F.desc("team"))
    best = scored.withColumn("rn", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("s").over(w), F.lit(0.0))).where("rn = 1").where((F.col("s") >= MIN_SIMILARITY) & (F.col("s") - F.col("next") >= MIN_READ_MARGIN))
    tally = best.groupBy(*TRACK, "team").agg(F.sum("s").alias("weight"))
    t = Window.partitionBy(*TRACK)
    o = t.orderBy(F.desc("weight"), "team")
    ranked = tally.withColumn("total", F.sum("weight").over(t)).withColumn("rn", F.row_number().over(o)).withColumn("next", F.coalesce(F.lead("weight").over(o), F.lit(0.0))).where("rn = 1")
    part, margin = F.col("weight") / F.col("total"), (F.col("weight") - F.col("next")) / F.col("total")
    enough = F.col("total") >= MIN_VOTES
    won = ranked.select(*TRACK, F.when(enough & (part >= MIN_CONFIDENCE) & (margin >= MIN_VOTE_MARGIN), F.col("team")).alias("team"), F.when(enough, F.bround(part, 3)).otherwise(0.0).alias("confidence"))
    return reads.select(*TRACK).distinct().join(won, TRACK, "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def roster_from_counts(counts: DataFrame, frames: int) -> DataFrame:
    """Top three teams of each side seen in over half of the frames, ``counts (alliance, team, n)``."""
    w = Window.partitionBy("alliance").orderBy(F.desc("n"), "team")
    return counts.withColumn("rn", F.row_number().over(w)).where((F.col("rn") <= 3) & (F.col("n") > frames / 2)).groupBy("alliance").agg(F.array_sort(F.collect_list("team")).alias("teams"))


def reconcile_fragments(fragments: DataFrame, overlap_s: float = 0.10, least_confidence: float = 0.55) -> DataFrame:
    """Status of each team's fragments ``(job_id, team, track_id, alliance, confidence, lo, hi)``.

    ``review`` with an issue where two overlap in time, sides conflict or a read is weak; else ``merged`` into the
    first fragment, with the holes between fragments counted.
    """
    w = Window.partitionBy("job_id", "team").orderBy("lo", "track_id")
    g = Window.partitionBy("job_id", "team")
    ends = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    f = fragments.where("team is not null").withColumn("late", F.coalesce(ends - F.col("lo") > overlap_s, F.lit(False))).withColumn("hole", F.col("lo") > ends)
    f = f.withColumn("overlaps", F.max("late").over(g)).withColumn("sides", F.size(F.collect_set("alliance").over(g))).withColumn("weak", F.min("confidence").over(g) < least_confidence)
    issue = F.when(F.col("overlaps"), "overlapping_team_claim").when(F.col("sides") > 1, "alliance_conflict").when(F.col("weak"), "weak_read")
    first = F.first("track_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return f.select("job_id", "team", "track_id", F.when(issue.isNull(), first).otherwise(F.col("track_id")).alias("merged_into"), F.when(issue.isNull(), "merged").otherwise("review").alias("identity_status"), issue.alias("issue"), F.coalesce("hole", F.lit(False)).alias("after_gap"))


def robot_names(tracks: DataFrame) -> DataFrame:
    """Adds ``robot_name`` where it is missing: ``Robot 1`` to ``Robot 6`` by track order within a job."""
    place = (F.dense_rank().over(Window.partitionBy("job_id").orderBy("track_id")) - 1) % 6 + 1
    valid = F.col("robot_name").rlike(r"^Robot [1-6]$")
    return tracks.withColumn("robot_name", F.when(valid, F.col("robot_name")).otherwise(F.concat(F.lit("Robot "), place)))


def has_motion(boxes: DataFrame, least_span: float = 0.02, least_speed: float = 0.5) -> DataFrame:
    """Whether a track ever moves: a speed of ``least_speed`` or a spread of centres that beats its own size."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    upper = lambda v: F.get(F.array_sort(F.collect_list(v)), F.floor(F.count("*") / 2).cast("int"))
    m = boxes.groupBy(*TRACK).agg(F.max("speed_ftps").alias("top"), F.hypot(F.max(cx) - F.min(cx), F.max(cy) - F.min(cy)).alias("span"), upper(F.col("w")).alias("mw"), upper(F.col("h")).alias("mh"))
    return m.select(*TRACK, (F.coalesce(F.col("top") >= least_speed, F.lit(False)) | (F.col("span") >= F.greatest(F.lit(least_span), 0.18 * F.hypot("mw", "mh")))).alias("moves"))


def eligible(tracks: DataFrame, motion: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Tracks of a known colour, or that move and are not suppressed."""
    t = tracks.join(motion, TRACK, "left").join(suppressed.select(*TRACK, F.lit(True).alias("gone")), TRACK, "left")
    return t.where(F.col("alliance").isNotNull() | (F.col("gone").isNull() & F.coalesce("moves", F.lit(False)))).drop("moves", "gone")
