"""Balls, shots and goal entries: one-to-one matching, association, near-duplicates, owners, outcomes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.exprs import inside_polygon
from matchlake.operators.ordered import fold
from matchlake.operators.temporal import band_join
from matchlake.sources.work import staged

MATCH_S, LINK_S, LINK_MARGIN, OWNER_REACH, VANISH_S = 0.075, 0.25, 0.25, 140.0, 0.4


def mutual_best(pairs: DataFrame, a: str, b: str, cost: str) -> DataFrame:
    """Pairs that are each side's cheapest, ties to the smaller partner."""
    wa = Window.partitionBy(a).orderBy(cost, b)
    wb = Window.partitionBy(b).orderBy(cost, a)
    return pairs.withColumn("_ra", F.row_number().over(wa)).withColumn("_rb", F.row_number().over(wb)).where("_ra = 1 and _rb = 1").drop("_ra", "_rb")


def match_shots(predicted: DataFrame, expected: DataFrame, tolerance: float = MATCH_S) -> DataFrame:
    """``shot_id, ref_id, dt``: launches of one robot matched one to one, nearest first, within ``tolerance``.

    Each round takes the mutual nearest pairs and leaves out their shots, until no pair is left. A round settles at
    least the nearest pair of every chain of launches that are within the tolerance of each other, so chains of a few
    take as few rounds.
    """
    p = predicted.select("job_id", "robot", "shot_id", F.col("t").alias("pt"))
    r = expected.select("job_id", "robot", F.col("shot_id").alias("ref_id"), F.col("t").alias("rt"))
    left = staged(band_join(p, r, ["job_id", "robot"], "pt", "rt", tolerance).select("job_id", "shot_id", "ref_id", F.abs(F.col("pt") - F.col("rt")).alias("dt")))
    out = left.limit(0)
    while not left.isEmpty():
        won = staged(mutual_best(left, "shot_id", "ref_id", "dt"))
        out = out.unionByName(won)
        left = staged(left.join(won.select("shot_id"), "shot_id", "left_anti").join(won.select("ref_id"), "ref_id", "left_anti").select(left.columns))
    return out


def _assigned(p: list[float], r: list[float], tolerance: float) -> list[tuple[int, int]]:
    """Index pairs of two ordered lists of times: as many as can be, then of least summed difference. Some such answer never crosses."""
    cost, step = np.arange(len(p) + 1) * 0.0, np.zeros((len(r) + 1, len(p) + 1), dtype=np.int8)
    for i, t in enumerate(r, 1):
        above, cost = cost, cost + 2.0
        for j in range(1, len(p) + 1):
            d = abs(p[j - 1] - t)
            if d <= tolerance and above[j - 1] + d / max(tolerance, 1e-9) < min(cost[j], cost[j - 1]):
                cost[j], step[i, j] = above[j - 1] + d / max(tolerance, 1e-9), 2
            elif cost[j - 1] < cost[j]:
                cost[j], step[i, j] = cost[j - 1], 1
    out, i, j = [], len(r), len(p)
    while i and j:
        if step[i, j] == 2:
            out.append((j - 1, i - 1))
        i, j = i - (step[i, j] != 1), j - (step[i, j] != 0)
    return out


def assign_shots(predicted: DataFrame, expected: DataFrame, tolerance: float = MATCH_S) -> DataFrame:
    """``job_id, shot_id, ref_id, dt``: launches of one robot matched one to one within ``tolerance``, optimally.

    As many pairs as can be, then the least summed ``dt``; :func:`match_shots` takes the nearest first and may end with
    fewer. A robot's launches are cut where none follows within the tolerance, and each chain is solved in one fold.
    """
    side = lambda d, ref: d.select("job_id", "robot", "shot_id", F.col("t").cast("double").alias("t"), F.lit(ref).alias("ref")).where("job_id is not null and robot is not null and t is not null")
    both = side(predicted, False).unionByName(side(expected, True))
    kind = both.schema["shot_id"].dataType.simpleString()
    found = fold(both, ["job_id", "robot"], ["t", "ref", "shot_id"], ["t", "ref", "shot_id"], lambda: _Chain(tolerance), f"shot_id {kind}, ref_id {kind}, dt double")
    return found.select("job_id", "shot_id", "ref_id", "dt")


class _Chain:
    """Launches in order of time; those so far are solved once the next is out of reach."""

    def __init__(self, tolerance: float):
        self.tolerance, self.sides, self.last = tolerance, ([], []), None

    def row(self, t: float, ref: bool, shot) -> list[tuple]:
        out = self.close() if self.last is not None and t - self.last > self.tolerance else []
        self.sides[ref].append((t, shot))
        self.last = t
        return out

    def close(self) -> list[tuple]:
        (p, r), self.sides = self.sides, ([], [])
        pairs = _assigned([t for t, _ in p], [t for t, _ in r], self.tolerance)
        return [(p[a][1], r[b][1], abs(p[a][0] - r[b][0])) for a, b in pairs]


def launch_score(matched: DataFrame, predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """Precision, recall and mean time error of launches, one row."""
    n = matched.agg(F.count("*").alias("hits"), F.avg("dt").alias("mean_dt"))
    both = n.join(predicted.agg(F.count("*").alias("np"))).join(expected.agg(F.count("*").alias("nr")))
    ratio = lambda d: F.coalesce(F.try_divide("hits", d), F.lit(0.0))
    return both.select("hits", ratio("np").alias("precision"), ratio("nr").alias("recall"), "mean_dt")


def associate_entries(entries: DataFrame, shots: DataFrame) -> DataFrame:
    """``entry_id, shot_id, association`` of goal entries.

    An entry takes the shot of its own ball track. Others take the shot whose ball, moved on from its last point at its
    last velocity, is cheapest to continue within LINK_S, if it beats every alternative of both sides by LINK_MARGIN.
    ``entries (job_id, entry_id, ball_track_id, t, x, y)``, ``shots (job_id, shot_id, ball_track_id, last_t, x, y, vx, vy)``.
    """
    own = entries.join(shots.select("job_id", "ball_track_id", "shot_id"), ["job_id", "ball_track_id"]).select("job_id", "entry_id", "shot_id", F.lit("same_track").alias("association"))
    e = entries.join(own.select("entry_id"), "entry_id", "left_anti").select("job_id", "entry_id", "t", F.col("x").alias("ex"), F.col("y").alias("ey"))
    s = shots.join(own.select("shot_id"), "shot_id", "left_anti").select("job_id", "shot_id", "last_t", "x", "y", "vx", "vy")
    near = band_join(e, s, ["job_id"], "t", "last_t", LINK_S).where("t > last_t").withColumn("dt", F.col("t") - F.col("last_t"))
    cost = F.hypot(F.col("x") + F.col("vx") * F.col("dt") - F.col("ex"), F.col("y") + F.col("vy") * F.col("dt") - F.col("ey")) + F.col("dt")
    priced = near.withColumn("cost", cost)
    other = lambda k, o: F.coalesce(F.lead("cost").over(Window.partitionBy(k).orderBy("cost", o)), F.lit(float("inf")))
    clear = mutual_best(priced.withColumn("_ea", other("entry_id", "shot_id")).withColumn("_sa", other("shot_id", "entry_id")), "entry_id", "shot_id", "cost")
    linked = clear.where(F.least("_ea", "_sa") - F.col("cost") >= LINK_MARGIN).select("job_id", "entry_id", "shot_id", F.lit("trajectory").alias("association"))
    found = own.unionByName(linked)
    return entries.select("job_id", "entry_id").join(found, ["job_id", "entry_id"], "left").withColumn("association", F.coalesce("association", F.lit("unassigned")))


def duplicate_launches(launches: DataFrame, within: float = 0.35, agreeing: int = 2, part: float = 0.75, reach: float = 0.02) -> DataFrame:
    """``shot_id, same_as``: launches of a robot that repeat an earlier one: near in time, with enough common instants at which the balls are together.

    ``launches (job_id, robot, shot_id, t, points array<struct<frame, x, y>>)``.
    """
    a = launches.select("job_id", "robot", "shot_id", F.col("t").alias("ta"), F.col("points").alias("pa"))
    b = launches.select("job_id", "robot", F.col("shot_id").alias("same_as"), F.col("t").alias("tb"), F.col("points").alias("pb"))
    pairs = band_join(a, b, ["job_id", "robot"], "ta", "tb", within).where("tb < ta or (tb = ta and same_as < shot_id)")
    common = F.filter("pa", lambda p: F.exists("pb", lambda q: q["frame"] == p["frame"]))
    together = F.filter("pa", lambda p: F.exists("pb", lambda q: (q["frame"] == p["frame"]) & (F.hypot(q["x"] - p["x"], q["y"] - p["y"]) <= reach)))
    same = pairs.withColumn("n", F.size(common)).withColumn("k", F.size(together)).where((F.col("k") >= agreeing) & (F.col("k") >= part * F.col("n")))
    return same.groupBy("job_id", "shot_id").agg(F.min_by("same_as", "tb").alias("same_as"))


def duplicate_entries(entries: DataFrame, within: float = 0.15, alias: float = 0.03) -> DataFrame:
    """Entries of a region that repeat an earlier one: another ball track within ``within`` and within ``alias`` of it."""
    a = entries.select("job_id", "region_id", "entry_id", F.col("t").alias("ta"), "x", "y")
    b = entries.select("job_id", "region_id", F.col("entry_id").alias("same_as"), F.col("t").alias("tb"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = band_join(a, b, ["job_id", "region_id"], "ta", "tb", within).where("tb < ta or (tb = ta and same_as < entry_id)")
    return near.where(F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")) <= alias).groupBy("job_id", "entry_id").agg(F.min_by("same_as", "tb").alias("same_as"))


def owners(balls: DataFrame, robots: DataFrame, reach: float = OWNER_REACH) -> DataFrame:
    """The robot nearest to each ball of the same frame within ``reach``, else null."""
    r = robots.select("job_id", "frame", F.col("track_id").alias("owner"), F.col("cx").alias("rx"), F.col("cy").alias("ry"))
    near = balls.join(r, ["job_id", "frame"]).withColumn("d", F.hypot(F.col("cx") - F.col("rx"), F.col("cy") - F.col("ry"))).where(F.col("d") <= reach)
    best = near.groupBy("job_id", "frame", "ball_id").agg(F.min_by("owner", F.struct("d", "owner")).alias("owner"))
    return balls.join(best, ["job_id", "frame", "ball_id"], "left")


def vanished(sightings: DataFrame, polygon: Sequence[tuple[float, float]], after: float = VANISH_S) -> DataFrame:
    """``job_id, track_id, t, owner``: last sights, inside a polygon, of tracks that are then not seen for more than ``after``.

    A track that comes back later than that is a track anew. One that is alive when its job's last row comes has not
    vanished. ``sightings (job_id, track_id, t, x, y, owner)``; rows without a time or place are left out.
    """
    s = sightings.where("t is not null and x is not null and y is not null")
    corners = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in polygon])
    order = Window.partitionBy("job_id", "track_id").orderBy("t", "x", "y")
    ends = s.groupBy("job_id").agg(F.max("t").alias("stop"))
    last = s.withColumn("next", F.lead("t").over(order)).join(ends, "job_id")
    micros = lambda c: F.round(c * 1_000_000).cast("long")
    gone = last.where(micros(F.coalesce("next", "stop")) - micros(F.col("t")) > round(after * 1_000_000)).where(inside_polygon(F.col("x"), F.col("y"), corners))
    return gone.select("job_id", "track_id", "t", "owner")


def validity(frames: DataFrame, patience: float = 3.0) -> DataFrame:
    """``start, end`` during which a camera is not to be trusted: more than ``patience`` after its last verified frame; open ends are null.

    ``frames (job_id, t, verified)``.
    """
    w = Window.partitionBy("job_id").orderBy("t")
    seen = frames.where("verified").withColumn("next", F.lead("t").over(w))
    last = frames.groupBy("job_id").agg(F.max("t").alias("stop"))
    return seen.join(last, "job_id").where(F.coalesce("next", "stop") - F.col("t") > patience).select("job_id", (F.col("t") + patience).alias("start"), F.col("next").alias("end"))
