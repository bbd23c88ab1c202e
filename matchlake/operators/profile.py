"""Team profiles over matches, predictions, counters, and the test of predictions on each next match."""

from __future__ import annotations

from collections import Counter
from math import hypot

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.aggregates import rounded_median, smoothed_confidence
from matchlake.functions.exprs import match_order
from matchlake.operators.features import SPOT_RADIUS_FT
from matchlake.operators.ordered import Leaders, fold
from matchlake.sources.work import clustered, staged

AUTO_SAME_PATH_FT, DEFENSE_MATCH_S, MIN_MATCHES_FOR_COUNTERS = 3.0, 15.0, 3


def mode_max(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, mode, n``: the most frequent non-null value, on a tie the largest as text; nothing for keys without one."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    return counts.groupBy(*keys).agg(F.max(F.struct("count", F.col(value).cast("string").alias("text"), F.col(value).alias("v"))).alias("m")).select(*keys, F.col("m.v").alias("mode"), F.col("m.count").alias("n"))


def numbered(features: DataFrame) -> DataFrame:
    """Features with ``k``, a match's place among its team's matches."""
    return features.where("team is not null").withColumn("k", F.row_number().over(Window.partitionBy("team").orderBy(match_order(F.col("match_id")), "job_id")))


class _Routines:
    """Routines of one team: a match joins the first routine whose path is near its own, else begins one."""

    def __init__(self) -> None:
        self.found: list[tuple[list, list[str]]] = []

    def row(self, match_id: str, path: list[dict | None] | None) -> list[tuple]:
        for first, ids in self.found:
            gaps = [hypot(p["x"] - q["x"], p["y"] - q["y"]) for p, q in zip(first or (), path or ()) if p and q]
            if len(gaps) >= 3 and sum(gaps) / len(gaps) <= AUTO_SAME_PATH_FT:
                ids.append(match_id)
                return []
        self.found.append((path, [match_id]))
        return []

    def close(self) -> list[tuple]:
        ranked = sorted(self.found, key=lambda r: -len(r[1]))
        return [([{"matches": len(ids), "match_ids": ids, "path": path} for path, ids in ranked],)]


def auto_routines(features: DataFrame) -> DataFrame:
    """Routines of each team: paths within AUTO_SAME_PATH_FT of a routine's first path, in match order, largest first.

    The fold keeps one path for each routine and the ids of the matches, which are the result.
    """
    rows = numbered(features).where("movement is not null").select("team", "k", "match_id", F.col("auto_path.points").alias("path"))
    kind = "routines array<struct<matches:int,match_ids:array<string>,path:array<struct<x:double,y:double>>>>"
    return fold(rows, ["team"], ["k"], ["match_id", "path"], _Routines, kind)


class _TopSpots:
    """Leader clusters of one team's launches; the ``top`` largest at the end."""

    def __init__(self, radius: float, top: int):
        self.found, self.top = Leaders(radius), top

    def row(self, x: float, y: float) -> list[tuple]:
        if x is not None and y is not None:
            self.found.add(x, y)
        return []

    def close(self) -> list[tuple]:
        return [(rank, sx / n, sy / n, n) for rank, (sx, sy, n) in enumerate(self.found.ranked()[: self.top])]


def team_spots(features: DataFrame, top: int = 3) -> DataFrame:
    """The largest shooting spots of each team with launches and distinct matches near the spot.

    Launches stream once, in match order, to find the clusters, and meet the few largest of their team again to count matches.
    """
    points = numbered(features).select("team", "match_id", "k", F.posexplode("points.list").alias("i", "p")).select("team", "match_id", "k", "i", F.col("p.ax").alias("x"), F.col("p.ay").alias("y"))
    points = staged(points)
    found = staged(fold(points, ["team"], ["k", "i"], ["x", "y"], lambda: _TopSpots(SPOT_RADIUS_FT, top), "rank int, cx double, cy double, n int"))
    near = points.join(found, "team").where(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) <= SPOT_RADIUS_FT)
    matches = near.select("team", "rank", "match_id").distinct().groupBy("team", "rank").agg(F.count("*").alias("matches"))
    both = found.join(matches, ["team", "rank"], "left")
    spot = F.struct(F.bround("cx", 1).alias("ax"), F.bround("cy", 1).alias("ay"), F.col("n").alias("launches"), F.coalesce("matches", F.lit(0)).cast("int").alias("matches"))
    return both.groupBy("team").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", spot.alias("s")))), lambda r: r["s"]).alias("spots"))


def zone_medians(features: DataFrame, field: str) -> DataFrame:
    """Median over a team's located matches of each zone's share, a match without the zone counting 0.

    The zeros come before all shares, so the middle shares are found by their rank, moved on by the number of zeros.
    """
    located = features.where("movement is not null and team is not null")
    n = located.groupBy("team").agg(F.count("*").alias("n"))
    w = Window.partitionBy("team", "zone")
    seen = located.select("team", F.explode(F.col(field)).alias("zone", "share")).withColumn("c", F.count("*").over(w)).withColumn("at", F.row_number().over(w.orderBy("share")) - 1)
    at = F.col("at") + F.col("n") - F.col("c")
    middle = lambda p: F.coalesce(F.sum(F.when(at == F.floor(p), F.col("share"))), F.lit(0.0))
    medians = seen.join(n, "team").groupBy("team", "zone").agg(F.bround((middle((F.col("n") - 1) / 2) + middle(F.col("n") / 2)) / 2, 2).alias("m"))
    return medians.groupBy("team").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("zone", "m")))).alias("medians"))


#: What profiles read of each group of features.
_READ = {
    "zones": ["teleop_zones", "teleop_lanes"], "start": ["ax", "ay", "lane"], "movement": ["top_speed_ftps", "stationary_share"], "auto_path": ["points", "distance_ft"],
    "shooting": ["median_volley_interval_s", "median_launches_per_volley", "median_dwell_s", "on_the_move_share", "median_distance_to_hub_ft"],
    "defense": ["near_opponent_s"], "endgame": ["stopped_scoring_before_endgame_s"], "points": ["list"], "launches": ["total"],
}


def read_features(features: DataFrame) -> DataFrame:
    """The part of :func:`features.match_features` that :func:`build_profiles` reads; what it leaves out need not be computed before a table is written."""
    groups = [F.struct(*[F.col(f"{g}.{c}").alias(c) for c in names]) for g, names in _READ.items()]
    kept = [F.when(F.col("movement").isNotNull(), group).alias(g) if g == "movement" else group.alias(g) for g, group in zip(_READ, groups)]
    return features.select("job_id", "robot_key", "match_id", "team", *kept)


#: Groups that are computed together; each of these steps has few sorts, which share a task's memory.
_STEPS = [["zones"], ["auto_path", "start"], ["movement"], ["shooting"], ["defense", "endgame"], ["points", "launches"]]


def written_features(features: DataFrame) -> DataFrame:
    """:func:`read_features`, written: some groups at a time, then joined without a shuffle.

    In one step, the sorts and aggregates of all groups would stand in each task at once.
    """
    kept = read_features(features)
    out = clustered(kept.select("job_id", "robot_key", "match_id", "team"), ["job_id", "robot_key"])
    for step in _STEPS:
        out = out.join(clustered(kept.select("job_id", "robot_key", *step), ["job_id", "robot_key"]), ["job_id", "robot_key"], "left")
    return staged(out)


def build_profiles(features: DataFrame) -> DataFrame:
    """One row per team: counts, timing, tendencies, prediction and counters, over all its matches.

    Several groups scan the features, so pass a written table, of :func:`read_features` at least.
    """
    f = numbered(features).withColumn("located", F.col("movement").isNotNull())
    at = lambda path: F.when(F.col("located"), F.col(path))
    med = lambda path, name: rounded_median(at(path)).alias(name)
    near = at("defense.near_opponent_s")
    base = f.groupBy("team").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "match_id"))), lambda r: r["match_id"]).alias("matches"), F.count("*").alias("n_matches"), F.count_if("located").alias("n_with_positions"),
        rounded_median(F.coalesce("launches.total", F.lit(0))).alias("launches_per_match"), rounded_median(F.col("shooting.median_volley_interval_s")).alias("median_volley_interval_s"),
        rounded_median(F.col("shooting.median_launches_per_volley")).alias("median_launches_per_volley"), rounded_median(F.col("endgame.stopped_scoring_before_endgame_s")).alias("median_stopped_scoring_before_endgame_s"),
        F.count(at("start.ax")).alias("known_starts"), med("start.ax", "mean_start_ax"), med("start.ay", "mean_start_ay"), med("auto_path.distance_ft", "median_auto_distance_ft"),
        med("shooting.median_dwell_s", "median_dwell_s"), med("shooting.on_the_move_share", "on_the_move_share"), med("shooting.median_distance_to_hub_ft", "median_distance_to_hub_ft"),
        med("movement.top_speed_ftps", "top_speed_ftps"), med("movement.stationary_share", "stationary_share"),
        F.count_if(near >= DEFENSE_MATCH_S).alias("defense_matches"), F.count(near).alias("defense_of"), rounded_median(near).alias("median_near_opponent_s"),
    )
    lane = mode_max(f.where("located").select("team", F.col("start.lane").alias("lane")), ["team"], "lane").select("team", F.col("mode").alias("start_lane"), F.col("n").alias("start_lane_matches"))
    out = base.join(lane, "team", "left").join(auto_routines(features), "team", "left").join(team_spots(features), "team", "left")
    for name in ("teleop_zones", "teleop_lanes"):
        out = out.join(zone_medians(features, f"zones.{name}").withColumnRenamed("medians", name), "team", "left")
    return with_counters(with_prediction(out))


def with_prediction(profiles: DataFrame) -> DataFrame:
    """Adds what a team is expected to do next."""
    first = F.try_element_at("routines", F.lit(1))
    spot = F.try_element_at("spots", F.lit(1))
    return (
        profiles.withColumn("auto_routine_confidence", F.when(first.isNotNull(), smoothed_confidence(first["matches"], F.col("n_with_positions"))))
        .withColumn("primary_spot", F.when(spot.isNotNull(), F.struct(spot["ax"].alias("ax"), spot["ay"].alias("ay"))))
        .withColumn("plays_defense", F.when(F.col("defense_of") > 0, F.col("defense_matches") / F.col("defense_of") >= 0.5))
    )


def with_counters(profiles: DataFrame) -> DataFrame:
    """Adds ``counters``, advice whose rule a team's tendencies meet, each with its evidence; none below three located matches."""
    n = F.col("n_with_positions")
    routine, spot = F.try_element_at("routines", F.lit(1)), F.try_element_at("spots", F.lit(1))
    text = F.format_string
    stops = F.coalesce(F.col("on_the_move_share") < 0.3, F.lit(False))
    lane = F.try_element_at(F.array_sort(F.transform(F.map_entries("teleop_lanes"), lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("lane")))), F.lit(1))
    rules = [
        ("predictable_auto", routine["matches"] >= F.greatest(F.lit(2), F.ceil(0.7 * n)), F.lit("Their auto repeats: plan yours to contest the pieces on its path."), text("%d of %d located matches began with this path.", routine["matches"], n)),
        ("favourite_spot", spot["matches"] >= F.greatest(F.lit(2), F.ceil(0.6 * n)),
         F.concat(text("Deny their shooting spot about %.0f ft out, %.0f ft across in their frame", spot["ax"], spot["ay"]), F.when(stops, "; they stop to shoot there.").otherwise(".")),
         F.concat(text("%d of %d located matches had launches there", spot["matches"], n), F.when(F.col("median_dwell_s").isNotNull(), text(", stays of %.1f s as a median.", "median_dwell_s")).otherwise("."))),
        ("expect_defense", F.try_divide("defense_matches", "defense_of") >= 0.5, F.lit("Expect defense: keep a scoring route that avoids their half."), text("Marked an opponent in %d of %d matches.", "defense_matches", "defense_of")),
        ("early_endgame", F.col("median_stopped_scoring_before_endgame_s") > 10, F.lit("They stop scoring early: the last stretch of teleop is yours."), text("Median last shot %.0f s before the endgame.", "median_stopped_scoring_before_endgame_s")),
        ("lane_bias", -lane["o"] >= 0.6, F.concat(F.lit("They keep to the "), lane["lane"], F.lit(" lane of their view: block it or go around.")), text("Median %.0f%% of teleop in that lane.", -100 * lane["o"])),
    ]
    items = [F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(i).alias("id"), advice.alias("advice"), evidence.alias("evidence"))) for i, rule, advice, evidence in rules]
    return profiles.withColumn("counters", F.when(n >= MIN_MATCHES_FOR_COUNTERS, F.array_compact(F.array(*items))).otherwise(F.array_compact(F.array(*[F.when(F.lit(False), x) for x in items]))))


def expanding(matches: DataFrame, key: str, order: str, values: list[str], least: int) -> DataFrame:
    """Each match from the ``least + 1``-th on with ``k``, its place, and ``h_*``, the means of ``values`` over all earlier matches of its key."""
    w = Window.partitionBy(key).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return matches.select("*", F.row_number().over(w).alias("k"), *[F.avg(v).over(before).alias(f"h_{v}") for v in values]).where(F.col("k") > least)


class _History:
    """What a team's matches so far let expect of the next one: most frequent start lane, largest spot, whether it defends."""

    def __init__(self, least: int):
        self.least, self.lanes, self.located, self.defended, self.of = least, Counter(), 0, 0, 0
        self.spots = Leaders(SPOT_RADIUS_FT)

    def row(self, k: int, located: bool, lane: str | None, near: float | None, points: list[dict] | None) -> list[tuple]:
        out = []
        if k > self.least and self.located:
            best = max(self.lanes, key=lambda x: (self.lanes[x], x), default=None)
            spot = max(self.spots.sums, key=lambda c: c[2], default=None)
            out.append((k, best, *((spot[0] / spot[2], spot[1] / spot[2]) if spot else (None, None)), self.defended / self.of >= 0.5 if self.of else None))
        for p in points or ():
            if p["ax"] is not None and p["ay"] is not None:
                self.spots.add(p["ax"], p["ay"])
        if located:
            self.located += 1
            self.lanes.update([lane] if lane is not None else [])
            if near is not None:
                self.of, self.defended = self.of + 1, self.defended + (near >= DEFENSE_MATCH_S)
        return out

    def close(self) -> list[tuple]:
        return []


def next_match_test(features: DataFrame, min_history: int = 2) -> DataFrame:
    """Per prediction, trials, accuracy and the accuracy of a baseline blind to the team's history.

    A team's matches stream once, in order; what the earlier ones let expect is kept as counts and clusters.
    """
    f = numbered(features)
    rows = f.select("team", "k", F.col("movement").isNotNull().alias("located"), F.col("start.lane").alias("lane"), F.col("defense.near_opponent_s").alias("near"), F.col("points.list").alias("points"))
    said = fold(rows, ["team"], ["k"], ["k", "located", "lane", "near", "points"], lambda: _History(min_history), "k int, start_lane string, sx double, sy double, plays_defense boolean")
    pred = said.withColumn("primary_spot", F.when(F.col("sx").isNotNull(), F.struct(F.bround("sx", 1).alias("ax"), F.bround("sy", 1).alias("ay")))).drop("sx", "sy")
    field_lane = mode_max(f.select(F.lit(1).alias("one"), F.col("start.lane").alias("lane")), ["one"], "lane").select(F.col("mode").alias("field_lane"))
    actual = f.where("movement is not null").select("team", "k", F.col("start.lane").alias("lane"), F.try_element_at("spots.list", F.lit(1)).alias("spot"), F.col("defense.near_opponent_s").alias("near"))
    both = actual.join(pred, ["team", "k"]).join(field_lane)
    tests = [
        ("start_lane", F.when(F.col("start_lane").isNotNull() & F.col("lane").isNotNull(), F.col("start_lane") == F.col("lane")), F.col("field_lane") == F.col("lane")),
        ("primary_spot", F.when(F.col("primary_spot").isNotNull() & F.col("spot").isNotNull(), F.hypot(F.col("primary_spot.ax") - F.col("spot.ax"), F.col("primary_spot.ay") - F.col("spot.ay")) <= 2 * SPOT_RADIUS_FT), F.lit(None).cast("boolean")),
        ("plays_defense", F.when(F.col("plays_defense").isNotNull() & F.col("near").isNotNull(), F.col("plays_defense") == (F.col("near") >= DEFENSE_MATCH_S)), F.col("near") < DEFENSE_MATCH_S),
    ]
    long = both.select(F.explode(F.array(*[F.struct(F.lit(n).alias("test"), t.alias("ok"), F.when(t.isNotNull(), b).alias("base")) for n, t, b in tests])).alias("r")).select("r.*").where("ok is not null")
    return long.groupBy("test").agg(F.count("*").alias("n"), F.bround(F.avg(F.col("ok").cast("int")), 3).alias("accuracy"), F.bround(F.avg(F.col("base").cast("int")), 3).alias("baseline_accuracy"))
