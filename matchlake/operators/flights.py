"""Launches and goal entries of tracked balls, as windows over each ball's points, and the links between them.

Places are shares of the frame; lengths and speeds are taken in pixels of a frame ``width`` by ``height`` and stated
as shares of its diagonal. Gates and boundaries are short lists from a camera's configuration.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import hypot

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.exprs import crosses_directed, inside_polygon, on_edge
from matchlake.operators.temporal import band_join, islands

Point = tuple[float, float]

# Fixed values.
CARRY_FRAMES, MEMORY_FRAMES, PADDING = 4, 8, 0.08
LAUNCH_SPEED, AWAY_FRAMES, STRAIGHT, EDGE_REACH = 0.32, 3, 0.62, 0.025
FLIGHT_S, ARM_S, BACK_RADII = 3.0, 0.30, 0.25
LINK_S, LINK_MARGIN, SAME_S = 0.25, 0.25, 0.15
TRAIL_S = 0.5
TRACK = "array<struct<frame:bigint,t:double,x:double,y:double,radius:double>>"


@dataclass(frozen=True)
class Boundary:
    """A line, the direction in which crossing it counts, and how near it a move touches it."""

    a: Point
    b: Point
    direction: Point
    slack: float = 1e-9

    def crossed(self, p: Sequence[Column], q: Sequence[Column]) -> Column:
        return crosses_directed(p, q, *[tuple(map(F.lit, end)) for end in (self.a, self.b)], self.direction, self.slack)

    def depth(self, x: Column, y: Column, r: Column, width: float, height: float) -> Column:
        """How far a point lies beyond the line along its direction, in radii of a pixel at least; ``r`` is a share of the diagonal."""
        along = ((self.b[0] - self.a[0]) * width, (self.b[1] - self.a[1]) * height)
        ahead = self.direction[1] * height * along[0] - self.direction[0] * width * along[1]
        out, size = (-along[1], along[0]) if ahead >= 0 else (along[1], -along[0]), hypot(*along)
        away = ((x - self.a[0]) * width * out[0] + (y - self.a[1]) * height * out[1]) / size
        return away / F.greatest(r * hypot(width, height), F.lit(1.0))


@dataclass(frozen=True)
class Gate:
    """A goal as one camera sees it.

    A ball arms where it crosses ``approach`` (without one, anywhere) and enters where it then crosses ``made``; a gate
    without that line counts no entries. The entry
    counts once the ball was seen ``frames`` times inside ``interior`` moving along ``direction``, at ``depth`` radii.
    The even-odd rule counts a place on the interior's edge or not, by the side; with ``open_edge`` none counts.
    """

    goal: str
    region: str
    direction: Point
    made: Boundary | None = None
    approach: Boundary | None = None
    interior: tuple[Point, ...] | None = None
    misses: tuple[Boundary, ...] = ()
    frames: int = 1
    depth: float = 0.0
    gap_s: float = 0.085
    confirm_s: float = 0.25
    open_edge: bool = False


def _stretches(points: DataFrame, cuts: DataFrame | None, gap_s: float) -> DataFrame:
    """Points of each ball with ``stretch``, numbered anew behind a hole over ``gap_s`` and behind each cut ``(job_id, t)``."""
    p = points.select("job_id", "ball", F.col("frame").cast("long"), *[F.col(c).cast("double") for c in ("t", "x", "y", "r")])
    if cuts is not None:
        both = p.withColumn("side", F.lit(1)).unionByName(cuts.select("job_id", F.col("t").cast("double"), F.lit(0).alias("side")), allowMissingColumns=True)
        scene = F.count_if(F.col("side") == 0).over(Window.partitionBy("job_id").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
        p = both.withColumn("scene", scene).where("side = 1").drop("side")
    else:
        p = p.withColumn("scene", F.lit(0))
    before = Window.partitionBy("job_id", "ball").orderBy("frame")
    fresh = (F.col("t") - F.lag("t").over(before) > gap_s) | (F.col("scene") != F.lag("scene").over(before))
    return islands(p.withColumn("fresh", fresh), ["job_id", "ball"], ["frame"], F.col("fresh"), "stretch").drop("scene", "fresh")


def _entries_at(points: DataFrame, gate: Gate, width: float, height: float, cuts: DataFrame | None) -> DataFrame:
    """Every confirmed entry at one gate.

    Each point knows the last point of its stretch that armed, that crossed while armed, and that moved back; what stands
    between two of them is told by running maxima and counts alone.
    """
    rows = _stretches(points, cuts, gate.gap_s)
    key = Window.partitionBy("job_id", "ball", "stretch").orderBy("frame")
    so_far = key.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    p, q = (F.lag("x").over(key), F.lag("y").over(key)), (F.col("x"), F.col("y"))
    moved = rows.withColumn("px", p[0]).withColumn("py", p[1])
    was = (F.col("px"), F.col("py"))
    step = (F.col("x") - F.col("px")) * width * gate.direction[0] + (F.col("y") - F.col("py")) * height * gate.direction[1]
    radius = F.greatest(F.col("r") * hypot(width, height), F.lit(1.0))
    arms = gate.approach.crossed(was, q) if gate.approach else F.col("px").isNotNull()
    signs = moved.withColumn("back", F.coalesce(step / hypot(*gate.direction) < -BACK_RADII * radius, F.lit(False))).withColumn("inward", F.coalesce(step > 0, F.lit(False)))
    signs = signs.withColumn("arm_t", F.when(F.coalesce(arms, F.lit(False)), F.col("t"))).withColumn("back_t", F.when(F.col("back"), F.col("t")))
    signs = signs.withColumn("armed", last("arm_t")).withColumn("backed", last("back_t"))
    live = F.col("armed").isNotNull() & (F.col("t") - F.col("armed") <= ARM_S) & (F.col("backed").isNull() | (F.col("backed") < F.col("armed")))
    enters = F.coalesce(gate.made.crossed(was, q), F.lit(False)) & live
    corners = [F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in gate.interior or ()]
    inside = inside_polygon(F.col("x"), F.col("y"), F.array(*corners)) if corners else F.lit(True)
    if corners and gate.open_edge:
        inside = inside & ~on_edge(F.col("x"), F.col("y"), gate.interior)
    signs = signs.withColumn("sights", F.sum((F.col("inward") & inside).cast("int")).over(so_far))
    at = F.struct("frame", "t", (F.col("sights") - (F.col("inward") & inside).cast("int")).alias("sights"))
    signs = signs.withColumn("crossing", F.when(enters, at)).withColumn("crossing", last("crossing"))
    deep = gate.made.depth(F.col("x"), F.col("y"), F.col("r"), width, height)
    seen = F.col("sights") - F.col("crossing.sights")
    ok = F.col("crossing").isNotNull() & inside & F.col("inward") & (seen >= gate.frames) & (deep >= gate.depth) & (F.col("t") - F.col("crossing.t") <= gate.confirm_s)
    ok = ok & (F.col("backed").isNull() | (F.col("backed") < F.col("crossing.t")))
    found = signs.where(ok).groupBy("job_id", "ball").agg(F.min_by(F.struct("frame", "t", "crossing", deep.alias("depth")), "frame").alias("e"))
    sure = F.round(F.least(F.lit(0.99), 0.7 + 0.1 * F.greatest(F.lit(0.0), F.col("e.depth"))), 6)
    return found.select(
        "job_id", "ball", F.lit(gate.goal).alias("goal"), F.lit(gate.region).alias("region"), "e.frame", "e.t", F.col("e.crossing.frame").alias("crossing_frame"), F.col("e.crossing.t").alias("crossing_t"),
        sure.alias("confidence"),
    )


def _with_track(found: DataFrame, points: DataFrame, since: Column, until: Column) -> DataFrame:
    """``found`` with ``ball_track``, its ball's points between two times."""
    p = points.select("job_id", "ball", F.struct(F.col("frame").cast("long").alias("frame"), *[F.col(c).cast("double").alias(n) for c, n in (("t", "t"), ("x", "x"), ("y", "y"), ("r", "radius"))]).alias("p"))
    names = found.columns
    both = found.withColumn("_since", since).withColumn("_until", until).join(p, ["job_id", "ball"]).where("p.t between _since and _until")
    return both.groupBy(*names).agg(F.array_sort(F.collect_list("p")).cast(TRACK).alias("ball_track"))


def goal_entries(points: DataFrame, gates: Sequence[Gate], width: float, height: float, cuts: DataFrame | None = None) -> DataFrame:
    """``job_id, ball, goal, region, frame, t, crossing_frame, crossing_t, confidence, ball_track``: each ball's first confirmed entry.

    A move back along a gate's direction by BACK_RADII of the ball disarms it, as does ARM_S without a crossing. A hole
    over the gate's ``gap_s``, or a cut, starts anew. Of entries at one frame the gate listed first counts.
    ``points (job_id, ball, frame, t, x, y, r)`` with places as shares of the frame and radii of its diagonal;
    ``cuts (job_id, t)`` are the instants at which the scene begins anew.
    """
    every = [_entries_at(points, gate, width, height, cuts).withColumn("gate", F.lit(i)) for i, gate in enumerate(gates) if gate.made]
    found = every[0]
    for more in every[1:]:
        found = found.union(more)
    first = found.withColumn("_rn", F.row_number().over(Window.partitionBy("job_id", "ball").orderBy("frame", "gate"))).where("_rn = 1").drop("_rn", "gate")
    return _with_track(first, points, F.col("crossing_t") - TRAIL_S, F.col("t"))


def repeated_entries(entries: DataFrame, width: float, height: float) -> DataFrame:
    """``job_id, region, ball, same_as``: the ball of the earliest entry that an entry repeats, else null.

    Two entries of a region within SAME_S are one if two of their points of one frame lie together, or three of
    neighbouring frames nearly coincide, as when one flight is split over alternating tracks.
    """
    e = entries.select("job_id", "region", "ball", "t", "ball_track")
    o = entries.select("job_id", "region", F.col("ball").alias("same_as"), F.col("t").alias("o_t"), F.col("ball_track").alias("o_track"))
    pairs = band_join(e, o, ["job_id", "region"], "t", "o_t", SAME_S).where("o_t < t or (o_t = t and same_as < ball)")
    away = lambda p, q: F.hypot((p["x"] - q["x"]) * width, (p["y"] - q["y"]) * height)
    near = lambda p, q, least, part: away(p, q) <= F.greatest(F.lit(float(least)), F.least(p["radius"], q["radius"]) * hypot(width, height) * part)
    common = F.filter("ball_track", lambda p: F.exists("o_track", lambda q: (p["frame"] == q["frame"]) & near(p, q, 2, 0.8)))
    beside = F.filter("ball_track", lambda p: F.exists("o_track", lambda q: (F.abs(p["frame"] - q["frame"]) <= 1) & (F.abs(p["t"] - q["t"]) <= 0.022) & near(p, q, 1, 0.25)))
    same = pairs.where((F.size(common) >= 2) | (F.size(beside) >= 3)).groupBy("job_id", "region", "ball").agg(F.min_by("same_as", F.struct("o_t", "same_as")).alias("same_as"))
    return entries.select("job_id", "region", "ball").join(same, ["job_id", "region", "ball"], "left")


def flight(points: Column) -> Column:
    """``struct(t0, x, vx, y, vy, ay)``: the least-squares line in x and parabola in y of points ``(t, x, y)`` about their last time.

    Null for fewer than four points or three times. The sums of the normal equations are taken over the points' array.
    """
    t0 = F.try_element_at(points, F.lit(-1))["t"]
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("s0", "s1", "s2", "s3", "s4", "x0", "x1", "y0", "y1", "y2")])

    def add(s: Column, p: Column) -> Column:
        t = p["t"] - t0
        powers = {"s0": F.lit(1.0), "s1": t, "s2": t * t, "s3": t * t * t, "s4": t * t * t * t, "x0": p["x"], "x1": p["x"] * t, "y0": p["y"], "y1": p["y"] * t, "y2": p["y"] * t * t}
        return F.struct(*[(s[c] + v).alias(c) for c, v in powers.items()])

    def solved(s: Column) -> Column:
        line = s["s0"] * s["s2"] - s["s1"] * s["s1"]
        minor = lambda a, b, c, d: s[a] * s[b] - s[c] * s[d]
        m0, m1, m2 = minor("s2", "s4", "s3", "s3"), minor("s2", "s3", "s1", "s4"), minor("s1", "s3", "s2", "s2")
        det = s["s0"] * m0 + s["s1"] * m1 + s["s2"] * m2
        rows = ((m0, m1, m2), (m1, minor("s0", "s4", "s2", "s2"), minor("s1", "s2", "s0", "s3")), (m2, minor("s1", "s2", "s0", "s3"), minor("s0", "s2", "s1", "s1")))
        y, vy, ay = [F.try_divide(sum(m * s[f"y{i}"] for i, m in enumerate(row)), det) for row in rows]
        x = F.try_divide(s["x0"] * s["s2"] - s["x1"] * s["s1"], line)
        vx = F.try_divide(s["x1"] * s["s0"] - s["x0"] * s["s1"], line)
        return F.when((s["s0"] >= 4) & (det > 1e-18), F.struct(t0.alias("t0"), x.alias("x"), vx.alias("vx"), y.alias("y"), vy.alias("vy"), ay.alias("ay")))

    return F.aggregate(points, zero, add, solved)


def link_entries(entries: DataFrame, shots: DataFrame, width: float, height: float) -> DataFrame:
    """``job_id, entry_id, shot_id, association, confidence``: the shot that each goal entry ends, null where none is sure.

    An entry of a shot's own ball is that shot's. Of the others, a shot whose flight, by its last eight points, passes an
    entry's first three points takes it if every other entry of the shot and every other shot of the entry costs
    LINK_MARGIN more; the cost is the mean miss in ball widths, and one of more than one width is no link.
    ``entries (job_id, entry_id, ball, t, ball_track)``, ``shots (job_id, shot_id, ball, launch_t, ball_track)``.
    """
    recent = F.col("t").between(F.col("launch_t"), F.col("launch_t") + FLIGHT_S)
    own = entries.select("job_id", "entry_id", "ball", "t").join(shots.select("job_id", "ball", "shot_id", "launch_t"), ["job_id", "ball"]).where(recent)
    own = own.groupBy("job_id", "entry_id").agg(F.max_by("shot_id", F.struct("launch_t", "shot_id")).alias("shot_id"))
    e = entries.join(own.select("job_id", "entry_id"), ["job_id", "entry_id"], "left_anti").select("job_id", "entry_id", "t", F.slice("ball_track", 1, 3).alias("first"))
    e = e.withColumn("begins", F.try_element_at("first", F.lit(1))["t"])
    s = shots.join(own.select("job_id", "shot_id").distinct(), ["job_id", "shot_id"], "left_anti")
    s = s.select("job_id", "shot_id", "launch_t", F.reverse(F.slice(F.reverse("ball_track"), 1, 8)).alias("tail")).withColumn("flight", flight(F.col("tail"))).where("flight is not null")
    s = s.withColumn("ends", F.col("flight.t0"))
    near = band_join(e, s, ["job_id"], "begins", "ends", LINK_S).where("begins > ends and size(first) > 1").where(F.col("t").between(F.col("launch_t"), F.col("launch_t") + FLIGHT_S))
    f, ahead = F.col("flight"), lambda p: p["t"] - F.col("flight.t0")
    miss = lambda p: F.hypot((f["x"] + f["vx"] * ahead(p) - p["x"]) * width, (f["y"] + f["vy"] * ahead(p) + f["ay"] * ahead(p) * ahead(p) - p["y"]) * height)
    wide = lambda p: F.greatest(2 * p["radius"] * hypot(width, height), F.lit(2.0))
    cost = F.aggregate("first", F.lit(0.0), lambda acc, p: acc + miss(p) / wide(p), lambda acc: acc / F.size("first"))
    priced = near.select("job_id", "entry_id", "shot_id", cost.alias("cost")).where("cost <= 1")

    def rival(key: str, other: str) -> Column:
        """The least cost among a key's other partners."""
        w = Window.partitionBy("job_id", key).orderBy("cost", other)
        return F.when(F.row_number().over(w) == 1, F.lead("cost").over(w)).otherwise(F.first("cost").over(w))

    clear = priced.withColumn("against", F.least(rival("entry_id", "shot_id"), rival("shot_id", "entry_id")))
    linked = clear.where(F.coalesce(F.col("against") - F.col("cost") >= LINK_MARGIN, F.lit(True)))
    linked = linked.select("job_id", "entry_id", "shot_id", F.lit("trajectory_relink").alias("association"), F.greatest(F.lit(0.5), 0.9 - 0.3 * F.col("cost")).alias("confidence"))
    found = own.select("job_id", "entry_id", "shot_id", F.lit("same_track").alias("association"), F.lit(1.0).alias("confidence")).unionByName(linked)
    return entries.select("job_id", "entry_id").join(found, ["job_id", "entry_id"], "left").withColumn("association", F.coalesce("association", F.lit("unassigned")))


def credited(shots: DataFrame, links: DataFrame, entries: DataFrame) -> DataFrame:
    """Shots with the outcome ``made`` and the goal and time of the entry linked to them; their points and its points become one track, the entry's where both have a frame."""
    e = links.where("shot_id is not null").join(entries.select("job_id", "entry_id", F.col("goal").alias("e_goal"), F.col("t").alias("e_t"), F.col("ball_track").alias("e_track")), ["job_id", "entry_id"])
    first = e.groupBy("job_id", "shot_id").agg(F.min_by(F.struct("e_goal", "e_t", "e_track"), F.struct("e_t", "entry_id")).alias("e"))
    both = shots.join(first, ["job_id", "shot_id"], "left")
    later = F.filter("e.e_track", lambda p: p["frame"] >= F.try_element_at(F.col("ball_track"), F.lit(1))["frame"])
    seen = F.transform(later, lambda p: p["frame"])
    merged = F.array_sort(F.concat(F.filter("ball_track", lambda p: ~F.array_contains(seen, p["frame"])), later))
    made = F.col("e").isNotNull()
    return both.withColumn("outcome", F.when(made, "made").otherwise(F.col("outcome"))).withColumn("goal", F.when(made, F.col("e.e_goal")).otherwise(F.col("goal"))).withColumn("outcome_t", F.when(made, F.col("e.e_t")).otherwise(F.col("outcome_t"))).withColumn("ball_track", F.when(made, merged).otherwise(F.col("ball_track"))).drop("e")


def launches(points: DataFrame, robots: DataFrame, gates: Sequence[Gate], width: float, height: float) -> DataFrame:
    """``job_id, ball, launch_frame, launch_t, robot, confidence, outcome, goal, outcome_t, ball_track`` of balls that a robot launches.

    A ball within one robot's box, grown by PADDING, for CARRY_FRAMES running is carried by it for MEMORY_FRAMES more. Its
    launch is the first point outside all boxes from which AWAY_FRAMES points lie outside, ever farther from where it left,
    fast and straight enough. A ball first seen within EDGE_REACH of one robot's box was carried by that one. The launch
    is ``missed`` where its ball then crosses a gate's miss boundary within FLIGHT_S, else ``unknown``.
    ``points (job_id, ball, frame, t, x, y, r)`` and ``robots (job_id, frame, track_id, x1, y1, x2, y2)`` in pixels.
    """
    diagonal = hypot(width, height)
    boxes = robots.groupBy("job_id", "frame").agg(F.array_sort(F.collect_list(F.struct("track_id", "x1", "y1", "x2", "y2"))).alias("robots"))
    p = points.select("job_id", "ball", F.col("frame").cast("long"), *[F.col(c).cast("double") for c in ("t", "x", "y", "r")]).join(boxes, ["job_id", "frame"], "left")
    grown = lambda b, lo, hi, at: (at >= b[lo] - (b[hi] - b[lo]) * PADDING) & (at <= b[hi] + (b[hi] - b[lo]) * PADDING)
    away = lambda b: F.hypot(F.greatest(b["x1"] - F.col("x"), F.lit(0.0), F.col("x") - b["x2"]), F.greatest(b["y1"] - F.col("y"), F.lit(0.0), F.col("y") - b["y2"]))
    ids = lambda test: F.coalesce(F.transform(F.filter("robots", test), lambda b: b["track_id"]), F.array())
    p = p.withColumn("within", ids(lambda b: grown(b, "x1", "x2", F.col("x")) & grown(b, "y1", "y2", F.col("y")))).withColumn("beside", ids(lambda b: away(b) <= EDGE_REACH * diagonal)).drop("robots")
    key = Window.partitionBy("job_id", "ball").orderBy("frame")
    p = p.withColumn("holder", F.when(F.size("within") == 1, F.get("within", F.lit(0)))).withColumn("changed", ~F.col("holder").eqNullSafe(F.lag("holder").over(key)))
    runs = islands(p, ["job_id", "ball"], ["frame"], F.col("changed"), "run")
    held = F.row_number().over(Window.partitionBy("job_id", "ball", "run").orderBy("frame"))
    runs = runs.withColumn("carrier", F.when(F.col("holder").isNotNull() & (held >= CARRY_FRAMES), F.col("holder"))).withColumn("nth", F.row_number().over(key))
    edge = F.when((F.col("nth") == 1) & (F.size("beside") == 1) & (F.size("within") == 0), F.get("beside", F.lit(0)))
    runs = runs.withColumn("source", F.coalesce(F.last("carrier", ignorenulls=True).over(key.rowsBetween(-MEMORY_FRAMES, 0)), edge))
    outside = F.size("within") == 0
    dist = lambda a, b: F.hypot(F.col(f"x{b}") - F.col(f"x{a}"), F.col(f"y{b}") - F.col(f"y{a}"))
    for k in range(AWAY_FRAMES):
        runs = runs.withColumns({f"x{k}": F.lead("x", k).over(key), f"y{k}": F.lead("y", k).over(key), f"t{k}": F.lead("t", k).over(key), f"out{k}": F.lead(outside, k).over(key)})
    n = AWAY_FRAMES - 1
    clear, path = F.lit(True), F.lit(0.0)
    for k in range(AWAY_FRAMES):
        clear, path = clear & F.coalesce(F.col(f"out{k}"), F.lit(False)), path + (dist(k - 1, k) if k else F.lit(0.0))
    farther = F.lit(True)
    for k in range(1, AWAY_FRAMES):
        farther = farther & (dist(0, k) > (dist(0, k - 1) if k > 1 else F.lit(0.0)))
    speed, straight = dist(0, n) / (F.col(f"t{n}") - F.col("t0")) / diagonal, dist(0, n) / path
    good = F.col("source").isNotNull() & clear & farther & (speed >= LAUNCH_SPEED) & (straight >= STRAIGHT)
    sure = F.round(0.5 + 0.49 * F.least(F.lit(1.0), straight) * F.least(F.lit(1.0), speed / (2 * LAUNCH_SPEED)), 6)
    found = runs.where(good).groupBy("job_id", "ball").agg(F.min_by(F.struct(F.col("frame").alias("launch_frame"), F.col("t").alias("launch_t"), F.col("source").alias("robot"), sure.alias("confidence")), "frame").alias("l"))
    found = found.select("job_id", "ball", "l.*")
    lines = [(gate.goal, line) for gate in gates for line in gate.misses]
    share = points.select("job_id", "ball", F.col("t").cast("double"), (F.col("x") / width).alias("x"), (F.col("y") / height).alias("y"), "frame")
    share = share.withColumn("px", F.lag("x").over(key)).withColumn("py", F.lag("y").over(key))
    goal = F.coalesce(*[F.when(line.crossed((F.col("px"), F.col("py")), (F.col("x"), F.col("y"))), F.lit(name)) for name, line in lines], F.lit(None).cast("string"))
    misses = share.withColumn("goal", goal).where("goal is not null").join(found.select("job_id", "ball", "launch_t"), ["job_id", "ball"])
    misses = misses.where((F.col("t") > F.col("launch_t")) & (F.col("t") <= F.col("launch_t") + FLIGHT_S)).groupBy("job_id", "ball").agg(F.min_by(F.struct("goal", F.col("t").alias("outcome_t")), "t").alias("m"))
    told = found.join(misses, ["job_id", "ball"], "left").withColumn("outcome", F.when(F.col("m").isNotNull(), "missed").otherwise("unknown"))
    told = told.select("job_id", "ball", "launch_frame", "launch_t", "robot", "confidence", "outcome", "m.goal", "m.outcome_t")
    return _with_track(told, points, F.col("launch_t"), F.least(F.col("launch_t") + FLIGHT_S, F.coalesce("outcome_t", F.col("launch_t") + FLIGHT_S)))
