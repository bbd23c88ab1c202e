"""Moments worth labelling, motion tests, and estimates over short losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.folds import theil_sen
from matchlake.operators.temporal import islands

TRACK = ["job_id", "track_id"]


def find_moments(boxes: DataFrame, least_life: int = 3, small: float = 0.5, hole: float = 1.0) -> DataFrame:
    """``job_id, track_id, t, reason`` where a detector probably erred.

    ``flicker``: a track of fewer than ``least_life`` boxes. ``undersized``: a box below ``small`` of its track's median
    area. ``vanished``: a track's last box away from the frame's edge before the clip ends. ``hole``: no box for longer
    than ``hole``. ``count_drop``: two or more robots fewer in a second than in the clip's median second.
    """
    w = Window.partitionBy(*TRACK)
    area = F.col("w") * F.col("h")
    b = boxes.withColumn("n", F.count("*").over(w)).withColumn("mid", F.median(area).over(w)).withColumn("before", F.lag("t").over(w.orderBy("t"))).withColumn("last", F.max("t").over(w)).withColumn("stop", F.max("t").over(Window.partitionBy("job_id")))
    edge = F.least(F.col("x"), F.col("y"), 1 - F.col("x") - F.col("w"), 1 - F.col("y") - F.col("h")) <= 0.02
    reasons = F.array_compact(F.array(
        F.when((F.col("n") < least_life) & F.col("before").isNull(), F.lit("flicker")), F.when(area < small * F.col("mid"), F.lit("undersized")),
        F.when((F.col("t") == F.col("last")) & (F.col("t") < F.col("stop") - 1) & ~edge, F.lit("vanished")), F.when(F.col("t") - F.col("before") > hole, F.lit("hole"))))
    found = b.select(*TRACK, "t", F.explode(reasons).alias("reason"))
    seconds = boxes.groupBy("job_id", F.floor("t").alias("second")).agg(F.count_distinct("track_id").alias("n"))
    drops = seconds.withColumn("usual", F.median("n").over(Window.partitionBy("job_id"))).where("usual - n >= 2")
    return found.unionByName(drops.select("job_id", F.lit(None).cast("int").alias("track_id"), F.col("second").cast("double").alias("t"), F.lit("count_drop").alias("reason")))


def presence(boxes: DataFrame, reach: float = 0.5) -> DataFrame:
    """Tracks seen within ``reach`` of each whole second; each sighting serves the seconds it is near to."""
    near = boxes.withColumn("second", F.explode(F.sequence(F.ceil(F.col("t") - reach), F.floor(F.col("t") + reach))))
    return near.groupBy("job_id", "second").agg(F.count_distinct("track_id").alias("tracks"))


def window_motion(boxes: DataFrame, least: float = 0.02) -> DataFrame:
    """Whether the median centre of a track's second half is away from that of its first half."""
    w = Window.partitionBy(*TRACK).orderBy("t")
    half = F.when(F.ntile(2).over(w) == 1, "a").otherwise("b")
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    m = boxes.withColumn("half", half).withColumn("cx", cx).withColumn("cy", cy)
    mid = lambda c, s: F.median(F.when(F.col("half") == s, F.col(c)))
    moved = F.hypot(mid("cx", "b") - mid("cx", "a"), mid("cy", "b") - mid("cy", "a"))
    return m.groupBy(*TRACK).agg((F.coalesce(moved, F.lit(0.0)) >= F.greatest(F.lit(least), 0.10 * F.hypot(F.median("w"), F.median("h")))).alias("moves"))


def startup_alliance(boxes: DataFrame, seconds: float = 2.0, split: float = 0.5) -> DataFrame:
    """Side of tracks seen at the start: left of ``split`` is blue, else red."""
    early = boxes.where(F.col("t") <= seconds).groupBy(*TRACK).agg(F.median(F.col("x") + F.col("w") / 2).alias("cx"))
    return early.select(*TRACK, F.when(F.col("cx") < split, "blue").otherwise("red").alias("alliance"))


def tracklets(boxes: DataFrame, gap: float = 5.0) -> DataFrame:
    """Adds ``fragment``: a new one after a hole longer than ``gap`` or when the stable id changes."""
    w = Window.partitionBy("job_id", "raw_track_id").orderBy("t")
    new = (F.col("t") - F.lag("t").over(w) > gap) | ~F.col("stable_track_id").eqNullSafe(F.lag("stable_track_id").over(w))
    return islands(boxes.withColumn("_new", F.when(F.lag("t").over(w).isNotNull(), new)), ["job_id", "raw_track_id"], ["t"], F.col("_new"), "fragment").drop("_new")


def velocity(samples: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """Adds ``vx, vy``: the median of pairwise slopes of the last ``n`` placed samples."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(1 - n, 0)
    s = samples.where("x is not null").withColumn("_t", F.collect_list("t").over(w)).withColumn("_x", F.collect_list("x").over(w)).withColumn("_y", F.collect_list("y").over(w))
    return s.withColumn("vx", theil_sen(F.col("_t"), F.col("_x"))).withColumn("vy", theil_sen(F.col("_t"), F.col("_y"))).drop("_t", "_x", "_y")


def coast(samples: DataFrame, gaps: DataFrame, keys: list[str], rate: float = 10.0, most: float = 1.0, decay: float = 0.6) -> DataFrame:
    """Estimated rows in gaps of lost detection up to ``most`` long: the last place moved on at a velocity that decays per second.

    Adds ``estimated``; gaps for other reasons stay empty.
    """
    v = velocity(samples, keys).select(*keys, F.col("t").alias("start"), "x", "y", "vx", "vy")
    g = gaps.where("reason = 'detection_lost'").where(F.col("end") - F.col("start") <= most)
    k = g.join(v, [*keys, "start"]).withColumn("_k", F.explode(F.sequence(F.floor(F.col("start") * rate + 1e-9) + 1, F.ceil(F.col("end") * rate - 1e-9) - 1)))
    dt = F.col("_k") / rate - F.col("start")
    far = (F.lit(1.0) - F.pow(F.lit(decay), dt)) / -F.log(F.lit(decay))
    made = k.where(F.col("_k") / rate > F.col("start")).select(*keys, F.bround(F.col("_k") / rate, 6).alias("t"), (F.col("x") + F.coalesce("vx", F.lit(0.0)) * far).alias("x"), (F.col("y") + F.coalesce("vy", F.lit(0.0)) * far).alias("y"), F.lit(True).alias("estimated"))
    return samples.select(*keys, "t", "x", "y", F.lit(False).alias("estimated")).unionByName(made)


def steady_tags(sightings: DataFrame, least: int = 5, drift: float = 2.0) -> DataFrame:
    """Median pixel of tags seen often enough and not moving; others with the reason."""
    g = sightings.groupBy("tag").agg(F.count("*").alias("n"), F.median("px").alias("px"), F.median("py").alias("py"), F.greatest(F.max("px") - F.min("px"), F.max("py") - F.min("py")).alias("drift"))
    return g.withColumn("reason", F.when(F.col("n") < least, "too_few").when(F.col("drift") > drift, "moves"))


def seam(centres: DataFrame, least_gap: float = 0.1) -> DataFrame:
    """Per frame, the middle of the largest gap between sorted heights of boxes, if it is wide enough: where two stacked views meet."""
    gap = centres.withColumn("before", F.lag("cy").over(Window.partitionBy("frame_id").orderBy("cy"))).where("before is not null")
    best = gap.groupBy("frame_id").agg(F.max(F.struct((F.col("cy") - F.col("before")).alias("gap"), ((F.col("cy") + F.col("before")) / 2).alias("y"))).alias("g"))
    return best.where(F.col("g.gap") >= least_gap).select("frame_id", F.col("g.y").alias("seam"))


def view_split(centres: DataFrame, usable: float = 0.35, least_gap: float = 0.1) -> DataFrame:
    """Median seam of a clip, one row, if at least ``usable`` of its frames show one."""
    n = centres.agg(F.count_distinct("frame_id").alias("frames"))
    s = seam(centres, least_gap).agg(F.count("*").alias("with_seam"), F.median("seam").alias("seam"))
    return s.join(n).where(F.col("with_seam") >= usable * F.col("frames")).select("seam", "with_seam", "frames")
