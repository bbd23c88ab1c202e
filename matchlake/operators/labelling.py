"""What to label and which boxes to propose: sample plans, hard moments, filters, and boxes at any instant."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.operators.fusion import box_problem, non_max, overlap
from matchlake.operators.ordered import fold

# Fixed values.
SKIP_HEAD, SKIP_TAIL, PLAN_GAP_S = 0.10, 0.08, 8.0
REASONS, MOMENT_GAP_S = ("hole", "vanished", "undersized", "static", "count_drop", "flicker"), 2.0
NMS_IOU, COLOUR_SHARE, COLOUR_BONUS, SURE = 0.75, 0.02, 0.08, 0.60
LINK_IOU, LINK_DISTANCE, LINK_MISSES, LEAST_HITS = 0.15, 0.10, 2, 2
MOST_REPROJECTION_FT = 1.5


def plan_frames(segments: DataFrame, total: int, gap: float = PLAN_GAP_S) -> DataFrame:
    """``segment, turn, t`` of ``total`` frames at most, spread round robin over ``segments (segment, duration)``.

    Each segment offers evenly spread times without its head and tail, ``gap`` apart or more; a single one lies in the middle.
    """
    start, end = F.col("duration") * SKIP_HEAD, F.col("duration") * (1 - SKIP_TAIL)
    usable = end - start
    n = F.least(F.lit(total), F.greatest(F.lit(1), F.floor(usable / gap) + 1)).cast("int")
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(n == 1, start + usable / 2).otherwise(start + usable / (n - 1) * i))
    offered = segments.where(F.col("duration") > 0).select("segment", F.posexplode(at).alias("turn", "t"))
    return offered.orderBy("turn", "segment").limit(max(0, total))


class _Moments:
    """One recording's moments, chosen at the end: the worst left of each reason in turn, none near another."""

    def __init__(self, limit: int, gap: float):
        self.limit, self.gap, self.queues = limit, gap, {r: [] for r in REASONS}

    def row(self, t: float, reason: str, severity: float) -> Iterable[tuple]:
        if reason in self.queues:
            self.queues[reason].append((-severity, t))
        return ()

    def close(self) -> Iterable[tuple]:
        chosen: list[tuple] = []
        queues = {r: iter(sorted(q)) for r, q in self.queues.items()}
        while queues and len(chosen) < self.limit:
            for reason in list(queues):
                free = next(((s, t) for s, t in queues[reason] if all(abs(t - c[0]) >= self.gap for c in chosen)), None)
                if free is None:
                    del queues[reason]
                elif len(chosen) < self.limit:
                    chosen.append((free[1], reason, -free[0]))
        return sorted(chosen)


def hard_moments(moments: DataFrame, limit: int, gap: float = MOMENT_GAP_S) -> DataFrame:
    """``job_id, t, reason, severity``: up to ``limit`` moments of each job, ``gap`` apart or more, the reasons taken in turn.

    A recording has a few hundred moments; they are held until its choice is made.
    """
    m = moments.select("job_id", F.col("t").cast("double"), "reason", F.col("severity").cast("double"))
    return fold(m, ["job_id"], ["t", "reason"], ["t", "reason", "severity"], lambda: _Moments(limit, gap), "t double, reason string, severity double")


def filtered(proposals: DataFrame, **rules: float) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` proposals: by geometry and confidence, then, with a bonus for team colour, by suppression.

    ``proposals`` may have ``colour_share``, the larger share of a box that is of either side's colour. Accepted rows
    keep ``raw_confidence``; rejected ones have ``reason``, ``duplicate`` for those suppressed.
    """
    p = proposals if "colour_share" in proposals.columns else proposals.withColumn("colour_share", F.lit(None).cast("double"))
    marked = p.withColumn("reason", box_problem(**rules))
    bonus = F.when(F.col("colour_share") >= COLOUR_SHARE, COLOUR_BONUS).otherwise(0.0)
    fit = marked.where("reason is null").withColumn("raw_confidence", F.col("confidence")).withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("confidence") + bonus), 6))
    key = ["frame_id", "source", "x", "y", "w", "h"]
    kept = non_max(fit, NMS_IOU).select(*key).distinct()
    gone = fit.join(kept, key, "left_anti").withColumn("reason", F.lit("duplicate"))
    return fit.join(kept, key, "left_semi").drop("reason"), marked.where("reason is not null").unionByName(gone, allowMissingColumns=True)


class _Supported:
    """Boxes of one clip, linked frame by frame; a box is given once its track has ended or gathered enough hits."""

    def __init__(self) -> None:
        self.frame, self.rows, self.active, self.made = None, [], [], 0

    def _ended(self, track: dict) -> Iterable[tuple]:
        return [(track["id"], len(track["boxes"]), *b) for b in track["boxes"]]

    def _frame(self) -> Iterable[tuple]:
        options = []
        for j, (_, x, y, w, h, _) in enumerate(self.rows):
            for i, track in enumerate(self.active):
                a, b = track["boxes"][-1][1:5], (x, y, w, h)
                over, away = overlap(a, b), float(np.hypot(a[0] + a[2] / 2 - x - w / 2, a[1] + a[3] / 2 - y - h / 2))
                if over >= LINK_IOU or away <= LINK_DISTANCE:
                    options.append((over - away, j, i))
        used, taken = set(), set()
        for _, j, i in sorted(options, reverse=True):
            if j not in used and i not in taken:
                used.add(j), taken.add(i)
                self.active[i]["boxes"].append(self.rows[j])
        for j, b in enumerate(self.rows):
            if j not in used:
                self.made += 1
                self.active.append({"id": self.made, "boxes": [b]})
        self.rows = []

    def row(self, frame: int, x: float, y: float, w: float, h: float, confidence: float) -> Iterable[tuple]:
        out: list[tuple] = []
        if frame != self.frame:
            if self.frame is not None:
                self._frame()
            for track in [t for t in self.active if frame - t["boxes"][-1][0] - 1 > LINK_MISSES]:
                out += self._ended(track)
                self.active.remove(track)
            self.frame = frame
        self.rows.append((frame, x, y, w, h, confidence))
        return out

    def close(self) -> Iterable[tuple]:
        self._frame()
        return [r for track in self.active for r in self._ended(track)]


def supported(boxes: DataFrame) -> DataFrame:
    """Boxes ``(clip, frame_index, x, y, w, h, confidence)`` with their ``track``, its ``hits``, and whether they stay.

    Boxes of a frame and tracks seen at most LINK_MISSES frames before pair by overlap less distance, the best first. A
    box stays with LEAST_HITS on its track (``temporal_support``), or alone with a sure confidence; else it goes.
    """
    b = boxes.select("clip", F.col("frame_index").cast("long"), *[F.col(c).cast("double") for c in ("x", "y", "w", "h", "confidence")])
    names = ["frame_index", "x", "y", "w", "h", "confidence"]
    kind = "track int, hits int, frame_index long, x double, y double, w double, h double, confidence double"
    found = fold(b, ["clip"], ["frame_index", F.desc("confidence"), "x", "y"], names, _Supported, kind)
    reason = F.when(F.col("hits") >= LEAST_HITS, "temporal_support").when(F.col("confidence") >= SURE, "high_confidence_single_frame").otherwise("insufficient_temporal_support")
    return found.withColumn("reason", reason).withColumn("stays", F.col("reason") != "insufficient_temporal_support")


def boxes_at(boxes: DataFrame, asked: DataFrame, gaps: DataFrame, hold: float = 0.0) -> DataFrame:
    """``job_id, at, track_id`` and the interpolated ``x, y, w, h`` of every track visible at the asked instants.

    ``boxes (job_id, track_id, t, x, y, w, h)``, ``asked (job_id, at)``, ``gaps (job_id, track_id, start, end)``. Between two
    boxes that a gap parts, the first is held for ``hold`` and no more, as is a track's last; in a gap nothing is seen.
    Spans between boxes are listed in the whole seconds they touch, where they meet the instants.
    """
    w = Window.partitionBy("job_id", "track_id").orderBy("t")
    names = ("x", "y", "w", "h")
    spans = boxes.select("job_id", "track_id", "t", *names, F.lead("t").over(w).alias("t2"), *[F.lead(c).over(w).alias(f"{c}2") for c in names])
    g = gaps.groupBy("job_id", "track_id").agg(F.collect_list(F.struct("start", "end")).alias("gaps"))
    spans = spans.join(g, ["job_id", "track_id"], "left")
    parted = F.coalesce(F.exists("gaps", lambda k: (k["start"] < F.col("t2")) & (k["end"] > F.col("t"))), F.lit(False))
    spans = spans.withColumn("parted", parted | F.col("t2").isNull()).withColumn("until", F.when(F.col("parted"), F.col("t") + hold).otherwise(F.col("t2")))
    second = F.explode(F.sequence(F.floor("t"), F.floor(F.col("until") + 1e-9)))
    met = asked.withColumn("second", F.floor("at")).join(spans.withColumn("second", second), ["job_id", "second"])
    held = F.col("at") <= F.col("until") + 1e-9
    here = met.where((F.col("at") >= F.col("t") - 1e-9) & F.when(F.col("parted"), held & (F.col("t2").isNull() | (F.col("at") < F.col("t2")))).otherwise(F.col("at") < F.col("t2")))
    blocked = F.coalesce(F.exists("gaps", lambda k: (k["start"] <= F.col("at")) & (F.col("at") < k["end"])), F.lit(False))
    u = F.when(F.col("parted"), 0.0).otherwise((F.col("at") - F.col("t")) / (F.col("t2") - F.col("t")))
    value = lambda c: F.when(F.col("parted"), F.col(c)).otherwise(F.col(c) + (F.col(f"{c}2") - F.col(c)) * u).alias(c)
    return here.where(~blocked).select("job_id", "at", "track_id", *[value(c) for c in names])


class _Plane:
    """Correspondences of one view, solved when all are there; a view has a few dozen."""

    def __init__(self) -> None:
        self.points: list[tuple] = []

    def row(self, x: float, y: float, fx: float, fy: float) -> Iterable[tuple]:
        self.points.append((x, y, fx, fy))
        return ()

    @staticmethod
    def _centred(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean, spread = p.mean(axis=0), np.sqrt(((p - p.mean(axis=0)) ** 2).sum(axis=1)).mean()
        s = np.sqrt(2) / spread if spread > 0 else 1.0
        t = np.array([[s, 0, -s * mean[0]], [0, s, -s * mean[1]], [0, 0, 1]])
        return t, np.c_[p, np.ones(len(p))] @ t.T

    def close(self) -> Iterable[tuple]:
        p = np.array(self.points)
        if len(p) < 4:
            return ()
        (t1, a), (t2, b) = self._centred(p[:, :2]), self._centred(p[:, 2:])
        zero = np.zeros_like(a)
        rows = np.vstack((np.c_[a, zero, -b[:, :1] * a], np.c_[zero, a, -b[:, 1:2] * a]))
        _, s, v = np.linalg.svd(rows)
        if s[7] < 1e-9 * s[0]:
            return ()
        h = np.linalg.inv(t2) @ v[8].reshape(3, 3) @ t1
        seen = np.c_[p[:, :2], np.ones(len(p))] @ h.T
        if abs(h[2, 2]) < 1e-12 or (np.abs(seen[:, 2]) < 1e-12).any():
            return ()
        error = np.hypot(*(seen[:, :2] / seen[:, 2:] - p[:, 2:]).T).max()
        return [((h / h[2, 2]).ravel().tolist(), float(error), len(p))]


def fit_homography(points: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, matrix, reprojection_ft, points, trustworthy``: the plane map of each view by least squares; none for fewer than four points or points on a line.

    ``points (keys, x, y, field_x, field_y)``. Four points fit exactly, so their error says nothing; more are
    trustworthy within MOST_REPROJECTION_FT.
    """
    p = points.select(*keys, *[F.col(c).cast("double") for c in ("x", "y", "field_x", "field_y")]).dropna(subset=["x", "y", "field_x", "field_y"])
    found = fold(p, keys, ["x", "y", "field_x", "field_y"], ["x", "y", "field_x", "field_y"], _Plane, "matrix array<double>, reprojection_ft double, points int")
    return found.withColumn("trustworthy", (F.col("points") == 4) | (F.col("reprojection_ft") <= MOST_REPROJECTION_FT))


def focal_pixels(width: Column, view_degrees: Column) -> Column:
    """Focal length in pixels of a pinhole camera by its horizontal field of view; null outside 1 to 179 degrees."""
    return F.when((width > 0) & (view_degrees > 1) & (view_degrees < 179), width / (2 * F.tan(F.radians(view_degrees) / 2)))


def robot_sized(boxes: DataFrame, share: float = 0.4, recent: int = 300, least: int = 10) -> DataFrame:
    """Adds ``typical``, the upper median width of the ``recent`` boxes before, and whether a box is no narrower than ``share`` of it.

    ``boxes (job_id, frame, t, w)``; with fewer than ``least`` boxes before, the frame's own count, from three on;
    where nothing is known every box passes. The widths before are gathered once a frame.
    """
    upper = lambda a: F.get(F.array_sort(a), F.floor(F.size(a) / 2).cast("int"))
    frames = boxes.groupBy("job_id", "frame").agg(F.min("t").alias("_t"), F.transform(F.array_sort(F.collect_list(F.struct("t", "w"))), lambda b: b["w"]).alias("_own"))
    earlier = Window.partitionBy("job_id").orderBy("_t", "frame").rowsBetween(-recent, -1)
    before = F.reverse(F.slice(F.reverse(F.flatten(F.collect_list("_own").over(earlier))), 1, recent))
    typical = F.when(F.size("_before") >= least, upper(F.col("_before"))).when(F.size("_own") >= 3, upper(F.col("_own")))
    known = frames.withColumn("_before", before).select(F.col("job_id").alias("_job"), F.col("frame").alias("_frame"), typical.alias("typical"))
    out = boxes.join(known, F.col("job_id").eqNullSafe(F.col("_job")) & F.col("frame").eqNullSafe(F.col("_frame"))).drop("_job", "_frame")
    return out.withColumn("robot_sized", F.coalesce(F.col("w") >= share * F.col("typical"), F.lit(True)))
