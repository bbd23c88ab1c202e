"""Order-sensitive folds as higher-order functions over the ordered array of one group.

Each group is one robot, frame or match, whose array length is bounded by what a match holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlake.functions.exprs import iou


def leader_clusters(points: Column, radius: float) -> Column:
    """Leader clustering of ``struct(x, y)`` points in order: each joins the first cluster whose running centroid is within ``radius``.

    Returns ``array<struct<sx, sy, n>>``, largest first, the earlier cluster first on a tie.
    """
    empty = F.array().cast("array<struct<sx:double,sy:double,n:int>>")

    def add(clusters: Column, p: Column) -> Column:
        near = F.transform(clusters, lambda c: F.hypot(c["sx"] / c["n"] - p["x"], c["sy"] / c["n"] - p["y"]) <= radius)
        home = F.array_position(near, F.lit(True))
        grown = F.transform(clusters, lambda c, i: F.when(i == home - 1, F.struct((c["sx"] + p["x"]).alias("sx"), (c["sy"] + p["y"]).alias("sy"), (c["n"] + 1).alias("n"))).otherwise(c))
        new = F.array(F.struct(p["x"].alias("sx"), p["y"].alias("sy"), F.lit(1).alias("n")))
        return F.when(home > 0, grown).otherwise(F.concat(clusters, new))

    found = F.aggregate(points, empty, add)
    keyed = F.transform(found, lambda c, i: F.struct((-c["n"]).alias("o"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda k: k["c"])


def suppress(boxes: Column, threshold: float) -> Column:
    """Greedy suppression of ``struct(confidence, x, y, w, h)`` boxes: most confident first, those overlapping a kept one by ``threshold`` or more go."""
    order = F.transform(boxes, lambda b, i: F.struct((-b["confidence"]).alias("o"), i.alias("i"), b.alias("b")))
    ordered = F.transform(F.array_sort(order), lambda x: x["b"])
    kept = F.slice(ordered, 1, 0)
    return F.aggregate(ordered, kept, lambda k, b: F.when(F.exists(k, lambda o: iou(o, b) >= threshold), k).otherwise(F.concat(k, F.array(b))))


def thin(times: Column, step: float) -> Column:
    """Times kept if at least ``step`` after the last kept one; the first and the last are always kept."""
    kept = F.aggregate(times, F.slice(times, 1, 0), lambda k, t: F.when((F.size(k) == 0) | (t - F.element_at(k, -1) >= step - 1e-9), F.concat(k, F.array(t))).otherwise(k))
    last = F.try_element_at(times, F.lit(-1))
    return F.when(F.try_element_at(kept, F.lit(-1)) < last, F.concat(kept, F.array(last))).otherwise(kept)


def downsample(points: Column, spacing: float) -> Column:
    """``struct(x, y)`` points at least ``spacing`` from the last kept one, and the final point."""

    def step(k: Column, p: Column) -> Column:
        far = F.hypot(F.element_at(k, -1)["x"] - p["x"], F.element_at(k, -1)["y"] - p["y"]) >= spacing
        return F.when(F.size(k) == 0, F.array(p)).when(far, F.concat(k, F.array(p))).otherwise(k)

    kept = F.aggregate(points, F.slice(points, 1, 0), step)
    last = F.try_element_at(points, F.lit(-1))
    return F.when(last.isNotNull() & (F.try_element_at(kept, F.lit(-1)) != last), F.concat(kept, F.array(last))).otherwise(kept)


def still_spans(boxes: Column, radius: float, least_s: float) -> Column:
    """Spans during which ``struct(t, x, y)`` stays within ``radius`` of the span's first point, of ``least_s`` or longer."""
    start = F.struct(
        F.lit(None).cast("double").alias("t0"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"),
        F.lit(None).cast("double").alias("t1"), F.array().cast("array<struct<start:double,end:double>>").alias("out"),
    )

    def closed(s: Column) -> Column:
        long = s["t1"] - s["t0"] >= least_s
        return F.when(long, F.concat(s["out"], F.array(F.struct(s["t0"].alias("start"), s["t1"].alias("end"))))).otherwise(s["out"])

    def step(s: Column, b: Column) -> Column:
        stays = s["t0"].isNotNull() & (F.hypot(b["x"] - s["x"], b["y"] - s["y"]) <= radius)
        return F.struct(
            F.when(stays, s["t0"]).otherwise(b["t"]).alias("t0"), F.when(stays, s["x"]).otherwise(b["x"]).alias("x"), F.when(stays, s["y"]).otherwise(b["y"]).alias("y"),
            b["t"].alias("t1"), F.when(stays, s["out"]).otherwise(closed(s)).alias("out"),
        )

    return F.aggregate(boxes, start, step, closed)


def stable_values(readings: Column, confirmations: int) -> Column:
    """Of ordered ``struct(t, value)`` readings, values above the last stable one that are seen ``confirmations`` times in a row, at their first sighting."""
    start = F.struct(
        F.lit(0).alias("top"), F.lit(None).cast("int").alias("seen"), F.lit(None).cast("double").alias("first_t"), F.lit(0).alias("n"),
        F.array().cast("array<struct<t:double,value:int>>").alias("out"),
    )

    def step(s: Column, r: Column) -> Column:
        same = s["seen"].eqNullSafe(r["value"])
        n, first = F.when(same, s["n"] + 1).otherwise(1), F.when(same, s["first_t"]).otherwise(r["t"])
        new = (r["value"] > s["top"]) & (n >= confirmations)
        return F.struct(
            F.when(new, r["value"]).otherwise(s["top"]).alias("top"), r["value"].alias("seen"), first.alias("first_t"), n.alias("n"),
            F.when(new, F.concat(s["out"], F.array(F.struct(first.alias("t"), r["value"].alias("value"))))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(readings, start, step, lambda s: s["out"])


def theil_sen(times: Column, values: Column) -> Column:
    """Median of all pairwise slopes; null below two points in time."""
    n = F.size(times)
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n), lambda j: F.when(
        F.element_at(times, j) > F.element_at(times, i), (F.element_at(values, j) - F.element_at(values, i)) / (F.element_at(times, j) - F.element_at(times, i))))))
    slopes = F.array_sort(F.filter(pairs, lambda s: s.isNotNull()))
    m = F.size(slopes)
    half = lambda k: F.get(slopes, F.floor(k).cast("int"))
    return F.when((n > 1) & (m > 0), (half((m - 1) / 2) + half(m / 2)) / 2)


def longest_common(a: str, b: str) -> int:
    """Length of the longest common subsequence of two short texts."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]
