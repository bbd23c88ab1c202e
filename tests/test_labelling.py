"""Sample plans, filters, boxes at instants, plane maps and identity memory on small made-up data."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake.operators import labelling, temporal


def test_plan_is_round_robin(spark):
    s = spark.createDataFrame([("a", 100.0), ("b", 10.0), ("c", 0.0)], "segment string, duration double")
    got = [(r.segment, round(r.t, 6)) for r in labelling.plan_frames(s, 4).collect()]
    step = 82.0 / 3
    assert got == [("a", 10.0), ("b", 1.0), ("a", round(10 + step, 6)), ("b", 9.2)]
    assert labelling.plan_frames(s, 0).count() == 0
    assert labelling.plan_frames(spark.createDataFrame([("x", 5.0)], s.schema), 3).first().t == pytest.approx(0.5 + 4.1 / 2)


def test_hard_moments_take_reasons_in_turn(spark):
    rows = [("j", 1.0, "hole", 9.0), ("j", 2.0, "hole", 8.0), ("j", 9.0, "hole", 1.0), ("j", 1.5, "static", 5.0), ("j", 20.0, "static", 1.0), ("j", 30.0, "odd", 9.0)]
    m = spark.createDataFrame(rows, "job_id string, t double, reason string, severity double")
    assert [(r.t, r.reason) for r in labelling.hard_moments(m, 10).orderBy("t").collect()] == [(1.0, "hole"), (9.0, "hole"), (20.0, "static")]
    assert [(r.t, r.reason) for r in labelling.hard_moments(m, 2).orderBy("t").collect()] == [(1.0, "hole"), (20.0, "static")]


def test_filter_adds_the_colour_bonus(spark):
    rows = [("f", "a", 0.1, 0.1, 0.2, 0.2, 0.50, 0.5), ("f", "b", 0.1, 0.1, 0.2, 0.21, 0.55, 0.0), ("f", "a", 0.6, 0.6, 0.1, 0.1, 0.97, 0.9), ("f", "a", 0.9, 0.9, 0.5, 0.5, 0.9, 0.0)]
    p = spark.createDataFrame(rows, "frame_id string, source string, x double, y double, w double, h double, confidence double, colour_share double")
    kept, gone = labelling.filtered(p)
    assert sorted((r.confidence, r.raw_confidence) for r in kept.collect()) == [(0.58, 0.5), (1.0, 0.97)]
    assert sorted(r.reason for r in gone.collect()) == ["duplicate", "invalid"]


def test_supported_boxes(spark):
    rows = [("c", i, 0.1 + 0.02 * i, 0.1, 0.2, 0.2, 0.4) for i in (0, 1, 4, 5)] + [("c", 2, 0.8, 0.8, 0.1, 0.1, 0.9), ("c", 3, 0.8, 0.2, 0.1, 0.1, 0.3), ("d", 0, 0.1, 0.1, 0.2, 0.2, 0.3)]
    b = spark.createDataFrame(rows, "clip string, frame_index int, x double, y double, w double, h double, confidence double")
    got = {(r.clip, r.frame_index): (r.hits, r.reason) for r in labelling.supported(b).collect()}
    assert len(got) == len(rows) and all(got["c", i] == (4, "temporal_support") for i in (0, 1, 4, 5))
    assert got["c", 2] == (1, "high_confidence_single_frame") and got["c", 3][1] == got["d", 0][1] == "insufficient_temporal_support"


def test_boxes_at_instants(spark):
    kind = "job_id string, track_id int, t double, x double, y double, w double, h double"
    b = spark.createDataFrame([("j", 1, 0.0, 0.0, 0.0, 0.1, 0.1), ("j", 1, 2.0, 0.2, 0.0, 0.1, 0.1), ("j", 1, 5.0, 0.5, 0.0, 0.1, 0.1), ("j", 2, 1.0, 0.9, 0.0, 0.1, 0.1)], kind)
    gaps = spark.createDataFrame([("j", 1, 2.5, 4.5, "lost")], "job_id string, track_id int, start double, end double, reason string")
    asked = spark.createDataFrame([("j", t) for t in (-1.0, 0.0, 1.0, 1.1, 1.5, 2.0, 2.1, 2.3, 3.0, 4.7, 5.0, 5.1, 6.0)], "job_id string, at double")
    got = {(r["at"], r.track_id): round(r.x, 6) for r in labelling.boxes_at(b, asked, gaps, 0.2).collect()}
    assert got == {(0.0, 1): 0.0, (1.0, 1): 0.1, (1.1, 1): 0.11, (1.5, 1): 0.15, (2.0, 1): 0.2, (2.1, 1): 0.2, (5.0, 1): 0.5, (5.1, 1): 0.5, (1.0, 2): 0.9, (1.1, 2): 0.9}


def test_plane_maps(spark):
    h = np.array([[30.0, 2.0, 1.0], [1.0, 20.0, 3.0], [0.2, 0.1, 1.0]])
    rng = random.Random(3)

    def view(name, n, noise):
        for _ in range(n):
            x, y = rng.random(), rng.random()
            u = h @ (x, y, 1)
            yield name, x, y, float(u[0] / u[2]) + noise * (rng.random() - 0.5), float(u[1] / u[2]) + noise * (rng.random() - 0.5)

    rows = [*view("exact", 12, 0.0), *view("rough", 30, 0.4), *view("bad", 12, 30.0), *view("few", 3, 0.0), *(("line", t / 9, t / 9, float(t), float(t)) for t in range(9))]
    got = {r.view: r for r in labelling.fit_homography(spark.createDataFrame(rows, "view string, x double, y double, field_x double, field_y double"), ["view"]).collect()}
    assert set(got) == {"exact", "rough", "bad"} and np.allclose(np.array(got["exact"].matrix).reshape(3, 3), h, atol=1e-6)
    assert got["exact"].reprojection_ft < 1e-6 and got["rough"].trustworthy and not got["bad"].trustworthy
    focal = spark.range(1).select(labelling.focal_pixels(F.lit(1920), F.lit(90.0)).alias("a"), labelling.focal_pixels(F.lit(1920), F.lit(180.0)).alias("b")).first()
    assert focal.a == pytest.approx(960.0) and focal.b is None


def test_motion_stops_at_holes(spark):
    b = spark.createDataFrame([("t", 0.0, 0.0, 0.0), ("t", 1.0, 3.0, 4.0), ("t", 2.0, None, None), ("t", 3.0, 9.0, 8.0), ("t", 4.0, 9.0, 9.0), ("t", 5.0, 99.0, 9.0), ("t", 6.0, 99.0, 10.0)], "k string, t double, field_x double, field_y double")
    gaps = spark.createDataFrame([("t", 3.2, 3.8)], "k string, start double, end double")
    assert [r.speed_ftps for r in temporal.field_motion_between(b, ["k"], gaps).orderBy("t").collect()] == [None, 5.0, None, None, None, None, 1.0]
    assert [r.speed_ftps for r in temporal.field_motion_between(b, ["k"]).orderBy("t").collect()] == [None, 5.0, None, None, 1.0, None, 1.0]


def test_robot_sized(spark):
    rows = [("j", f, f / 10, w) for f in range(6) for w in (0.10, 0.11, 0.12)] + [("j", 6, 0.6, 0.03), ("j", 6, 0.6, 0.11), ("k", 0, 0.0, 0.5)]
    got = {(r.job_id, r.frame, r.w): (r.typical, r.robot_sized) for r in labelling.robot_sized(spark.createDataFrame(rows, "job_id string, frame int, t double, w double")).collect()}
    assert got["j", 6, 0.03] == (0.11, False) and got["j", 6, 0.11] == (0.11, True) and got["k", 0, 0.5] == (None, True) and got["j", 0, 0.10] == (0.11, True)


def test_robot_sized_like_a_loop(spark):
    import random

    rng = random.Random(9)
    rows = [(j, f, f / 10 + b / 1000, round(rng.random(), 3)) for j in "ab" for f in range(25) for b in range(rng.randrange(1, 6))]
    got = {(r.job_id, r.frame, r.t): (r.typical, r.robot_sized) for r in labelling.robot_sized(spark.createDataFrame(rows, "job_id string, frame int, t double, w double"), recent=20, least=8).collect()}
    for job, frame, t, w in rows:
        before, own = [x[3] for x in sorted(r for r in rows if r[0] == job and r[1] < frame)][-20:], [r[3] for r in rows if r[:2] == (job, frame)]
        known = before if len(before) >= 8 else own if len(own) >= 3 else None
        typical = sorted(known)[len(known) // 2] if known else None
        assert got[job, frame, t] == (typical, typical is None or w >= 0.4 * typical)
