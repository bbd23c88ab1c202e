from __future__ import annotations

import random

import pytest

from matchlake.operators import balls, moments


def test_match_shots(spark):
    kind = "job_id string, robot int, shot_id string, t double"
    p = spark.createDataFrame([("j", 1, "p1", 1.00), ("j", 1, "p2", 1.05), ("j", 2, "p3", 1.0), ("j", 1, "p4", 9.0)], kind)
    r = spark.createDataFrame([("j", 1, "r1", 1.04), ("j", 1, "r2", 1.10), ("j", 1, "r3", 9.2)], kind)
    m = balls.match_shots(p, r)
    assert {(x.shot_id, x.ref_id) for x in m.collect()} == {("p2", "r1")}
    score = balls.launch_score(m, p, r).first()
    assert score.precision == score.hits / 4 and score.recall == score.hits / 3


def test_assign_shots_is_optimal(spark):
    def best(p, r):
        if not r:
            return 0, 0.0
        found = [best(p, r[1:])]
        for i, t in enumerate(p):
            if abs(t - r[0]) <= 0.075:
                n, d = best(p[:i] + p[i + 1 :], r[1:])
                found.append((n - 1, d + abs(t - r[0])))
        return min(found)

    rng = random.Random(6)
    groups = [([0.0, 0.07], [0.06, 0.14])] + [([rng.random() * 0.5 for _ in range(rng.randrange(6))], [rng.random() * 0.5 for _ in range(rng.randrange(6))]) for _ in range(40)]
    kind = "job_id string, robot int, shot_id string, t double"
    p, r = (spark.createDataFrame([("j", g, f"{name}{g}.{i}", t) for g, both in enumerate(groups) for i, t in enumerate(both[side])], kind) for side, name in enumerate("pr"))
    rows = balls.assign_shots(p, r).collect()
    assert len({x.shot_id for x in rows}) == len({x.ref_id for x in rows}) == len(rows)
    for g, (a, b) in enumerate(groups):
        own = [x.dt for x in rows if x.shot_id.split(".")[0] == f"p{g}"]
        n, d = best(a, b)
        assert len(own) == -n and sum(own) == pytest.approx(d)
    assert len([x for x in rows if x.shot_id.startswith("p0.")]) == 2
    assert balls.launch_score(balls.assign_shots(p, r), p, r).first().hits == len(rows)


def test_entries(spark):
    e = spark.createDataFrame([("j", "e1", 5, 1.0, 0.0, 0.0), ("j", "e2", 6, 2.1, 1.1, 0.0), ("j", "e3", 7, 9.0, 0.0, 0.0)], "job_id string, entry_id string, ball_track_id int, t double, x double, y double")
    s = spark.createDataFrame([("j", "s1", 5, 0.9, 0.0, 0.0, 0.0, 0.0), ("j", "s2", 8, 2.0, 1.0, 0.0, 1.0, 0.0)], "job_id string, shot_id string, ball_track_id int, last_t double, x double, y double, vx double, vy double")
    got = {r.entry_id: (r.shot_id, r.association) for r in balls.associate_entries(e, s).collect()}
    assert got == {"e1": ("s1", "same_track"), "e2": ("s2", "trajectory"), "e3": (None, "unassigned")}
    d = spark.createDataFrame([("j", "g", "a", 1.0, 0.5, 0.5), ("j", "g", "b", 1.1, 0.51, 0.5), ("j", "h", "c", 1.1, 0.51, 0.5)], "job_id string, region_id string, entry_id string, t double, x double, y double")
    assert [(r.entry_id, r.same_as) for r in balls.duplicate_entries(d).collect()] == [("b", "a")]


def test_launches_owners_validity(spark):
    pts = [(i, 0.1 * i, 0.0) for i in range(4)]
    kind = "job_id string, robot int, shot_id string, t double, points array<struct<frame:int,x:double,y:double>>"
    rows = [("j", 1, "a", 1.0, pts), ("j", 1, "b", 1.2, pts[1:]), ("j", 1, "c", 1.2, [(9, 0.0, 0.0)])]
    assert [(r.shot_id, r.same_as) for r in balls.duplicate_launches(spark.createDataFrame(rows, kind)).collect()] == [("b", "a")]
    b = spark.createDataFrame([("j", 1, "x", 0.0, 0.0), ("j", 1, "y", 900.0, 0.0)], "job_id string, frame int, ball_id string, cx double, cy double")
    r = spark.createDataFrame([("j", 1, 7, 50.0, 0.0), ("j", 1, 8, 60.0, 0.0)], "job_id string, frame int, track_id int, cx double, cy double")
    assert {x.ball_id: x.owner for x in balls.owners(b, r).collect()} == {"x": 7, "y": None}
    f = spark.createDataFrame([("j", float(t), t in (0, 1, 8)) for t in range(15)], "job_id string, t double, verified boolean")
    assert [(x.start, x.end) for x in balls.validity(f).orderBy("start").collect()] == [(4.0, 8.0), (11.0, None)]


def test_moments(spark):
    kind = "job_id string, track_id int, t double, x double, y double, w double, h double"
    rows = [("j", 1, float(t), 0.3 + 0.01 * t, 0.4, 0.1, 0.1 if t != 5 else 0.02) for t in range(10) if t not in (2, 3)] + [("j", 2, 1.0, 0.5, 0.5, 0.1, 0.1)]
    b = spark.createDataFrame(rows, kind)
    got = {(r.track_id, r.t, r.reason) for r in moments.find_moments(b).collect()}
    assert {(1, 5.0, "undersized"), (1, 4.0, "hole"), (2, 1.0, "flicker"), (2, 1.0, "vanished")} <= got
    assert {r.track_id: r.moves for r in moments.window_motion(b).collect()} == {1: True, 2: False}
    assert {r.second: r.tracks for r in moments.presence(b).collect()}[1] == 2
    t = spark.createDataFrame([("j", 1, 0.0, 1), ("j", 1, 1.0, 1), ("j", 1, 7.0, 1), ("j", 1, 8.0, 2)], "job_id string, raw_track_id int, t double, stable_track_id int")
    assert [r.fragment for r in moments.tracklets(t).orderBy("t").collect()] == [1, 1, 2, 3]


def test_coast(spark):
    s = spark.createDataFrame([("k", i / 10, float(i), 0.0) for i in range(6)] + [("k", 1.2, 9.0, 0.0)], "k string, t double, x double, y double")
    g = spark.createDataFrame([("k", 0.5, 1.2, "detection_lost"), ("k", 5.0, 5.5, "occlusion")], "k string, start double, end double, reason string")
    made = moments.coast(s, g, ["k"]).where("estimated").orderBy("t").collect()
    assert [r.t for r in made] == pytest.approx([0.6, 0.7, 0.8, 0.9, 1.0, 1.1])
    assert 5.9 < made[0].x < 6.0 and made[-1].x < 11.0
    tags = spark.createDataFrame([(1, 10.0, 5.0)] * 5 + [(2, 1.0, 1.0)], "tag int, px double, py double")
    assert {r.tag: r.reason for r in moments.steady_tags(tags).collect()} == {1: None, 2: "too_few"}
    c = spark.createDataFrame([(f, y) for f in range(3) for y in (0.1, 0.2, 0.7, 0.8)], "frame_id int, cy double")
    assert moments.view_split(c).first().seam == pytest.approx(0.45)

