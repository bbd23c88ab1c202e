"""Tracks, launches and goal entries on small made-up recordings."""

from __future__ import annotations

import math

import pytest

from matchlake.operators import clock, datasets, facts, flights, tracking
from matchlake.operators.flights import Boundary, Gate
from pyspark.sql import functions as F

DOWN = (0.0, 1.0)
MADE = Boundary((0.4, 0.5), (0.6, 0.5), DOWN)
POINTS = "job_id string, ball int, frame long, t double, x double, y double, r double"


def fall(ball, ys, x=0.5, job="j", start=0, r=0.01, step=1):
    return [(job, ball, start + step * i, (start + step * i) / 30, x, y, r) for i, y in enumerate(ys)]


def entered(spark, rows, gate, cuts=None):
    found = flights.goal_entries(spark.createDataFrame(rows, POINTS), [gate], 1000, 1000, cuts)
    return {(r.ball, r.frame, r.crossing_frame) for r in found.collect()}


def test_crossing_needs_direction_and_contact(spark):
    at = lambda p: tuple(map(F.lit, p))
    slanted = Boundary((0.4, 0.4), (0.6, 0.6), (1.0, 0.0))
    cases = [
        (MADE, (0.5, 0.4), (0.5, 0.6), True), (MADE, (0.5, 0.6), (0.5, 0.4), False), (MADE, (0.5, 0.5), (0.5, 0.6), True), (MADE, (0.5, 0.4), (0.5, 0.5), True),
        (MADE, (0.7, 0.4), (0.7, 0.6), False), (MADE, (0.41, 0.5), (0.45, 0.5), False), (slanted, (0.4, 0.5), (0.6, 0.5), True), (slanted, (0.6, 0.5), (0.4, 0.5), False),
    ]
    row = spark.range(1).select(*[line.crossed(at(p), at(q)).alias(f"c{i}") for i, (line, p, q, _) in enumerate(cases)]).first()
    assert [row[f"c{i}"] for i in range(len(cases))] == [c[3] for c in cases]
    deep = lambda line, x, y: spark.range(1).select(line.depth(F.lit(x), F.lit(y), F.lit(0.01), 1000, 500).alias("d")).first().d
    radius = 0.01 * math.hypot(1000, 500)
    assert deep(MADE, 0.5, 0.6) == pytest.approx(50 / radius) and deep(MADE, 0.5, 0.4) == pytest.approx(-50 / radius)
    assert deep(Boundary((0.6, 0.5), (0.4, 0.5), DOWN), 0.5, 0.6) == pytest.approx(50 / radius)
    assert deep(Boundary((0.3, 0.0), (0.3, 1.0), (1.0, 0.0)), 0.4, 0.2) == pytest.approx(100 / radius)


def test_an_entry_is_armed_crossed_and_confirmed(spark):
    gate = Gate("high", "h1", DOWN, made=MADE, approach=Boundary((0.4, 0.4), (0.6, 0.4), DOWN), interior=((0.4, 0.3), (0.6, 0.3), (0.6, 0.8), (0.4, 0.8)), frames=2, depth=1.0)
    through = fall(1, [0.35, 0.38, 0.42, 0.46, 0.51, 0.54, 0.58])
    beside = fall(2, [0.35, 0.38, 0.42, 0.46, 0.51, 0.54, 0.58], x=0.8)
    bounced = fall(3, [0.35, 0.38, 0.42, 0.46, 0.44, 0.4, 0.36])
    late = fall(4, [0.45, 0.47, 0.52, 0.56, 0.6])
    slow = [("j", 5, i, i / 2, 0.5, y, 0.01) for i, y in enumerate([0.35, 0.42, 0.46, 0.51, 0.56, 0.6])]
    assert entered(spark, through + beside + bounced + late + slow, gate) == {(1, 5, 4)}
    cut = spark.createDataFrame([("j", 0.14)], "job_id string, t double")
    assert entered(spark, through, gate, cut) == set()
    open_ = Gate(**{**gate.__dict__, "approach": None})
    assert {b for b, _, _ in entered(spark, through + late + bounced, open_)} == {1, 4}
    twice = Gate(**{**gate.__dict__, "frames": 9})
    assert entered(spark, through, twice) == set()
    assert entered(spark, [], gate) == set()


def test_places_on_the_interiors_edge(spark):
    """By the even-odd rule the lower edge is inside; an open interior has no edge."""
    gate = Gate("high", "h1", (1.0, 0.0), made=Boundary((0.5, 0.0), (0.5, 1.0), (1.0, 0.0)), interior=((0.2, 0.0), (1.0, 0.0), (1.0, 1.0), (0.2, 1.0)))
    rows = [("j", ball, i, i / 30, x, y, 0.01) for ball, y in ((1, 0.0), (2, 0.1)) for i, x in enumerate((0.3, 0.45, 0.6))]
    assert {b for b, _, _ in entered(spark, rows, gate)} == {1, 2}
    assert {b for b, _, _ in entered(spark, rows, Gate(**{**gate.__dict__, "open_edge": True}))} == {2}


def test_a_line_without_slack_is_met_exactly(spark):
    p, q = (F.lit(0.30000000000000004), F.lit(0.5)), (F.lit(0.6), F.lit(0.5))
    lines = [Boundary((0.3, 0.0), (0.3, 1.0), (1.0, 0.0), *slack) for slack in ((), (0.0,))]
    assert tuple(spark.range(1).select(*[line.crossed(p, q) for line in lines]).first()) == (True, False)


def test_repeated_entries(spark):
    track = lambda ys, first, step=1: [(first + step * i, (first + step * i) / 60, 0.5, y, 0.01) for i, y in enumerate(ys)]
    ys = [0.40, 0.41, 0.42, 0.43, 0.44, 0.45]
    rows = [("j", "g", 1, 0.20, track(ys, 0)), ("j", "g", 2, 0.22, track(ys[1:], 1)), ("j", "g", 3, 0.30, track([0.7, 0.72, 0.74], 0)), ("j", "h", 4, 0.22, track(ys, 0)), ("j", "g", 5, 9.0, track(ys, 0))]
    odd = [("k", "g", 1, 0.2, track([0.40, 0.42, 0.44, 0.46], 0, 2)), ("k", "g", 2, 0.21, track([0.40, 0.42, 0.44, 0.46], 1, 2))]
    e = spark.createDataFrame(rows + odd, f"job_id string, region string, ball int, t double, ball_track {flights.TRACK}")
    got = {(r.job_id, r.region, r.ball): r.same_as for r in flights.repeated_entries(e, 1000, 1000).collect()}
    assert {k: v for k, v in got.items() if v is not None} == {("j", "g", 2): 1, ("k", "g", 2): 1} and len(got) == 7


def arc(frames, vx, vy, x=0.2, y=0.5, g=0.9):
    return [{"frame": f, "t": f / 30, "x": x + vx * f / 30, "y": y + vy * f / 30 + g * (f / 30) ** 2, "radius": 0.01} for f in frames]


def test_links_follow_the_parabola(spark):
    shot, goes_on, other = arc(range(0, 9), 0.6, -0.5), arc(range(12, 15), 0.6, -0.5), arc(range(12, 15), -0.6, 0.5)
    rows = lambda d: [(p["frame"], p["t"], p["x"], p["y"], p["radius"]) for p in d]
    e = spark.createDataFrame([("j", "e1", 7, 0.5, rows(goes_on)), ("j", "e2", 1, 0.5, rows(other)), ("j", "e3", 9, 0.5, rows(other))], f"job_id string, entry_id string, ball int, t double, ball_track {flights.TRACK}")
    s = spark.createDataFrame([("j", "s1", 3, 0.0, rows(shot)), ("j", "s2", 1, 0.1, rows(arc(range(0, 9), 0.1, 0.1)))], f"job_id string, shot_id string, ball int, launch_t double, ball_track {flights.TRACK}")
    got = {r.entry_id: (r.shot_id, r.association) for r in flights.link_entries(e, s, 1000, 1000).collect()}
    assert got == {"e1": ("s1", "trajectory_relink"), "e2": ("s2", "same_track"), "e3": (None, "unassigned")}
    twin = s.union(spark.createDataFrame([("j", "s3", 4, 0.0, rows(shot))], s.schema))
    assert {r.entry_id: r.shot_id for r in flights.link_entries(e, twin, 1000, 1000).collect()}["e1"] is None
    shots = s.withColumn("outcome", F.lit("unknown")).withColumn("goal", F.lit(None).cast("string")).withColumn("outcome_t", F.lit(None).cast("double"))
    made = {r.shot_id: r for r in flights.credited(shots, flights.link_entries(e, s, 1000, 1000), e.withColumn("goal", F.lit("high"))).collect()}
    assert made["s1"].outcome == "made" and made["s1"].goal == "high" and [p.frame for p in made["s1"].ball_track] == [*range(9), 12, 13, 14]


def test_launches(spark):
    robots = [("j", f, k, 100.0 + 400 * (k - 1), 400.0, 200.0 + 400 * (k - 1), 600.0, 0.0, 0.0) for f in range(40) for k in (1, 2)]
    kind = "job_id string, frame long, track_id int, x1 double, y1 double, x2 double, y2 double, vx double, vy double"
    points = []

    def path(ball, places, first=0):
        points.extend(("j", ball, first + i, (first + i) / 30, x, y, 8.0) for i, (x, y) in enumerate(places))

    leaves = [(150.0 + 30 * i, 420.0 - 30 * i) for i in range(1, 12)]
    path(1, [(150.0, 450.0)] * 8 + leaves)
    path(2, [(150.0, 450.0)] * 30)
    path(3, [(800.0 + 2 * i, 300.0) for i in range(20)])
    path(4, [(210.0 + 35 * i, 420.0 - 25 * i) for i in range(8)], 5)
    path(5, [(150.0, 450.0)] * 2 + [(150.0 + 4 * i, 450.0) for i in range(20)])
    boundary = Boundary((0.3, 0.0), (0.3, 0.35), (1.0, 0.0))
    miss = Gate("high", "h", DOWN, misses=(boundary,))
    got = {r.ball: r for r in flights.launches(spark.createDataFrame(points, POINTS), spark.createDataFrame(robots, kind), [miss], 1000, 1000).collect()}
    assert set(got) == {1, 4} and got[1].robot == 1 and got[4].robot == 1
    assert 8 <= got[1].launch_frame <= 12 and got[4].launch_frame == 5 and 0.35 < got[1].confidence <= 0.99
    assert got[1].outcome == "missed" and got[1].goal == "high"
    assert [p.frame for p in got[1].ball_track] == sorted(p.frame for p in got[1].ball_track)


def test_boxes_are_followed_through_crossings_and_cuts(spark):
    rows = []
    for i in range(12):
        t = i / 10
        if i not in (5, 6, 7):
            rows.append(("j", t, 0.1 + 0.05 * i, 0.1, 0.08, 0.08, False))
        rows.append(("j", t, 0.7 - 0.05 * i, 0.1, 0.08, 0.08, False))
    rows.append(("j", 1.2, None, None, None, None, True))
    rows += [("j", 1.3, 0.1 + 0.05 * 13, 0.1, 0.08, 0.08, False), ("j", 20.0, 0.5, 0.5, 0.1, 0.1, False)]
    got = tracking.track_boxes(spark.createDataFrame(rows, "job_id string, t double, x double, y double, w double, h double, cut boolean")).collect()
    of = {(r.t, round(r.x, 3)): r.track for r in got if r.kind == "box"}
    first, second = of[0.0, 0.1], of[0.0, 0.7]
    assert all(of[i / 10, round(0.1 + 0.05 * i, 3)] == first for i in (0, 1, 2, 3, 4, 8, 9, 10, 11)) and all(of[i / 10, round(0.7 - 0.05 * i, 3)] == second for i in range(12))
    assert of[1.3, 0.75] == first and of[20.0, 0.5] not in (first, second)
    assert sorted((r.track, r.t, r.end, r.reason) for r in got if r.kind == "gap") == [(first, 0.4, 0.8, "detection_lost"), (first, 1.2, 1.3, "shot_change")]


SEASON = {"auto_seconds": 20, "teleop_seconds": 140, "endgame_seconds": 30}


def fitted(spark, readings):
    rows = [("j", float(t), v) for t, v in readings]
    return clock.fit(spark.createDataFrame(rows, "job_id string, t double, remaining int"), SEASON).collect()


def test_clock_finds_both_periods(spark):
    held = [(t, 20) for t in range(5)]
    auto = [(t, 25 - t) for t in range(5, 26)]
    pause = [(t, 140) for t in range(26, 31)]
    teleop = [(t, 171 - t) for t in range(31, 172)]
    (row,) = fitted(spark, held + auto + pause + teleop)
    assert abs(row.auto_start_t - 5) <= 1 and row.auto_seconds == 20.0 and row.auto_from == "clock"
    assert abs(row.teleop_start_t - 31) <= 1 and row.teleop_seconds == 140.0 and row.teleop_from == "clock" and row.samples == len(held + auto + pause + teleop)
    (late,) = fitted(spark, teleop[40:])
    assert late.auto_start_t is None and late.auto_seconds == 20.0 and late.teleop_from == "assumed" and abs(late.teleop_start_t - 31) <= 1
    (alone,) = fitted(spark, auto)
    assert alone.teleop_start_t is None and abs(alone.auto_start_t - 5) <= 1
    assert fitted(spark, [(0, 5), (1, 9), (2, None)]) == []


def test_frozen_and_misread_values_do_not_stretch_a_period(spark):
    noise = [(0, 35), (1, 35), (2, 33), (3, 20), (4, 20), (5, 20), (6, 20), (7, 20), (8, 20), (9, 20), (10, 20), (11, 20), (12, 20), (13, 20), (14, 20)]
    auto = [(t, 35 - t) for t in range(15, 36)]
    (row,) = fitted(spark, noise + auto)
    assert row.auto_seconds == 20.0 and abs(row.auto_start_t - 15) <= 1


def test_facts_rosters_and_windows(spark):
    rows = spark.createDataFrame([("j", "e", 1.0)], "job_id string, event_type string, t_seconds double")
    a, b = (facts.with_identity(rows, ["job_id", "event_type"]).first() for _ in range(2))
    assert a.event_id == b.event_id and len(a.event_id) == 36 and a.schema_version == 3 and a.field_x is None and a.source == "model"
    t = spark.createDataFrame([("red", 5, "b"), (None, 1, "a"), ("blue", None, "z"), ("blue", 3, "c")], "alliance string, team int, robot_key string")
    assert [r.robot_key for r in facts.timeline_order(t).collect()] == ["z", "c", "b", "a"]
    m = spark.createDataFrame([({"auto": {"a": 0}},), ({"auto": {"a": 0}, "teleop": {"b": 3}},), (None,)], "v map<string,map<string,int>>")
    assert [r.x for r in m.select(facts.scoring_is_meaningful(F.col("v")).alias("x")).collect()] == [False, True, False]
    ids = spark.createDataFrame([("2025abc_qm1",), ("practice",), (None,)], "match_id string")
    assert facts.season_of(ids).first().season == 2025 and facts.season_of(ids.where("match_id = 'practice'")).first().season == 2026
    assert facts.parse_teams("254,1678 x 971") == [254, 1678, 971] and facts.parse_teams(None) == []
    tr = spark.createDataFrame([(1, 254, ["b"]), (2, 971, None)], "track_id int, team int, identity_issues array<string>")
    got = {r.track_id: (r.team, r.identity_issues) for r in facts.mark_uncertain(tr, F.col("track_id") == 1, "a").collect()}
    assert got == {1: (None, ["a", "b"]), 2: (971, None)}
    wire = facts.to_wire(spark.createDataFrame([(1, 2)], "eventId int, fieldX int"))
    assert wire.columns == ["event_id", "field_x"] and facts.to_domain(wire).columns == ["eventId", "fieldX"]
    roster = spark.createDataFrame([([1, 2], [3]), ([], [3]), (None, [3])], "o array<int>, d array<int>").select(facts.roster_for(F.col("o"), F.col("d")).alias("x"))
    assert [r.x for r in roster.collect()] == [[1, 2], [3], [3]]


def test_label_sequence(spark):
    from matchlake.operators import fusion

    frames = spark.createDataFrame([("c", i, i / 5, "ok" if i != 4 else "graphic_card") for i in range(6)], "clip string, frame_index int, t double, verdict string")
    steady = [("c", i, 0.9, 0.1, 0.1, 0.2, 0.2) for i in range(6)]
    once = [("c", 2, 0.9, 0.6, 0.6, 0.2, 0.2)]
    rows = fusion.label_sequence(spark.createDataFrame(steady + once, "clip string, frame_index int, confidence double, x double, y double, w double, h double"), frames).collect()
    assert {r.frame_index for r in rows} == {0, 1, 2, 3, 5} and all(r.status == "proposed" and r.human_review_required for r in rows)
    sure = {(r.frame_index, round(r.x, 1)): r.agreement_count for r in rows}
    assert sure[2, 0.1] == 2 and sure[2, 0.6] == 1


def test_truth_and_tiles(spark):
    lines = spark.createDataFrame([("a", "0 1 1 1 1"), ("a", " "), ("b", ""), ("c", "0 1 1 1 1"), ("c", "1 1 1 1 1")], "stem string, value string")
    keep = spark.createDataFrame([("a",), ("b",)], "stem string")
    assert {r.stem: r.n for r in datasets.truth_counts(lines).collect()} == {"a": 1, "c": 2}
    assert {r.stem: r.n for r in datasets.truth_counts(lines, keep).collect()} == {"a": 1}
    at = lambda total, tile: spark.range(1).select(datasets.tile_origins(F.lit(total), F.lit(tile), 0.2).alias("o")).first().o
    assert at(1920, 640) == [0, 512, 1024, 1280] and at(600, 640) == [0] and at(0, 640) == [] and at(1280, 640) == [0, 512, 640]
