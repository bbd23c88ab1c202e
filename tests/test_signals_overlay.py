from __future__ import annotations

import numpy as np

from matchlake.operators import clock, overlay, signals


def test_anchor_and_common_reading(spark):
    rows = [("a", float(i), 100 - i) for i in range(6)] + [("a", 7.0, 13), ("a", 8.0, None), ("b", 1.0, 5), ("b", 2.0, 90)]
    r = spark.createDataFrame(rows, "job_id string, t double, remaining int")
    found = signals.match_anchor(r)
    assert [tuple(x) for x in found.collect()] == [("a", 100.0, 6)]
    assert signals.match_start(found, {"auto_seconds": 20, "teleop_seconds": 140}).first().start == -60.0
    assert [(x.end, x.support) for x in clock.period_end(r).collect()] == [(100.0, 6)]
    v = spark.createDataFrame([("a", 3.0, 7), ("a", 1.0, 9), ("a", 2.0, 7), ("a", 4.0, 9), ("a", 5.0, None)], "job_id string, t double, value int")
    assert signals.common_reading(v).first().value == 9
    assert signals.match_anchor(r.limit(0)).count() == 0


def test_immobile_events(spark):
    boxes = [(float(t), 0.1 if t < 6 else 0.1 + t / 20, 0.1, 0.1, 0.1) for t in range(9)]
    tracks = spark.createDataFrame([("j", 1, 254, boxes), ("j", 2, None, [])], "job_id string, track_id int, team int, boxes array<struct<t:double,x:double,y:double,w:double,h:double>>")
    starts = spark.createDataFrame([("j", 2.0)], "job_id string, start double")
    got = signals.immobile_events(tracks, starts, {"auto_seconds": 2, "teleop_seconds": 10, "endgame_seconds": 3}).collect()
    assert [(r.track_id, r.event_type, r.t_seconds, r.phase) for r in got] == [(1, "immobile_start", 0.0, "auto"), (1, "immobile_end", 5.0, "teleop")]


def test_hidden_from(spark):
    still = [("j", 1, i / 10, 0.5, 0.5, 0.1, 0.1) for i in range(80)]
    moving = [("j", 2, i / 10, i / 100, 0.5, 0.1, 0.1) for i in range(80)]
    stops = [("j", 3, i / 10, min(i, 20) / 100, 0.5, 0.1, 0.1) for i in range(100)]
    b = spark.createDataFrame(still + moving + stops, "job_id string, track_id int, t double, x double, y double, w double, h double")
    got = {r.track_id: round(r.hidden_from, 3) for r in signals.hidden_from(b).collect()}
    assert set(got) == {1, 3} and got[1] == 5.0 and 7.0 <= got[3] <= 8.3


def peaks(values, absolute, relative):
    low, top, out = None, None, []
    for i, v in enumerate(values):
        need, before = absolute, np.array(values[max(0, i - 45) : i], dtype=float)
        if len(before) >= 8:
            lower = before[before <= np.median(before)]
            need = max(need, min(2 * absolute, 3 * 1.4826 * np.median(np.abs(lower - np.median(lower)))))
        if low is None:
            low = v
        elif top is None:
            low = min(low, v)
            top = (float(i), float(v)) if v - low >= need else None
        else:
            top = (float(i), float(v)) if v > top[1] else top
            if top[1] - v >= max(need, relative * top[1]):
                out.append(top)
                top, low = None, v
    return out


def test_pulses(spark):
    rng = np.random.default_rng(3)
    signals_of = {"noisy": rng.integers(0, 12, 200).tolist(), "calm": (rng.integers(0, 2, 120) + 9 * (np.arange(120) % 10 == 4)).tolist(), "flat": [7] * 60, "one": [5]}
    rows = [(k, float(i), float(v)) for k, vs in signals_of.items() for i, v in enumerate(vs)]
    found = signals.pulses(spark.createDataFrame(rows, "port string, t double, value double"), ["port"], 3.0, 0.25).collect()
    for k, vs in signals_of.items():
        assert sorted((r.t, r.value) for r in found if r.port == k) == peaks(vs, 3.0, 0.25)
    assert len(peaks(signals_of["calm"], 3.0, 0.25)) == 12


def test_viewer(spark):
    asked = spark.createDataFrame([("j", 1.0), ("j", 2.0), ("k", 1.0)], "job_id string, at double")
    gaps = spark.createDataFrame([("j", 0.5, 1.0), ("j", 2.0, None)], "job_id string, start double, end double")
    assert sorted((r.job_id, r.at, r.paused) for r in overlay.paused(asked, gaps).collect()) == [("j", 1.0, False), ("j", 2.0, True), ("k", 1.0, False)]
    path = [(0.6, 0.0, 0.0), (0.8, 0.1, 0.0), (1.0, 0.2, 0.0), (1.1, 0.3, 0.0)]
    shots = spark.createDataFrame([("j", "s", 0.6, path), ("j", "none", 0.9, [])], "job_id string, shot_id string, launch_t_seconds double, ball_track array<struct<t_seconds:double,x:double,y:double>>")
    assert sorted((r.at, r.t) for r in overlay.shot_trails(asked, shots).collect()) == [(1.0, 0.8), (1.0, 1.0)]
    boxes = spark.createDataFrame([("j", 1, 5, i / 10, x, 1.0) for i, x in enumerate([1.0, 2.0, None, 3.0, 99.0, 4.0])], "job_id string, track_id int, team int, t double, field_x double, field_y double")
    assert sorted(r.t for r in overlay.placed_samples(boxes, 54.0, 27.0).collect()) == [0.0, 0.3]
    assert tuple(overlay.unplaced(boxes, 54.0, 27.0).first()) == ("j", 6, 2)
    events = spark.createDataFrame([("j", 1, "e", "reload", 0.65), ("j", None, "f", "reload", 0.1)], "job_id string, track_id int, event_id string, event_type string, t_seconds double")
    assert sorted(r.t for r in overlay.near_events(boxes, events).collect()) == [0.1, 0.2, 0.3, 0.4, 0.5]


def test_lists(spark):
    jobs = spark.createDataFrame([("a", "e1", 1, 5.0, 30.0, 10, 10), ("b", "e2", 3, None, 30.0, 10, 10), ("c", "e1", 2, 0.0, 30.0, 10, 10), ("d", None, 9, 1.0, None, 1, 1)], "job_id string, event string, created_at int, duration double, fps double, width int, height int")
    assert [r.job_id for r in overlay.playable(jobs).collect()] == ["a"]
    assert [(r.event, r.jobs, r.latest) for r in overlay.activity(jobs, "event").collect()] == [("e2", 1, 3), ("e1", 2, 2)]
    assert [(r.event, r.n) for r in overlay.kinds(jobs, "event").collect()] == [("e1", 2), ("e2", 1), (None, 1)]
    f = spark.createDataFrame([("x", "a", True), ("x", "b", None), ("y", "c", False)], "group string, name string, built boolean")
    assert {(r["group"], r.done, r.todo) for r in overlay.built_summary(f).collect()} == {("x", 1, 1), ("y", 0, 1), (None, 1, 2)}
    t = spark.createDataFrame([("j", 1, 0.5), ("j", 2, None), ("j", 3, 0.1)], "job_id string, track_id int, team_confidence double")
    assert [r.track_id for r in overlay.least_sure_first(t).collect()] == [2, 3, 1]
