"""Operators on small fixtures against plain Python."""

from __future__ import annotations

import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from matchlake import schemas
from matchlake.engine import Engine
from matchlake.functions import exprs as X
from matchlake.functions import folds
from matchlake.operators import chains, clock, corrections, datasets, features, fusion, heatmap, identity, metrics, plan, profile, quality, stats, temporal, timeline
from matchlake.sources import readers, sinks
from matchlake.streaming import sessions, tracker


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_phases(spark):
    lit = [F.lit(float(v)) for v in (15, 135, 30)]
    events = [one(spark, X.phase_of_event(F.lit(float(t)), *lit)) for t in (-1, 0, 14.9, 15, 119.9, 120, 150, 150.1)]
    assert events == ["unknown", "auto", "auto", "teleop", "teleop", "endgame", "endgame", "unknown"]
    assert [one(spark, X.phase_simulated(F.lit(float(t)), *lit)) for t in (-5, 200)] == ["auto", "endgame"]
    at = lambda t: tuple(one(spark, X.clock_at(F.lit(float(t)), F.lit(10.0), F.lit(15.0), F.lit(3.0), F.lit(135.0), F.lit(30.0))))
    assert [at(t) for t in (5, 25, 26, 28, 178)] == [(-5.0, "pre_match"), (15.0, "auto"), (15.0, "transition"), (15.0, "teleop"), (165.0, "post_match")]


def test_geometry(spark):
    box = lambda x, y, w, h: F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("xywh", (x, y, w, h))])
    assert one(spark, X.iou(box(0, 0, 2, 2), box(1, 1, 2, 2))) == pytest.approx(1 / 7)
    bands = [("a", 0.0, 10.0), ("b", 10.0, 20.0)]
    assert [one(spark, X.band_of(F.lit(v), bands)) for v in (0.0, 10.0, -3.0, 25.0)] == ["a", "b", "a", "b"]
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    assert one(spark, X.inside_polygon(F.lit(1.0), F.lit(1.0), square)) and not one(spark, X.inside_polygon(F.lit(5.0), F.lit(1.0), square))
    p = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    assert one(spark, X.segments_intersect(p(0, 0), p(2, 2), p(0, 2), p(2, 0))) and not one(spark, X.segments_intersect(p(0, 0), p(1, 0), p(0, 1), p(1, 1)))
    assert one(spark, X.nearest_edge(box(0.01, 0.3, 0.2, 0.2), 0.05)) == "left" and one(spark, X.nearest_edge(box(0.3, 0.3, 0.2, 0.2), 0.05)) is None
    assert one(spark, X.hamming(F.lit(0b1011), F.lit(0b0010))) == 2
    assert one(spark, X.alliance_frame(F.lit(1.0), F.lit(2.0), F.lit("red"), F.lit(54.0), F.lit(27.0))).asDict() == {"ax": 53.0, "ay": 25.0}


def test_names(spark):
    v = lambda c: one(spark, c)
    assert [v(X.team_number(F.lit(t))) for t in ("frc254", "11", "frcB1")] == [254, 11, None]
    assert v(X.video_id(F.lit("https://youtu.be/abcdefghijk?t=3"))) == "abcdefghijk" and v(X.video_id(F.lit("no"))) is None
    assert [v(X.video_start(F.lit(u))) for u in ("x?t=90", "x?v=1&t=1h2m3s", "x")] == [90, 3723, None]
    assert [v(X.timer_seconds(F.lit(t))) for t in ("2:15", "0:61", "x")] == [135, None, None]
    assert v(X.clock_text(F.lit(-61.5))) == "-1:01"
    assert v(X.error_code(F.lit("Video Unavailable!"), [("timeout", "slow"), ("unavailable", "gone")])) == "gone"
    assert v(X.shots_from_points(F.lit(6), F.create_map(F.lit("a"), F.lit(3), F.lit("b"), F.lit(0)))) == 2
    assert v(X.source_stem(F.lit("m_12_jpg.rf.abc.jpg"))) == "m_12"


def test_folds(spark):
    pts = [(0, 0), (1, 0), (10, 0), (2, 0), (11, 0), (3.4, 0)]
    array = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])
    assert [c.n for c in one(spark, folds.leader_clusters(array, 2.0))] == [3, 2, 1]
    times = F.array(*[F.lit(t) for t in (0.0, 0.1, 0.2, 0.5, 0.9, 1.0)])
    assert one(spark, folds.thin(times, 0.3)) == [0.0, 0.5, 0.9, 1.0]
    assert one(spark, folds.theil_sen(F.array(*[F.lit(float(t)) for t in (0, 1, 2, 3)]), F.array(*[F.lit(float(t)) for t in (0, 2, 4, 100)]))) == pytest.approx(statistics.median([2, 2, 2, 96, 49, 100 / 3]))
    path = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(x).alias("x"), F.lit(0.0).alias("y")) for t, x in ((0, 0.0), (3, 0.1), (6, 0.0), (7, 5.0), (8, 5.0))])
    assert [(s.start, s.end) for s in one(spark, folds.still_spans(path, 0.5, 4.0))] == [(0.0, 6.0)]
    r = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(v).alias("value")) for t, v in ((0, 0), (1, 3), (2, 3), (3, 9), (4, 3), (5, 5), (6, 5))])
    assert [(s.t, s.value) for s in one(spark, folds.stable_values(r, 2))] == [(1.0, 3), (5.0, 5)]
    assert folds.longest_common("824", "8242") == 3


EVENT = "event_id string, match_id string, job_id string, team int, track_id int, t_seconds double, phase string, event_type string, confidence double, field_x double, field_y double, goal string, source string"


def test_track_corrections_follow_moved_events(spark):
    ev = spark.createDataFrame([("a", "m", "j", 1, 5, 1.0, "auto", "reload", 0.5, None, None, None, "model"), ("b", "m", "j", 1, 6, 2.0, "auto", "reload", 0.5, None, None, None, "model")], EVENT)
    c = "correction_id string, scope string, job_id string, target_id string, match_id string, action string, fields map<string,string>, created_at timestamp"
    rows = [("1", "event", "j", "b", "m", "edit", {"track_id": "5"}, "2024-01-01 00:00:01"), ("2", "track", "j", "5", "m", "edit", {"team": "99"}, "2024-01-01 00:00:02"),
            ("3", "event", "j", "a", "m", "delete", {}, "2024-01-01 00:00:03"), ("4", "event", "j", "a", "m", "create", {"team": "7"}, None), ("5", "event", "j", "zz", "m", "edit", {"team": "7"}, "2024-01-01 00:00:03")]
    log = spark.createDataFrame([r[:-1] for r in rows], c.rsplit(",", 1)[0]).join(spark.createDataFrame([(r[0], r[-1]) for r in rows], "correction_id string, at string"), "correction_id").withColumn("created_at", F.col("at").cast("timestamp")).drop("at")
    got = {r.event_id: (r.team, r.track_id, r.correction_id) for r in corrections.apply_corrections(ev, log).collect()}
    assert got == {"b": (99, 5, "2"), "a": (7, None, "4")}


def test_made_shots_and_events(spark):
    shots = spark.createDataFrame([("j", "s1", 1.0, 1, "made", 2.0, "high", 0.9), ("j", "s2", 3.0, 2, "missed", None, None, 0.9), ("j", "s3", 5.0, None, "made", None, "low", 0.9)], "job_id string, shot_id string, launch_t_seconds double, robot_track_id int, outcome string, outcome_t_seconds double, goal string, confidence double")
    entries = spark.createDataFrame([("j", "s1", 2.1, 1)], "job_id string, shot_id string, t_seconds double, robot_track_id int")
    assert sorted(r.t for r in stats.made_shots(entries, shots).collect()) == [2.1, 5.0]
    tracks = spark.createDataFrame([("j", 1, 254)], "job_id string, track_id int, team int")
    assert stats.shot_events(shots, tracks, ["high", "low"]).groupBy("event_type").count().orderBy("event_type").collect()[1].asDict() == {"event_type": "shot_made", "count": 2}
    with pytest.raises(Exception, match="goal not of this season"):
        stats.shot_events(shots, tracks, ["high"]).collect()


def run_folder(tmp_path):
    for k, (job, match) in enumerate((("j1", "2024ev_qm1"), ("j2", "2024ev_qm2"))):
        d = tmp_path / job
        d.mkdir()
        (d / "job.json").write_text(json.dumps({"job_id": job, "match_id": match, "season": 2024, "alliances": {"red": [1, 2, 3], "blue": [4, 5, 6]}}))
        boxes = [{"t": i / 5, "x": 0.1, "y": 0.1, "w": 0.1, "h": 0.1, "field_x": 10 + i * 0.5, "field_y": 5.0} for i in range(40)]
        still = [{"t": i / 5, "x": 0.1, "y": 0.1, "w": 0.1, "h": 0.1, "field_x": 14.0, "field_y": 5.0} for i in range(40)]
        rows = [{"track_id": 1, "team": 4, "alliance": "blue", "boxes": boxes[:10] + boxes[20:], "gaps": [{"start": 1.9, "end": 4.0, "reason": "occlusion"}]},
                {"track_id": 2, "team": 1, "boxes": still, "gaps": []}, {"track_id": 3, "team": 1, "boxes": still[:5], "gaps": []}, {"track_id": 4, "team": None, "boxes": still[:3], "gaps": []}]
        (d / "tracks.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n[1, 2]\n")
        shots = [{"shot_id": f"s{i}", "robot_track_id": 1, "launch_t_seconds": 4.05 + i, "confidence": 0.9} for i in range(3)]
        (d / "shots.jsonl").write_text("\n".join(map(json.dumps, shots)))
    return str(tmp_path)


def saved(df, path):
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


SEASON = {"auto_seconds": 2.0, "teleop_seconds": 6.0, "endgame_seconds": 2.0}


def test_runs_to_profiles(spark, tmp_path):
    root = run_folder(tmp_path)
    assert len(readers.runs(spark, root)) == 2
    t = readers.load_run_tables(spark, root)
    assert t["tracks"].count() == 8 and t["events"].count() == 0
    seasons = spark.createDataFrame([(2024, 2.0, 6.0, 2.0, 0.0)], "season int, auto_seconds double, teleop_seconds double, endgame_seconds double, transition_seconds double")
    geometry = spark.createDataFrame([(2024, 54.0, 27.0, [("own", 0.0, 15.0), ("far", 15.0, 54.0)], [("r", 0.0, 9.0), ("l", 9.0, 27.0)])], "season int, field_length_ft double, field_width_ft double, zones array<struct<id:string,x_min:double,x_max:double>>, lanes array<struct<id:string,y_min:double,y_max:double>>")
    clocks = spark.createDataFrame([("j1", 0.0), ("j2", 0.0)], "job_id string, start double")
    samples, launches = (saved(df, f"{root}/{n}") for n, df in zip(("samples", "launches"), timeline.build(t["tracks"], t["jobs"], t["shots"], seasons, geometry, clocks)))
    mine = samples.where("job_id = 'j1' and robot_key = 'team:4'").orderBy("t").collect()
    grid = [r.t for r in mine]
    assert grid == sorted([*(i / 10 for i in range(0, 19)), *(i / 10 for i in range(40, 79))])
    assert all(r.x == pytest.approx(10 + r.t * 2.5, abs=2e-3) for r in mine)
    assert all(r.speed == pytest.approx(2.5, abs=1e-2) for r in mine if 0.45 < r.t < 1.35 or 4.45 < r.t < 7.35)
    keys = {r.robot_key for r in samples.where("job_id = 'j1'").select("robot_key").distinct().collect()}
    assert keys == {"team:4", "team:1", "team:1#track:3", "track:4"}
    fired = launches.where("job_id = 'j1'").orderBy("t").collect()
    assert [r.ax for r in fired] == [pytest.approx(10 + 2.5 * t, abs=0.2) for t in (4.0, 5.0, 6.0)]
    back = timeline.to_rows(timeline.to_columns(samples))
    assert back.count() == samples.count()
    geo = {"field_length_ft": 54.0, "field_width_ft": 27.0, "hub_x": 15.0, "hub_y": 13.0, "zones": [("own", 0.0, 15.0), ("far", 15.0, 54.0)], "lanes": [("r", 0.0, 9.0), ("l", 9.0, 27.0)]}
    f = saved(features.match_features(samples, launches, SEASON, geo), f"{root}/features")
    row = f.where("job_id = 'j1' and robot_key = 'team:4'").first()
    assert row.coverage.observed_s == pytest.approx(5.8) and row.launches.total == 3 and row.shooting.volleys == 1
    assert row.zones.own_half_share == pytest.approx(sum(x.x < 27 for x in mine if x.phase in ("teleop", "endgame")) / sum(x.phase in ("teleop", "endgame") for x in mine), abs=1e-3)
    profiles = saved(profile.build_profiles(f), f"{root}/profiles")
    p = {r.team: r for r in profiles.collect()}
    assert p[4].n_matches == 2 and p[4].launches_per_match == 3 and p[4].spots[0].matches == 2 and len(p[4].routines) == 1
    maps = {n: saved(df, f"{root}/map-{n}") for n, df in heatmap.maps(f.withColumn("seq", F.lit(0)), geo).items()}
    assert maps["counts"].where("team = 4").first().n_matches == 2
    assert maps["scoring"].where("team = 4").agg(F.sum("launches")).first()[0] == 6
    assert profile.next_match_test(f, 1).where("test = 'start_lane'").first().n >= 1
    advice = plan.match_plan([4], [1, 77], profiles, maps["auto"], maps["zones"])
    assert {"missing_profile"} <= {r.id for r in advice.collect()}
    engine = Engine.open(spark, root, SEASON, geo, f"{root}/work")
    assert engine.events().count() == 0 and engine.tracks("j1").count() == 4 and engine.jobs("2024ev").count() == 2
    assert [r.team for r in engine.pick_list([1], None, profiles, maps).collect()] == [4]
    log = sinks.pose_log(samples).collect()
    assert sum(len(r.body) for r in log) == 32 * samples.where("x is not null").count()


def test_strict_reader_fails(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "tracks.jsonl").write_text("{bad\n")
    with pytest.raises(Exception):
        readers.strict(spark, f"{tmp_path}/*/tracks.jsonl", "tracks").collect()
    assert readers.lenient(spark, f"{tmp_path}/*/none.jsonl", "events").count() == 0


def test_fusion(spark):
    rows = [("f", "a", 0.1, 0.1, 0.2, 0.2, 0.9), ("f", "b", 0.11, 0.1, 0.2, 0.2, 0.8), ("f", "a", 0.6, 0.6, 0.2, 0.2, 0.7), ("f", "a", 0.12, 0.1, 0.2, 0.2, 0.5)]
    b = spark.createDataFrame(rows, schemas.schema("proposals"))
    got = fusion.fuse(b).orderBy("cluster").collect()
    assert [r.agreement_count for r in got] == [2, 1, 1] and got[0].x == pytest.approx((0.1 * 0.9 + 0.11 * 0.8) / 1.7, abs=1e-6)
    w = {r.source: r.weight for r in fusion.source_weights(b).collect()}
    assert w["b"] / w["a"] == pytest.approx(1 / (2 / 3))
    assert fusion.consensus(b, 2).count() == 1 and fusion.non_max(b, 0.5).count() == 2
    ok, bad = fusion.split_boxes(b.union(spark.createDataFrame([("f", "a", 0.9, 0.9, 0.5, 0.5, 0.9)], b.schema)))
    assert ok.count() == 2 and bad.first().reason == "invalid"
    clip = spark.createDataFrame([("c", i, 0.1 + 0.01 * i, 0.1, 0.2, 0.2, 0.9) for i in range(6) if i != 3] + [("c", i, 0.7, 0.7, 0.1, 0.1, 0.8) for i in (0, 5)] + [("d", 0, 0.1, 0.1, 0.2, 0.2, 0.9)], "clip string, frame_index int, x double, y double, w double, h double, confidence double")
    linked = fusion.link_frames(clip)
    assert sorted((r.clip, r["count"]) for r in linked.groupBy("clip", "track").count().collect()) == [("c", 1), ("c", 1), ("c", 5), ("d", 1)]
    assert fusion.persistence(linked).where("clip = 'd'").first().confidence == pytest.approx(0.3)
    t = spark.createDataFrame([("f", 0, 0.1, 0.1, 0.2, 0.2), ("f", 0, 0.6, 0.6, 0.2, 0.2)], "frame_id string, kind int, x double, y double, w double, h double")
    m = fusion.agreement_with(t, t.limit(1).union(spark.createDataFrame([("g", 0, 0.1, 0.1, 0.2, 0.2)], t.schema))).first()
    assert (m.tp, m.precision, m.recall) == (1, 0.5, 0.5)


def test_identity(spark):
    reads = spark.createDataFrame([("j", 1, "red", r) for r in ("8242", "824", "842", "8242")] + [("j", 2, None, "1")], "job_id string, track_id int, alliance string, read string")
    roster = spark.createDataFrame([("j", "red", 8242), ("j", "red", 254), ("j", "blue", 11281)], "job_id string, alliance string, team int")
    got = {r.track_id: (r.team, r.confidence) for r in identity.team_votes(reads, roster).collect()}
    assert got == {1: (8242, 1.0), 2: (None, 0.0)}
    f = spark.createDataFrame([("j", 5, 1, "red", 0.9, 0.0, 1.0), ("j", 5, 2, "red", 0.9, 2.0, 3.0), ("j", 6, 3, "red", 0.9, 0.0, 1.0), ("j", 6, 4, "red", 0.9, 0.5, 2.0)], "job_id string, team int, track_id int, alliance string, confidence double, lo double, hi double")
    assert {r.track_id: (r.merged_into, r.issue) for r in identity.reconcile_fragments(f).collect()} == {1: (1, None), 2: (1, None), 3: (3, "overlapping_team_claim"), 4: (4, "overlapping_team_claim")}
    o = spark.createDataFrame([("j", 1, c) for c in ("red", "red", "blue", None)] + [("j", 2, "red"), ("j", 2, "blue")], "job_id string, track_id int, alliance string")
    assert {r.track_id: r.alliance for r in identity.alliance_votes(o).collect()} == {1: "red", 2: None}


def test_clock_and_scores(spark):
    rows = [("j", float(t), 150 - t) for t in range(20, 60)] + [("j", float(t), 99) for t in range(5)]
    r = spark.createDataFrame(rows, schemas.schema("clock_readings"))
    ev = spark.createDataFrame([("j", "match_start", 3.0), ("k", "match_start", 4.0)], "job_id string, event_type string, t_seconds double")
    got = {x.job_id: (x.start, x.source) for x in clock.match_clock(r, ev, {"auto_seconds": 15, "teleop_seconds": 135}).collect()}
    assert got == {"j": (0.0, "scoreboard_clock"), "k": (4.0, "match_start_event")}
    assert [x.value for x in clock.frozen_values(r).collect()] == [99]
    s = spark.createDataFrame([("j", "red", float(i), v) for i, v in enumerate((0, 3, 3, 9, 9, 4, 13, 13))], schemas.schema("score_readings"))
    assert [(x.t, x.points, x.shots) for x in clock.scoring_moments(s, {"high": 3}).orderBy("t").collect()] == [(1.0, 3, 1), (3.0, 6, 2), (6.0, 4, None)]


def test_datasets_and_quality(spark):
    d = spark.createDataFrame([("k", float(t)) for t in (0, 1, 2, 5, 6, 9)], "k string, t double")
    assert sorted(r.t for r in chains.spaced(d, ["k"], "t", 3.0).collect()) == [0.0, 5.0, 9.0]
    assert datasets.strided(d, ["k"], ["t"], 3).count() == 3
    lines = spark.createDataFrame([("a", "0 0.5 0.5 0.1 0.2"), ("a", "bad")], "stem string, value string")
    assert datasets.yolo_rows(lines).count() == 1
    box = ("f", 1, 100, 200, -0.1, 0.5, 0.3, 0.2, "reviewed")
    kind = "frame_id string, image_id int, width int, height int, x double, y double, w double, h double, review_status string"
    assert [tuple(r)[1:5] for r in datasets.coco_rows(spark.createDataFrame([box], kind)).collect()] == [(0.0, 100.0, 20.0, 40.0)]
    with pytest.raises(Exception, match="unreviewed"):
        datasets.coco_rows(spark.createDataFrame([(*box[:-1], "proposed")], kind)).collect()
    p = spark.createDataFrame([({"team": "x", "odd": "1"},)], "fields map<string,string>").select(quality.patch_problems("fields", ["team"]).alias("p")).first().p
    assert p == ["unknown field odd", "team is no number"]
    assert metrics.problems([{"id": "a", "event_type": "zz"}, {"id": "a"}], [{"id": "r", "min": 1, "max": 1, "weight": 0.5}], set()) == ["repeated id a", "unknown event type zz", "empty range of r", "weights do not sum to 1"]
    assert schemas.drift(spark.createDataFrame([("j", 1)], "job_id string, more int").schema, "clock_readings") == {"missing": ["remaining", "t"], "extra": ["more"]}


def test_temporal(spark):
    rng = random.Random(5)
    left = [("k", round(rng.uniform(0, 20), 2), i) for i in range(40)]
    right = [("k", round(rng.uniform(0, 20), 2), i) for i in range(25)]
    a, b = spark.createDataFrame(left, "k string, t double, i int"), spark.createDataFrame(right, "k string, rt double, v int")
    got = {r.i: r.near_v for r in temporal.asof_nearest(a, b, ["k"], "t", "rt", 0.3, ["v"], "v").collect()}
    for _, t, i in left:
        best = min(right, key=lambda r: (round(abs(r[1] - t), 9), r[1], r[2]))
        assert got[i] == (best[2] if abs(best[1] - t) <= 0.3 else None)
    pairs = temporal.band_join(a, b, ["k"], "t", "rt", 0.5)
    assert pairs.count() == sum(abs(x[1] - y[1]) <= 0.5 for x in left for y in right)
    q = spark.createDataFrame([("k", 0.5), ("k", 1.0), ("k", 3.0), ("k", 9.0)], "k string, at double")
    pts = spark.createDataFrame([("k", 0.0, 0.0), ("k", 1.0, 10.0), ("k", 2.0, 20.0), ("k", 6.0, 0.0)], "k string, t double, x double")
    assert {r["at"]: r.x for r in temporal.interpolate_at(pts, q, ["k"], "t", ["x"], 1.5).collect()} == {0.5: 5.0, 1.0: 10.0, 3.0: None, 9.0: None}
    assert [(r.first, r.last, r.n) for r in temporal.runs_above(pts, ["k"], "t", "x", 5.0, 2).collect()] == [(1.0, 2.0, 2)]
    h = temporal.heading_hold(spark.createDataFrame([("k", 0.0, 0.0, 0.0), ("k", 1.0, 1.0, 0.0), ("k", 2.0, 1.01, 0.01), ("k", 3.0, None, None), ("k", 4.0, 5.0, 5.0)], "k string, t double, x double, y double"), ["k"], "t").orderBy("t").collect()
    assert [r.heading for r in h] == [0.0, 0.0, 0.0, None, 0.0]


def test_merge_and_retention(spark, tmp_path):
    old, new = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "row_key string, v int"), spark.createDataFrame([("b", 2), ("c", 3), ("d", 4)], "row_key string, v int")
    m = sinks.keyed_merge(old, new)
    assert sorted((r.row_key, r.v, r.change) for r in m.collect()) == [("a", 1, "kept"), ("b", 2, "skipped"), ("c", 3, "changed"), ("d", 4, "appended")]
    assert tuple(sinks.merge_counts(m).first()) == (2, 1)
    path = str(tmp_path / "t")
    sinks.replace_jobs(spark.createDataFrame([("j1", 1), ("j2", 2)], "job_id string, v int"), path)
    sinks.replace_jobs(spark.createDataFrame([("j2", 5)], "job_id string, v int"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("job_id", "v").collect()) == [("j1", 1), ("j2", 5)]
    with pytest.raises(ValueError, match="nothing to export"):
        sinks.refuse_empty(new.limit(0), spark.createDataFrame([(1,)], "team int"))


def stream(spark, rows, schema, tmp_path, batches):
    path = tmp_path / "in"
    path.mkdir()
    for i, part in enumerate(batches):
        spark.createDataFrame([rows[k] for k in part], schema).coalesce(1).write.parquet(str(path / f"b{i}"))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(path / "*"))


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    at = lambda s: F.timestamp_millis(F.lit(int(1_700_000_000_000 + s * 1000)))
    ts = {s: one(spark, at(s)) for s in (0, 1, 2, 2.5, 8, 9, 100)}
    rows = [("j", "r", ts[s]) for s in (0, 1, 2.5, 8, 100)]
    out = drain(sessions.volleys(stream(spark, rows, "job_id string, robot_key string, ts timestamp", tmp_path, [[0, 1, 2], [3], [4]])), "volleys")
    assert sorted(r.launches for r in out.collect()) == [1, 3]


def test_stream_tracker_equals_batch_ids(spark, tmp_path):
    t0 = 1_700_000_000
    rows = [("j", one(spark, F.timestamp_seconds(F.lit(t0 + i))), 0.1 + 0.02 * i, 0.1, 0.2, 0.2) for i in range(6)]
    rows += [("j", rows[3][1], 0.7, 0.7, 0.1, 0.1)]
    out = drain(tracker.track_boxes(stream(spark, rows, "job_id string, ts timestamp, x double, y double, w double, h double", tmp_path, [[0, 1, 2], [3, 6], [4, 5]])), "tracked")
    assert sorted(r["count"] for r in out.where("kind = 'box'").groupBy("track").count().collect()) == [1, 6]


def test_stream_tracker_gives_gaps_and_never_an_id_twice(spark, tmp_path):
    """On replay as the batch form, over a pause that times the job out."""
    from matchlake.operators import tracking

    t0, rows = 1_700_000_000, []
    for i in range(30):
        if i not in (5, 6, 7, 8):
            rows.append(("j", i / 2, 0.1 + 0.01 * i, 0.1, 0.1, 0.1))
        rows.append(("j", i / 2, 0.7, 0.5, 0.1, 0.1))
    rows += [("j", 60.0 + i / 2, 0.3, 0.3, 0.1, 0.1) for i in range(4)]
    kind = "job_id string, t double, x double, y double, w double, h double"
    timed = [(j, one(spark, F.timestamp_millis(F.lit(int((t0 + t) * 1000)))), *box) for j, t, *box in rows]
    other = ("k", one(spark, F.timestamp_seconds(F.lit(t0 + 50))), 0.1, 0.1, 0.1, 0.1)
    first = list(range(len(rows) - 4))
    batches = [first[:20], first[20:], [len(rows)], [len(rows)], list(range(len(rows) - 4, len(rows)))]
    out = drain(tracker.track_boxes(stream(spark, [*timed, other], "job_id string, ts timestamp, x double, y double, w double, h double", tmp_path, batches)), "gaps").where("job_id = 'j'").collect()
    want = tracking.track_boxes(spark.createDataFrame(rows, kind)).collect()
    at = lambda ts: round(ts.timestamp() - t0, 3)
    assert sorted((at(r.ts), r.x, r.track) for r in out if r.kind == "box") == sorted((r.t, r.x, r.track) for r in want if r.kind == "box")
    gaps = sorted((r.track, at(r.since), at(r.ts), r.reason) for r in out if r.kind == "gap")
    assert gaps == sorted((r.track, r.t, r.end, r.reason) for r in want if r.kind == "gap") and len(gaps) == 1


def test_stream_goal_gate(spark, tmp_path):
    t = lambda s: one(spark, F.timestamp_millis(F.lit(int(1_700_000_000_000 + s * 1000))))
    rows = [("j", 1, "g", t(0), 1.0), ("j", 1, "g", t(0.1), -1.0), ("j", 1, "g", t(0.2), -1.0), ("j", 2, "g", t(0), 1.0), ("j", 2, "g", t(1), -1.0), ("j", 2, "g", t(1.1), -2.0)]
    rows[2] = ("j", 1, "g", t(0.2), -2.0)
    rows += [("j", 3, "g", t(0), 1.0), ("j", 3, "g", t(0.1), -1.0), ("j", 3, "g", t(0.2), -0.5), ("j", 3, "g", t(0.25), -2.0)]
    out = drain(tracker.count_entries(stream(spark, rows, "job_id string, ball int, region string, ts timestamp, depth double", tmp_path, [[0, 1, 3, 6, 7], [2, 4, 5, 8, 9]])), "gate")
    assert [r.ball for r in out.collect()] == [1]


def test_distance_helpers(spark):
    assert one(spark, X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, X.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    p = lambda *v: F.array(*[F.when(F.lit(x is not None), F.struct(F.lit(float(x or 0)).alias("x"), F.lit(0.0).alias("y"))) for x in v])
    assert one(spark, X.path_distance(p(0, 1, None, 3), p(1, 2, 3, 4))) == pytest.approx(1.0) and one(spark, X.path_distance(p(0, 1), p(0, 1))) is None
