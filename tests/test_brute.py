"""Registered queries without SQL against plain Python over all rows."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from matchlake.operators import assignment, balls
from matchlake.plans import adapter as A
from matchlake.plans import queries
from matchlake.plans.registry import QUERIES


def overlap(a, b):
    w = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / union if union > 0 else 0.0


@pytest.fixture(scope="module")
def facts(spark, sf):
    return sorted(A.facts(spark, sf).collect(), key=lambda r: (r.t_seconds, r.event_id))


@pytest.fixture(scope="module")
def frames(spark, sf):
    out = defaultdict(list)
    for r in A.boxes(spark, sf).collect():
        out[r.frame_id].append((-r.confidence, r.source, r.x, r.y, r.w, r.h))
    return {k: sorted(v) for k, v in out.items()}


def test_crc_split(spark, sf):
    url = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}

    def split(name):
        stem = name.rsplit(".", 1)[0] if "." in name else name
        u = zlib.crc32(stem.encode()) % 10000 / 10000
        return "train" if u < 0.8 else "valid" if u < 0.9 else "test"

    got = {r.page_id: r.split for r in QUERIES["crc_split"](spark, sf).collect()}
    plain = {i: u for i, u in url.items() if u and ".rf." not in u and "/" not in u.rsplit(".", 1)[-1]}
    assert set(got) == set(url) and all(got[i] == split(u) for i, u in plain.items())


def clusters(points, radius):
    out = []
    for x, y in points:
        for c in out:
            if math.hypot(c[0] / c[2] - x, c[1] / c[2] - y) <= radius:
                c[0], c[1], c[2] = c[0] + x, c[1] + y, c[2] + 1
                break
        else:
            out.append([x, y, 1])
    return sorted(out, key=lambda c: -c[2])


def test_shooting_spots(spark, sf, facts):
    points = defaultdict(list)
    for r in facts:
        points[r.job_id, f"team:{r.team}"].append((r.field_x, r.field_y))
    got = defaultdict(list)
    for r in QUERIES["shooting_spots"](spark, sf).collect():
        got[r.job_id, r.robot_key].append((r.rank, r.ax, r.ay, r.launches))
    assert set(got) == set(points)
    for k, p in points.items():
        want = [(i, x / n, y / n, n) for i, (x, y, n) in enumerate(clusters(p, 4.0), 1)]
        assert [(g[0], g[3]) for g in sorted(got[k])] == [(w[0], w[3]) for w in want]
        assert all(abs(g[1] - w[1]) < 0.006 and abs(g[2] - w[2]) < 0.006 for g, w in zip(sorted(got[k]), want))


def test_suppressed_boxes(spark, sf, frames):
    got = defaultdict(set)
    for r in QUERIES["suppressed_boxes"](spark, sf).collect():
        got[r.frame_id].add((-r.confidence, r.source, r.x, r.y, r.w, r.h))
    for frame, boxes in frames.items():
        if len({b[0] for b in boxes}) < len(boxes):
            continue
        kept = []
        for b in boxes:
            if all(overlap(k[2:], b[2:]) < 0.3 for k in kept):
                kept.append(b)
        assert got[frame] == set(kept)


def test_fused_boxes(spark, sf, frames):
    backed, count = defaultdict(int), defaultdict(int)
    for boxes in frames.values():
        for b in boxes:
            count[b[1]] += 1
            backed[b[1]] += any(o[1] != b[1] and overlap(o[2:], b[2:]) >= 0.4 for o in boxes)
    rate = {s: max(0.1, backed[s] / count[s]) for s in count}
    weight = {s: r / (sum(rate.values()) / len(rate)) for s, r in rate.items()}
    got = defaultdict(list)
    for r in QUERIES["fused_boxes"](spark, sf).collect():
        got[r.frame_id].append((r.cluster, r.x, r.y, r.confidence, r.agreement_count, r.agreement))
    assert set(got) == set(frames)
    for frame, boxes in frames.items():
        found = []
        for b in boxes:
            home = next((m for m in found if all(o[1] != b[1] for o in m) and max(overlap(o[2:], b[2:]) for o in m) >= 0.4), None)
            found.append([b]) if home is None else home.append(b)
        total = sum(weight[s] for s in {b[1] for b in boxes})
        for (n, m), g in zip(enumerate(found), sorted(got[frame]), strict=True):
            v = [weight[b[1]] * -b[0] for b in m]
            mean = lambda k: sum(b[k] * w for b, w in zip(m, v)) / sum(v)  # noqa: B023, E731
            agree = min(1.0, sum(weight[b[1]] for b in m) / total)
            pairs = [overlap(a[2:], b[2:]) for i, a in enumerate(m) for b in m[i + 1 :]]
            sure = -mean(0) * agree**0.5 * (0.7 + 0.3 * (sum(pairs) / len(pairs) if pairs else 0.0))
            assert (g[0], g[4]) == (n, len({b[1] for b in m}))
            assert abs(g[1] - mean(2)) < 2e-6 and abs(g[2] - mean(3)) < 2e-6 and abs(g[3] - max(0.0, min(1.0, sure))) < 2e-6 and abs(g[5] - agree) < 1e-4


def test_sources_that_found_nothing_count(spark):
    from matchlake.operators import fusion

    b = spark.createDataFrame([("f", "a", 0.1, 0.1, 0.2, 0.2, 0.9), ("g", "a", 0.1, 0.1, 0.2, 0.2, 0.9)], "frame_id string, source string, x double, y double, w double, h double, confidence double")
    ran = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "a")], "frame_id string, source string")
    got = {r.frame_id: (r.agreement, r.confidence) for r in fusion.fuse(b, frames=ran).collect()}
    assert got["g"] == (1.0, pytest.approx(0.63)) and got["f"] == (0.5, pytest.approx(0.63 * 0.5**0.5, abs=1e-6))


def test_signal_pulses(spark, sf, facts):
    from tests.test_signals_overlay import peaks

    values = defaultdict(list)
    for r in sorted(facts, key=lambda r: (r.t_seconds, r.value)):
        values[r.job_id, r.team].append((r.t_seconds, r.value))
    got = defaultdict(list)
    for r in QUERIES["signal_pulses"](spark, sf).collect():
        got[r.job_id, r.team].append((r.t, r.value))
    for k, v in values.items():
        want = [(v[int(i)][0], x) for i, x in peaks([x for _, x in v], 5.0, 0.25)]
        assert sorted(got[k]) == sorted(want)


def test_fitted_clock(spark, sf, facts):
    """The best end by counting every pair of readings; the rest of the fit on what agrees with it."""
    readings = defaultdict(dict)
    for r in facts:
        value = 7 if r.n % 4 == 0 else int(70000 - math.floor(r.t_seconds))
        readings[r.job_id][r.t_seconds] = max(value, readings[r.job_id].get(r.t_seconds, value))
    got = {r.job_id: (r.start, r.source) for r in QUERIES["fitted_clock"](spark, sf).collect()}
    assert set(got) == set(readings)
    for job, of in readings.items():
        rows = sorted(of.items())
        votes = [(t + v, t, v) for t, v in rows if v > 0]
        counts = [sum(abs(o[0] - v[0]) <= 1.5 for o in votes) for v in votes]
        best = votes[counts.index(max(counts))][0]
        support, at = [v for v in votes if abs(v[0] - best) <= 1.5], {t: i for i, (t, _) in enumerate(rows)}
        while len(support) >= 2:
            (_, t0, v0), (_, t1, v1) = support[:2]
            i = at[t0]
            frozen = i >= 2 and rows[i - 1][1] == v0 and rows[i - 2][1] == v0
            if not frozen and v0 != v1 and abs(v0 - v1 - (t1 - t0)) <= 0.6:
                break
            support = support[1:]
        assert (got[job][1] == "scoreboard_clock") == (len(support) >= 4)


def test_match_features(spark, sf, facts):
    by_robot = defaultdict(list)
    for r in facts:
        by_robot[r.job_id, f"team:{r.team}"].append(r)
    got = {(r.job_id, r.robot_key): r for r in QUERIES["match_features"](spark, sf).collect()}
    assert set(got) == set(by_robot)
    for k, rows in by_robot.items():
        placed = [(n / 10, r.value / 50, r.phase) for n, r in enumerate(rows, 1) if r.phase in ("auto", "teleop", "endgame")]
        g = got[k]
        assert (g.observed_s or 0) == pytest.approx(len(placed) * 0.1, abs=0.051)
        if placed:
            assert g.distance_ft == pytest.approx(0.1 * sum(s for _, s, _ in placed if s >= 1), abs=0.051)
        times = [n / 10 for n in range(1, len(rows) + 1)]
        assert g.volleys == 1 + sum(b - a > 3 for a, b in zip(times, times[1:]))


def test_team_profiles(spark, sf, facts):
    launches, matches = defaultdict(lambda: defaultdict(int)), defaultdict(set)
    for r in facts:
        launches[r.team][r.job_id] += 1
        matches[r.team].add(r.job_id)
    got = {r.team: r for r in QUERIES["team_profiles"](spark, sf).collect()}
    assert set(got) == set(matches)
    assert all(got[t].n_matches == len(m) and got[t].launches_per_match == pytest.approx(median(launches[t].values())) for t, m in matches.items())


def test_spots_of_teams(spark, sf, facts):
    from matchlake.operators import profile

    f = queries._features(spark, sf)
    got = {r.team: [(s.launches, s.matches) for s in r.spots] for r in profile.team_spots(f).collect()}
    points = defaultdict(list)
    for r in sorted(facts, key=lambda r: (r.match_id, r.t_seconds, r.event_id)):
        points[r.team].append((r.field_x, r.field_y, r.match_id))
    for team, rows in points.items():
        top = clusters([p[:2] for p in rows], 4.0)[:3]
        near = [len({m for x, y, m in rows if math.hypot(x - c[0] / c[2], y - c[1] / c[2]) <= 4.0}) for c in top]
        assert got[team] == [(c[2], n) for c, n in zip(top, near)]


def test_nearest_rank_of_many_values(spark):
    """One key of two hundred thousand values, beyond what the sketch holds exactly."""
    from matchlake.functions.aggregates import nearest_rank

    n = 200_000
    rows = spark.range(n).select(F.lit("hot").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("v"))
    few = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", None), ("b", 5.0), (None, 2.0), (None, 9.0), ("c", None)], "k string, v double")
    values = sorted(r.v for r in rows.select("v").collect())
    for q in (0.0, 0.25, 0.5, 0.95, 1.0):
        got = {r.k: r.v for r in nearest_rank(rows.union(few), ["k"], "v", q, "v").collect()}
        assert got == {"hot": values[int(q * (n - 1) + 0.5)], "a": [1.0, 3.0][int(q + 0.5)], "b": 5.0, None: [2.0, 9.0][int(q + 0.5)]}


def test_asof_of_one_hot_key_is_linear(spark):
    """Two hundred thousand rows of one key on both sides, which a quadratic window does not end in any time."""
    from matchlake.operators import temporal

    n = 200_000
    left = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") / 10).alias("t"), "id")
    right = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") / 10 + 0.04).alias("rt"), F.col("id").alias("v"))
    got = temporal.asof_nearest(left, right, ["k"], "t", "rt", 0.05, ["v"], "v")
    assert got.count() == n and got.where("near_v = id").count() == n
    asked = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") / 10 + 0.05).alias("at"))
    points = left.withColumn("x", F.col("t") * 3)
    found = temporal.interpolate_at(points, asked, ["k"], "t", ["x"], 0.15)
    assert found.where("x is not null and abs(x - at * 3) < 1e-6").count() == n - 1 and found.count() == n


def test_numbers_over_a_whole_table(spark):
    from matchlake.operators.ordered import numbered

    got = numbered(spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(7), ["v"], "i").collect()
    assert len(got) == 5000 and all(r.v == r.i for r in got)
    assert numbered(spark.range(0).withColumnRenamed("id", "v"), ["v"], "i").count() == 0


def test_sure_identities(spark, sf):
    import numpy as np

    scores = defaultdict(dict)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        key = r.l_linenumber, r.l_partkey % 3
        value = round(r.l_discount * 10, 9) if r.l_discount > 0 else None
        old = scores[r.l_orderkey].get(key)
        scores[r.l_orderkey][key] = value if old is None else max(old, value or old)

    def best(s, rows, columns, without=None):
        if not rows:
            return 0.0, ()
        out = best(s, rows[1:], columns, without)
        for c in columns:
            v = s.get((rows[0], c))
            if v is not None and (rows[0], c) != without:
                total, pairs = best(s, rows[1:], [x for x in columns if x != c], without)
                if total + v > out[0] + 1e-9:
                    out = total + v, ((rows[0], c), *pairs)
        return out

    got = defaultdict(set)
    for r in QUERIES["sure_identities"](spark, sf).collect():
        got[r.frame].add((r.detection, r.identity))
    for frame, s in list(scores.items())[:400]:
        rows, columns = sorted({k[0] for k in s}), sorted({k[1] for k in s})
        total, pairs = best(s, rows, columns)
        want = {p for p in pairs if total - best(s, rows, columns, p)[0] + 1e-9 >= 0.08}
        assert got[frame] == want
    assert assignment.sure_pairs(np.full((2, 2), 0.5)) == []


def test_assigned_launches(spark, sf):
    rows = QUERIES["assigned_launches"](spark, sf).collect()
    assert rows and len({r.shot_id for r in rows}) == len({r.ref_id for r in rows}) == len(rows) and all(r.dt <= 1800 for r in rows)
    assert balls.MATCH_S == 0.075


def test_tracked_boxes_cover_every_box(spark, sf):
    rows = QUERIES["tracked_boxes"](spark, sf).collect()
    boxes = [r for r in rows if r.kind == "box"]
    f = A.facts(spark, sf)
    want = f.select("job_id", F.floor(F.col("t_seconds") / 60).alias("t"), "field_x", "field_y").distinct().count()
    assert len(boxes) == want
    assert len({(r.job_id, r.t, r.track) for r in boxes}) == len(boxes)
    assert all(r.end > r.t and r.reason == "detection_lost" for r in rows if r.kind == "gap")


def test_places_near_are_counted_without_pairs():
    import numpy as np

    from matchlake.operators.features import _Near

    g = np.random.default_rng(3)
    for n, m, whole in ((0, 4, False), (1, 1, False), (3000, 1500, True), (3000, 1500, False)):
        place = lambda k, most: g.integers(0, 2 * most, k) / 2 if whole else g.random(k) * most  # noqa: B023, E731
        x, y, w, qx, qy = place(n, 54), place(n, 27), g.integers(1, 5, n), place(m, 54), place(m, 27)
        near = np.sqrt((qx[:, None] - x) ** 2 + (qy[:, None] - y) ** 2) <= 6
        assert (_Near(x, y, w, 6.0).count(qx, qy) == (near * w).sum(1)).all()


def test_defense_of_a_crowded_instant(spark):
    """Sixty thousand robots at one instant, of whom each meets thousands: more pairs than a join ends with."""
    from matchlake.operators import features

    n = 60_000
    rows = spark.range(n).select(
        F.lit("j").alias("job_id"), F.concat(F.lit("r"), "id").alias("robot_key"), F.col("id").cast("int").alias("team"), F.when(F.col("id") % 2 == 0, "blue").otherwise("red").alias("alliance"),
        F.lit(0.1).alias("t"), F.lit("teleop").alias("phase"), (F.col("id") * 54 / n).alias("ax"), F.lit(1.0).alias("ay"), (F.col("id") * 54 / n).alias("x"), F.lit(1.0).alias("y"))
    got = features.defense(rows, 54.0, 1.0).agg(F.max("near_opponent_s").alias("most"), F.count_if(F.expr("near_opponent_s > 0")).alias("some")).first()
    assert abs(got.most - 2 * 6 / 54 * n / 2) <= 2 and got.some == n // 2 - 1


def test_features_that_nobody_asks_for_form_no_pairs(spark, sf):
    from matchlake.operators import profile

    for df in (QUERIES["match_features"](spark, sf), profile.read_features(queries._features(spark, sf))):
        assert "o_alliance" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_conflicts_shuffle_no_pairs(spark, sf):
    """Pairs of teams are summed where they are made: no exchange stands above the join."""
    from matchlake.operators import plan

    marks = queries._marks(spark, sf)
    df = plan.conflicts(marks, F.col("team") % 20 == 0)
    steps = df._jdf.queryExecution().sparkPlan().toString().splitlines()
    executed = df._jdf.queryExecution().executedPlan().toString().split("HashJoin")[0]
    assert steps and "Exchange" not in executed
    want = {tuple(r) for r in df.collect()}
    old = plan.SLICE
    try:
        plan.SLICE = 7
        assert {tuple(r) for r in plan.conflicts(marks, F.col("team") % 20 == 0).collect()} == want
    finally:
        plan.SLICE = old


def test_conflict_overlap_asks_about_every_team(spark, sf, facts):
    from collections import Counter

    marks = Counter((r.team, r.event_type) for r in facts)
    teams, kinds = {t for t, _ in marks}, {k for _, k in marks}
    want = {}
    for a in teams:
        for b in teams - {a}:
            both = [min(marks[a, k], marks[b, k]) for k in kinds if (a, k) in marks and (b, k) in marks]
            if both:
                want[a, b] = pytest.approx(sum(both) / 100)
    assert {(r.a_team, r.b_team): r.total for r in QUERIES["conflict_overlap"](spark, sf).collect()} == want


def test_conflicts_of_few_keys_equal_those_of_many(spark):
    """One row of weights a team gives what meeting key by key gives; so do marks that such a row cannot hold."""
    from matchlake.operators import plan

    rows = [(t, kind, f"k{k}", ((t * 7 + k * 3) % 11) / 2000 + (1e9 if t == 5 else 0)) for t in range(12) for kind in ("auto", "zones") for k in range(4) if (t + k) % 3 or kind == "auto" and t % 5 == 2]
    rows += [(None, "auto", "k1", 1.0), (1, "auto", None, 1.0), (99, "zones", "alone", 1.0), (98, "other", "k1", 1.0), (97, "other", "k1", 2.0)]
    marks = lambda more=(): spark.createDataFrame([*rows, *more], "team int, kind string, key string, weight double")
    old, found = (plan.DENSE, plan.SLICE, plan.BLOCK), []
    try:
        for few, slice_, block in ((32, 400_000, 1000), (32, 9, 2), (0, 400_000, 1000)):
            plan.DENSE, plan.SLICE, plan.BLOCK = few, slice_, block
            found.append([sorted(map(tuple, plan.conflicts(marks(more), a, b).collect())) for a, b in ((None, None), (F.col("team") % 4 == 0, None), (None, [1, 2, 3])) for more in ((), [(3, "auto", "k1", 0.5)], [(3, "auto", "k9", None)])])
    finally:
        plan.DENSE, plan.SLICE, plan.BLOCK = old
    assert found[0] == found[1] == found[2] and len(found[0][0]) > 100
    x = spark.createDataFrame([(v,) for k in range(-4100, 4100) for v in (k / 2000, k / 1000 + 0.0005, k / 7, 1e9 + k / 2000, 1e15 + k)] + [(None,), (float("inf"),)], "x double")
    assert x.where(~plan._thousandths(F.col("x")).eqNullSafe(F.bround("x", 3))).isEmpty()


def test_tracked_balls_hold_every_blob(spark, sf, facts):
    want = {(r.job_id, int(r.t_seconds // 900), round(r.field_x * 30, 6), round(r.field_y * 30, 6)) for r in facts}
    got = [(r.job_id, r.frame, r.x, r.y) for r in QUERIES["tracked_balls"](spark, sf).collect()]
    assert len(got) == len(set(got)) == len(want) and set(got) == want


def test_match_features_hold_every_group(spark, sf, facts):
    """All groups come back; places in auto, the path's length and the opponent most often near as in plain Python."""
    by_robot, at = defaultdict(list), defaultdict(list)
    for r in facts:
        by_robot[r.job_id, f"team:{r.team}"].append(r)
    for (job, key), rows in by_robot.items():
        for n, r in enumerate(rows, 1):
            at[job, n].append(r)
    found = {(r.job_id, r.robot_key): r for r in QUERIES["match_features"](spark, sf).collect()}
    assert set(found) == set(by_robot) and any(r.defense.marked for r in found.values())
    for k, rows in by_robot.items():
        got, near = found[k], {}
        for n, r in enumerate(rows, 1):
            second = round(n / 10)
            if second <= 15 and abs(n / 10 - second) <= 0.3:
                near.setdefault(second, []).append((abs(n / 10 - second), n / 10, r.field_x, r.field_y))
        path = [min(near[s])[2:] if s in near else None for s in range(16)]
        assert [p and (p.x, p.y) for p in got.auto_path.points] == path
        assert got.auto_path.observed_share == pytest.approx(len(near) / 16, abs=6e-4)
        assert got.auto_path.distance_ft == pytest.approx(sum(math.dist(a, b) for a, b in zip(path, path[1:]) if a and b), abs=0.051)
        close = defaultdict(list)
        for n, r in enumerate(rows, 1):
            if r.phase in ("teleop", "endgame") and r.field_x > A.LENGTH / 2:
                for o in at[k[0], n]:
                    if o.team % 2 != r.team % 2 and math.dist((r.field_x, r.field_y), (o.field_x, o.field_y)) <= 6.0:
                        close[str(o.team)].append(n)
        want = min(close, key=lambda o: (-len(close[o]), close[o][0], o)) if close else None
        assert (got.defense.marked, got.defense.marked_s) == (want, pytest.approx(len(close[want]) / 10) if want else None)
        assert got.launches.total == got.shooting.launches == len(got.points) == sum(s.launches for s in got.spots) == len(rows)
        assert got.zones is None or got.movement.longest_stop_s is not None and got.endgame.final_position is not None


@pytest.mark.parametrize("blocks", [(100_000, 400_000, 1_000_000), (7, 5, 3)])
def test_marked_opponents_equal_all_pairs(spark, monkeypatch, blocks):
    """Robots of many samples, several samples of one label at an instant, ties and the circle's edge."""
    import random

    from matchlake.operators import features

    for name, v in zip(("ASKED", "MET", "PAIRS"), blocks):
        monkeypatch.setattr(features, name, v)
    draw = random.Random(3)
    rows = [(j, f"r{i % 9}", draw.randrange(6) / 2, draw.choice(["red", "blue", "green"]), draw.randrange(0, 40) * 0.5, draw.randrange(0, 10) * 1.0) for j in ("a", "b") for i in range(130)]
    other = [(j, k, s, x, y, draw.choice(["ä", "p", "q", r])) for j, r, k, s, x, y in rows] + [("c", 1.0, "red", 1.0, 1.0, "p"), ("a", 0.5, "red", float("nan"), 1.0, "p")]
    want = {}
    for job, robot in {(r[0], r[1]) for r in rows}:
        n = defaultdict(list)
        for j, r, k, s, x, y in rows:
            for oj, ok, os, ox, oy, label in other:
                if (j, r) == (job, robot) and oj == j and ok == k and os != s and math.sqrt((x - ox) ** 2 + (y - oy) ** 2) <= 3.0:
                    n[label].append(k + 0.01)
        if n:
            best = min(n, key=lambda v: (-len(n[v]), min(n[v]), v))
            want[job, robot] = (best, len(n[best]))
    deep = spark.createDataFrame([(*r, r[2] + 0.01) for r in rows], "job_id string, robot_key string, k double, alliance string, x double, y double, t double")
    met = spark.createDataFrame(other, "job_id string, k double, alliance string, x double, y double, label string")
    got = features.opponents_marked(deep, met, 3.0).collect()
    assert {(r.job_id, r.robot_key): (r.label, r.n) for r in got} == want and len(got) == len(want) > 10
