"""Thinning, links and exact samples against plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from matchlake.operators import chains, sampling


def greedy(times, gap):
    out = []
    for t in sorted(set(times)):
        if not out or t >= out[-1] + gap:
            out.append(t)
    return out


@pytest.mark.parametrize("gap", [1, 7, 1000])
def test_spaced_equals_the_fold(spark, gap):
    rng = random.Random(gap)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(400)) for _ in range(700)] + [("c", None), ("d", 5)]
    got = defaultdict(list)
    for r in chains.spaced(spark.createDataFrame(rows, "k string, t long"), ["k"], "t", gap).collect():
        got[r.k].append(r.t)
    of = defaultdict(list)
    for k, t in rows:
        if t is not None:
            of[k].append(t)
    want = {k: sorted(t for t in ts if t in set(greedy(ts, gap))) for k, ts in of.items()}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert chains.spaced(spark.createDataFrame([], "k string, t long"), ["k"], "t", gap).count() == 0


def test_spaced_keeps_the_last_where_asked(spark):
    rows = spark.createDataFrame([("a", t / 10) for t in range(11)], "k string, t double")
    assert sorted(r.t for r in chains.spaced(rows, ["k"], "t", 0.4 - 1e-9, with_last=True).collect()) == [0.0, 0.4, 0.8, 1.0]


def test_one_key_runs_in_many_tasks(spark):
    rows = spark.range(200_000).select(F.lit("k").alias("k"), (F.col("id") * 3).alias("t"))
    parts = [r["count"] for r in chains._ranges(rows, ["k"], "t", 10).groupBy("_part").count().collect()]
    assert len(parts) == 4 and max(parts) < 2 * min(parts)
    kept = chains.spaced(rows, ["k"], "t", 10).agg(F.count("*"), F.max("t"), F.count_if(F.col("t") % 12 == 0)).first()
    assert tuple(kept) == (50_000, 599_988, 50_000)


def test_roots_and_places(spark):
    rng = random.Random(3)
    ids = list(range(300))
    rng.shuffle(ids)
    pointers, want = [], {}
    while ids:
        chain = [ids.pop() for _ in range(min(len(ids), rng.choice([1, 1, 2, 5, 60])))]
        pointers += list(zip(chain, [*chain[1:], None]))
        want |= {x: (chain[0], i) for i, x in enumerate(chain)}
    got = {r.id: (r.root, r.place) for r in chains.roots(spark.createDataFrame(pointers, "id long, next long")).collect()}
    assert got == want


def test_links_follow_the_nearest(spark):
    rows = []
    for f in range(8):
        rows.append(("j", f, 10.0 + 2 * f, 5.0))
        if f not in (3, 4):
            rows.append(("j", f, 40.0 - 2 * f, 9.0))
    rows += [("j", 20, 24.0, 5.0), (None, 0, 10.0, 5.0), (None, 1, 10.5, 5.0), ("j", 5, None, 1.0)]
    frame = spark.createDataFrame(rows, "job string, f long, x double, y double")
    got = defaultdict(list)
    for r in chains.linked(frame, ["job"], "f", "x", "y", 3.0, missed=2).collect():
        got[r.track].append((r.place, r.job, r.f, r.y))
    assert sorted(len(v) for v in got.values()) == [1, 2, 6, 8]
    for v in got.values():
        assert [p for p, *_ in sorted(v)] == list(range(len(v))) and len({(j, y) for _, j, _, y in v}) == 1
    apart = chains.linked(frame, ["job"], "f", "x", "y", 3.0)
    assert sorted(n for n in Counter(r.track for r in apart.collect()).values()) == [1, 2, 3, 3, 8]


def order(seed, i):
    return hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()


@pytest.mark.parametrize("parts", [1, 5])
def test_samples_are_exact_and_do_not_depend_on_partitions(spark, parts):
    rows = [(i, ["x", "y", None][i % 3 if i < 900 else 0]) for i in range(3000)]
    quotas = [("x", 700), ("y", 5000), (None, 17), ("z", 4)]
    df = spark.createDataFrame(rows, "id long, s string").repartition(parts)
    got = defaultdict(set)
    for r in sampling.exact_sample(df, "s", spark.createDataFrame(quotas, "s string, take long"), ["id"], "seed").collect():
        got[r.s].add(r.id)
    for s, take in quotas[:3]:
        ids = sorted((i for i, x in rows if x == s), key=lambda i: order("seed", i))
        assert got[s] == set(ids[:take])
    assert "z" not in got


def test_samples_of_rows_that_tie(spark):
    df = spark.createDataFrame([(1, "x", k) for k in range(500)] + [(k, "x", 0) for k in range(2, 100)], "id long, s string, k int").repartition(3)
    quota = lambda n: spark.createDataFrame([("x", n)], "s string, take long")
    for n in (1, 50, 300, 598, 700):
        assert sampling.exact_sample(df, "s", quota(n), ["id"]).count() == min(n, 598)
    assert sampling.exact_sample(df, "s", quota(None), ["id"]).count() == 0
    assert sampling.exact_sample(df.limit(0), "s", quota(5), ["id"]).count() == 0


def test_capped_frames(spark):
    rows = [(i, i % 10 == 0, i % 4 == 1) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, human boolean, blank boolean")
    got = sampling.capped(df, "human", "blank", ["id"], machine_share=0.6, empty_share=0.2).collect()
    human, machine, blank = (sum(c) for c in zip(*[(r.human and not r.blank, not r.human and not r.blank, r.blank) for r in got]))
    assert (human, machine, blank) == (100, 150, 62)
    assert sampling.capped(df.where("not human"), "human", "blank", ["id"]).count() == 0


def test_pairs_of_points_are_not_shuffled(spark, monkeypatch):
    """What is written between the rounds is found by cell: at most nine rows a point leave the join of the cells."""
    from matchlake.operators import chains

    plans, staged = [], chains.staged
    monkeypatch.setattr(chains, "staged", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or staged(df))
    rows = [("j", f, float(10 * i), float(f)) for f in range(4) for i in range(20)]
    got = chains.linked(spark.createDataFrame(rows, "job string, f long, x double, y double"), ["job"], "f", "x", "y", 90.0).collect()
    assert len(got) == 80 and all(r.place == r.f for r in got) and len({r.track for r in got}) == 20
    assert not any("Window" in p for p in plans)


@pytest.mark.parametrize("around, pairs", [(48, 1_000_000), (2, 7)])
def test_links_of_crowded_frames_equal_all_pairs(spark, monkeypatch, around, pairs):
    """Many points within a reach, on tile edges, in one place and far away are linked as if all of them met."""
    import math
    import random

    monkeypatch.setattr(chains, "AROUND", around)
    monkeypatch.setattr(chains, "PAIRS", pairs)
    monkeypatch.setattr(chains, "GROUP", 500)
    draw = random.Random(7)
    grid = [(k, f, 4.0 * draw.randrange(-30, 30), 4.0 * draw.randrange(-9, 9)) for k in ("a", None) for f in range(4) for _ in range(60)]
    crowd = [("a", f, draw.gauss(80, 3), draw.gauss(-80, 3)) for f in range(4) for _ in range(120)]
    rows = sorted(set(grid + crowd + [("b", f, 1e7 + 10.0 * i, -1e7) for f in range(3) for i in range(20)]), key=lambda r: (r[0] or "", *r[1:]))

    def pairs_of(step, a, b):
        near = [(math.sqrt((q[2] - p[2]) * (q[2] - p[2]) + (q[3] - p[3]) * (q[3] - p[3])), p, q) for p in a for q in b if p[0] == q[0] and q[1] == p[1] + step]
        near, there, back = [n for n in near if n[0] <= 10.0 * step], {}, {}
        for d, p, q in near:
            there[p], back[q] = min(there.get(p, (d, q)), (d, q)), min(back.get(q, (d, p)), (d, p))
        return {p: q for p, (_, q) in there.items() if back[q][1] == p}

    rows = [(k or "", *r) for k, *r in rows]
    links = pairs_of(1, rows, rows)
    links |= pairs_of(2, [r for r in rows if r not in links], [r for r in rows if r not in set(links.values())])
    want, ends = {}, set(links.values())
    for r in rows:
        if r not in ends:
            n, at = 0, r
            while at is not None:
                want[at], at, n = (r, n), links.get(at), n + 1
    df = spark.createDataFrame([(k or None, *r) for k, *r in rows], "job string, f long, x double, y double").repartition(5)
    found = chains.linked(df, ["job"], "f", "x", "y", 10.0, missed=1).collect()
    first = {r.track: (r.job or "", r.f, r.x, r.y) for r in found if r.place == 0}
    assert {(r.job or "", r.f, r.x, r.y): (first[r.track], r.place) for r in found} == want and len(links) > 300
