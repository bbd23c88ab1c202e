"""Streams with timers against their batch forms, and the eviction of launch ports."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from matchlake.operators import balls, signals
from matchlake.streaming import vanish

T0 = 1_700_000_000
SQUARE = ((0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6))


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(vanish.PROVIDER)
    vanish.with_rocksdb(spark)
    yield spark
    spark.conf.set(vanish.PROVIDER, before)


def replay(spark, tmp_path, batches, schema, operator, name):
    """The rows of a stream that reads one file a batch, in turn."""
    path = tmp_path / "in"
    path.mkdir()
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis((F.col("t") * 1000).cast("long") + T0 * 1000)).drop("t")
        df.coalesce(1).write.parquet(str(path / f"b{i:03}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path / "*"))
    query = operator(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def sightings(seed):
    rng, rows = random.Random(seed), []
    for track in range(12):
        t = rng.randrange(20) / 10
        for _ in range(rng.randrange(1, 30)):
            t = round(t + rng.choice([0.1, 0.1, 0.2, 0.4, 0.5, 1.5]), 1)
            rows.append(("j", track, t, rng.choice([0.1, 0.5, 0.55]), rng.choice([0.5, 0.45, 0.9]), rng.choice(["R1", None])))
    return rows


def test_vanished_stream_equals_batch(rocksdb, tmp_path):
    """Rows come out of order within the allowed lateness; a far row closes what is open."""
    kind = "job_id string, track_id long, t double, x double, y double, owner string"
    rows = sightings(1)
    end = [("j", 99, 60.0, 0.1, 0.1, None), ("j", 99, 90.0, 0.1, 0.1, None)]
    rng = random.Random(2)
    late = sorted(rows, key=lambda r: r[2] + rng.random() * 1.5)
    batches = [late[i : i + 25] for i in range(0, len(late), 25)] + [[e] for e in end]
    got = replay(rocksdb, tmp_path, batches, kind, lambda s: vanish.vanished(s, SQUARE), "vanished")
    want = balls.vanished(rocksdb.createDataFrame(rows + end, kind), SQUARE)
    key = lambda r: (r[0], r[1], r[2])
    told = sorted(((r.job_id, r.track_id, round(r.ts.timestamp() - T0, 3), r.owner) for r in got.collect()), key=key)
    assert told == sorted(((r.job_id, r.track_id, round(r.t, 3), r.owner) for r in want.collect()), key=key) and len(told) > 10


def test_vanished_like_a_loop(spark):
    rows = sightings(5)
    stop, want = max(r[2] for r in rows), []
    for track in range(12):
        own = sorted(r for r in rows if r[1] == track)
        for r, after in zip(own, [*own[1:], None]):
            inside = 0.4 <= r[3] < 0.6 and 0.4 <= r[4] < 0.6
            if (after[2] if after else stop) - r[2] > 0.45 and inside:
                want.append((track, r[2], r[5]))
    got = balls.vanished(spark.createDataFrame(rows, "job_id string, track_id long, t double, x double, y double, owner string"), SQUARE, 0.45)
    assert sorted(map(str, want)) == sorted(str((r.track_id, r.t, r.owner)) for r in got.collect())


def test_ports_are_found_again_expire_and_give_way(rocksdb, tmp_path):
    seed = lambda t, robot, x, dx=1.0, dy=0.0: ("j", t, robot, x, 0.0, dx, dy, 1.0)
    first = [seed(0.0, 1, 0.0), seed(0.1, 1, 2.0), seed(0.2, 1, 2.0, 0.0, 1.0), seed(0.3, 2, 0.0)]
    again = [seed(0.9, 1, 1.0), seed(2.5, 1, 1.0)]
    many = [seed(10 + i / 100, 3, 10.0 * i) for i in range(30)] + [seed(10.5, 3, 0.0), seed(10.6, 3, 290.0)]
    kind = "job_id string, t double, robot long, x double, y double, dx double, dy double, radius double"
    rows = replay(rocksdb, tmp_path, [first, again, many, [seed(60.0, 1, 1.0)]], kind, vanish.launch_ports, "ports").collect()
    port = {(round(r.ts.timestamp() - T0, 2), r.robot): (r.port, r.standing) for r in rows}
    assert [port[t, 1][0] for t in (0.0, 0.1, 0.2, 0.9)] == [1, 1, 2, 1] and port[0.3, 2][0] == 3
    assert port[2.5, 1] == (4, 1)
    assert max(n for _, n in port.values()) == vanish.PORTS
    assert port[10.5, 3][0] == 35 and port[10.6, 3][0] == 34
    assert port[60.0, 1] == (36, 1)


def test_paired_pulses_like_a_loop(spark):
    rng = random.Random(3)
    inner, outer = ([(rng.choice("ab"), rng.randrange(400) / 100) for _ in range(60)] for _ in range(2))
    want = []
    for k in "ab":
        a, b = sorted({t for x, t in inner if x == k}), sorted({t for x, t in outer if x == k})
        nearest = {t: min((u for u in b if u >= t), default=None) for t in a}
        for u in b:
            own = [t for t in a if nearest[t] == u]
            if own and u - max(own) <= 0.16 + 1e-12:
                want.append((k, max(own), u))
    of = lambda rows: spark.createDataFrame(rows, "k string, t double")
    got = [(r.k, r.inner_t, r.outer_t) for r in signals.paired_pulses(of(inner), of(outer), ["k"]).collect()]
    assert [x for x in sorted(got) if x[2] - x[1] < 0.159] == [x for x in sorted(want) if x[2] - x[1] < 0.159] and got
