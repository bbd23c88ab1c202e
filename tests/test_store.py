"""Versions, the ledger of work, isolation of bad jobs, and progress of streams."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from matchlake.operators.isolate import TooManyFailures, isolated
from matchlake.sources import sinks
from matchlake.sources.ledger import Ledger, digest, frame_rows
from matchlake.sources.store import MOST_LAYERS, Change, Conflict, Store
from matchlake.streaming.progress import JobTable


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions_appear_whole_and_readers_keep_theirs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    table = lambda *rows: spark.createDataFrame(list(rows), "job_id string, v int")
    assert store.version().number == 0
    with pytest.raises(KeyError):
        store.read("events")
    first = store.commit({"events": Change(table(("a", 1), ("a", 2), ("b", 3), (None, 4))), "jobs": Change(table(("a", 0)))})
    held = store.read("events")
    store.commit({"events": Change(table(("a", 9), (None, 5)), ["job_id"]), "jobs": Change(table(("c", 0)))})
    assert rows_of(held) == rows_of(table(("a", 1), ("a", 2), ("b", 3), (None, 4)))
    assert rows_of(store.read("events")) == rows_of(table(("a", 9), ("b", 3), (None, 5)))
    assert rows_of(store.read("events", store.version(1))) == rows_of(held) and store.read("jobs").count() == 2
    with pytest.raises(Conflict):
        store.commit({"events": Change(table(("z", 1)))}, first)
    assert store.version().number == 2 and store.read("events").where("job_id = 'z'").count() == 0


def test_a_write_that_dies_changes_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    good = spark.createDataFrame([("a", 1)], "job_id string, v int")
    store.commit({"events": Change(good)})
    bad = good.select("job_id", F.raise_error(F.lit("boom")).cast("int").alias("v"))
    with pytest.raises(Exception, match="boom"):
        store.commit({"jobs": Change(good), "events": Change(bad, ["job_id"])})
    assert store.version().number == 1 and rows_of(store.read("events")) == [("a", 1)] and "jobs" not in store.version().tables


def test_layers_are_merged_and_old_versions_go(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for i in range(MOST_LAYERS + 2):
        store.commit({"t": Change(spark.createDataFrame([(i % 3, i), (100 + i, i)], "k int, v int"), ["k"])})
    assert len(store.version().tables["t"]) <= MOST_LAYERS
    n = MOST_LAYERS + 2
    want = sorted([(k, max(i for i in range(n) if i % 3 == k)) for k in range(3)] + [(100 + i, i) for i in range(n)])
    assert sorted(map(tuple, store.read("t").collect())) == want
    store.vacuum(keep=1)
    assert sorted(map(tuple, store.read("t").collect())) == want
    assert len(list((tmp_path / "s" / "versions").glob("*.json"))) == 1
    used = {layer[k] for layer in store.version().tables["t"] for k in ("data", "gone") if k in layer}
    assert {p.name for p in (tmp_path / "s" / "data").iterdir()} == used


def test_updates_are_conditional(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit({"jobs": Change(spark.createDataFrame([("a", "running"), ("b", "complete")], "job_id string, status string"))})
    cancel = lambda job: store.update("jobs", ["job_id"], (F.col("job_id") == job) & (F.col("status") == "running"), {"status": F.lit("canceled")}, expect=1)
    cancel("a")
    assert rows_of(store.read("jobs")) == [("a", "canceled"), ("b", "complete")]
    for job in ("a", "b", "c"):
        with pytest.raises(Conflict):
            cancel(job)
    seen = []

    def late(base):
        if not seen:
            seen.append(store.commit({"jobs": Change(spark.createDataFrame([("d", "running")], "job_id string, status string"))}))
        return {"jobs": Change(store.read("jobs", base).where("job_id = 'b'").withColumn("status", F.lit("seen")), ["job_id"])}

    store.retry(late)
    assert rows_of(store.read("jobs")) == [("a", "canceled"), ("b", "seen"), ("d", "running")]


def test_json_takes_the_place_of_an_earlier_folder(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    sinks.write_json(spark.range(3), path)
    sinks.write_json(spark.read.json(path).where("id > 0"), path)
    assert sorted(r.id for r in spark.read.json(path).collect()) == [1, 2] and [p.name for p in tmp_path.iterdir()] == ["out"]


RECORDING = "segment_sha256 string, match_id string, video_id string, start_offset double, duration double, fps double"


def test_ledger_plans_what_is_new(spark, tmp_path):
    ledger = Ledger(Store(spark, f"file://{tmp_path}/s"), ["segment_sha256", "match_id"])
    work = spark.createDataFrame([("h1", "m1", "v", 0.0, 2.0, 30.0), ("h2", "m2", "v", 5.0, 0.0, 30.0), ("h1", "m1", "v", 0.0, 2.0, 30.0), ("h3", None, "w", 1.5, 1.2, 25.0)], RECORDING)
    settings = {"fps": 1.0, "seed": "s"}

    def run(settings, work=work):
        planned, base = ledger.plan(work, settings)
        planned = planned.cache()
        ledger.commit(planned.select("item_id"), frame_rows(planned, settings["fps"], settings["seed"]), base)
        return planned.count()

    assert run(settings) == 3 and ledger.results().count() == 2 + 0 + 2
    assert run({"seed": "s", "fps": 1.0}) == 0 and digest(settings) == digest({"seed": "s", "fps": 1.0})
    assert run({"fps": 2.0, "seed": "s"}) == 3
    more = work.union(spark.createDataFrame([("h4", "m1", "v", 0.0, 1.0, 30.0)], RECORDING))
    assert ledger.plan(more, settings)[0].select("segment_sha256").collect()[0][0] == "h4" and run(settings, more) == 1
    planned, base = ledger.plan(spark.createDataFrame([("h5", "m5", "v", 0.0, 9.0, 30.0)], RECORDING), settings)
    with pytest.raises(Exception, match="killed"):
        ledger.commit(planned.select("item_id"), frame_rows(planned, 1.0, "s").withColumn("split", F.raise_error(F.lit("killed"))), base)
    assert ledger.plan(more, settings)[0].count() == 0 and ledger.results().where("match_id = 'm5'").count() == 0
    assert ledger.plan(spark.createDataFrame([("h5", "m5", "v", 0.0, 9.0, 30.0)], RECORDING), settings)[0].count() == 1


def test_frame_rows(spark):
    rows = frame_rows(spark.createDataFrame([("i", "m", "v", 10.0, 2.5, 29.97)], "item_id string, match_id string, video_id string, start_offset double, duration double, fps double"), 2.0, "seed").orderBy("frame_id").collect()
    assert [(r.frame_id, r.segment_time, r.source_time, r.frame_index) for r in rows] == [(f"i-f{n:06}", n / 2, 10 + n / 2, round(n / 2 * 29.97)) for n in range(5)]
    u = int(hashlib.sha256(b"seed:m").hexdigest()[:16], 16) / 2**64
    assert {r.split for r in rows} == {"train" if u < 0.8 else "valid" if u < 0.9 else "test"}


def test_one_bad_job_gives_one_error_row(spark):
    rows = spark.createDataFrame([(f"j{i:02}", str(v)) for i in range(40) for v in range(3)] + [("j07", "x"), (None, "5")], "job_id string, v string")

    def compute(jobs):
        own = rows.join(jobs, rows.job_id.eqNullSafe(jobs.job_id), "left_semi")
        return own.groupBy("job_id").agg(F.sum(F.when(F.col("v").rlike(r"^\d+$"), F.col("v").try_cast("int")).otherwise(F.raise_error(F.lit("odd value")))).alias("total"))

    good, dead = isolated(rows, compute)
    assert rows_of(good) == rows_of(spark.createDataFrame([(f"j{i:02}", 3) for i in range(40) if i != 7] + [(None, 5)], "job_id string, total long"))
    (letter,) = dead.collect()
    assert letter.job_id == "j07" and "odd value" in letter.error
    with pytest.raises(Exception, match="failed before"):
        isolated(spark.range(500).select(F.col("id").cast("string").alias("job_id")), lambda jobs: jobs.select(F.raise_error(F.lit("all"))))
    none, letters = isolated(rows.limit(0), compute)
    assert none.count() == 0 and letters.count() == 0 and issubclass(TooManyFailures, Exception)


def test_progress_is_a_table(spark, tmp_path):
    table = JobTable(spark, f"file://{tmp_path}/jobs")
    spark.streams.addListener(table)
    source = tmp_path / "in"
    try:
        for i in range(3):
            spark.range(5).select("id", F.timestamp_seconds(F.col("id") + 100 * i).alias("ts")).coalesce(1).write.json(str(source / f"b{i}"))
        read = lambda: spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).json(str(source / "*"))
        counted = read().withWatermark("ts", "10 seconds").groupBy(F.window("ts", "1 minute")).count()
        good = counted.writeStream.format("memory").queryName("good").outputMode("update").start()
        good.processAllAvailable()
        good.stop()
        bad = read().select(F.when(F.col("id") == 4, F.raise_error(F.lit("broken row"))).cast("int")).writeStream.format("memory").queryName("bad").start()
        with pytest.raises(Exception, match="broken row"):
            bad.processAllAvailable()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(table)
    for _ in range(2):
        last = {r["name"]: r for r in table.latest().collect()}
        assert last["good"].stage == "finished" and last["good"].total_rows == 15 and last["good"].batches >= 3 and last["good"].error is None
        assert last["bad"].stage == "failed" and "broken row" in last["bad"].error
        ran = table.rows().where("name = 'good' and stage = 'running'").orderBy("batch").collect()
        assert [r.rows for r in ran] == [5, 5, 5] and ran[-1].lag_s >= 10 and all(r.rows_per_s > 0 for r in ran)
        table.compact()
    assert not list((tmp_path / "jobs" / "rows").glob("*.json"))
