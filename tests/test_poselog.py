from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from matchlake.sources import poselog


def test_round_trip_through_the_data_source(spark, tmp_path):
    path = f"file://{tmp_path}/logs"
    rows = [(f"j{j}", f"team:{k}", i / 10, 0.1 * i, -0.5 * k, None if i == 0 else 0.25) for j in range(5) for k in range(3) for i in range(40)]
    rows += [(None, "rød", 1.0, 2.0, 3.0, 0.0), ("j0", "team:1", 9.0, None, 1.0, 0.0)]
    kind = "job_id string, robot_key string, t double, x double, y double, heading double"
    poselog.save(spark.createDataFrame(rows, kind), path)
    back = spark.read.format("poselog").load(path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted((r for r in rows if r[3] is not None), key=str)
    assert back.rdd.getNumPartitions() == 6 and len(list((tmp_path / "logs").iterdir())) == 6
    times = [r.t for r in back.where("job_id = 'j3'").collect()]
    assert times == sorted(times)
    poselog.save(spark.createDataFrame(rows[:40], kind), path, mode="overwrite")
    assert spark.read.format("poselog").load(path).count() == 40 and len(list((tmp_path / "logs").iterdir())) == 1


def test_a_run_that_fails_leaves_nothing_to_read(spark, tmp_path):
    path = f"file://{tmp_path}/logs"
    good = spark.range(20).select(F.format_string("j%d", F.col("id") % 4).alias("job_id"), F.lit("r").alias("robot_key"), F.col("id").cast("double").alias("t"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(None).cast("double").alias("heading"))
    bad = good.withColumn("x", F.when(F.col("t") == 19, F.raise_error(F.lit("boom")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="boom"):
        poselog.save(bad, path)
    spark.dataSource.register(poselog.PoseLog)
    assert spark.read.format("poselog").load(path).count() == 0


def test_files_of_other_kinds(spark):
    log = poselog.LogFile("j")
    log.add("a", 1.5, 1.0, 2.0, 0.5)
    log._record(0, 0, struct.pack("<H", 9) + poselog._text("note") + poselog._text("string"))
    log._record(9, 7, b"hello")
    log.add("b", 2.5, 3.0, 4.0, None)
    raw = log.content()
    assert list(poselog.parse(raw)) == [("j", "a", 1.5, 1.0, 2.0, 0.5), ("j", "b", 2.5, 3.0, 4.0, None)]
    for broken, why in ((raw[:-3], "cut short"), (b"x" + raw, "not a pose log"), (raw[:8] + struct.pack("<H", 7) + raw[10:], "version 7")):
        with pytest.raises(ValueError, match=why):
            list(poselog.parse(broken))
