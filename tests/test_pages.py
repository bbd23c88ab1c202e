from __future__ import annotations

import random

from pyspark.sql import functions as F

from matchlake.operators import datasets, pages, stats


def test_pages_follow_each_other(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice(["a", "b", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, n int, s string")
    for order in (["n", "-s", "id"], ["-n", "s", "-id"]):
        got, last = [], None
        while some := pages.page(df, order, 17, last).collect():
            got += [(r.id, r.n, r.s) for r in some]
            last = some[-1].asDict()
        keys = [F.col(o.lstrip("-")).desc_nulls_last() if o[0] == "-" else F.col(o).asc_nulls_last() for o in order]
        assert got == [tuple(r) for r in df.orderBy(*keys).collect()]
    plan = pages.page(df, ["n", "id"], 5, {"n": 2, "id": 7})._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_library(spark):
    rows = [("j1", "2025abc_qm1", "complete", 5), ("j2", "2025abc_qm2", "failed", 7), ("j3", "2025xyz_qm1", "complete", None), ("j4", "practice", "complete", 5)]
    jobs = spark.createDataFrame(rows, "job_id string, match_id string, status string, created_at int")
    ids = lambda **k: [r.job_id for r in pages.library(jobs, 10, **k).collect()]
    assert ids() == ["j2", "j1", "j4", "j3"] and ids(last={"created_at": 5, "job_id": "j1"}) == ["j4", "j3"] and ids(last={"created_at": None, "job_id": "j3"}) == []
    assert ids(event="2025abc") == ["j2", "j1"] and ids(status="complete", text="QM1") == ["j1", "j3"]


def test_one_job_is_read_from_few_files(spark, tmp_path):
    table = pages.JobFiles(spark, f"file://{tmp_path}/t")
    rows = spark.range(2000).select(F.format_string("j%03d", F.col("id") % 200).alias("job_id"), "id")
    table.append(rows, files=16)
    table.append(spark.createDataFrame([("j150", -1), (None, -2)], "job_id string, id long"), files=1)
    assert len(table.files(["j017"])) == 1 and len(table.files(["j150"])) == 2 and len(table.files([None])) == 1 and table.files(["zzz"]) == []
    assert sorted(r.id for r in table.get(["j150"]).collect()) == [-1, *range(150, 2000, 200)]
    assert [r.id for r in table.get([None]).collect()] == [-2] and table.get(["zzz"]).count() == 0 and table.get(["zzz"]).columns == ["job_id", "id"]
    assert table.get(["j001", "j150"]).count() == 21


def test_models_have_their_scores(spark):
    models = spark.createDataFrame([("b", "2024-02-01"), ("a", "2024-01-01"), ("c", None)], "id string, trained_on string")
    scores = spark.createDataFrame([("a", 0.4, "2024-03-01"), ("a", 0.6, "2024-04-01"), ("z", 0.9, None)], "id string, full_share double, measured_on string")
    assert [(r.id, r.heldout and r.heldout.full_share) for r in datasets.models_with_scores(models, scores).collect()] == [("a", 0.6), ("b", None), ("c", None)]


def test_cycles_are_listed(spark):
    e = spark.createDataFrame([(1, "m", "reload", 5.0, "a"), (1, "m", "reload", 9.0, "b"), (1, "m", "shot_made", 10.0, "c"), (1, "m", "reload", 12.0, "d"), (1, "n", "reload", 1.0, "e"), (2, "m", "reload", 1.0, "f")], "team int, match_id string, event_type string, t_seconds double, event_id string")
    assert [tuple(r) for r in stats.cycles(e).orderBy("team", "n").collect()] == [(1, "m", 1, 9.0, 4.0), (1, "m", 2, 12.0, 3.0)]
