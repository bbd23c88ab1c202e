"""Who acts near whom, against all pairs."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from matchlake.operators import temporal
from matchlake.plans.registry import QUERIES


def brute(rows, width):
    found = defaultdict(list)
    for k, w, t in rows:
        found[w] += [w2 for k2, w2, t2 in rows if k is not None and k == k2 and w2 != w and t is not None and t2 is not None and w2 is not None and abs(t - t2) <= width]
    return {w: (len(v), len(set(v))) for w, v in found.items() if v and w is not None}


def test_meetings_equal_all_pairs(spark, monkeypatch):
    g = np.random.default_rng(5)
    rows = [(f"k{k}", int(w), float(t) / 1e6) for k, w, t in zip(g.integers(0, 3, 400), g.integers(0, 25, 400), g.integers(0, 40, 400) * 15_000_001)]
    rows += [("k0", 1, i * 60.0) for i in range(5)] + [("k1", int(w), 60.3 * i) for i in range(6) for w in (1, 2, 2)] + [("k0", 99, 1e6), (None, 3, 1.0), ("k1", None, 1.0), ("k1", 4, None), ("k1", 5, float("inf"))]
    df = spark.createDataFrame(rows, "k string, w int, t double").repartition(3)
    want = brute(rows, 60.0)
    for pairs, marks in ((temporal._Meetings.PAIRS, temporal._Meetings.MARKS), (7, 3)):
        small = lambda *a, pairs=pairs, marks=marks: _limited(temporal._Meetings, pairs, marks)(*a)
        with monkeypatch.context() as m:
            m.setattr(temporal, "BLOCKS", 3 if pairs == 7 else temporal.BLOCKS)
            got = {r.w: (r.meetings, r.others) for r in temporal.meetings(df, ["k"], "w", "t", 60.0).collect()}
            assert got == want
        state = small(["k"], "w", 60.0, _arrow(rows)["w"].type)
        state.meet(_arrow(rows))
        made = [b for b in state.ask(_arrow(sorted((r for r in rows if None not in r), key=lambda r: r[1])))] + [state.close()]
        found = {w: (m, o) for b in made for w, m, o in zip(*(b[c].to_pylist() for c in ("w", "meetings", "others"))) if m}
        assert found == want


def _arrow(rows):
    import pyarrow as pa

    rows = [r for r in rows if None not in r and r[2] < float("inf")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.float64()))], names=["k", "w", "_t"])


def _limited(kind, pairs, marks):
    return type("Limited", (kind,), {"PAIRS": pairs, "MARKS": marks})


def test_meetings_of_a_crowded_minute(spark, sf):
    """Fifteen thousand who all meet: 225 million pairs, none of which is a row."""
    n = 15_000
    rows = spark.range(n).select(F.lit("k").alias("k"), F.col("id").cast("int").alias("w"), (F.col("id") * 60 / n).alias("t"))
    got = temporal.meetings(rows, ["k"], "w", "t", 60.0).agg(F.min("meetings").alias("a"), F.max("others").alias("b"), F.count("*").alias("n")).first()
    assert tuple(got) == (n - 1, n - 1, n)
    assert "Join" not in QUERIES["band_self_join"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
