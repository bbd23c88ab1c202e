"""Many frames solved at once, against one frame after the other."""

from __future__ import annotations

import time
from collections import defaultdict

import numpy as np
import pytest

from matchlake.operators import assignment, fusion


def frames_of(g, n, rows, columns, whole):
    out = {}
    for k in range(n):
        cells = {(int(a), int(b)) for a, b in zip(g.integers(0, rows, rows * 2), g.integers(0, columns, rows * 2))}
        out[k] = {(d * 3, i * 5 - 7): None if g.random() < 0.1 else float(g.integers(-1, 11)) / 10 if whole else float(g.random()) for d, i in cells}
    return out


def one_by_one(scores, margin):
    rows, columns = (sorted({k[i] for k in scores}) for i in (0, 1))
    matrix = np.full((len(rows), len(columns)), np.nan)
    for (d, i), s in scores.items():
        matrix[rows.index(d), columns.index(i)] = np.nan if s is None else s
    return {(rows[r], columns[c], float(matrix[r, c])) for r, c in assignment.sure_pairs(matrix, margin)}


@pytest.mark.parametrize(("rows", "columns", "whole"), [(7, 3, True), (3, 7, False), (6, 6, False), (12, 12, False), (1, 4, True)])
def test_sure_pairs_of_many_frames(spark, monkeypatch, rows, columns, whole):
    monkeypatch.setattr(assignment, "CELLS", 500)
    found = frames_of(np.random.default_rng(rows), 150, rows, columns, whole)
    table = [("j" if k % 2 else None, k, d, i, s) for k, f in found.items() for (d, i), s in f.items()]
    df = spark.createDataFrame(table, "job_id string, frame long, detection int, identity int, score double").repartition(3)
    got = defaultdict(set)
    for r in assignment.resolve(df).collect():
        assert r.job_id == ("j" if r.frame % 2 else None)
        got[r.frame].add((r.detection, r.identity, r.score))
    for k, f in found.items():
        assert got[k] == one_by_one(f, assignment.SURE_MARGIN)


def test_sure_pairs_of_forty_thousand_frames_take_seconds(spark):
    """One by one, a frame takes about a millisecond of a core."""
    g = np.random.default_rng(1)
    scores = g.integers(1, 11, (40_000, 6, 3)) / 10
    began = time.process_time()
    f, r, c = assignment._sure_of_many(scores, assignment.SURE_MARGIN)
    assert time.process_time() - began < 8
    for k in range(0, 40_000, 2000):
        assert {(a, b) for a, b in zip(r[f == k].tolist(), c[f == k].tolist())} == set(assignment.sure_pairs(scores[k]))


def fused_one_by_one(boxes, weight, least):
    """``(cluster, x, sources, agreement)`` of one frame."""
    found = []
    for c, s, *b in sorted(boxes, key=lambda r: (-r[0], *r[1:])):
        home = next((m for m in found if all(o[0] != s for o in m) and max(fusion.overlap(o[1], b) for o in m) >= least), None)
        found.append([(s, b, c)]) if home is None else home.append((s, b, c))
    total = sum(weight.get(s, 1.0) for s in {b[1] for b in boxes})
    out = []
    for k, m in enumerate(found):
        v = [weight.get(s, 1.0) * max(1e-6, c) for s, _, c in m]
        pairs = [fusion.overlap(a[1], b[1]) for i, a in enumerate(m) for b in m[i + 1 :]]
        out.append((k, sum(b[0] * w for (_, b, _), w in zip(m, v)) / sum(v), sorted(s for s, _, _ in m), min(1.0, sum(weight.get(s, 1.0) for s, _, _ in m) / total), sum(pairs) / len(pairs) if pairs else 0.0))
    return out


def test_fused_frames_equal_one_by_one(spark):
    g = np.random.default_rng(8)
    frames = {f"f{k}": [(float(g.integers(1, 9)) / 8, "abcd"[g.integers(0, 4)], *(g.random(2) * (0.3 if k % 2 else 1.0)).tolist(), *g.choice([0.2, 0.3, 0.0], 2, p=[0.6, 0.35, 0.05]).tolist()) for _ in range(int(g.integers(1, 40 if k % 10 == 0 else 8)))] for k in range(120)}
    rows = [(f, *b) for f, boxes in frames.items() for b in boxes]
    df = spark.createDataFrame(rows, "frame_id string, confidence double, source string, x double, y double, w double, h double").repartition(3)
    backed, count = defaultdict(int), defaultdict(int)
    for boxes in frames.values():
        for _, s, *b in boxes:
            count[s] += 1
            backed[s] += any(o[1] != s and fusion.overlap(o[2:], b) >= fusion.FUSE_IOU for o in boxes)
    rate = {s: max(fusion.LEAST_WEIGHT, backed[s] / count[s]) for s in count}
    want = {s: r / (sum(rate.values()) / len(rate)) for s, r in rate.items()}
    weights = fusion.source_weights(df)
    assert {r.source: pytest.approx(r.weight) for r in weights.collect()} == want
    got = defaultdict(list)
    for r in fusion.fuse(df, weights).collect():
        got[r.frame_id].append((r.cluster, r.x, r.supporting_sources, r.agreement, r.tightness))
    for f, boxes in frames.items():
        for a, b in zip(sorted(got[f]), fused_one_by_one(boxes, want, fusion.FUSE_IOU), strict=True):
            assert (a[0], a[2]) == (b[0], b[2]) and a[1] == pytest.approx(b[1], abs=2e-6) and a[3:] == pytest.approx(b[3:], abs=1e-4)


def test_a_hundred_thousand_frames_are_fused_in_seconds():
    """Row by row, a box takes some ten microseconds and a frame some forty."""
    import pyarrow as pa

    g, n = np.random.default_rng(2), 400_000
    sides = [g.random(n), g.random(n), np.full(n, 0.2), np.full(n, 0.2), g.random(n), np.ones(n), np.full(n, np.nan)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.where(g.random(n) < 0.5, "a", "b")), *map(pa.array, sides)], names=["source", "x", "y", "w", "h", "confidence", "weight", "total"])
    began = time.process_time()
    frame, _ = fusion._fused(batch, np.arange(0, n, 4), fusion.FUSE_IOU)
    assert time.process_time() - began < 4 and len(np.unique(frame)) == n // 4
