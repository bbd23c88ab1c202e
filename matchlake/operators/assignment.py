"""One-to-one assignment inside one frame or chain: exact, with the choice to leave a row or column alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.operators.ordered import fold_whole

#: Fixed value: what the best total must lose without a pair for the pair to count as sure.
SURE_MARGIN = 0.08


def cheapest(costs: np.ndarray, alone: float) -> list[tuple[int, int]]:
    """``(row, column)`` pairs of least summed cost, where a row may stay alone for ``alone``; infinite costs never pair.

    Shortest augmenting paths over the columns and one private column for each row.
    """
    rows, columns = costs.shape
    if not rows:
        return []
    wide = np.full((rows, columns + rows), np.inf)
    wide[:, :columns] = costs
    wide[np.arange(rows), columns + np.arange(rows)] = alone
    n = wide.shape[1]
    u, v, owner = np.zeros(rows), np.zeros(n), np.full(n, -1)
    for row in range(rows):
        least, before, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, dtype=bool)
        at, column = row, -1
        while True:
            slack = wide[at] - u[at] - v
            better = ~done & (slack < least)
            least[better], before[better] = slack[better], column
            open_ = np.where(done, np.inf, least)
            step_to = int(np.argmin(open_))
            delta = open_[step_to]
            u[row] += delta
            u[owner[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            done[step_to], column = True, step_to
            if owner[step_to] < 0:
                break
            at = owner[step_to]
        while column >= 0:
            back = before[column]
            owner[column] = owner[back] if back >= 0 else row
            column = back
    return sorted((int(r), c) for c, r in enumerate(owner[:columns]) if r >= 0 and np.isfinite(costs[r, c]))


def best(scores: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """Greatest summed score of pairs, none forced; NaN never pairs."""
    gain = np.where(np.isnan(scores), np.inf, -scores)
    pairs = [(r, c) for r, c in cheapest(gain, 0.0) if scores[r, c] > 0]
    return float(sum(scores[r, c] for r, c in pairs)), pairs


def sure_pairs(scores: np.ndarray, margin: float = SURE_MARGIN) -> list[tuple[int, int]]:
    """Pairs of the best assignment without which the best total falls by ``margin`` or more."""
    total, pairs = best(scores)
    out = []
    for r, c in pairs:
        other = scores.copy()
        other[r, c] = np.nan
        if total - best(other)[0] + 1e-12 >= margin:
            out.append((r, c))
    return out


#: Frames whose smaller side is larger are solved one by one; the others many at once, over all subsets of that side.
FEW = 8
#: Cells of an array over many frames.
CELLS = 4_000_000


def _best_totals(gains: np.ndarray, steps: list[np.ndarray] | None = None) -> np.ndarray:
    """Greatest summed gain of each frame of ``gains (frame, row, column)``, over all subsets of the columns, row by row."""
    n, rows, columns = gains.shape
    best_of = np.zeros((n, 1 << columns))
    for r in range(rows):
        if steps is not None:
            steps.append(best_of)
        more = best_of.copy()
        for c in range(columns):
            having = [m for m in range(1 << columns) if m >> c & 1]
            more[:, having] = np.maximum(more[:, having], best_of[:, [m ^ 1 << c for m in having]] + gains[:, r, c, None])
        best_of = more
    if steps is not None:
        steps.append(best_of)
    return best_of[:, -1]


def _sure_of_many(gains: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(frame, row, column)`` of the pairs that :func:`sure_pairs` gives for each frame; a gain of 0 is no pair."""
    n, rows, columns = gains.shape
    steps: list[np.ndarray] = []
    total, at, every = _best_totals(gains, steps), np.full(n, (1 << columns) - 1), np.arange(n)
    chosen = np.full((n, columns), -1)
    for r in range(rows - 1, -1, -1):
        now, free = steps[r + 1][every, at], steps[r][every, at] != steps[r + 1][every, at]
        for c in range(columns):
            took = free & (at >> c & 1 == 1) & (steps[r][every, at & ~(1 << c)] + gains[:, r, c] == now)
            chosen[took, c], free = r, free & ~took
            at = np.where(took, at & ~(1 << c), at)
    found = []
    for c in range(columns):
        of = np.flatnonzero(chosen[:, c] >= 0)
        other = gains[of].copy()
        other[np.arange(len(of)), chosen[of, c], c] = 0.0
        sure = of[total[of] - _best_totals(other) + 1e-12 >= margin]
        found.append((sure, chosen[sure, c], np.full(len(sure), c)))
    return tuple(np.concatenate(f) for f in zip(*found))


def _ranks(of: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of each value among its frame's distinct ones; their number by frame, and the values, frame after frame."""
    order = np.lexsort((values, of))
    o, v = of[order], values[order]
    first = np.concatenate([[True], o[1:] != o[:-1]])
    new = first | np.concatenate([[True], v[1:] != v[:-1]])
    upto = np.cumsum(new) - 1
    rank = np.empty(len(of), np.int64)
    rank[order] = upto - upto[np.flatnonzero(first)][o]
    return rank, np.bincount(o[new]), v[new]


def _resolved(batch: pa.RecordBatch, starts: np.ndarray, margin: float) -> tuple[np.ndarray, list]:
    """Sure pairs of many frames: those of one smaller side together."""
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
    detection, identity = batch["detection"].to_numpy(zero_copy_only=False), batch["identity"].to_numpy(zero_copy_only=False)
    score = batch["score"].to_numpy(zero_copy_only=False)
    (d, nd, named), (i, ni, given) = _ranks(of, detection), _ranks(of, identity)
    at_d, at_i = np.cumsum(nd) - nd, np.cumsum(ni) - ni
    small, long = np.minimum(nd, ni), np.maximum(nd, ni)
    turned = nd < ni
    row, column = np.where(turned[of], i, d), np.where(turned[of], d, i)
    found = []
    for side in np.unique(small).tolist():
        frames = np.flatnonzero(small == side)
        frames = frames[np.argsort(long[frames], kind="stable")]
        while len(frames):
            cells = np.arange(1, len(frames) + 1) * (long[frames] + 1) * (1 << min(side, FEW))
            many = frames[: max(1, int(np.searchsorted(cells, CELLS, "right")))] if side <= FEW else frames[:1]
            frames = frames[len(many) :]
            place = np.full(len(starts), -1)
            place[many] = np.arange(len(many))
            mine = np.flatnonzero(place[of] >= 0)
            scores = np.full((len(many), int(long[many].max()), side), np.nan)
            scores[place[of[mine]], row[mine], column[mine]] = score[mine]
            if side <= FEW:
                f, r, c = _sure_of_many(np.where(scores > 0, scores, 0.0), margin)
            else:
                flat = scores[0].T if turned[many[0]] else scores[0]
                pairs = np.array(sure_pairs(flat, margin), np.int64).reshape(-1, 2)
                f, (r, c) = np.zeros(len(pairs), np.int64), (pairs[:, ::-1] if turned[many[0]] else pairs).T
            g = many[f]
            found.append((g, named[at_d[g] + np.where(turned[g], c, r)], given[at_i[g] + np.where(turned[g], r, c)], scores[f, r, c]))
    g, *columns = (np.concatenate(c) for c in zip(*found))
    return g, columns


def resolve(scores: DataFrame, margin: float = SURE_MARGIN) -> DataFrame:
    """``job_id, frame, detection, identity, score``: detections given to identities, one to one and only where it is sure.

    ``scores (job_id, frame, detection, identity, score)`` lists the pairs that may be, null for those that may not.
    Detections whose best assignment is as good without them stay unnamed rather than wrongly named.
    """
    s = scores.select("job_id", "frame", F.col("detection").cast("long"), F.col("identity").cast("long"), F.col("score").cast("double"))
    return fold_whole(s, ["job_id", "frame"], ["detection", "identity"], ["detection", "identity", "score"], lambda rows, starts: _resolved(rows, starts, margin), "detection long, identity long, score double")
