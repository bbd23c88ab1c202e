"""Tracks from boxes of consecutive frames; state is what is alive in one recording."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from math import hypot
from statistics import median

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.operators.fusion import overlap
from matchlake.operators.ordered import fold

# Fixed values.
LEAST_IOU, REACH_PER_S, MOST_REACH, TTL_S, MISSES_TO_GAP = 0.3, 1.0, 0.30, 6.0, 2
#: Pairs of a track and a box that are measured at once.
PAIRS = 1_000_000
#: Pairs of a small frame, which cost less one by one than as arrays.
FEW = 150


def predicted(recent: list[tuple[float, tuple]], t: float) -> tuple:
    """Where a box ``x, y, w, h`` is expected at ``t``: moved on by the median velocity of its last four intervals."""
    (t1, box) = recent[-1]
    steps = [(b[0] - a[0], [(q - p) / (b[0] - a[0]) for p, q in zip(a[1][:2], b[1][:2])]) for a, b in zip(recent[-5:], recent[-4:]) if b[0] - a[0] > 1e-9]
    if not steps or t <= t1:
        return box
    return (*[box[i] + median(v[i] for _, v in steps) * (t - t1) for i in (0, 1)], *box[2:])


def _overlapping(expected: np.ndarray, boxes: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(-overlap, i, j)`` of the pairs that overlap by LEAST_IOU or more; only boxes that meet a track's stretch of x are measured."""
    order = np.argsort(boxes[:, 0], kind="stable")
    b = boxes[order]
    wide = b[:, 2].max()
    lo = np.searchsorted(b[:, 0], np.nextafter(expected[:, 0] - wide, -np.inf) - 1e-9 * (1 + wide), "left")
    n = np.maximum(0, np.searchsorted(b[:, 0], expected[:, 0] + expected[:, 2], "right") - lo)
    upto, found, first = np.cumsum(n), [], 0
    while first < len(n):
        end = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, "right")))
        m = n[first:end]
        i = np.repeat(np.arange(first, end), m)
        j = np.arange(len(i)) + np.repeat(lo[first:end] - (np.cumsum(m) - m), m)
        (ax, ay, aw, ah), (bx, by, bw, bh) = expected[i].T, b[j].T
        w = np.maximum(0.0, np.minimum(ax + aw, bx + bw) - np.maximum(ax, bx))
        h = np.maximum(0.0, np.minimum(ay + ah, by + bh) - np.maximum(ay, by))
        union = aw * ah + bw * bh - w * h
        over = np.divide(w * h, union, out=np.zeros(len(i)), where=union > 0)
        kept = over >= LEAST_IOU
        found.append((-over[kept], i[kept], order[j[kept]]))
        first = end
    return tuple(np.concatenate(c) for c in zip(*found))


def _within_reach(expected: np.ndarray, boxes: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(-strength, i, j)`` of the pairs whose centres are within a track's reach, the nearer for its reach the stronger."""
    found, step = [], max(1, PAIRS // len(boxes))
    for first in range(0, len(expected), step):
        a = expected[first : first + step]
        dx, dy = ((a[:, n] + a[:, n + 2] / 2)[:, None] - boxes[:, n] - boxes[:, n + 2] / 2 for n in (0, 1))
        i, j = np.nonzero(dx * dx + dy * dy <= (reach[first : first + step, None] * (1 + 1e-9)) ** 2)
        away, of = np.fromiter(map(hypot, dx[i, j].tolist(), dy[i, j].tolist()), float, len(i)), reach[first + i]
        kept = away <= of
        found.append((-LEAST_IOU * 0.5 * (1 - away[kept] / of[kept]), first + i[kept], j[kept]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _options(expected: list[tuple], boxes: list[tuple], reach: list[float]) -> Iterable[tuple[float, int, int]]:
    """Both kinds of pairs of a small frame."""
    for i, e in enumerate(expected):
        for j, b in enumerate(boxes):
            over = overlap(e, b)
            away = hypot(*(e[n] + e[n + 2] / 2 - b[n] - b[n + 2] / 2 for n in (0, 1)))
            if over >= LEAST_IOU:
                yield -over, i, j
            elif away <= reach[i]:
                yield -LEAST_IOU * 0.5 * (1 - away / reach[i]), i, j


def _taken(options: Iterable[tuple[float, int, int]]) -> dict[int, int]:
    """The track of each box, one to one; of ``(value, track, box)`` in order, those whose track and box are free are taken."""
    of: dict[int, int] = {}
    used = set()
    for _, i, j in options:
        if i not in used and j not in of:
            of[j] = i
            used.add(i)
    return of


@dataclass
class Track:
    """One robot's boxes: the recent ones, misses in a row, and the gap that is open."""

    id: int
    recent: list[tuple[float, tuple]]
    missed: int = 0
    gap: tuple[float, str] | None = None


@dataclass
class BoxTracker:
    """Boxes of a frame go to the tracks where they are expected; the strongest pairing first."""

    tracks: list[Track] = field(default_factory=list)
    made: int = 0
    gaps: list[tuple[int, float, float, str]] = field(default_factory=list)

    def cut(self, t: float) -> None:
        """A camera cut: nothing is matched, and every track has a gap until it is seen again."""
        self._retire(t)
        for k in self.tracks:
            k.gap = k.gap or (t, "shot_change")

    def _retire(self, t: float) -> None:
        self.tracks = [k for k in self.tracks if t - k.recent[-1][0] <= TTL_S]

    def _paired(self, t: float, boxes: list[tuple]) -> dict[int, int]:
        """The place of the track of each box that has one.

        Any overlap of LEAST_IOU is stronger than any nearness, so distances are measured only among the tracks and boxes
        that overlaps have left.
        """
        if not self.tracks or not boxes:
            return {}
        places = [predicted(k.recent, t) for k in self.tracks]
        reach = [min(REACH_PER_S * max(1e-6, t - k.recent[-1][0]), MOST_REACH) for k in self.tracks]
        if len(places) * len(boxes) <= FEW:
            return _taken(sorted(_options(places, boxes, reach)))
        expected, found, reach = np.array(places, float), np.array(boxes, float), np.array(reach)
        some, any_of = np.isfinite(expected).all(1), np.isfinite(found).all(1)
        of: dict[int, int] = {}
        for near in (_overlapping, _within_reach):
            rows, columns = np.flatnonzero(some), np.flatnonzero(any_of)
            if not len(rows) or not len(columns):
                break
            value, i, j = near(expected[rows], found[columns], reach[rows])
            i, j = rows[i], columns[j]
            order = np.lexsort((j, i, value))
            more = _taken(zip(value[order].tolist(), i[order].tolist(), j[order].tolist()))
            some[list(more.values())], any_of[list(more)] = False, False
            of |= more
        return of

    def frame(self, t: float, boxes: list[tuple]) -> list[int]:
        """The track of each box."""
        self._retire(t)
        of = self._paired(t, boxes)
        taken = set(of.values())
        for i, k in enumerate(self.tracks):
            if i in taken:
                continue
            k.missed += 1
            if k.missed >= MISSES_TO_GAP:
                k.gap = k.gap or (k.recent[-1][0], "detection_lost")
        out = []
        for j, b in enumerate(boxes):
            if j in of:
                k = self.tracks[of[j]]
                if k.gap and t > k.gap[0]:
                    self.gaps.append((k.id, k.gap[0], t, k.gap[1]))
                k.gap, k.missed, k.recent = None, 0, [*k.recent[-4:], (t, b)]
            else:
                self.made += 1
                self.tracks.append(k := Track(self.made, [(t, b)]))
            out.append(k.id)
        return out


class _Boxes:
    """Rows of one recording in order of time, frame by frame."""

    def __init__(self) -> None:
        self.tracker, self.t, self.rows = BoxTracker(), None, []

    def _frame(self) -> Iterable[tuple]:
        if self.t is None:
            return
        if any(r[-1] for r in self.rows):
            self.tracker.cut(self.t)
            return
        boxes = [r[:4] for r in self.rows if r[0] is not None]
        ids = self.tracker.frame(self.t, boxes)
        yield from (("box", k, self.t, None, *b, None) for k, b in zip(ids, boxes))
        yield from (("gap", k, start, end, None, None, None, None, reason) for k, start, end, reason in self.tracker.gaps)
        self.tracker.gaps = []

    def row(self, t, x, y, w, h, cut) -> Iterable[tuple]:
        if t != self.t:
            yield from self._frame()
            self.t, self.rows = t, []
        self.rows.append((x, y, w, h, cut))

    def close(self) -> Iterable[tuple]:
        return self._frame()


def track_boxes(boxes: DataFrame) -> DataFrame:
    """``job_id, kind, track, t, end, x, y, w, h, reason``: a row of kind ``box`` for each box, and of kind ``gap`` for each hole of a track that was seen again.

    ``boxes (job_id, t, x, y, w, h)`` with an optional ``cut``, true on the rows of a frame that follows a camera cut
    and is not used. A frame without boxes is a row without a place. A gap begins at the last sight after two frames
    without one (``detection_lost``) or at a cut (``shot_change``); a track unseen for TTL_S ends where it was last seen.
    """
    b = boxes if "cut" in boxes.columns else boxes.withColumn("cut", F.lit(False))
    rows = b.select("job_id", F.col("t").cast("double"), *[F.col(c).cast("double") for c in "xywh"], F.coalesce("cut", F.lit(False)).alias("cut")).where("t is not null")
    kind = "kind string, track int, t double, end double, x double, y double, w double, h double, reason string"
    return fold(rows, ["job_id"], ["t", "x", "y", "w", "h"], ["t", "x", "y", "w", "h", "cut"], _Boxes, kind)
