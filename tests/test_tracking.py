"""Tracks of crowded frames, against every track met with every box."""

from __future__ import annotations

import time
from math import hypot

import numpy as np

from matchlake.operators.fusion import overlap
from matchlake.operators.tracking import LEAST_IOU, MISSES_TO_GAP, MOST_REACH, REACH_PER_S, BoxTracker, Track, predicted


class Plain(BoxTracker):
    """Every track against every box, all pairs in one list."""

    def frame(self, t, boxes):
        self._retire(t)
        options = []
        for i, k in enumerate(self.tracks):
            expected = predicted(k.recent, t)
            reach = min(REACH_PER_S * max(1e-6, t - k.recent[-1][0]), MOST_REACH)
            for j, b in enumerate(boxes):
                over = overlap(expected, b)
                away = hypot(*(expected[n] + expected[n + 2] / 2 - b[n] - b[n + 2] / 2 for n in (0, 1)))
                if over >= LEAST_IOU:
                    options.append((-over, i, j))
                elif away <= reach:
                    options.append((-LEAST_IOU * 0.5 * (1 - away / reach), i, j))
        of = {}
        for _, i, j in sorted(options):
            if i not in of.values() and j not in of:
                of[j] = i
        for i, k in enumerate(self.tracks):
            if i not in of.values():
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


def test_tracks_equal_all_pairs(monkeypatch):
    from matchlake.operators import tracking

    g = np.random.default_rng(11)
    for size, whole, most in ((0.1, False, 40), (0.3, True, 25), (0.02, False, 60), (0.1, True, 3)):
        monkeypatch.setattr(tracking, "PAIRS", 50 if most < 30 else 1_000_000)
        monkeypatch.setattr(tracking, "FEW", 0 if most < 50 else 150)
        new, old, t = BoxTracker(), Plain(), 0.0
        for _ in range(40):
            n = int(g.integers(0, most))
            place = g.integers(0, 10, (n, 2)) / 10 if whole else g.random((n, 2))
            sides = g.choice([size, size * 1.5, 0.0], (n, 2), p=[0.6, 0.35, 0.05])
            boxes = [tuple(r) for r in np.hstack([place, sides]).tolist()]
            t += float(g.choice([0.1, 0.25, 1.0, 3.0]))
            assert new.frame(t, boxes) == old.frame(t, boxes) and new.gaps == old.gaps
            assert [(k.id, k.recent, k.missed, k.gap) for k in new.tracks] == [(k.id, k.recent, k.missed, k.gap) for k in old.tracks]


def test_a_crowded_recording_ends():
    """Forty frames of two thousand boxes: 160 million pairs, some minutes if each is met."""
    g, tracker = np.random.default_rng(3), BoxTracker()
    place = g.random((2000, 2)) * 20
    began = time.process_time()
    for n in range(40):
        ids = tracker.frame(n / 10, [(x, y, 0.1, 0.1) for x, y in (place + n * 0.002).tolist()])
        assert len(set(ids)) == 2000
    assert time.process_time() - began < 30
