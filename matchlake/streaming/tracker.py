"""Stateful stream operators, keyed by job: box tracking and goal-gate counting.

State is what is alive: a few tracks or balls of one job. It ends with event time: what was not seen for the time to
live is retired, and a job without rows times out. Of a job that timed out the number of tracks made stays, one number a
job, so that ids go on where they ended when it is seen again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchlake.operators.tracking import TTL_S, BoxTracker, Track

ARM_S = 0.30
COLUMNS = ["job_id", "ts", "x", "y", "w", "h", "track", "kind", "since", "reason"]


def _kept(tracker: BoxTracker) -> dict:
    return {"made": tracker.made, "tracks": [[k.id, k.recent, k.missed, k.gap] for k in tracker.tracks]}


def _again(state: dict) -> BoxTracker:
    return BoxTracker([Track(i, [(t, tuple(b)) for t, b in recent], missed, tuple(gap) if gap else None) for i, recent, missed, gap in state["tracks"]], state["made"])


def track_boxes(boxes: DataFrame, lateness: str = "5 seconds") -> DataFrame:
    """Stream ``(job_id, ts, x, y, w, h)`` to rows of kind ``box``, the same with ``track``, and of kind ``gap``.

    Boxes go to the tracks where they are expected, as in :func:`matchlake.operators.tracking.track_boxes`; rows of a batch
    are taken in order of time. A gap is given out when its track is seen again: ``ts`` is then, ``since`` its last sight
    before, and ``reason`` why. A row older than the last one tracked of its job gets no track (null): the tracker cannot
    go back.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"last": None, "made": 0, "tracks": []}
        if state.hasTimedOut:
            state.update((json.dumps({"last": kept["last"], "made": kept["made"], "tracks": []}),))
            return
        last, tracker = kept["last"], _again(kept)
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        for ts, group in rows.groupby("ts", sort=True):
            t, ids = ts.timestamp(), [None] * len(group)
            if last is None or t > last:
                ids, last = tracker.frame(t, list(group[["x", "y", "w", "h"]].itertuples(index=False, name=None))), t
            yield group.assign(job_id=key[0], track=pd.array(ids, dtype="Int32"), kind="box", since=pd.Series(pd.NaT, index=group.index, dtype="datetime64[us]"), reason=None)[COLUMNS]
            if tracker.gaps:
                found = pd.DataFrame([(key[0], ts, k, "gap", pd.Timestamp(round(since * 1_000_000), unit="us"), why) for k, since, _, why in tracker.gaps], columns=["job_id", "ts", "track", "kind", "since", "reason"])
                yield found.assign(x=float("nan"), y=float("nan"), w=float("nan"), h=float("nan"))[COLUMNS]
                tracker.gaps = []
        state.update((json.dumps({"last": last, **_kept(tracker)}),))
        state.setTimeoutTimestamp(int((last + TTL_S) * 1000) + max(0, state.getCurrentWatermarkMs() - int(last * 1000)) + 1)

    keyed = boxes.withWatermark("ts", lateness).groupBy("job_id")
    kind = "job_id string, ts timestamp, x double, y double, w double, h double, track int, kind string, since timestamp, reason string"
    return keyed.applyInPandasWithState(step, kind, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def count_entries(signs: DataFrame, lateness: str = "5 seconds") -> DataFrame:
    """Stream ``(job_id, ts, ball, region, depth)`` to confirmed goal entries.

    ``depth`` is a ball's distance outside a region, below 0 inside. A ball outside arms; the first row inside within
    ARM_S crosses; a further row within ARM_S that lies deeper confirms one entry at the crossing. A ball that moves back
    out before that, or anything slower, starts anew, so a ball that only touches the region is none.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        phase, at, crossed, deep = state.get if state.exists else ("idle", 0.0, 0.0, 0.0)
        out = []
        for r in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples():
            t = r.ts.timestamp()
            fresh = t - at <= ARM_S
            if r.depth > 0:
                phase, at = "armed", t
            elif phase == "armed" and fresh:
                phase, at, crossed, deep = "crossed", t, t, r.depth
            elif phase == "crossed" and fresh and r.depth > deep:
                phase = "idle"
            elif phase == "crossed" and fresh and r.depth < deep:
                out.append((*key, pd.Timestamp(round(crossed * 1_000_000), unit="us")))
                phase, at = "done", t
            elif not fresh:
                phase = "idle"
        state.update((phase, at, crossed, deep))
        state.setTimeoutTimestamp(max(int((at + ARM_S) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["job_id", "ball", "region", "ts"])

    keyed = signs.withWatermark("ts", lateness).groupBy("job_id", "ball", "region")
    return keyed.applyInPandasWithState(step, "job_id string, ball int, region string, ts timestamp", "phase string, at double, crossed double, deep double", "append", GroupStateTimeout.EventTimeTimeout)
