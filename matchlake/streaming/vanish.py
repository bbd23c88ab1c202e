"""What leaves without a word: tracks that end inside a region, told by timers in event time.

The batch forms are :func:`matchlake.operators.balls.vanished` and :func:`matchlake.operators.signals.paired_pulses`; on
replay the streams give the same rows. Both need Spark's RocksDB state store (:func:`with_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from matchlake.operators.balls import VANISH_S

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Seconds for which a port stands without evidence, ports of a job at most, and what makes two seeds one port.
PORT_S, PORTS, SAME_WAY, SAME_PLACE = 1.0, 24, 0.94, 3.0


def with_rocksdb(spark: SparkSession) -> None:
    """Keep state in RocksDB; operators with timers and several kinds of state need it."""
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Vanished(StatefulProcessor):
    """One track: rows that may still be overtaken, and the last one that cannot.

    Rows wait until the watermark passes them and are then taken in order; the track has vanished once the watermark is
    VANISH_S beyond its last row, or the next row is. State is what came within the allowed lateness, and one row.
    """

    def __init__(self, polygon: tuple[tuple[float, float], ...], after: float):
        self.polygon, self.after = polygon, round(after * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = "micros long, x double, y double, owner string"
        self.waiting, self.last = handle.getListState("waiting", row), handle.getValueState("last", row)

    def _inside(self, x: float, y: float) -> bool:
        ends = zip(self.polygon, (*self.polygon[1:], self.polygon[0]))
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in ends) % 2 == 1

    def _advance(self, key: tuple, rows: list[tuple], mark: int) -> Iterator[pd.DataFrame]:
        last, out = self.last.get() if self.last.exists() else None, []

        def ends() -> None:
            if self._inside(last[1], last[2]):
                out.append((*key, pd.Timestamp(last[0], unit="us"), last[3]))

        due = sorted(r for r in rows if r[0] <= mark)
        for row in due:
            if last is not None and row[0] - last[0] > self.after:
                ends()
            last = row
        later = [r for r in rows if r[0] > mark]
        if last is not None and mark - last[0] > self.after:
            ends()
            last = None
        self.waiting.put(later) if later else self.waiting.clear()
        self.last.update(last) if last is not None else self.last.clear()
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        times = [min(later)[0]] if later else []
        if last is not None:
            times.append(last[0] + self.after)
        if times:
            self.handle.registerTimer(max(min(times), mark) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["job_id", "track_id", "ts", "owner"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(r.ts.value // 1000, float(r.x), float(r.y), r.owner if isinstance(r.owner, str) else None) for pdf in rows for r in pdf.itertuples()]
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        yield from self._advance(key, held + new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        yield from self._advance(key, held, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def vanished(sightings: DataFrame, polygon: tuple[tuple[float, float], ...], after: float = VANISH_S, lateness: str = "2 seconds") -> DataFrame:
    """Stream ``(job_id, track_id, ts, x, y, owner)`` to ``(job_id, track_id, ts, owner)`` of the last sights of tracks that ended inside a polygon."""
    keyed = sightings.withWatermark("ts", lateness).groupBy("job_id", "track_id")
    return keyed.transformWithStateInPandas(_Vanished(polygon, after), "job_id string, track_id long, ts timestamp, owner string", "Append", "EventTime")


class _Ports(StatefulProcessor):
    """The launch ports of one job: at most PORTS, each gone PORT_S after its last evidence; of too many the oldest goes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ports = handle.getListState("ports", "port long, robot long, x double, y double, dx double, dy double, radius double, seen double")
        self.made = handle.getValueState("made", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ports = [tuple(p) for p in self.ports.get()] if self.ports.exists() else []
        made, out = self.made.get()[0] if self.made.exists() else 0, []
        for r in sorted((r for pdf in rows for r in pdf.itertuples()), key=lambda r: (r.ts, r.robot, r.x, r.y)):
            t = r.ts.timestamp()
            ports = [p for p in ports if t - p[7] <= PORT_S]
            same = lambda p: p[1] == r.robot and p[4] * r.dx + p[5] * r.dy >= SAME_WAY and ((p[2] - r.x) ** 2 + (p[3] - r.y) ** 2) ** 0.5 <= SAME_PLACE * max(p[6], r.radius)  # noqa: B023, E731
            i = next((i for i, p in enumerate(ports) if same(p)), None)
            if i is None:
                made += 1
                ports = [*ports, (made, r.robot, r.x, r.y, r.dx, r.dy, r.radius, t)][-PORTS:]
                port = made
            else:
                port = ports[i][0]
                ports[i] = (*ports[i][:7], t)
            out.append((*key, r.ts, r.robot, port, len(ports)))
        self.ports.put(ports)
        self.made.update((made,))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(int((max(p[7] for p in ports) + PORT_S) * 1000), timerValues.getCurrentWatermarkInMs()) + 1)
        yield pd.DataFrame(out, columns=["job_id", "ts", "robot", "port", "standing"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No port has evidence any more; only the number of ports ever made stays, so that none is given twice."""
        self.ports.clear()
        yield pd.DataFrame({"job_id": pd.Series(dtype=str), "ts": pd.Series(dtype="datetime64[us]"), "robot": pd.Series(dtype="int64"), "port": pd.Series(dtype="int64"), "standing": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def launch_ports(seeds: DataFrame, lateness: str = "2 seconds") -> DataFrame:
    """Stream ``(job_id, ts, robot, x, y, dx, dy, radius)`` of observed launches to ``(job_id, ts, robot, port, standing)``.

    A seed is evidence for the robot's standing port that points the same way (cosine SAME_WAY or more) and lies within
    SAME_PLACE radii, else it makes a port, whose place stays as first seen. Rows of a batch are taken in order of time.
    """
    keyed = seeds.withWatermark("ts", lateness).groupBy("job_id")
    return keyed.transformWithStateInPandas(_Ports(), "job_id string, ts timestamp, robot long, port long, standing long", "Append", "EventTime")
