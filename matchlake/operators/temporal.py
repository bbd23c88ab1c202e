"""Sequence operators over ordered facts: differences, islands, sessions, pairs, as-of and band joins, resampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Into how many blocks those who meet are dealt, at least, and the most rows meant for one.
BLOCKS, BLOCK_ROWS = 6, 8_000_000


def _w(keys: Sequence[str], order: Sequence[str | Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def differences(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str] = (), name: str = "gap") -> DataFrame:
    """Time since the row before of the same key; null for the first."""
    return df.withColumn(name, F.col(time) - F.lag(time).over(_w(keys, [time, *tie])))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Column, name: str = "island") -> DataFrame:
    """Number runs of rows; ``breaks`` tells, with null as true, that a row starts a new one."""
    return df.withColumn(name, F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(_w(keys, order)))


def sessions(df: DataFrame, keys: Sequence[str], time: str, gap: float, tie: Sequence[str] = (), name: str = "session") -> DataFrame:
    """Number sessions: a row joins the one before if it follows within ``gap``, the gap itself included."""
    since = F.col(time) - F.lag(time).over(_w(keys, [time, *tie]))
    return islands(df.withColumn("_since", since), keys, [time, *tie], F.col("_since") > gap, name).drop("_since")


def paired_intervals(df: DataFrame, keys: Sequence[str], time: str, starts: Column, ends: Column, close_at: Column, tie: Sequence[str] = ()) -> DataFrame:
    """``start, end`` of intervals: a start while one is open is passed over, as is an end while none is; an open one closes at ``close_at``.

    Of start and end rows in order, a row counts iff it differs in kind from the one before (a first end does not
    count); what is left alternates, so the next row ends an interval.
    """
    kind = F.when(starts, 1).when(ends, 0)
    w = _w(keys, [time, *tie])
    marks = df.withColumn("_kind", kind).where("_kind is not null").withColumn("_before", F.coalesce(F.lag("_kind").over(w), F.lit(0)))
    turns = marks.where("_kind <> _before")
    closed = turns.withColumn("_next", F.lead(time).over(w)).where("_kind = 1")
    end = F.coalesce(F.col("_next"), close_at)
    return closed.select(*keys, F.col(time).alias("start"), end.alias("end"), F.greatest(F.lit(0.0), end - F.col(time)).alias("seconds"))


def _neighbours(left: DataFrame, right: DataFrame, keys: Sequence[str], width: float, at: str, value: str) -> DataFrame:
    """``left`` with ``_back`` and ``_ahead``, the ``value`` of the last right row up to ``at`` and of the first after it.

    Only right rows within ``width`` need be found: time is cut into bins of that width, and a bin also holds the last
    row of the bin before and the first of the bin after. So one key's rows fall in many tasks, each row is sorted
    with its bin alone, and both windows look back only. ``right`` has ``keys, at, value``, one row a key and time.
    """
    if not width > 0 or width == float("inf"):
        bin_of = F.lit(0).cast("long")
    else:
        bin_of = F.floor(F.col(at) / width).cast("long")
    rights = right.select(*keys, F.col(at), F.col(value), bin_of.alias("_bin"))
    edges = rights.groupBy(*keys, "_bin").agg(F.min_by(F.struct(at, value), at).alias("_lo"), F.max_by(F.struct(at, value), at).alias("_hi"))
    moved = F.explode(F.array(F.struct((F.col("_bin") + 1).alias("b"), F.col("_hi").alias("r")), F.struct((F.col("_bin") - 1).alias("b"), F.col("_lo").alias("r"))))
    moved = edges.select(*keys, moved.alias("m")).select(*keys, F.col(f"m.r.{at}").alias(at), F.col(f"m.r.{value}").alias(value), F.col("m.b").alias("_bin"))
    every = rights if not width > 0 or width == float("inf") else rights.unionByName(moved)
    both = left.withColumn("_bin", bin_of).withColumn("_side", F.lit(1)).unionByName(every.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    up, down = _w([*keys, "_bin"], [at, "_side"]), _w([*keys, "_bin"], [F.desc(at), F.desc("_side")])
    so_far = lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_back", so_far(up)).withColumn("_ahead", so_far(down)).where("_side = 1").drop("_side", "_bin", value)


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, tolerance: float, values: Sequence[str], tie: str) -> DataFrame:
    """Each left row with ``values`` of the nearest right row within ``tolerance``, the earlier one on a tie, else nulls.

    No pair is formed; see :func:`_neighbours`. ``tie`` orders right rows of one time, the first counts.
    """
    value = F.struct(F.col(right_time).cast("double").alias("t"), *[F.col(v) for v in values])
    rights = right.groupBy(*keys, F.col(right_time).alias("_t")).agg(F.min_by(value, F.col(tie)).alias("_v"))
    seen = _neighbours(left.withColumn("_t", F.col(left_time)), rights, keys, tolerance, "_t", "_v")
    gap_back, gap_ahead = F.col("_t") - F.col("_back.t"), F.col("_ahead.t") - F.col("_t")
    pick = F.when(F.col("_ahead").isNull() | (gap_back <= gap_ahead), F.col("_back")).otherwise(F.col("_ahead"))
    near = seen.withColumn("_pick", pick).withColumn("_ok", F.abs(F.col("_pick.t") - F.col("_t")) <= tolerance)
    return near.select(*left.columns, F.when(F.col("_ok"), F.col("_pick.t")).alias("near_t"), *[F.when(F.col("_ok"), F.col(f"_pick.{v}")).alias(f"near_{v}") for v in values])


def asof_next(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, tolerance: float) -> DataFrame:
    """Left rows with ``right_time``, the first right time at or after their own and within ``tolerance``; others are left out."""
    rights = right.select(*keys, F.col(right_time).alias("_t"), F.struct(F.col(right_time).alias("t")).alias("_v"))
    seen = _neighbours(left.withColumn("_t", F.col(left_time)), rights, keys, tolerance, "_t", "_v")
    first = F.when(F.col("_back.t") == F.col("_t"), F.col("_back.t")).otherwise(F.col("_ahead.t"))
    return seen.withColumn(right_time, first).where(F.col(right_time) - F.col("_t") <= tolerance).select(*left.columns, right_time)


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, width: float) -> DataFrame:
    """Pairs of a key whose times differ by ``width`` or less, found by an equi-join on time bins of that width.

    Right rows are listed in their own bin and both neighbours, so each pair meets in exactly one bin.
    """
    a = left.withColumn("_bin", F.floor(F.col(left_time) / width))
    b = right.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(right_time) / width) - 1, F.floor(F.col(right_time) / width) + 1)))
    return a.join(b, [*keys, "_bin"]).where(F.abs(F.col(left_time) - F.col(right_time)) <= width).drop("_bin")


def meetings(df: DataFrame, keys: Sequence[str], who: str, time: str, width: float) -> DataFrame:
    """``who, meetings, others``: how many rows of others lie within ``width`` of someone's own at the same keys, and of how many others.

    No pair leaves the task that counts it. Both sides are dealt into blocks by ``who``, and a task for each pair of
    blocks marks whom of the second block each one of the first meets: second blocks have nobody in common, so their
    counts add up. A task holds its second block's rows, the first's pass through it one by one. Rows are shuffled twice
    for each block; there are more blocks than BLOCKS only if one would hold over BLOCK_ROWS.
    """
    rows = df.select(*keys, who, F.col(time).cast("double").alias("_t")).where(F.abs("_t") < float("inf")).na.drop()
    blocks = max(BLOCKS, -(-rows.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64(who), F.lit(blocks)).cast("int")
    every = rows.withColumn("_every", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asks = every.withColumn("_cell", block * blocks + F.col("_every")).withColumn("_asks", F.col(who))
    met = every.withColumn("_cell", F.col("_every") * blocks + block).withColumn("_asks", F.lit(None).cast(rows.schema[who].dataType))
    dealt = asks.unionByName(met).drop("_every").repartitionById(blocks * blocks, "_cell").sortWithinPartitions(F.asc_nulls_first("_asks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            state = state or _Meetings(keys, who, width, batch.schema.field(who).type)
            cells = batch["_cell"].to_numpy()
            cell = int(cells[0]) if cell is None else cell
            if (cells != cell).any():
                raise ValueError("a task has rows of two pairs of blocks")
            state.meet(batch.slice(0, batch["_asks"].null_count))
            yield from state.ask(batch.slice(batch["_asks"].null_count))
        if state is not None:
            yield state.close()

    counted = dealt.mapInArrow(run, f"{who} {dict(df.dtypes)[who]}, meetings long, others long")
    return counted.groupBy(who).agg(F.sum("meetings").alias("meetings"), F.sum("others").alias("others")).where("meetings > 0")


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """``(first, end)`` of the runs of equal values."""
    ends = np.concatenate([np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
    return list(zip([0, *ends[:-1]], ends)) if len(values) else []


class _Meetings:
    """One pair of blocks: rows that may be met, all of them first, then rows that ask, in order of ``who``."""

    PAIRS, MARKS = 2_000_000, 16_000_000

    def __init__(self, keys: Sequence[str], who: str, width: float, kind: pa.DataType):
        self.keys, self.who, self.width, self.kind = keys, who, width, kind
        self.parts, self.key_codes, self.people, self.at = [], {}, {}, None
        self.last, self.count, self.marks = None, 0, None

    def _keyed(self, rows: pa.RecordBatch) -> np.ndarray:
        """A number for each row's keys."""
        codes, size = np.zeros(rows.num_rows, np.int64), 1
        sides = [rows[k].dictionary_encode() for k in self.keys]
        for s in sides:
            codes, size = codes * max(1, len(s.dictionary)) + s.indices.to_numpy(zero_copy_only=False), size * max(1, len(s.dictionary))
        found, at = np.unique(codes, return_inverse=True)
        names = []
        for code in found.tolist():
            name = []
            for s in reversed(sides):
                code, i = divmod(code, len(s.dictionary))
                name.append(s.dictionary[i].as_py())
            names.append(self.key_codes.setdefault(tuple(name), len(self.key_codes)))
        return np.array(names, np.int32)[at]

    def meet(self, rows: pa.RecordBatch) -> None:
        if rows.num_rows:
            self.parts.append((self._keyed(rows), rows["_t"].to_numpy(), rows[self.who]))

    def _ready(self) -> None:
        """Rows that may be met by keys and time; the places of each key's distinct times."""
        key = np.concatenate([p[0] for p in self.parts] or [np.zeros(0, np.int32)])
        t = np.concatenate([p[1] for p in self.parts] or [np.zeros(0)])
        order = np.lexsort((t, key))
        people = pa.chunked_array([p[2] for p in self.parts]).combine_chunks().dictionary_encode() if self.parts else None
        self.people = {} if people is None else {p: i for i, p in enumerate(people.dictionary.to_pylist())}
        self.met = np.zeros(0, np.int32) if people is None else people.indices.to_numpy(zero_copy_only=False).astype(np.int32)[order]
        key, t, self.parts = key[order], t[order], []
        self.at = {}
        for lo, hi in _runs(key):
            times, starts = np.unique(t[lo:hi], return_index=True)
            self.at[int(key[lo])] = times, np.append(starts, hi - lo) + lo

    def _window(self, times: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first time within the width of each ``t`` and of the first after it, by the difference itself."""
        n, out = len(times), []
        for at, sign in ((np.searchsorted(times, t - self.width, "left"), 1), (np.searchsorted(times, t + self.width, "right"), -1)):
            out_of = lambda i: np.abs(t - times[np.clip(i, 0, n - 1)]) > self.width  # noqa: B023, E731
            while True:
                more = (at < n) & (times[np.minimum(at, n - 1)] < t) & out_of(at) if sign > 0 else (at < n) & ~out_of(at)
                less = (at > 0) & ~out_of(at - 1) if sign > 0 else (at > 0) & (times[np.maximum(at - 1, 0)] > t) & out_of(at - 1)
                if not (more.any() or less.any()):
                    break
                at = at + more - less
            out.append(at)
        return out[0], out[1]

    def ask(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        if self.at is None:
            self._ready()
        key, t = self._keyed(rows), rows["_t"].to_numpy()
        lo, n = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        order = np.argsort(key, kind="stable")
        for a, b in _runs(key[order]):
            if (of := self.at.get(int(key[order[a]]))) is not None:
                mine = order[a:b]
                first, end = self._window(of[0], t[mine])
                lo[mine], n[mine] = of[1][first], of[1][end] - of[1][first]
        whose = rows[self.who].to_pylist()
        codes = rows[self.who].dictionary_encode().indices.to_numpy(zero_copy_only=False)
        pairs, begin = np.cumsum(n), 0
        while begin < len(t):
            end = max(begin + 1, int(np.searchsorted(pairs, (pairs[begin - 1] if begin else 0) + self.PAIRS, "right")))
            end = min(end, int(np.searchsorted(codes, codes[begin] + max(1, self.MARKS // max(1, len(self.people))))))
            yield from self._mark(whose[begin:end], codes[begin:end] - codes[begin], lo[begin:end], n[begin:end])
            begin = end

    def _mark(self, whose: list, of: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        width = len(self.people)
        marks = np.zeros((int(of[-1]) + 1, width), bool)
        upto = np.cumsum(n)
        at = np.arange(int(upto[-1])) + np.repeat(lo - (upto - n), n)
        marks.ravel()[np.repeat(of * width, n) + self.met[at]] = True
        counts = np.bincount(of, n, len(marks)).astype(np.int64)
        names = [whose[i] for i in np.flatnonzero(np.diff(of, prepend=-1))]
        own = np.array([self.people.get(p, -1) for p in names])
        if (own >= 0).any():
            asker = np.repeat(of, n)
            counts -= np.bincount(asker[self.met[at] == own[asker]], minlength=len(marks))
            marks[np.flatnonzero(own >= 0), own[own >= 0]] = False
        if self.marks is not None and self.last == names[0]:
            marks[0] |= self.marks
            counts[0] += self.count
        elif self.marks is not None:
            yield self.close()
        if len(names) > 1:
            yield self._made(names[:-1], counts[:-1], np.array([np.count_nonzero(m) for m in marks[:-1]], np.int64))
        self.last, self.count, self.marks = names[-1], int(counts[-1]), marks[-1].copy()

    def _made(self, names: list, counts: np.ndarray, others: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, self.kind), pa.array(counts, pa.int64()), pa.array(others, pa.int64())], names=[self.who, "meetings", "others"])

    def close(self) -> pa.RecordBatch:
        names = [] if self.marks is None else [self.last]
        return self._made(names, np.array([self.count] * len(names), np.int64), np.array([m.sum() for m in [self.marks] * len(names)], np.int64))


def resample(points: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], rate: float, bridge: float, gaps: DataFrame | None = None) -> DataFrame:
    """Points of each key on the grid of ``1 / rate``: exact hits, else linear between neighbours at most ``bridge`` apart.

    Grid instants between neighbours farther apart, or parted by a listed gap ``(keys, start, end)``, are left out.
    Grid places are whole numbers, so they do not drift.
    """
    w = _w(keys, [time])
    nxt = points.withColumn("_t2", F.lead(time).over(w))
    for v in values:
        nxt = nxt.withColumn(f"_{v}2", F.lead(v).over(w))
    first, last = F.ceil(F.col(time) * rate - 1e-9), F.floor(F.coalesce(F.col("_t2"), F.col(time)) * rate + 1e-9)
    seg = nxt.withColumn("_first", first).withColumn("_last", F.when(F.col("_t2").isNull(), last).otherwise(F.ceil(F.col("_t2") * rate - 1e-9) - 1)).where("_last >= _first")
    if gaps is not None:
        g = gaps.groupBy(*keys).agg(F.collect_list(F.struct("start", "end")).alias("_gaps"))
        seg = seg.join(g, list(keys), "left").withColumn("_cut", F.coalesce(F.exists("_gaps", lambda x: (x["start"] < F.col("_t2")) & (x["end"] > F.col(time))), F.lit(False))).drop("_gaps")
    else:
        seg = seg.withColumn("_cut", F.lit(False))
    grid = seg.withColumn("_k", F.explode(F.sequence("_first", "_last"))).withColumn("_at", F.bround(F.col("_k") / rate, 6))
    hit = F.abs(F.col("_at") - F.col(time)) < 1e-6
    ok = hit | ((F.col("_t2") - F.col(time) <= bridge) & ~F.col("_cut"))
    u = (F.col("_at") - F.col(time)) / (F.col("_t2") - F.col(time))
    out = [F.when(hit, F.col(v)).otherwise(F.col(v) + (F.col(f"_{v}2") - F.col(v)) * u).alias(v) for v in values]
    return grid.where(ok).select(*keys, F.col("_at").alias(time), *out)


def smooth_speed(samples: DataFrame, keys: Sequence[str], time: str, x: str, y: str, rate: float, smooth_s: float = 0.5) -> DataFrame:
    """Adds ``speed``: over runs of consecutive placed samples, the move of the centred mean across its window by the time across it."""
    step, half = 1.0 / rate, max(1, round(smooth_s * rate / 2))
    w = _w(keys, [time])
    broken = F.col(x).isNull() | F.lag(x).over(w).isNull() | (F.abs(F.col(time) - F.lag(time).over(w) - step) >= 1e-6)
    runs = islands(samples.withColumn("_broken", broken), keys, [time], F.col("_broken"), "_run")
    around = _w([*keys, "_run"], [time]).rowsBetween(-half, half)
    mean = runs.withColumn("_sx", F.avg(x).over(around)).withColumn("_sy", F.avg(y).over(around))
    moved = F.hypot(F.last("_sx").over(around) - F.first("_sx").over(around), F.last("_sy").over(around) - F.first("_sy").over(around))
    n = F.count(F.lit(1)).over(around)
    return mean.withColumn("speed", F.when(F.col(x).isNotNull() & (n > 1), F.bround(moved / ((n - 1) * step), 3))).drop("_broken", "_run", "_sx", "_sy")


def field_motion(boxes: DataFrame, keys: Sequence[str], fps: float, limit: float = 20.0) -> DataFrame:
    """Velocity of placed boxes from the placed box before, if it is at most ``max(1.5 / fps, 1 s)`` back and the speed is plausible."""
    w = _w(keys, ["t"])
    prev = {v: F.last(F.when(F.col("field_x").isNotNull(), F.col(v)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for v in ("t", "field_x", "field_y")}
    df = boxes.withColumn("_dt", F.col("t") - prev["t"]).withColumn("_dx", F.col("field_x") - prev["field_x"]).withColumn("_dy", F.col("field_y") - prev["field_y"])
    ok = (F.col("_dt") > 0) & (F.col("_dt") <= max(1.5 / fps, 1.0)) & (F.hypot("_dx", "_dy") / F.col("_dt") <= limit)
    value = lambda e: F.when(ok, e)
    return (
        df.withColumn("velocity_x_ftps", value(F.col("_dx") / F.col("_dt"))).withColumn("velocity_y_ftps", value(F.col("_dy") / F.col("_dt")))
        .withColumn("speed_ftps", value(F.hypot("_dx", "_dy") / F.col("_dt"))).withColumn("motion_heading_rad", value(F.atan2("_dy", "_dx"))).drop("_dt", "_dx", "_dy")
    )


def field_motion_between(boxes: DataFrame, keys: Sequence[str], gaps: DataFrame | None = None, limit: float = 20.0) -> DataFrame:
    """Velocity of placed boxes from the box just before, if that is placed too, no listed gap ``(keys, start, end)`` lies between them, and the speed is plausible."""
    w = _w(keys, ["t"])
    df = boxes.withColumn("_t0", F.lag("t").over(w)).withColumn("_x0", F.lag("field_x").over(w)).withColumn("_y0", F.lag("field_y").over(w))
    if gaps is None:
        df = df.withColumn("_cut", F.lit(False))
    else:
        g = gaps.groupBy(*keys).agg(F.collect_list(F.struct("start", "end")).alias("_gaps"))
        df = df.join(g, list(keys), "left").withColumn("_cut", F.coalesce(F.exists("_gaps", lambda k: (k["start"] >= F.col("_t0")) & (k["end"] <= F.col("t"))), F.lit(False))).drop("_gaps")
    dt, dx, dy = F.col("t") - F.col("_t0"), F.col("field_x") - F.col("_x0"), F.col("field_y") - F.col("_y0")
    ok = (dt > 0) & ~F.col("_cut") & (F.hypot(dx, dy) / dt <= limit)
    value = lambda e: F.when(ok, e)
    return (
        df.withColumn("velocity_x_ftps", value(dx / dt)).withColumn("velocity_y_ftps", value(dy / dt)).withColumn("speed_ftps", value(F.hypot(dx, dy) / dt))
        .withColumn("motion_heading_rad", value(F.atan2(dy, dx))).drop("_t0", "_x0", "_y0", "_cut")
    )


def gaps_of(boxes: DataFrame, keys: Sequence[str], fps: float, edge: float = 0.02) -> DataFrame:
    """Holes longer than 1.5 frames: ``out_of_frame`` if either side is near the frame's edge, else ``occlusion``."""
    near = F.least(F.col("x"), 1 - F.col("x") - F.col("w"), F.col("y"), 1 - F.col("y") - F.col("h")) <= edge
    w = _w(keys, ["t"])
    b = boxes.withColumn("_edge", near).withColumn("_t0", F.lag("t").over(w)).withColumn("_e0", F.lag("_edge").over(w)).where(F.col("t") - F.col("_t0") > 1.5 / fps)
    return b.select(*keys, F.col("_t0").alias("start"), F.col("t").alias("end"), F.when(F.col("_edge") | F.col("_e0"), "out_of_frame").otherwise("occlusion").alias("reason"))


def heading_hold(samples: DataFrame, keys: Sequence[str], time: str, least: float = 0.08) -> DataFrame:
    """Adds ``heading`` of travel, held while a move from the sample before is below ``least``, forgotten at an unplaced sample."""
    w = _w(keys, [time])
    runs = islands(samples, keys, [time], F.col("x").isNull() | F.lag("x").over(w).isNull(), "_run")
    r = _w([*keys, "_run"], [time])
    dx, dy = F.col("x") - F.lag("x").over(r), F.col("y") - F.lag("y").over(r)
    turned = runs.withColumn("_h", F.when(F.hypot(dx, dy) >= least, F.atan2(dy, dx)))
    return turned.withColumn("heading", F.coalesce(F.last("_h", ignorenulls=True).over(r), F.when(F.col("x").isNotNull(), 0.0))).drop("_run", "_h")


def running_total(df: DataFrame, keys: Sequence[str], time: str, value: Column, name: str = "total") -> DataFrame:
    """Total of all rows up to and at the same time."""
    return df.withColumn(name, F.sum(value).over(_w(keys, [time]).rangeBetween(Window.unboundedPreceding, 0)))


def moving_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int, name: str = "average") -> DataFrame:
    return df.withColumn(name, F.avg(value).over(_w(keys, order).rowsBetween(1 - n, 0)))


def interpolate_at(points: DataFrame, asked: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], bridge: float = 0.10) -> DataFrame:
    """``asked (keys, at)`` with values at that instant: an exact hit, else linear between neighbours at most ``bridge`` apart, else null.

    Neighbours farther than ``bridge`` are never used, so they need not be found; see :func:`_neighbours`. Of points
    at one time the one with the least values counts.
    """
    value = F.struct(F.col(time).cast("double").alias("t"), *[F.col(v).cast("double").alias(v) for v in values])
    p = points.groupBy(*keys, F.col(time).cast("double").alias("_at")).agg(F.min(value).alias("_p"))
    both = _neighbours(asked.select(*keys, "at", F.col("at").cast("double").alias("_at")), p, keys, max(bridge, 1e-5), "_at", "_p").withColumnsRenamed({"_back": "_a", "_ahead": "_b"})
    hit = F.abs(F.col("_a.t") - F.col("at")) <= 1e-5
    ok = F.col("_b.t") - F.col("_a.t") <= bridge
    u = (F.col("at") - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    return both.select(*keys, "at", *[F.when(hit, F.col(f"_a.{v}")).when(ok, F.col(f"_a.{v}") + (F.col(f"_b.{v}") - F.col(f"_a.{v}")) * u).alias(v) for v in values])


def runs_above(df: DataFrame, keys: Sequence[str], order: str, value: str, threshold: float, least: int) -> DataFrame:
    """``first, last, n`` of runs of at least ``least`` consecutive rows at or above a threshold."""
    w = _w(keys, [order])
    high = df.withColumn("_high", F.coalesce(F.col(value) >= threshold, F.lit(False)))
    runs = islands(high.withColumn("_new", F.col("_high") != F.lag("_high").over(w)), keys, [order], F.col("_new"), "_run").where("_high")
    return runs.groupBy(*keys, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_run")
