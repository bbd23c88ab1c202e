"""Chains of rows that each point to at most one later row, followed by pointer doubling instead of row by row.

What a row points to is found where sorted rows stream by, in range partitions that split a key of any size; a chain of
n rows is then followed in log n rounds of joins on row numbers. So no task sees a whole key, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.sources.work import staged


def _ranges(rows: DataFrame, keys: Sequence[str], time: str, gap: float) -> DataFrame:
    """The distinct times of each key (``_side`` 1) and the times that they ask for (0), sorted together into parts of one size."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    times = rows.select(*keys, F.col(time).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    asks = times.select(*keys, (F.col("_t") + F.lit(gap)).alias("_at"), F.lit(0).alias("_side"), F.col("_t").alias("_of"))
    every = asks.unionByName(times.select(*keys, F.col("_t").alias("_at"), F.lit(1).alias("_side"), F.col("_t").alias("_of")))
    order = [*keys, "_at", "_side"]
    sorted_ = every.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return staged(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))


def next_after(rows: DataFrame, keys: Sequence[str], time: str, gap: float) -> DataFrame:
    """``keys, time, id, next``: for each distinct time of a key, the ``id`` of its first row ``gap`` or more later, null for none.

    Rows and the times that they ask for are sorted together into ranges; what a range does not hold is the first row of
    a later one, known from one row a range.
    """
    dealt = _ranges(rows, keys, time, gap)
    here = F.when(F.col("_side") == 1, F.struct(*[F.col(k) for k in keys], F.col("_id")))
    down = Window.partitionBy("_part").orderBy(F.desc("_id")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    firsts = dealt.groupBy("_part").agg(F.min_by(here, F.when(F.col("_side") == 1, F.col("_id"))).alias("_first"))
    firsts = firsts.select("_part", F.first("_first", ignorenulls=True).over(later).alias("_beyond"))
    found = dealt.withColumn("_here", F.last(here, ignorenulls=True).over(down)).where("_side = 0").join(firsts, "_part")
    found = found.withColumn("_to", F.coalesce("_here", "_beyond"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_to.{k}"))
    pointers = found.select(*keys, F.col("_of").alias("_t"), F.when(same, F.col("_to._id")).alias("next"))
    own = dealt.where("_side = 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_of"), F.col("_id").alias("id"))
    met = F.col("_t") == F.col("_of")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return staged(pointers.join(own, met).select(*keys, F.col("_t").alias(time), "id", "next"))


def reached(pointers: DataFrame, first: DataFrame) -> DataFrame:
    """``id`` of all rows on the chains from ``first (id)``, by ``pointers (id, next)``.

    Round k adds what lies 2 ** k steps behind the rows found so far, then joins the pointers with themselves; those that
    lead off their chain's end go, so the rounds end when no chain is longer.
    """
    found, jumps = staged(first.select("id")), staged(pointers.where("next is not null").select("id", "next"))
    while not jumps.isEmpty():
        found = staged(found.join(jumps, "id").select(F.col("next").alias("id")).union(found))
        jumps = staged(jumps.join(jumps.select(F.col("id").alias("next"), F.col("next").alias("then")), "next").select("id", F.col("then").alias("next")))
    return found


def roots(pointers: DataFrame) -> DataFrame:
    """``id, root, place``: the first row of each row's chain and how many rows lie before it, by ``pointers (id, next)`` in which each row is pointed to at most once."""
    back = pointers.where("next is not null").select(F.col("next").alias("id"), F.col("id").alias("up"))
    rows = pointers.select("id").join(back, "id", "left").select("id", F.coalesce("up", "id").alias("root"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("place"))
    rows = staged(rows)
    open_ = True
    while open_:
        above = rows.select(F.col("id").alias("root"), F.col("root").alias("top"), F.col("place").alias("more"))
        rows = staged(rows.join(above, "root").select("id", F.col("top").alias("root"), (F.col("place") + F.col("more")).alias("place"), (F.col("more") > 0).alias("moved")))
        open_ = not rows.where("moved").isEmpty()
        rows = rows.drop("moved")
    return rows


def spaced(df: DataFrame, keys: Sequence[str], time: str, gap: float, with_last: bool = False) -> DataFrame:
    """Rows ``gap`` or more after the last kept one of their key, its first row included; rows of one time go together.

    ``with_last`` also keeps each key's last time. Rows without a time are left out. Null is a key like any other; an
    empty table stays empty.
    """
    keys = list(keys)
    points = next_after(df, keys, time, gap)
    ends = points.groupBy(*keys).agg(F.min_by("id", time).alias("id"), F.max_by("id", time).alias("last"))
    chosen = reached(points, ends.select("id"))
    chosen = chosen.union(ends.select("last")).distinct() if with_last else chosen
    kept = points.join(chosen, "id", "left_semi")
    met = F.col("_kept") == F.col(time)
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(kept.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(time).alias("_kept")), met, "left_semi")


#: Rows that meet in one group of :func:`_met`, how many others a point is measured against at first, and how many pairs are measured at once.
GROUP, AROUND, PAIRS = 200_000, 48, 1_000_000


class _Places:
    """Points in which others look for their nearest within ``reach`` and within their own ``tile``.

    They lie in square cells that are halved until a point meets few others; what lies within a cell's side is in the
    cells around. Points that have none so near look again in cells twice as wide, up to the reach.
    """

    def __init__(self, tile: np.ndarray, u: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray, reach: float):
        self.tile, self.u, self.v, self.x, self.y, self.reach = tile, u, v, x, y, reach

    def _cells(self, size: float) -> None:
        self.size, self.wide = size * (1 + 1e-9), int(self.span / size) + 8
        code = self._code(self.tile, self.u, self.v, 0)
        self.order = np.argsort(code, kind="stable")
        self.codes = code[self.order]

    def _code(self, tile: np.ndarray, u: np.ndarray, v: np.ndarray, aside: int) -> np.ndarray:
        i, j = np.floor(u / self.size).astype(np.int64) + 2 + aside, np.floor(v / self.size).astype(np.int64) + 2
        return (tile * self.wide + i) * self.wide + j

    def _around(self, asks: _Places, of: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        codes = [self._code(asks.tile[of], asks.u[of], asks.v[of], k) for k in (-1, 0, 1)]
        return [(np.searchsorted(self.codes, c - 1, "left"), np.searchsorted(self.codes, c + 1, "right")) for c in codes]

    def nearest(self, asks: _Places, rank: np.ndarray) -> np.ndarray:
        """For each of ``asks`` the index of the nearest point within the reach, of equals that of the least ``rank``; -1 for none."""
        best = np.full(len(asks.x), -1, np.int64)
        if not len(self.x) or not len(best):
            return best
        self.span = max(self.u.max(), self.v.max(), asks.u.max(), asks.v.max(), self.reach)
        left, size = np.arange(len(best)), self.reach
        self._cells(size)
        while size > self.reach / 64 and sum((hi - lo).sum() for lo, hi in self._around(asks, left)) > AROUND * len(left):
            size /= 2
            self._cells(size)
        while True:
            found, d = self._measured(asks, left, rank)
            sure = (found >= 0) & (d <= size)
            best[left[sure]] = found[sure]
            left = left[~sure]
            if size >= self.reach or not len(left):
                return best
            size = min(self.reach, 2 * size)
            self._cells(size)

    def _measured(self, asks: _Places, of: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, least = np.full(len(of), -1, np.int64), np.full(len(of), np.inf)
        for lo, hi in self._around(asks, of):
            n, begin = hi - lo, 0
            upto = np.cumsum(n)
            while begin < len(of):
                end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
                some = begin + np.flatnonzero(n[begin:end])
                begin = end
                if not len(some):
                    continue
                m = n[some]
                starts = np.cumsum(m) - m
                at = self.order[np.arange(m.sum()) - np.repeat(starts, m) + np.repeat(lo[some], m)]
                dx, dy = self.x[at] - np.repeat(asks.x[of[some]], m), self.y[at] - np.repeat(asks.y[of[some]], m)
                d = np.sqrt(dx * dx + dy * dy)
                near = np.minimum.reduceat(d, starts)
                ranks = np.where(d == np.repeat(near, m), rank[at], np.iinfo(np.int64).max)
                first = np.minimum.reduceat(ranks, starts)
                which = at[np.flatnonzero(ranks == np.repeat(first, m))]  # ranks are distinct, so one for each
                other = np.where(best[some] >= 0, rank[best[some]], np.iinfo(np.int64).max)
                better = (near < least[some]) | ((near == least[some]) & (first < other))
                best[some[better]], least[some[better]] = which[better], near[better]
        return best, least


def _met(a: DataFrame, b: DataFrame, names: Sequence[str], reach: float, rows: int) -> DataFrame:
    """``id, next`` of points of ``a`` and ``b`` that are each other's nearest within ``reach``; both have ``names, f, id, x, y``.

    Points meet in square tiles of a frame. ``b`` comes with what lies within the reach of a tile and ``a`` with twice
    that, so a tile knows the nearest of each of its own points and the nearest of those. Many tiles are one group.
    """
    side = 8 * reach
    tile = lambda c, m: F.explode(F.sequence(F.floor((F.col(c) - m) / side).cast("long"), F.floor((F.col(c) + m) / side).cast("long")))
    own = lambda c, t: F.floor(F.col(c) / side).cast("long") == F.col(t)
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    keys = [*names, "f", "_tx", "_ty"]
    spread = lambda df, m, asks: df.where(finite).select(*names, "f", "id", "x", "y", tile("x", m * 1.001).alias("_tx")).select("*", tile("y", m * 1.001).alias("_ty")).select(*keys, "id", "x", "y", F.lit(asks).alias("_a"), (own("x", "_tx") & own("y", "_ty")).alias("_own"))
    both = spread(a, 2 * reach, True).unionByName(spread(b, reach, False))
    both = both.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-4 * rows // GROUP)))))

    def pairs(rows: pa.Table) -> pa.Table:
        x, y, id_ = (rows[c].to_numpy() for c in ("x", "y", "id"))
        of = np.zeros(len(x), np.int64)
        for c in keys:
            part = np.unique(rows[c].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            of = np.unique(of * (part.max() + 1) + part, return_inverse=True)[1]
        corner = lambda c, t: c - side * rows[t].to_numpy() + 3 * reach
        u, v = corner(x, "_tx"), corner(y, "_ty")
        asks, mine = (rows[c].to_numpy(zero_copy_only=False) for c in ("_a", "_own"))
        pick = lambda at: _Places(of[at], u[at], v[at], x[at], y[at], reach)
        ours, theirs, all_ours = np.flatnonzero(asks & mine), np.flatnonzero(~asks), np.flatnonzero(asks)
        to = pick(theirs).nearest(pick(ours), id_[theirs])
        ours, to = ours[to >= 0], theirs[to[to >= 0]]
        asked, which = np.unique(to, return_inverse=True)
        back = pick(all_ours).nearest(pick(asked), id_[all_ours])
        same = all_ours[back[which]] == ours if len(ours) else np.zeros(0, bool)
        return pa.table({"id": id_[ours[same]], "next": id_[to[same]]})

    return both.groupBy("_group").applyInArrow(pairs, "id long, next long")


def linked(points: DataFrame, keys: Sequence[str], frame: str, x: str, y: str, reach: float, missed: int = 0) -> DataFrame:
    """``points`` with ``track``, the id of its chain's first point, and ``place`` in the chain: nearest points of following frames.

    Two points are linked where each is the other's nearest within ``reach`` a frame, of those that are still free; the
    next frame first, then points up to ``missed`` frames further. Points meet in tiles of some reaches, so a frame of any
    number of points is no single task; no pair is shuffled, and a point is measured against few others however many lie
    within its reach. Ties go to the smaller ``x``, then ``y``, then row. Points without a place or frame are left out; a
    key of nulls is a key.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, frame, x, y]
    rows = points.where(F.col(frame).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))
    small = rows.select(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(frame).cast("long").alias("f"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), "id")
    names, pairs, n = [f"_k{i}" for i in range(len(keys))], None, rows.count()
    for step in range(1, missed + 2):
        free = lambda side: small if pairs is None else small.join(pairs.select(F.col(side).alias("id")), "id", "left_anti")  # noqa: B023, E731
        more = _met(free("id").withColumn("f", F.col("f") + step), free("next"), names, reach * step, n)
        pairs = staged(more if pairs is None else more.union(pairs))
    chains = roots(rows.select("id").join(pairs, "id", "left"))
    return rows.join(chains, "id").drop("id").withColumnRenamed("root", "track")
