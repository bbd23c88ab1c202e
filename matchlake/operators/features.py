"""Behaviour of one robot in one match, from its samples and launches; keys are ``job_id, robot_key``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.aggregates import nearest_rank, rounded_median
from matchlake.functions.exprs import PHASES, distance, share
from matchlake.operators.ordered import Leaders, fold
from matchlake.operators.temporal import islands, sessions
from matchlake.sources.work import clustered

STATIONARY_FTPS, SPOT_RADIUS_FT, VOLLEY_GAP_S, DEFENSE_RADIUS_FT, START_WINDOW_S, PATH_TOLERANCE_S = 1.0, 4.0, 3.0, 6.0, 1.5, 0.3
KEYS = ["job_id", "robot_key"]


def in_match(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("phase").isin(*PHASES))


def coverage(samples: DataFrame, match_seconds: float, step: float) -> DataFrame:
    """Seconds observed and placed, and the placed share of the match."""
    placed = F.count("ax") * step
    out = in_match(samples).groupBy(*KEYS).agg(F.bround(F.count("*") * step, 1).alias("observed_s"), F.bround(placed, 1).alias("positioned_s"), F.bround(placed / match_seconds, 3).alias("positioned_share"))
    return out if match_seconds else out.withColumn("positioned_share", F.lit(None).cast("double"))


def movement(samples: DataFrame, step: float) -> DataFrame:
    """Distance, median moving and 95th percentile speed, share of time still, longest stop."""
    placed = in_match(samples).where("ax is not null")
    moving = F.when(F.col("speed") >= STATIONARY_FTPS, F.col("speed"))
    base = placed.groupBy(*KEYS).agg(
        F.bround(F.coalesce(F.sum(moving), F.lit(0.0)) * step, 1).alias("distance_ft"), rounded_median(moving).alias("median_moving_speed_ftps"),
        share(F.count("speed") - F.count(moving), F.count("speed")).alias("stationary_share"),
    )
    base = base.join(nearest_rank(placed, KEYS, "speed", 0.95, "_top"), KEYS, "left").withColumn("top_speed_ftps", F.bround("_top", 2)).drop("_top")
    w = Window.partitionBy(*KEYS).orderBy("t")
    still = F.coalesce(F.col("speed") < STATIONARY_FTPS, F.lit(False))
    runs = placed.withColumn("_still", still).withColumn("_gap", F.col("t") - F.lag("t").over(w)).withColumn("_was", F.lag("_still").over(w))
    runs = islands(runs, KEYS, ["t"], ~(F.col("_still") & F.col("_was") & (F.abs(F.col("_gap") - step) < 1e-6)), "_run").where("_still")
    longest = runs.groupBy(*KEYS, "_run").count().groupBy(*KEYS).agg(F.bround(F.max("count") * step, 1).alias("longest_stop_s"))
    return base.join(longest, KEYS, "left").withColumn("longest_stop_s", F.coalesce("longest_stop_s", F.lit(0.0)))


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of each non-null value per key."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    return counts.withColumn("share", F.bround(F.col("count") / F.sum("count").over(Window.partitionBy(*keys)), 3))


def zones(samples: DataFrame, length: float) -> DataFrame:
    """Maps of zone shares in auto and teleop, of lane shares in teleop, and the share of teleop in the own half."""
    placed = in_match(samples).where("ax is not null")
    teleop = placed.where("phase in ('teleop', 'endgame')")
    as_map = lambda df, value, name: distribution(df, KEYS, value).groupBy(*KEYS).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "share")))).alias(name))
    out = placed.select(*KEYS).distinct()
    for df, value, name in ((placed.where("phase = 'auto'"), "zone", "auto_zones"), (teleop, "zone", "teleop_zones"), (teleop, "lane", "teleop_lanes")):
        out = out.join(as_map(df, value, name), KEYS, "left").withColumn(name, F.coalesce(name, F.create_map().cast("map<string,double>")))
    half = teleop.groupBy(*KEYS).agg(F.bround(F.avg((F.col("ax") < length / 2).cast("int")), 3).alias("own_half_share"))
    return out.join(half, KEYS, "left")


def _nearest(samples: DataFrame, target: Column, tolerance: float, keys: list[str]) -> DataFrame:
    gap = F.abs(F.col("mt") - target)
    return samples.where("ax is not null").where(gap <= tolerance).groupBy(*keys).agg(F.min_by(F.struct("ax", "ay", "zone", "lane"), F.struct(gap, "t")).alias("p"))


def start(samples: DataFrame) -> DataFrame:
    """The placed sample nearest match time zero."""
    return _nearest(samples, F.lit(0.0), START_WINDOW_S, KEYS).select(*KEYS, "p.*")


def auto_path(samples: DataFrame, auto_seconds: int) -> DataFrame:
    """A place for each whole second of auto (null if unseen), the share known, and the length of legs known at both ends.

    A sample serves the whole second nearest to it, the only one that can lie within the tolerance.
    """
    near = samples.where("ax is not null").withColumn("second", F.bround("mt").cast("int")).where(F.abs(F.col("mt") - F.col("second")) <= PATH_TOLERANCE_S)
    best = _nearest(near.where(f"second between 0 and {auto_seconds}"), F.col("second"), PATH_TOLERANCE_S, [*KEYS, "second"])
    seen = best.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("second", F.struct(F.col("p.ax").alias("x"), F.col("p.ay").alias("y"))))).alias("seen"))
    path = samples.select(*KEYS).distinct().join(seen, KEYS, "left")
    points = F.transform(F.sequence(F.lit(0), F.lit(auto_seconds)), lambda k: F.try_element_at("seen", k))
    leg = lambda k: F.coalesce(distance(*[F.try_element_at("seen", k + i)[c] for i in (0, 1) for c in ("x", "y")]), F.lit(0.0))
    length = F.aggregate(F.sort_array(F.map_keys("seen")), F.lit(0.0), lambda total, k: total + leg(k))
    return path.select(
        *KEYS, points.alias("points"), share(F.when(F.col("seen").isNotNull(), F.size("seen")).otherwise(0), F.lit(auto_seconds + 1)).alias("observed_share"),
        F.bround(F.coalesce(length, F.lit(0.0)), 1).alias("distance_ft"),
    )


def volleys(launches: DataFrame) -> DataFrame:
    """``volley, start, end, launches`` and the volley's mean place; a gap of VOLLEY_GAP_S still belongs to it."""
    numbered = sessions(launches, KEYS, "t", VOLLEY_GAP_S, ["shot_id"], "volley")
    return numbered.groupBy(*KEYS, "volley").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("launches"), F.avg("ax").alias("cx"), F.avg("ay").alias("cy"))


def dwell(samples: DataFrame, volley: DataFrame, radius: float = SPOT_RADIUS_FT) -> DataFrame:
    """How long a robot stayed within ``radius`` of a volley's place: the run of samples around its first launch, and the volley itself."""
    rows = samples.withColumn("_i", F.row_number().over(Window.partitionBy(*KEYS).orderBy("t")))
    inside = rows.join(volley.where("cx is not null"), KEYS).where(distance("ax", "ay", "cx", "cy") <= radius)
    runs = inside.withColumn("_run", F.col("_i") - F.row_number().over(Window.partitionBy(*KEYS, "volley").orderBy("_i")))
    spans = runs.groupBy(*KEYS, "volley", "start", "end", "_run").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.min(F.struct(F.abs(F.col("t") - F.col("start")), "_i")).alias("near"))
    best = spans.groupBy(*KEYS, "volley", "start", "end").agg(F.min_by(F.struct("lo", "hi"), "near").alias("s"))
    return best.select(*KEYS, "volley", F.bround(F.greatest("s.hi", "end") - F.least("s.lo", "start"), 1).alias("dwell_s"))


class _Spots:
    """Leader clusters of one robot's launches, ranked at the end."""

    def __init__(self, radius: float):
        self.found = Leaders(radius)

    def row(self, x: float, y: float) -> list[tuple]:
        if x is not None and y is not None:
            self.found.add(x, y)
        return []

    def close(self) -> list[tuple]:
        n = sum(c[2] for c in self.found.sums)
        return [(rank, sx / k, sy / k, k, n) for rank, (sx, sy, k) in enumerate(self.found.ranked(), 1)]


def spots(launches: DataFrame, hub_x: float, hub_y: float, radius: float = SPOT_RADIUS_FT) -> DataFrame:
    """Shooting spots of each robot, largest first, with share and distance to the hub; launches stream in order of time."""
    placed = launches.where("ax is not null").select(*KEYS, "t", "shot_id", "ax", "ay")
    found = fold(placed, KEYS, ["t", "shot_id", "ax", "ay"], ["ax", "ay"], lambda: _Spots(radius), "rank int, cx double, cy double, launches int, n int")
    return found.select(*KEYS, "rank", F.bround("cx", 2).alias("ax"), F.bround("cy", 2).alias("ay"), "launches", share(F.col("launches"), F.col("n")).alias("share"), F.bround(F.hypot(F.col("cx") - hub_x, F.col("cy") - hub_y), 1).alias("distance_to_hub_ft"))


def shooting(samples: DataFrame, launches: DataFrame, hub_x: float, hub_y: float) -> DataFrame:
    """Launch counts, volleys and their intervals, dwell, share on the move, median distance to the hub."""
    located = F.col("ax").isNotNull()
    speed = F.when(located, F.col("speed"))
    base = launches.groupBy(*KEYS).agg(
        F.count("*").alias("launches"), F.count("ax").alias("located_launches"), share(F.count_if(speed >= STATIONARY_FTPS), F.count(speed)).alias("on_the_move_share"),
        F.bround(F.median(distance("ax", "ay", F.lit(hub_x), F.lit(hub_y))), 1).alias("median_distance_to_hub_ft"),
    )
    v = volleys(launches)
    between = v.withColumn("gap", F.col("start") - F.lag("start").over(Window.partitionBy(*KEYS).orderBy("start")))
    timing = between.groupBy(*KEYS).agg(F.count("*").alias("volleys"), F.median("launches").alias("median_launches_per_volley"), F.bround(F.median("gap"), 1).alias("median_volley_interval_s"))
    stay = dwell(samples, v).groupBy(*KEYS).agg(F.bround(F.median("dwell_s"), 1).alias("median_dwell_s"))
    return base.join(timing, KEYS, "left").join(stay, KEYS, "left")


class _Near:
    """Counts, for places asked about, the weight of other places within ``radius``, without meeting all of them.

    Others lie in strips of equal height, each in order of x. In a strip, those nearer in x than the disc is wide all
    along the strip count by a difference of running sums; only those at the disc's edge are measured. Finer strips for
    more places keep the work at about n to the power of one and a half.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, radius: float):
        self.radius, self.low = radius, y.min() if len(y) else 0.0
        self.height = radius / np.clip(np.sqrt(len(x)) / 16, 1, 64)
        strip = np.floor((y - self.low) / self.height).astype(np.int64)
        order = np.lexsort((x, strip))
        self.x, self.y, self.weight, self.strip = x[order], y[order], weight[order], strip[order]
        self.sums = np.concatenate([[0], np.cumsum(self.weight)])
        self.starts = np.searchsorted(self.strip, np.arange(self.strip[-1] + 2 if len(x) else 1))

    def count(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out, r, slack = np.zeros(len(x), np.int64), self.radius, 1e-9 * (1 + self.radius)
        for k in range(len(self.starts) - 1):
            a, b = self.starts[k], self.starts[k + 1]
            bottom, top = self.low + k * self.height - slack, self.low + (k + 1) * self.height + slack
            near = np.flatnonzero((y >= bottom - r - slack) & (y <= top + r + slack)) if b > a else ()
            if not len(near):
                continue
            qx, qy, xs = x[near], y[near], self.x[a:b]
            least = np.maximum(0.0, np.maximum(bottom - qy, qy - top))
            most = np.maximum(np.abs(bottom - qy), np.abs(top - qy))
            wide = np.sqrt(np.maximum(0.0, r * r - least * least)) + 2 * slack
            sure = np.where(most < r, np.sqrt(np.maximum(0.0, r * r - most * most)) - 2 * slack, -1.0)
            lo, hi = a + np.searchsorted(xs, qx - wide, "left"), a + np.searchsorted(xs, qx + wide, "right")
            inner_lo = np.where(sure > 0, a + np.searchsorted(xs, qx - sure, "left"), hi)
            inner_hi = np.where(sure > 0, a + np.searchsorted(xs, qx + sure, "right"), hi)
            found = np.where(sure > 0, self.sums[inner_hi] - self.sums[inner_lo], 0)
            for begin, end in ((lo, inner_lo), (inner_hi, hi)):
                found = found + self._measured(qx, qy, begin, end)
            out[near] += found
        return out

    def _measured(self, x: np.ndarray, y: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Weight within the radius among the others at ``begin`` up to ``end``, a million at a time."""
        out, n = np.zeros(len(x), np.int64), np.maximum(0, end - begin)
        upto = np.cumsum(n)
        lo = 0
        while lo < len(x):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 1_000_000, "right")))
            m = n[lo:hi]
            of = np.repeat(np.arange(lo, hi), m)
            at = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m) + begin[of]
            dx, dy = x[of] - self.x[at], y[of] - self.y[at]
            inside = np.sqrt(dx * dx + dy * dy) <= self.radius
            out[lo:hi] = np.bincount(of[inside] - lo, self.weight[at[inside]], hi - lo).astype(np.int64)
            lo = hi
        return out


def opponents_near(deep: DataFrame, other: DataFrame, radius: float) -> DataFrame:
    """``job_id, k, alliance, x, y, near``: for each place at an instant, the samples of other alliances within ``radius`` of it.

    Samples of one place are one row with their number, and no pair of samples is formed; see :class:`_Near`. An
    instant is cut into columns of three radii, so one with very many robots falls in several tasks.
    """
    wide, finite = 3 * radius, lambda *cs: [F.abs(F.col(c)) < float("inf") for c in cs]
    column = lambda x: F.floor(x / wide).cast("long")
    place = ["job_id", "k", "alliance", "x", "y"]
    asked = deep.where(finite("x", "y")[0] & finite("x", "y")[1]).groupBy(*place).agg(F.lit(0).cast("long").alias("n")).withColumn("_column", column(F.col("x"))).withColumn("_asks", F.lit(True))
    met = other.where(finite("x", "y")[0] & finite("x", "y")[1]).groupBy(*place).agg(F.count("*").alias("n"))
    met = met.withColumn("_column", F.explode(F.sequence(column(F.col("x") - radius * 1.001), column(F.col("x") + radius * 1.001)))).withColumn("_asks", F.lit(False))

    def counted(key: tuple, rows: pa.Table) -> pa.Table:
        asks = rows["_asks"].to_numpy(zero_copy_only=False)
        side = rows["alliance"].combine_chunks().dictionary_encode()
        codes = side.indices.to_numpy(zero_copy_only=False)
        x, y, n = (rows[c].to_numpy() for c in ("x", "y", "n"))
        near = np.zeros(len(x), np.int64)
        for code in np.unique(codes[asks]):
            mine, theirs = asks & (codes == code), ~asks & (codes != code)
            if theirs.any():
                near[mine] = _Near(x[theirs], y[theirs], n[theirs], radius).count(x[mine], y[mine])
        return rows.select(place).filter(pa.array(asks)).append_column("near", pa.array(near[asks]))

    kinds = ", ".join(f"{c} {t}" for c, t in deep.select(*place).dtypes) + ", near long"
    return asked.unionByName(met).groupBy("job_id", "k", "_column").applyInArrow(counted, kinds)


#: Samples of a job from which those asked about, and those they meet, are dealt to one more block each; pairs that are measured at once.
ASKED, MET, PAIRS = 100_000, 400_000, 1_000_000


def opponents_marked(deep: DataFrame, other: DataFrame, radius: float) -> DataFrame:
    """``job_id, robot_key, label, n``: whom of other alliances each robot was within ``radius`` of most often, and in how many samples.

    Of equals it is who was near first, then the least label. Robots and labels of a job are dealt to blocks, each pair
    of which counts in one task: no pair is a row, and a job of many robots falls in many tasks.
    """
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & F.col("robot_key").isNotNull()
    size = other.groupBy("job_id").agg(F.count("*").alias("_n"))
    blocks = lambda per: F.ceil(F.col("_n") / per).cast("int")
    dealt = lambda df, key, own, per, across, others: (
        df.where(finite).join(size, "job_id").withColumn(own, F.pmod(F.xxhash64(key), blocks(per)).cast("int")).withColumn(across, F.explode(F.sequence(F.lit(0), blocks(others) - 1))).drop("_n")
    )
    asked = dealt(deep.select("job_id", "robot_key", "k", "alliance", "x", "y", "t"), "robot_key", "_a", ASKED, "_b", MET)
    met = dealt(other.select("job_id", F.col("label").alias("robot_key"), "k", "alliance", "x", "y", F.lit(None).cast("double").alias("t")), "robot_key", "_b", MET, "_a", ASKED)
    both = asked.withColumn("t", F.col("t").cast("double")).withColumn("_asks", F.lit(True)).unionByName(met.withColumn("_asks", F.lit(False)))

    def counted(key: tuple, rows: pa.Table) -> pa.Table:
        asks = rows["_asks"].to_numpy(zero_copy_only=False)
        column = lambda c, of: rows[c].to_numpy(zero_copy_only=False)[of]
        names = rows["robot_key"].combine_chunks().dictionary_encode()
        order = np.argsort(np.array(names.dictionary.to_pylist(), object))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        name = rank[names.indices.to_numpy()]
        side = rows["alliance"].combine_chunks().dictionary_encode().indices.to_numpy()
        instant = np.unique(rows["k"].to_numpy(), return_inverse=True)[1]
        ours, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
        ours = ours[np.lexsort((column("t", ours), name[ours]))]
        got = _most_met(*[(name[of], side[of], instant[of], column("x", of), column("y", of)) for of in (ours, theirs)], column("t", ours), radius)
        at = lambda c: names.dictionary.take(pa.array(order[c]))
        return pa.table({"job_id": pa.array([key[0].as_py()] * len(got[0]), rows.schema.field("job_id").type), "robot_key": at(got[0]), "label": at(got[1]), "n": got[2], "first_t": got[3]})

    kind = dict(deep.dtypes)["job_id"]
    found = both.groupBy("job_id", "_a", "_b").applyInArrow(counted, f"job_id {kind}, robot_key string, label string, n long, first_t double")
    return found.groupBy(*KEYS).agg(F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), "first_t", "label")).alias("m")).select(*KEYS, "m.*")


def _most_met(asked: tuple, met: tuple, t: np.ndarray, radius: float) -> tuple:
    """For each robot of ``asked``, in order of robot and ``t``, the name of ``met`` most often near, how often and when first; both are names, sides, instants, x and y."""
    name, side, instant, x, y = asked
    o_name, o_side, o_instant, ox, oy = met
    empty = tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, float))
    if not len(name) or not len(o_name):
        return empty
    cell = radius / 2 * (1 + 1e-9)
    lo_x, lo_y = min(x.min(), ox.min()), min(y.min(), oy.min())
    place = lambda c, low: np.floor((c - low) / cell)
    columns, levels = [np.unique(np.concatenate([np.concatenate([place(c, low) + k for k in (-2, -1, 0, 1, 2)]) for c in cs])) for cs, low in (((x, ox), lo_x), ((y, oy), lo_y))]
    code = lambda ins, px, py: (ins * len(columns) + np.searchsorted(columns, px)) * len(levels) + np.searchsorted(levels, py)
    codes = code(o_instant, place(ox, lo_x), place(oy, lo_y))
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    px, py = place(x, lo_x), place(y, lo_y)
    ranges = [(np.searchsorted(codes, code(instant, px + k, py - 2), "left"), np.searchsorted(codes, code(instant, px + k, py + 2), "right")) for k in (-2, -1, 0, 1, 2)]
    upto = np.cumsum(sum(hi - lo for lo, hi in ranges))
    robot = np.cumsum(np.concatenate([[0], name[1:] != name[:-1]]))
    first = np.searchsorted(robot, np.arange(robot[-1] + 1))
    later = np.cumsum(np.concatenate([[0], (t[1:] != t[:-1]) & (name[1:] == name[:-1])]))
    later = later - later[first][robot]  # the how many-eth time of its robot
    bits = int(later.max()).bit_length()
    best, kept, begin = [], empty[:3], 0
    while begin < len(name):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
        keys = [(kept[0] << bits) | kept[2]]
        for lo, hi in ranges:
            m = (hi - lo)[begin:end]
            of = np.repeat(np.arange(begin, end), m)
            at = order[np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[begin:end], m)]
            dx, dy = x[of] - ox[at], y[of] - oy[at]
            near = (np.sqrt(dx * dx + dy * dy) <= radius) & (side[of] != o_side[at])
            of, at = of[near], at[near]
            keys.append(((robot[of] * (o_name.max() + 1) + o_name[at]) << bits) | later[of])
        weight = np.concatenate([kept[1], np.ones(sum(map(len, keys[1:])), np.int64)])
        found, begin = np.concatenate(keys), end
        if not len(found):
            continue
        if len(kept[0]):
            by = np.argsort(found, kind="stable")
            found, weight = found[by], weight[by]
        else:
            found = np.sort(found)
        pair = found >> bits
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        n, pair, when = np.add.reduceat(weight, starts), pair[starts], found[starts] & ((1 << bits) - 1)
        who = pair // (o_name.max() + 1)
        # a robot whose samples go on in the next step is kept for it
        open_ = who == robot[end] if end < len(name) else np.zeros(len(who), bool)
        kept = pair[open_], n[open_], when[open_]
        pair, n, when, who = pair[~open_], n[~open_], when[~open_], who[~open_]
        if not len(who):
            continue
        starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        size = np.diff(np.append(starts, len(who)))
        most = np.repeat(np.maximum.reduceat(n, starts), size)
        soon = np.where(n == most, when, np.iinfo(np.int64).max)
        soon = np.where(soon == np.repeat(np.minimum.reduceat(soon, starts), size), pair, np.iinfo(np.int64).max)
        chosen = np.searchsorted(pair, np.minimum.reduceat(soon, starts))
        best.append((who[chosen], pair[chosen] % (o_name.max() + 1), n[chosen], when[chosen]))
    if not best:
        return empty
    who, label, n, when = (np.concatenate(c) for c in zip(*best))
    times = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (name[1:] != name[:-1])]))
    return name[first[who]], label, n, t[times[np.searchsorted(times, first[who]) + when]]


def defense(samples: DataFrame, length: float, step: float) -> DataFrame:
    """Time in the opponents' half, near an opponent there, and the opponent most often near.

    Time near opponents is counted without pairs; see :func:`opponents_near` and :func:`opponents_marked`.
    """
    late = samples.where("phase in ('teleop', 'endgame') and ax is not null")
    deep = late.where(F.col("ax") > length / 2)
    base = samples.groupBy(*KEYS).agg(F.max("alliance").alias("alliance")).join(deep.groupBy(*KEYS).agg(F.bround(F.count("*") * step, 1).alias("opponent_half_s")), KEYS, "left").withColumn("opponent_half_s", F.coalesce("opponent_half_s", F.lit(0.0)))
    key = F.bround(F.col("t"), 1)
    placed = "x is not null and y is not null and alliance is not null"
    sided = deep.where(placed).select(*KEYS, key.alias("k"), "alliance", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "t")
    other = samples.where(placed).select("job_id", key.alias("k"), "alliance", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.coalesce(F.col("team").cast("string"), "robot_key").alias("label"))
    near = sided.join(opponents_near(sided, other, DEFENSE_RADIUS_FT), ["job_id", "k", "alliance", "x", "y"])
    total = near.groupBy(*KEYS).agg(F.sum("near").alias("total"))
    most = opponents_marked(sided, other, DEFENSE_RADIUS_FT)
    out = base.join(total, KEYS, "left").join(most, KEYS, "left")
    known = F.col("alliance").isNotNull()
    return out.select(*KEYS, "opponent_half_s", F.when(known, F.bround(F.coalesce("total", F.lit(0)) * step, 1)).alias("near_opponent_s"), F.col("label").alias("marked"), F.bround(F.col("n") * step, 1).alias("marked_s"))


def endgame(samples: DataFrame, launches: DataFrame, match_seconds: float, endgame_seconds: float) -> DataFrame:
    """Match time of the last launch, how long before the endgame it was, and the last place."""
    last = launches.groupBy(*KEYS).agg(F.max("mt").alias("last_launch_mt"))
    final = in_match(samples).where("ax is not null").groupBy(*KEYS).agg(F.max_by(F.struct("ax", "ay", "zone", "lane", "mt"), "t").alias("final_position"))
    both = samples.select(*KEYS).distinct().join(last, KEYS, "left").join(final, KEYS, "left")
    return both.withColumn("stopped_scoring_before_endgame_s", F.bround(F.lit(match_seconds - endgame_seconds) - F.col("last_launch_mt"), 1))


def match_features(samples: DataFrame, launches: DataFrame, season: dict, geometry: dict, rate: float = 10.0) -> DataFrame:
    """One row per robot and match with all groups as nested columns; groups that need positions are null without them.

    Both inputs are written once by robot and match, so that the groups and their joins need no shuffle of their own.
    """
    samples, launches = clustered(samples, KEYS, ["t"]), clustered(launches, KEYS, ["t"])
    step, seconds = 1.0 / rate, float(season["auto_seconds"] + season["teleop_seconds"])
    hub = geometry["hub_x"], geometry["hub_y"]
    groups = {
        "coverage": coverage(samples, seconds, step), "movement": movement(samples, step), "zones": zones(samples, geometry["field_length_ft"]), "start": start(samples),
        "auto_path": auto_path(samples, int(season["auto_seconds"])), "shooting": shooting(samples, launches, *hub), "defense": defense(samples, geometry["field_length_ft"], step),
        "endgame": endgame(samples, launches, seconds, float(season.get("endgame_seconds", 0))),
        "spots": spots(launches, *hub).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("rank", "ax", "ay", "launches", "share", "distance_to_hub_ft"))).alias("list")),
        "points": launches.where("ax is not null").groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("t", "shot_id", "ax", "ay", "mt"))).alias("list")),
        "launches": launches.groupBy(*KEYS, "phase").count().groupBy(*KEYS).agg(F.sum("count").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", "count")))).alias("by_phase")),
    }
    out = samples.groupBy(*KEYS).agg(F.max("match_id").alias("match_id"), F.max("team").alias("team"), F.max("alliance").alias("alliance"))
    for name, df in groups.items():
        nested = df.select(*KEYS, F.struct(*[c for c in df.columns if c not in KEYS]).alias(name))
        out = out.join(nested, KEYS, "left")
    return out


#: Groups that are computed together; each of these steps has few sorts, which share a task's memory.
STEPS = [["coverage", "zones"], ["auto_path", "start"], ["movement"], ["shooting"], ["defense"], ["endgame", "spots"], ["points", "launches"]]


def written(features: DataFrame) -> DataFrame:
    """:func:`match_features` with all groups, written some groups at a time, then joined without a shuffle.

    In one step, the sorts and aggregates of all groups would stand in each task at once.
    """
    out = clustered(features.select(*KEYS, "match_id", "team", "alliance"), KEYS)
    for step in STEPS:
        out = out.join(clustered(features.select(*KEYS, *step), KEYS), KEYS, "left")
    return out
