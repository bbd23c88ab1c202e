"""Queries over the given tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.functions import contracts
from matchlake.functions import exprs as X
from matchlake.operators import (
    assignment, balls, chains, clock, corrections, datasets, facts, features, flights, fusion, heatmap, identity, metrics, overlay, pages, plan, profile, quality, sampling, signals, stats, temporal, tracking,
)
from matchlake.plans import adapter as A
from matchlake.sources import sinks
from matchlake.sources.work import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = ["job_id", "robot_key"]


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(name: str, digits: int = 4):
    return F.round(F.col(name), digits).alias(name)


@query(f"""with {A.FACTS}, f as (select *, lag(t_seconds) over (partition by team, match_id, event_type order by t_seconds, event_id) as before from facts),
d as (select team, match_id, t_seconds, event_id, event_type, coalesce(lag(event_type) over (partition by team, match_id order by t_seconds, event_id), 'defense_end') as prev
  from facts where event_type in ('defense_start', 'defense_end')),
e as (select team, event_type, t_seconds, lead(t_seconds) over (partition by team, match_id order by t_seconds, event_id) as next from d where event_type <> prev),
s as (select team, sum(greatest(0, coalesce(next, 80000) - t_seconds)) as defense from e where event_type = 'defense_start' group by team)
select f.team, count(distinct match_id) as matches_played, count(*) filter (where event_type = 'reload' and before is not null) as cycles,
  round(median(t_seconds - before) filter (where event_type = 'reload'), 7) as avg_cycle_seconds,
  greatest(count(*) filter (where event_type = 'shot_attempt'), count(*) filter (where event_type = 'shot_made')) as shot_attempts,
  count(*) filter (where event_type = 'shot_made') as shots_made, round(avg(t_seconds - before) filter (where event_type = 'shot_attempt'), 6) as avg_shot_interval_seconds,
  count(*) filter (where event_type = 'reload') as reloads, count(*) filter (where confidence < 0.5) as low_confidence_events,
  round(count(*) filter (where event_type = 'shot_made') / nullif(greatest(count(*) filter (where event_type = 'shot_attempt'), count(*) filter (where event_type = 'shot_made')), 0), 6) as shot_accuracy,
  round(coalesce(max(defense), 0::double), 6) as defense_seconds
from f left join s on f.team = s.team group by f.team""")
def team_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per-team statistics over all matches."""
    out = stats.team_stats(A.facts(spark, sf), A.SEASON["auto_seconds"] + A.SEASON["teleop_seconds"])
    return out.select("team", "matches_played", "cycles", _r("avg_cycle_seconds", 7), "shot_attempts", "shots_made", _r("avg_shot_interval_seconds", 6), "reloads", "low_confidence_events", _r("shot_accuracy", 6), _r("defense_seconds", 6))


@query(f"""with {A.FACTS}, d as (select *, coalesce(lag(event_type) over (partition by team, match_id order by t_seconds, event_id), 'defense_end') as prev from facts where event_type in ('defense_start', 'defense_end')),
e as (select *, lead(t_seconds) over (partition by team, match_id order by t_seconds, event_id) as next from d where event_type <> prev)
select team, match_id, t_seconds as start, coalesce(next, 86400) as "end" from e where event_type = 'defense_start'""")
def paired_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Defence intervals of each team and match."""
    return temporal.paired_intervals(A.facts(spark, sf), ["team", "match_id"], "t_seconds", F.col("event_type") == "defense_start", F.col("event_type") == "defense_end", F.lit(86400.0), ["event_id"]).select("team", "match_id", "start", "end")


@query(f"""with {A.FACTS}, g as (select team, match_id, t_seconds, event_id, case when t_seconds - lag(t_seconds) over w <= 7200 then 0 else 1 end as first from facts window w as (partition by team, match_id order by t_seconds, event_id)),
s as (select *, sum(first) over (partition by team, match_id order by t_seconds, event_id) as session from g)
select team, match_id, cast(session as bigint) as session, min(t_seconds) as start, max(t_seconds) as "end", count(*) as launches from s group by team, match_id, session""")
def volley_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Gap sessions of each team's events."""
    s = temporal.sessions(A.facts(spark, sf), ["team", "match_id"], "t_seconds", 7200, ["event_id"])
    return s.groupBy("team", "match_id", "session").agg(F.min("t_seconds").alias("start"), F.max("t_seconds").alias("end"), F.count("*").alias("launches"))


@query(f"with {A.FACTS} select event_type, count(*) as n, round(avg(confidence), 6) as mean from facts where confidence >= 0.25 and confidence < 0.5 and event_type in ('shot_attempt', 'reload') group by event_type")
def low_confidence_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Events of middling confidence by type, through the inspector's filter."""
    kept = stats.in_confidence(A.facts(spark, sf), 0.25).where(quality.inspector(low=0.5, kinds=["shot_attempt", "reload"]))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


def _jobs(f: DataFrame) -> DataFrame:
    teams = f.select("match_id", "team").distinct()
    side = lambda k: F.array_sort(F.collect_list(F.when(F.col("team") % 2 == k, F.col("team"))))
    return teams.groupBy("match_id").agg(F.struct(side(1).alias("red"), side(0).alias("blue")).alias("alliances")).withColumn("season", F.lit(2024))


def _seasons(spark: SparkSession) -> DataFrame:
    values = {"auto": {"shot_made_high": 5, "shot_made_low": 2}, "teleop": {"shot_made_high": 3, "shot_made_low": 1}, "endgame": {"shot_made_high": 4}}
    return spark.createDataFrame([(2024, values)], "season int, point_values map<string,map<string,int>>")


_POINTS = "case when phase = 'auto' and goal = 'high' then 5 when phase = 'auto' and goal = 'low' then 2 when phase = 'teleop' and goal = 'high' then 3 when phase = 'teleop' and goal = 'low' then 1 when phase = 'endgame' and goal = 'high' then 4 else 0 end"


@query(f"with {A.FACTS} select match_id, cast(coalesce(sum({_POINTS}) filter (where event_type = 'shot_made' and team % 2 = 1), 0) as bigint) as red, cast(coalesce(sum({_POINTS}) filter (where event_type = 'shot_made' and team % 2 = 0), 0) as bigint) as blue from facts group by match_id")
def score_reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    """Alliance scores from made shots."""
    f = A.facts(spark, sf)
    return stats.reconstruct_score(f, _jobs(f), _seasons(spark))


@query(f"""with {A.FACTS}, s as (select match_id, coalesce(sum({_POINTS}) filter (where event_type = 'shot_made' and team % 2 = 1), 0) as red, coalesce(sum({_POINTS}) filter (where event_type = 'shot_made' and team % 2 = 0), 0) as blue from facts group by match_id),
o as (select match_id, count(*) filter (where team % 2 = 1) as r, count(*) filter (where team % 2 = 0) as b from facts where n % 2 = 0 group by match_id)
select s.match_id, cast(red - r as bigint) as delta_red, cast(blue - b as bigint) as delta_blue, (abs(red - r) + abs(blue - b)) / 2 as mean_error,
  case when (abs(red - r) + abs(blue - b)) / 2 <= 3 then 'good' when (abs(red - r) + abs(blue - b)) / 2 <= 10 then 'fair' else 'poor' end as grade from s join o using (match_id)""")
def score_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Reconstructed scores against another count of the same matches."""
    f = A.facts(spark, sf)
    other = f.where("n % 2 = 0").groupBy("match_id").agg(F.count_if(F.expr("team % 2 = 1")).alias("red"), F.count_if(F.expr("team % 2 = 0")).alias("blue"))
    return stats.accuracy(stats.reconstruct_score(f, _jobs(f), _seasons(spark)), other).select("match_id", "delta_red", "delta_blue", "mean_error", "grade")


_SHOTS = "shots as (select l_linestatus as job_id, coalesce(cast(case when l_suppkey % 9 <> 0 then l_suppkey % 40 end as varchar), 'unassigned') as robot, case l_returnflag when 'A' then 'made' when 'R' then 'missed' else 'unknown' end as outcome from lineitem)"


@query(f"with {_SHOTS} select job_id, robot, count(*) as attempted, count(*) filter (where outcome = 'made') as made, count(*) filter (where outcome = 'missed') as missed, count(*) filter (where outcome = 'unknown') as unknown from shots group by grouping sets ((job_id, robot), (job_id))")
def outcome_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Shot outcomes per robot and in total."""
    return stats.shot_statistics(A.shots(spark, sf))


@query("""with e as (select l_linestatus as job_id, l_returnflag as region, coalesce(cast(case when l_suppkey % 9 <> 0 then l_suppkey % 40 end as varchar), 'unassigned') as robot from lineitem)
select job_id, region, robot, case when grouping(region) = 0 then 'region' when grouping(robot) = 0 then 'robot' else 'total' end as level, count(*) as made,
  count(*) filter (where robot <> 'unassigned') as attributed, count(*) filter (where robot = 'unassigned') as unassigned from e group by grouping sets ((job_id, region), (job_id, robot), (job_id))""")
def goal_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Goal entries by region, robot and in total."""
    li = A.table(spark, sf, "lineitem")
    e = li.select(F.col("l_linestatus").alias("job_id"), F.col("l_returnflag").alias("region_id"), F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey") % 40).alias("robot_track_id"), F.lit("high").alias("goal"), F.col("l_orderkey").alias("entry_id"))
    return stats.goal_statistics(e).drop("goal")


@query(f"with {A.FACTS} select team, " + ", ".join(f"count(*) filter (where phase = '{p}' and event_type = 'shot_{k}') as {p}_{n}" for p in ("auto", "teleop", "endgame", "unknown") for k, n in (("attempt", "attempts"), ("made", "made"))) + " from facts where event_type in ('shot_attempt', 'shot_made') group by team")
def phase_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts and made shots per team and phase."""
    return stats.by_phase(A.facts(spark, sf)).na.fill(0)


@query("""select o_custkey as team, o_orderkey as n, round(pow(0.5, (count(*) over (partition by o_custkey) - row_number() over (partition by o_custkey order by o_orderkey)) / 4.0), 9) as weight from orders""")
def recency_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Half-life weights of a customer's orders, as matches."""
    o = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("team"), F.concat(F.lit("2024ev_qm"), F.col("o_orderkey").cast("string")).alias("match_id"), F.col("o_orderkey").alias("n"), F.lit(0).alias("seq"))
    return heatmap.recency(o).select("team", "n", _r("weight", 9))


def _weighted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = A.points(spark, sf)
    return p, heatmap.recency(p.select("team", "match_id", F.lit(0).alias("seq")).distinct())


@query(f"""with {A.POINTS}, c as (select team, least(floor(ax / 3), 18) as ix, least(floor(ay / 3), 9) as iy, count(*) as launches, sum(weight) as weight, count(distinct m) as matches from points join weights using (team, m) group by 1, 2, 3)
select team, (ix + 0.5::double) * 3 as x, (iy + 0.5::double) * 3 as y, launches, round_even(weight, 3) as weight, matches, round_even(round_even(weight, 3) / max(round_even(weight, 3)) over (partition by team), 3) as intensity from c""")
def grid_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    """Recency-weighted launch grid of every team."""
    p, w = _weighted(spark, sf)
    return heatmap.grid(p, w, A.LENGTH, A.WIDTH)


_ZONE = "case when ax < 15 then 'own' when ax < 39 then 'neutral' else 'opponent' end as zone, case when ay < 9 then 'right' when ay < 18 then 'centre' else 'left' end as lane"


@query(f"""with {A.POINTS}, r as (select team, {_ZONE}, m, weight from points join weights using (team, m)),
g as (select team, zone, lane, count(*) as launches, sum(weight) as w, count(distinct m) as matches from r group by 1, 2, 3)
select team, zone, lane, launches, round_even(w, 3) as weight, matches, round_even(w / sum(w) over (partition by team), 3) as share, w / sum(w) over (partition by team) >= 0.15 and matches >= 2 as effective from g""")
def effective_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Zones that hold a real share of a team's launches."""
    p, w = _weighted(spark, sf)
    return heatmap.effective_zones(p, w, A.ZONES, A.LANES)


@query(f"with {A.FACTS}, c as (select team, event_type, count(*) as n from facts group by 1, 2) select team, max(struct_pack(n := n, e := event_type)).e as mode, max(n) as n from c group by team")
def mode_max_tiebreak(spark: SparkSession, sf: str) -> DataFrame:
    """Most frequent event type of a team, the largest name on a tie."""
    return profile.mode_max(A.facts(spark, sf), ["team"], "event_type")


@query("select l_suppkey as supplier, list_sort(list(l_extendedprice))[cast(floor(0.95 * (count(*) - 1) + 0.5) as bigint) + 1] as value from lineitem group by l_suppkey")
def nearest_rank_p95(spark: SparkSession, sf: str) -> DataFrame:
    """95th percentile without interpolation."""
    return stats.price_percentile(A.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "supplier"), "supplier", "l_extendedprice", 0.95)


@query(f"""with {A.FACTS}, p as (select * from facts where event_type = 'shot_made'), v as (select * from facts where event_type = 'defense_start'),
j as (select p.event_id, v.t_seconds as near_t, v.value as near_value, row_number() over (partition by p.event_id order by abs(p.t_seconds - v.t_seconds), v.t_seconds, v.event_id) as rn
  from p join v on p.team = v.team and p.match_id = v.match_id and abs(p.t_seconds - v.t_seconds) <= 3600)
select p.event_id, p.team, near_t, near_value from p left join j on p.event_id = j.event_id and rn = 1""")
def asof_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest view of the same user and day within an hour of each purchase."""
    f = A.facts(spark, sf)
    left, right = f.where("event_type = 'shot_made'").select("event_id", "team", "match_id", "t_seconds"), f.where("event_type = 'defense_start'").select("team", "match_id", F.col("t_seconds").alias("vt"), "value", F.col("event_id").alias("vid"))
    return temporal.asof_nearest(left, right, ["team", "match_id"], "t_seconds", "vt", 3600.0, ["value"], "vid").select("event_id", "team", "near_t", "near_value")


@query(f"with {A.FACTS} select a.team, count(*) as meetings, count(distinct b.team) as others from facts a join facts b on a.match_id = b.match_id and a.team <> b.team and abs(a.t_seconds - b.t_seconds) <= 60 group by a.team")
def band_self_join(spark: SparkSession, sf: str) -> DataFrame:
    """How often users act within a minute of another."""
    return temporal.meetings(A.facts(spark, sf), ["match_id"], "team", "t_seconds", 60.0)


_GRID = f"""{A.FACTS}, h as (select team, match_id, t_seconds / 3600 as h, value, lead(t_seconds / 3600) over w as h2, lead(value) over w as v2 from facts window w as (partition by team, match_id order by t_seconds)),
k as (select *, unnest(generate_series(cast(ceil(h * 4 - 1e-9) as bigint), cast(case when h2 is null then floor(h * 4 + 1e-9) else ceil(h2 * 4 - 1e-9) - 1 end as bigint))) as k from h),
grid as (select team, match_id, k / 4 as h, case when abs(k / 4 - h) < 1e-6 then value else value + (v2 - value) * ((k / 4 - h) / (h2 - h)) end as value from k where abs(k / 4 - h) < 1e-6 or h2 - h <= 3)"""


@query(f"with {_GRID} select team, match_id, h, round(value, 6) as value from grid")
def resample_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Values of a user's day on a quarter-hour grid, without bridging holes over three hours."""
    f = A.facts(spark, sf).select("team", "match_id", (F.col("t_seconds") / 3600).alias("h"), "value")
    return temporal.resample(f, ["team", "match_id"], "h", ["value"], 4.0, 3.0).select("team", "match_id", "h", _r("value", 6))


@query(f"""with {_GRID}, b as (select *, case when abs(h - lag(h) over (partition by team, match_id order by h) - 0.25) < 1e-6 then 0 else 1 end as brk from grid),
r as (select *, sum(brk) over (partition by team, match_id order by h) as run from b),
m as (select *, avg(value) over (partition by team, match_id, run order by h rows between 1 preceding and 1 following) as s from r),
e as (select *, first_value(s) over w as lo, last_value(s) over w as hi, count(*) over w as n from m window w as (partition by team, match_id, run order by h rows between 1 preceding and 1 following))
select team, match_id, h, case when n > 1 then round_even(abs(hi - lo) / ((n - 1) * 0.25::double), 3) end as speed from e""")
def smooth_speed(spark: SparkSession, sf: str) -> DataFrame:
    """Speed of the resampled values over runs without holes."""
    f = A.facts(spark, sf).select("team", "match_id", (F.col("t_seconds") / 3600).alias("h"), "value")
    g = temporal.resample(f, ["team", "match_id"], "h", ["value"], 4.0, 3.0).withColumn("zero", F.lit(0.0))
    return temporal.smooth_speed(g, ["team", "match_id"], "h", "value", "zero", 4.0).select("team", "match_id", "h", "speed")


@query(f"""with {A.SAMPLES}, p as (select * from samples where phase in ('auto', 'teleop', 'endgame')),
b as (select *, case when speed < 1 and lag(speed) over w < 1 and k - lag(k) over w = 1 then 0 else 1 end as brk from p window w as (partition by job_id, robot_key order by k)),
r as (select *, sum(brk) over (partition by job_id, robot_key order by k) as run from b),
l as (select job_id, robot_key, max(n) as n from (select job_id, robot_key, run, count(*) as n from r where speed < 1 group by 1, 2, 3) group by 1, 2)
select p.job_id, p.robot_key, round_even(coalesce(sum(speed) filter (where speed >= 1), 0::double) * 0.1::double, 1) as distance_ft, round_even((count(speed) - count(*) filter (where speed >= 1)) / count(speed), 3) as stationary_share,
  round_even(coalesce(max(l.n), 0) * 0.1::double, 1) as longest_stop_s from p left join l on p.job_id = l.job_id and p.robot_key = l.robot_key group by 1, 2""")
def movement(spark: SparkSession, sf: str) -> DataFrame:
    """Distance, stillness and the longest stop of each robot."""
    return features.movement(A.samples(spark, sf), 0.1).select(*KEYS, "distance_ft", "stationary_share", "longest_stop_s")


@query(f"""with {A.SAMPLES}, c as (select job_id, robot_key, zone, count(*) as n from samples where phase in ('teleop', 'endgame') group by 1, 2, 3)
select job_id, robot_key, zone, n as "count", round_even(n / sum(n) over (partition by job_id, robot_key), 3) as share from c""")
def zone_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Share of teleop that each robot spends in each zone."""
    return features.distribution(A.samples(spark, sf).where("phase in ('teleop', 'endgame')"), KEYS, "zone")


@query(f"""with {A.SAMPLES}, d as (select * from samples where phase in ('teleop', 'endgame') and ax > 27),
n as (select d.job_id, d.robot_key, o.team, count(*) as n, min(d.k) as first_k from d join samples o on o.job_id = d.job_id and o.k = d.k and o.alliance <> d.alliance
  where sqrt((d.ax - o.ax) * (d.ax - o.ax) + (d.ay - o.ay) * (d.ay - o.ay)) <= 6 group by 1, 2, 3),
t as (select job_id, robot_key, sum(n) as total from n group by 1, 2),
h as (select job_id, robot_key, count(*) as deep from d group by 1, 2), a as (select distinct job_id, robot_key from samples)
select a.job_id, a.robot_key, round_even(coalesce(deep, 0) * 0.1::double, 1) as opponent_half_s, round_even(coalesce(total, 0)::double * 0.1::double, 1) as near_opponent_s from a left join h using (job_id, robot_key) left join t using (job_id, robot_key)""")
def defense(spark: SparkSession, sf: str) -> DataFrame:
    """Time in the opponents' half and near an opponent there."""
    return features.defense(A.samples(spark, sf), A.LENGTH, 0.1).select(*KEYS, "opponent_half_s", "near_opponent_s")


def _patches(f: DataFrame) -> DataFrame:
    """Edits of every 7th event, deletions of every 11th, a creation for every 13th."""
    row = lambda every, action, fields, day: f.where(F.col("n") % every == 0).select(
        F.concat(F.lit(action), "event_id").alias("correction_id"), F.lit("event").alias("scope"), "job_id", F.concat(F.lit("new" if action == "create" else ""), "event_id").alias("target_id"),
        "match_id", F.lit(action).alias("action"), fields.alias("fields"), F.lit(f"2024-02-{day} 00:00:00").cast("timestamp").alias("created_at"))
    made = F.create_map(F.lit("team"), F.col("team").cast("string"), F.lit("t_seconds"), F.lit("1.5"), F.lit("event_type"), F.lit("foul"), F.lit("confidence"), F.lit("1.0"))
    edit = F.create_map(F.lit("team"), (F.col("team") + 1000).cast("string"), F.lit("goal"), F.lit(None).cast("string"))
    none = F.create_map().cast("map<string,string>")
    return row(7, "edit", edit, "01").unionByName(row(11, "delete", none, "02")).unionByName(row(13, "create", made, "03"))


_CORRECTED = f"""{A.FACTS}, corrected as (
  select event_id, match_id, case when n % 7 = 0 then team + 1000 else team end as team, t_seconds, event_type, case when n % 7 <> 0 then goal end as goal, n % 7 = 0 as corrected from facts where n % 11 <> 0
  union all select 'new' || event_id, match_id, team, 1.5, 'foul', null, true from facts where n % 13 = 0)"""


@query(f"with {_CORRECTED} select * from corrected")
def corrections_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Events with edits, deletions and creations composed onto them."""
    f = A.facts(spark, sf)
    return corrections.apply_corrections(f.drop("n", "value"), _patches(f)).select("event_id", "match_id", "team", "t_seconds", "event_type", "goal", "corrected")


@query(f"with {_CORRECTED} select count(*) as deleted, (select count(*) from corrected where corrected and event_id like 'new%') as created, (select count(*) from corrected c join facts f using (event_id, match_id) where c.team <> f.team) as retitled from facts where n % 11 = 0")
def corrections_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of deleted, created and changed events, from the difference of the two views."""
    f = A.facts(spark, sf)
    raw = f.drop("n", "value")
    out = corrections.apply_corrections(raw, _patches(f))
    view = corrections.view_events(out, raw, ["team", "goal"])
    gone = corrections.deleted_events(raw, out).agg(F.count("*").alias("deleted"))
    return gone.join(view.agg(F.count_if(F.expr("not was_raw")).alias("created"), F.count_if(F.array_contains("changed_fields", F.lit("team"))).alias("retitled")))


@query(f"""with {A.FACTS}, l as (select match_id, team, max(struct_pack(t := t_seconds, v := cast(floor(value) as integer))) filter (where n % 5 = 0) as last from facts group by 1, 2)
select match_id as job_id, team as track_id, coalesce(last.v, team) as team from l""")
def track_last_writer(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks with the last team that a patch gave them."""
    f = A.facts(spark, sf)
    tracks = f.select("job_id", "track_id", "team", F.lit(None).cast("string").alias("alliance"), F.lit(None).cast("double").alias("team_confidence")).distinct()
    patch = f.where("n % 5 = 0").select(F.col("event_id").alias("correction_id"), F.lit("track").alias("scope"), "job_id", F.col("track_id").cast("string").alias("target_id"), "match_id", F.lit("edit").alias("action"),
        F.create_map(F.lit("team"), F.floor("value").cast("string")).alias("fields"), F.timestamp_micros((F.col("t_seconds") * 1_000_000).cast("long")).alias("created_at"))
    return corrections.apply_track_corrections(tracks, patch).select("job_id", "track_id", "team")


@query(f"""with {A.FACTS}, m as (select team, match_id, count(*) as v from facts group by 1, 2), n as (select *, row_number() over (partition by team order by match_id) as k from m)
select a.team, cast(a.k as integer) as k, round(avg(b.v), 6) as expected, max(a.v) as actual from n a join n b on a.team = b.team and b.k < a.k where a.k > 2 group by a.team, a.k""")
def expanding_prediction(spark: SparkSession, sf: str) -> DataFrame:
    """Each match's count against the mean of all earlier ones of its team."""
    m = A.facts(spark, sf).groupBy("team", "match_id").agg(F.count("*").alias("v"))
    return profile.expanding(m, "team", "match_id", ["v"], 2).select("team", "k", F.round("h_v", 6).alias("expected"), F.col("v").alias("actual"))


def _marks(spark: SparkSession, sf: str) -> DataFrame:
    return A.facts(spark, sf).groupBy("team", F.col("event_type").alias("key")).agg((F.count("*") / 100).alias("weight")).withColumn("kind", F.lit("zones"))


_CONFLICT = f"{A.FACTS}, w as (select team, event_type, count(*) / 100 as weight from facts group by 1, 2), c as (select a.team as a_team, b.team as b_team, round_even(sum(least(a.weight, b.weight)), 3) as total from w a join w b on a.event_type = b.event_type and a.team <> b.team group by 1, 2)"


@query(f"with {_CONFLICT} select * from c")
def conflict_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """What each team would contest with each other team; the result grows with the square of the teams."""
    return plan.conflicts(_marks(spark, sf), None).select("a_team", "b_team", "total")


@query(f"""with {_CONFLICT}, p as (select team, count(*) / 10 as power from facts group by team), s as (select b_team as team, sum(total) as c from c where a_team in (1, 2) and b_team not in (1, 2) group by 1)
select p.team, round_even(power, 1) as power, round_even(coalesce(c, 0::double), 3) as conflict, round_even(power - 2 * coalesce(c, 0::double), 2) as score from p left join s using (team) where p.team not in (1, 2) order by score desc, power desc, team limit 18""")
def partner_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The best eighteen partners for two teams."""
    f = A.facts(spark, sf)
    power = f.groupBy("team").agg((F.count("*") / 10).alias("launches_per_match"))
    return plan.rank_partners([1, 2], None, power, _marks(spark, sf))


@query("""with p as (select vec_id, cast(embedding as double[]) as e, lag(cast(embedding as double[])) over (partition by label order by vec_id) as b from embeddings)
select vec_id, round(list_dot_product(e, b) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(b, b))), 6) as cosine from p where b is not null""")
def cosine_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of each vector with the one before it in its label."""
    e = A.table(spark, sf, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    return e.withColumn("b", F.lag("e").over(Window.partitionBy("label").orderBy("vec_id"))).where("b is not null").select("vec_id", F.round(X.cosine(F.col("e"), F.col("b")), 6).alias("cosine"))


@query(f"with {A.FACTS}, c as (select event_type as alliance, team, count(*) as n from facts group by 1, 2), r as (select *, row_number() over (partition by alliance order by n desc, team) as rn from c where n > 5) select alliance, list_sort(list(team))::varchar as teams from r where rn <= 3 group by alliance")
def roster_majority(spark: SparkSession, sf: str) -> DataFrame:
    """The three most frequent teams of each type."""
    c = A.facts(spark, sf).groupBy(F.col("event_type").alias("alliance"), "team").agg(F.count("*").alias("n"))
    return identity.roster_from_counts(c, 10).select("alliance", F.concat(F.lit("["), F.array_join(F.col("teams").cast("array<string>"), ", "), F.lit("]")).alias("teams"))


@query("""with c as (select source as segment, n_chars % 8 as found, n_chars % 7 as truth from documents)
select segment, count(*) as frames, round_even(avg(found), 3) as mean_robots, count(*) filter (where found = 0) as blind, count(*) filter (where found >= 6) as "full",
  round_even(count(*) filter (where found >= 6) / count(*), 4) as full_share, round_even(sum(least(found, truth)) / sum(truth), 4) as ceiling_recall from c group by rollup (segment)""")
def held_out_report(spark: SparkSession, sf: str) -> DataFrame:
    """Frame counts per segment and in total."""
    d = A.table(spark, sf, "documents")
    return datasets.held_out_report(d.select(F.col("source").alias("segment"), F.col("doc_id").alias("frame_id"), (F.col("n_chars") % 8).alias("found"), (F.col("n_chars") % 7).alias("truth")))


@query("""with m as (select o_orderkey, case when o_orderkey % 5 = 0 then 'practice ' || o_orderkey else '2024ev_' || ['qm', 'ef', 'qf', 'sf', 'f'][o_orderkey % 5 + 1] || o_orderkey || case when o_orderkey % 2 = 0 then 'm' || o_orderkey % 3 else '' end end as id from orders)
select o_orderkey, case when o_orderkey % 5 = 0 then id else '2024ev' end as event, case when o_orderkey % 5 = 0 then 9 else cast(o_orderkey % 5 as integer) end as level,
  case when o_orderkey % 5 = 0 then 0 else cast(o_orderkey as integer) end as number, case when o_orderkey % 5 <> 0 and o_orderkey % 2 = 0 then cast(o_orderkey % 3 as integer) else 0 end as game from m""")
def match_key_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of match ids."""
    n = F.col("o_orderkey")
    level = F.element_at(F.array(*map(F.lit, X.LEVELS)), (n % 5 + 1).cast("int"))
    key = F.when(n % 5 == 0, F.concat(F.lit("practice "), n.cast("string"))).otherwise(F.concat(F.lit("2024ev_"), level, n.cast("string"), F.when(n % 2 == 0, F.concat(F.lit("m"), (n % 3).cast("string"))).otherwise("")))
    return A.table(spark, sf, "orders").select("o_orderkey", X.match_order(key).alias("k")).select("o_orderkey", "k.*")


@query("""with u as (select doc_id, ('0x' || substr(sha256('s1:' || source), 1, 16))::ubigint::double / pow(2::double, 64) as u from documents)
select doc_id, case when u < 0.8 then 'train' when u < 0.9 then 'valid' else 'test' end as split from u""")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    """Train, valid and test by the hash of a group."""
    return datasets.with_group_split(A.table(spark, sf, "documents").select("doc_id", "source"), "source", "s1").select("doc_id", "split")


@query()
def crc_split(spark: SparkSession, sf: str) -> DataFrame:
    """The same by CRC-32 of a page's address; SQL has no CRC here."""
    return datasets.with_split(A.table(spark, sf, "pages").select("page_id", F.col("url").alias("name"))).select("page_id", "split")


@query("select doc_id, source, lang from (select *, row_number() over (partition by source, lang order by n_chars desc, doc_id) as rn from documents) where rn <= 3")
def dedupe_keep_k(spark: SparkSession, sf: str) -> DataFrame:
    """The three longest documents of each source and language."""
    return datasets.keep_first(A.table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars"), ["source", "lang"], [F.desc("n_chars"), F.asc("doc_id")], 3).select("doc_id", "source", "lang")


@query("""select coalesce(a.s_suppkey, b.s_suppkey) as row_key, case when b.s_suppkey is null then 'kept' when a.s_suppkey is null then 'appended' when a.s_acctbal = b.s_acctbal then 'skipped' else 'changed' end as change, coalesce(b.s_acctbal, a.s_acctbal) as s_acctbal
from (select s_suppkey, s_acctbal from supplier where s_suppkey % 4 <> 0) a full join (select s_suppkey, case when s_suppkey % 3 = 0 then s_acctbal + 1 else s_acctbal end as s_acctbal from supplier where s_suppkey % 5 <> 0) b on a.s_suppkey = b.s_suppkey""")
def keyed_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Merge of two snapshots by key."""
    s = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_key"), "s_acctbal")
    new = s.where("row_key % 5 <> 0").withColumn("s_acctbal", F.when(F.col("row_key") % 3 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    return sinks.keyed_merge(s.where("row_key % 4 <> 0"), new)


@query("""with m as (select o_orderdate::date as day, min(o_orderkey) as k from orders where o_orderkey % 7 = 0 group by 1), d as (select distinct o_orderdate::date as day from orders)
select cast(d.day as varchar) as day, cast((select max_by(k, m.day) from m where m.day <= d.day) as varchar) as name from d""")
def history_asof(spark: SparkSession, sf: str) -> DataFrame:
    """For each day, the latest model up to it."""
    o = A.table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    models = o.where("o_orderkey % 7 = 0").groupBy(F.col("day").alias("trained_on")).agg(F.min("o_orderkey").cast("string").alias("name")).withColumn("score", F.lit(1.0))
    return datasets.history(models, o.select("day").distinct()).select(F.col("day").cast("string").alias("day"), "name")


@query("select cast(day as varchar) as day, round_even(sum(n) over (order by day) / (select count(*) from orders), 4) as share from (select o_orderdate::date as day, count(*) as n from orders group by 1)")
def cumulative_share(spark: SparkSession, sf: str) -> DataFrame:
    """Share of orders placed by each day."""
    o = A.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("day"))
    return datasets.cumulative_share(o, o.count())


@query(f"""with {A.FACTS}, f as (select *, t_seconds - lag(t_seconds) over (partition by team, match_id, event_type order by t_seconds, event_id) as since from facts),
e as (select team, match_id, count(*) filter (where event_type = 'shot_made') as scored, cast(coalesce(sum({_POINTS}) filter (where event_type = 'shot_made'), 0) as bigint) as points, round(median(since) filter (where event_type = 'reload'), 7) as cycle from f group by 1, 2)
select *, round(avg(points) over (partition by team order by match_id rows between 2 preceding and current row), 6) as forecast from e""")
def scouting_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Declared metrics per team and match with a moving average."""
    f = A.facts(spark, sf).join(F.broadcast(_seasons(spark).drop("season")))
    m = [metrics.Metric("scored", "count", "shot_made"), metrics.Metric("points", "points", "shot_made"), metrics.Metric("cycle", "median_seconds", "reload")]
    out = metrics.evaluate(f, m, X.points_for(F.col("phase"), F.col("goal"), F.col("point_values")))
    return metrics.forecast(out, "match_id", "points").select("team", "match_id", "scored", "points", _r("cycle", 7), _r("forecast", 6))


@query(f"""with {A.FACTS}, a as (select distinct team from facts where event_type = 'reload' and n % 2 = 0), b as (select distinct team from facts where event_type = 'shot_made' and n % 3 = 0)
select 'union' as op, team from (select team from a union select team from b) union all select 'intersect', team from (select team from a intersect select team from b) union all select 'except', team from (select team from a except select team from b)""")
def set_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Union, intersection and difference of two rosters."""
    f = A.facts(spark, sf)
    a, b = f.where("event_type = 'reload' and n % 2 = 0").select("team").distinct(), f.where("event_type = 'shot_made' and n % 3 = 0").select("team").distinct()
    named = lambda name, df: df.select(F.lit(name).alias("op"), "team")
    return named("union", a.union(b).distinct()).union(named("intersect", a.intersect(b))).union(named("except", a.exceptAll(b)))


@query("""select 'documents_without_label' as "check", count(*) as n from documents where doc_id not in (select doc_id from labels) union all select 'labels_without_document', count(*) from labels where doc_id not in (select doc_id from documents)
union all select 'repeated_text', count(*) from (select text from documents group by text having count(*) > 1)""")
def anti_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without partners and repeated texts."""
    d, lab = A.table(spark, sf, "documents").select("doc_id", "text"), A.table(spark, sf, "labels")
    one = lambda name, df: df.agg(F.lit(name).alias("check"), F.count("*").alias("n"))
    return one("documents_without_label", quality.orphans(d, lab, ["doc_id"])).union(one("labels_without_document", quality.orphans(lab, d, ["doc_id"]))).union(one("repeated_text", quality.duplicates(d, ["text"])))


@query(f"""with {A.FACTS} select problem, count(*) as n from (
  select 'confidence out of range' as problem from facts where n % 17 = 0 union all select 'goal on something else than a shot' from facts where goal is not null and event_type not like 'shot%'
  union all select 'goal: low' from facts where goal = 'low' union all select 'team not positive' from facts where team <= 0) group by problem""")
def event_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Contract violations by kind."""
    f = A.facts(spark, sf).withColumn("confidence", F.when(F.col("n") % 17 == 0, 2.0).otherwise(F.col("confidence")))
    return quality.violations(quality.split(f, quality.event_problems(["high"]))[1])


@query(f"""with {A.FACTS}, s as (select *, sum(case when event_type = 'shot_made' then 1 else 0 end) over (partition by match_id order by t_seconds range between unbounded preceding and current row) as total from facts) select event_id, cast(total as bigint) as total from s""")
def running_score(spark: SparkSession, sf: str) -> DataFrame:
    """Shots made up to each event of a match."""
    return temporal.running_total(A.facts(spark, sf), ["match_id"], "t_seconds", (F.col("event_type") == "shot_made").cast("int")).select("event_id", "total")


@query(f"""with {A.FACTS}, w as (select *, t_seconds - lag(t_seconds) over o as dt, field_x - lag(field_x) over o as dx, field_y - lag(field_y) over o as dy from facts window o as (partition by match_id order by t_seconds))
select event_id, case when dt > 0 and dt <= 1000 and sqrt(dx * dx + dy * dy) / dt <= 0.5 then round(sqrt(dx * dx + dy * dy) / dt, 6) end as speed from w""")
def field_motion(spark: SparkSession, sf: str) -> DataFrame:
    """Speed between placed rows, implausible ones null."""
    f = A.facts(spark, sf).withColumn("t", F.col("t_seconds"))
    return temporal.field_motion(f, ["match_id"], 1.5 / 1000, 0.5).select("event_id", F.round("speed_ftps", 6).alias("speed"))


@query(f"""with {A.FACTS}, w as (select *, lag(t_seconds) over o as t0, lag(field_x) over o as x0 from facts window o as (partition by match_id order by t_seconds)) select match_id, t0 as start, t_seconds as "end", case when least(field_x, x0) <= 5 then 'out_of_frame' else 'occlusion' end as reason from w where t_seconds - t0 > 600""")
def gap_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Holes over ten minutes and whether they began or ended at the edge."""
    f = A.facts(spark, sf).select("match_id", F.col("t_seconds").alias("t"), F.col("field_x").alias("x"), F.lit(-1000.0).alias("w"), F.lit(1000.0).alias("y"), F.lit(-2000.0).alias("h"))
    return temporal.gaps_of(f, ["match_id"], 1.5 / 600, 5.0)


@query("""with c as (select l_orderkey, count(*) as n from lineitem group by 1) select n, count(*) as frames from c group by n""")
def box_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Frames by number of boxes."""
    return A.boxes(spark, sf).groupBy("frame_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("frames"))


@query("""with b as (select l_quantity / 100 as x, (l_extendedprice % 50::double) / 100 as y, 0.2::double as w, 0.2::double as h, l_discount * 5 + 0.3::double + l_linenumber / 1000::double as confidence from lineitem)
select case when x + w > 1.000001 or y + h > 1.000001 then 'invalid' when confidence < 0.35 then 'low_confidence' when x + w / 2 > 0.5 or y + h / 2 > 0.5 then 'outside_region' else 'none' end as reason, count(*) as n from b group by 1""")
def box_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Why boxes are refused."""
    rule = fusion.box_problem(least_confidence=0.35, roi=(0.0, 0.0, 0.5, 0.5))
    return A.boxes(spark, sf).groupBy(F.coalesce(rule, F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query("""select l_suppkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_extendedprice, l_partkey) - 1 as i,
  greatest(1, ceil(count(*) over (partition by l_suppkey) / 60.0)) as step from lineitem) where i % cast(step as bigint) = 0""")
def strided_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Evenly strided rows of each supplier, sixty at most."""
    li = A.table(spark, sf, "lineitem")
    return datasets.strided(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"], 60).select("l_suppkey", "l_orderkey", "l_linenumber")


@query(f"""with {A.SAMPLES}, s as (select * from samples where phase in ('auto', 'teleop', 'endgame'))
select job_id, robot_key, round_even(count(*) * 0.1::double, 1) as observed_s, round_even(count(ax) * 0.1::double, 1) as positioned_s, round_even(count(ax) * 0.1::double / 50, 3) as positioned_share from s group by 1, 2""")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds observed and placed."""
    return features.coverage(A.samples(spark, sf), 50.0, 0.1)


@query(f"""with {A.SAMPLES} select job_id, robot_key, max(t) as last_launch_mt, round_even(2 - max(t), 1) as stopped_scoring_before_endgame_s from samples group by 1, 2""")
def endgame(spark: SparkSession, sf: str) -> DataFrame:
    """Last launch of each robot and how long before the endgame it was."""
    s = A.samples(spark, sf)
    return features.endgame(s, s, 3.0, 1.0).select(*KEYS, "last_launch_mt", "stopped_scoring_before_endgame_s")


@query(f"""with {A.SAMPLES}, h as (select *, case when (speed >= 0.5) = (lag(speed) over w >= 0.5) then 0 else 1 end as brk from samples window w as (partition by job_id, robot_key order by k)),
r as (select *, sum(brk) over (partition by job_id, robot_key order by k) as run from h)
select job_id, robot_key, min(t) as first, max(t) as last, count(*) as n from r where speed >= 0.5 group by job_id, robot_key, run having count(*) >= 2""")
def runs_above(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of two or more fast samples."""
    return temporal.runs_above(A.samples(spark, sf), KEYS, "t", "speed", 0.5, 2)


@query(f"""with {A.FACTS} select case when n % 4 <> 0 then cast(team as varchar) when n % 8 <> 0 then 'unattributed' else 'match' end as lane, count(*) as n from facts group by 1""")
def event_lanes(spark: SparkSession, sf: str) -> DataFrame:
    """Events by display lane."""
    f = A.facts(spark, sf)
    f = f.withColumn("team", F.when(F.col("n") % 4 != 0, F.col("team"))).withColumn("track_id", F.when(F.col("n") % 8 != 0, F.col("track_id")))
    return f.groupBy(quality.lane_of_event().alias("lane")).agg(F.count("*").alias("n"))


@query(f"""with {A.FACTS}, l as (select * from facts where event_type = 'shot_made'),
g as (select team, match_id, t_seconds, event_id, case when t_seconds - lag(t_seconds) over w <= 3 then 0 else 1 end as first from l window w as (partition by match_id, team order by t_seconds, event_id)),
v as (select team, match_id, sum(first) over (partition by match_id, team order by t_seconds, event_id) as volley, t_seconds from g)
select match_id as job_id, team, cast(volley as bigint) as volley, min(t_seconds) as start, count(*) as launches from v group by 1, 2, 3""")
def volleys(spark: SparkSession, sf: str) -> DataFrame:
    """Visits to shoot."""
    f = A.facts(spark, sf).where("event_type = 'shot_made'")
    launches = f.select("job_id", F.concat(F.lit("team:"), "team").alias("robot_key"), F.col("event_id").alias("shot_id"), F.col("t_seconds").alias("t"), F.col("field_x").alias("ax"), F.col("field_y").alias("ay"))
    return features.volleys(launches).select("job_id", F.split("robot_key", ":")[1].cast("int").alias("team"), "volley", "start", "launches")


@query("""select s_suppkey, s_acctbal from supplier where s_suppkey % 2 = 0 union all select s_suppkey, s_acctbal + 1 from supplier where s_suppkey % 2 <> 0""")
def fallback_source(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a first source, and of a second where the first has none."""
    from matchlake.sources.readers import first_of

    sup = A.table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return first_of(sup.where("s_suppkey % 2 = 0"), sup.withColumn("s_acctbal", F.col("s_acctbal") + 1), ["s_suppkey"])


@query()
def shooting_spots(spark: SparkSession, sf: str) -> DataFrame:
    """Leader clusters of each robot's places; an order-sensitive fold without SQL form."""
    s = A.samples(spark, sf)
    return features.spots(s, 15.0, 13.0)


@query()
def suppressed_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy suppression per frame."""
    return fusion.non_max(A.boxes(spark, sf), 0.3)


@query()
def fused_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Fused boxes of two detectors, weighted by how often one backs the other."""
    b = A.boxes(spark, sf)
    return fusion.fuse(b, fusion.source_weights(b)).drop("supporting_sources")


def _features(spark: SparkSession, sf: str) -> DataFrame:
    s = A.samples(spark, sf)
    launches = s.select("job_id", "match_id", "robot_key", "team", "shot_id", "t", "mt", "phase", "ax", "ay", "speed", F.lit(1.0).alias("confidence"))
    return features.match_features(s, launches, A.SEASON | {"auto_seconds": 15.0}, {"field_length_ft": A.LENGTH, "hub_x": 15.0, "hub_y": 13.0})


@query()
def match_features(spark: SparkSession, sf: str) -> DataFrame:
    """All feature groups of every robot and match, with maps as their entries."""
    f = features.written(_features(spark, sf))
    entries = lambda group, *maps: F.when(F.col(group).isNotNull(), F.struct(*[F.map_entries(f"{group}.{c}").alias(c) if c in maps else F.col(f"{group}.{c}").alias(c) for c in f.schema[group].dataType.names])).alias(group)
    return f.select(
        "job_id", "robot_key", "team", "match_id", "alliance", "coverage.*", "movement.distance_ft", "shooting.volleys", "shooting.median_dwell_s", "defense.near_opponent_s",
        "movement", entries("zones", "auto_zones", "teleop_zones", "teleop_lanes"), "start", "auto_path", "shooting", "defense", "endgame", F.col("spots.list").alias("spots"),
        F.col("points.list").alias("points"), entries("launches", "by_phase"),
    )


@query()
def team_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles of every team over its matches."""
    found = profile.build_profiles(profile.written_features(_features(spark, sf)))
    return found.select("team", "n_matches", "n_with_positions", "launches_per_match", "start_lane", "median_dwell_s", "plays_defense", F.size("counters").alias("counters"))


@query()
def fitted_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Match clocks from readings that mostly agree."""
    f = A.facts(spark, sf)
    r = f.select("job_id", F.col("t_seconds").alias("t"), F.when(F.col("n") % 4 == 0, 7).otherwise((F.lit(70000) - F.floor("t_seconds")).cast("int")).alias("remaining"))
    return clock.match_clock(r, f, A.SEASON)


READINGS = f"""{A.FACTS}, readings as (select match_id as job_id, n, t_seconds as t, case when n % 4 = 0 then 7 when n % 9 <> 0 then cast(70000 - floor(t_seconds) as integer) end as remaining from facts)"""


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    f = A.facts(spark, sf)
    remaining = F.when(F.col("n") % 4 == 0, 7).when(F.col("n") % 9 != 0, (F.lit(70000) - F.floor("t_seconds")).cast("int"))
    return f.select("job_id", F.col("t_seconds").alias("t"), remaining.alias("remaining"))


@query(f"""with {READINGS}, z as (select job_id, t, t + remaining as zero from readings where remaining is not null),
v as (select *, count(*) over (partition by job_id order by zero range between 1 preceding and 1 following) as n from z),
b as (select *, row_number() over (partition by job_id order by n desc, t) as r from v)
select job_id, round(zero, 6) as anchor, n as agreeing from b where r = 1 and n >= 4""")
def timer_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """Where each day's timer shows zero."""
    return signals.match_anchor(_readings(spark, sf)).select("job_id", _r("anchor", 6), "agreeing")


@query(f"""with {READINGS}, c as (select job_id, remaining, count(*) as n, min(t) as first from readings where remaining is not null group by all)
select job_id, remaining as value from c qualify row_number() over (partition by job_id order by n desc, first) = 1""")
def common_reading(spark: SparkSession, sf: str) -> DataFrame:
    """The timer value read most often each day."""
    return signals.common_reading(_readings(spark, sf).withColumnRenamed("remaining", "value"))


@query(f"""with {A.FACTS}, b as (select match_id as job_id, team as track_id, t_seconds as t from facts where event_type = 'shot_made'),
e as (select match_id as job_id, team as track_id, event_id, event_type, t_seconds from facts where event_type <> 'shot_made')
select b.job_id, b.track_id, b.t / 1000 as t, e.event_id, e.event_type from b join e on b.job_id = e.job_id and b.track_id = e.track_id and abs(b.t / 1000 - e.t_seconds / 1000) < 0.6""")
def near_events(spark: SparkSession, sf: str) -> DataFrame:
    """Other events near the goals of a user, a thousand seconds taken as one."""
    f = A.facts(spark, sf).withColumn("t_seconds", F.col("t_seconds") / 1000)
    goals = f.where("event_type = 'shot_made'").select("job_id", "track_id", F.col("t_seconds").alias("t"))
    return overlay.near_events(goals, f.where("event_type <> 'shot_made'"))


@query(f"""with {A.FACTS}, g as (select match_id as job_id, t_seconds as start, case when n % 10 <> 0 then t_seconds + 60 end as "end" from facts where event_type = 'defense_end' and n % 5 = 0)
select f.match_id as job_id, f.event_id, exists (select 1 from g where g.job_id = f.match_id and g.start <= f.t_seconds and (g."end" is null or f.t_seconds < g."end")) as paused from facts f""")
def paused_instants(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each event falls in a gap of its day."""
    f = A.facts(spark, sf)
    gaps = f.where("event_type = 'defense_end' and n % 5 = 0").select("job_id", F.col("t_seconds").alias("start"), F.when(F.col("n") % 10 != 0, F.col("t_seconds") + 60).alias("end"))
    return overlay.paused(f.select("job_id", "event_id", F.col("t_seconds").alias("at")), gaps).select("job_id", "event_id", "paused")


@query("select event_type, count(*) as n from events group by event_type")
def event_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """How often each kind of event occurs."""
    return overlay.kinds(A.table(spark, sf, "events"), "event_type")


@query()
def signal_pulses(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks of every user's values over time."""
    f = A.facts(spark, sf).select("job_id", "team", F.col("t_seconds").alias("t"), "value")
    return signals.pulses(f, ["job_id", "team"], 5.0, 0.25)


@query(f"""with {A.FACTS}, p as (select team, match_id, t_seconds / 3600 as h, min(value) as v from facts where event_type = 'shot_attempt' group by 1, 2, 3),
a as (select event_id, team, match_id, t_seconds / 3600 + 0.05::double as q from facts where event_type = 'reload'),
b as (select a.*, max(case when p.h <= a.q then p.h end) as h1, min(case when p.h > a.q then p.h end) as h2 from a left join p on a.team = p.team and a.match_id = p.match_id group by all),
c as (select b.*, p1.v as v1, p2.v as v2 from b left join p p1 on b.team = p1.team and b.match_id = p1.match_id and b.h1 = p1.h left join p p2 on b.team = p2.team and b.match_id = p2.match_id and b.h2 = p2.h)
select team, match_id, round(q, 6) as asked, round(case when abs(h1 - q) <= 1e-5 then v1 when h2 - h1 <= 3 then v1 + (v2 - v1) * ((q - h1) / (h2 - h1)) end, 6) as value from c""")
def interpolated_values(spark: SparkSession, sf: str) -> DataFrame:
    """A user's value three minutes after each sign-up, between clicks at most three hours apart."""
    f = A.facts(spark, sf)
    clicks = f.where("event_type = 'shot_attempt'").select("team", "match_id", (F.col("t_seconds") / 3600).alias("h"), "value")
    asked = f.where("event_type = 'reload'").select("team", "match_id", (F.col("t_seconds") / 3600 + 0.05).alias("at"))
    return temporal.interpolate_at(clicks, asked, ["team", "match_id"], "h", ["value"], 3.0).select("team", "match_id", F.round("at", 6).alias("asked"), _r("value", 6))


@query("""with j as (select cast(o_orderkey as varchar) as job_id, case when o_orderkey % 7 <> 0 then 'm' || o_orderkey end as match_id, o_totalprice / 1000 as duration from orders),
e as (select *, 'match_start' as event_type, 0::double as t_seconds from j where match_id is not null union all select *, 'match_end', greatest(0::double, duration) from j where match_id is not null),
h as (select *, sha256(job_id || '|' || event_type) as d from e)
select job_id, match_id, event_type, t_seconds, case when t_seconds < 15 then 'auto' when t_seconds < 120 then 'teleop' when t_seconds <= 150 then 'endgame' else 'unknown' end as phase,
  substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4) || '-' || substr(d, 17, 4) || '-' || substr(d, 21, 12) as event_id, 'model' as source from h""")
def match_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Start and end facts of orders as recordings."""
    o = A.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    jobs = o.select(key.cast("string").alias("job_id"), F.when(key % 7 != 0, F.concat(F.lit("m"), key.cast("string"))).alias("match_id"), F.lit(2024).alias("season"), (F.col("o_totalprice") / 1000).alias("duration"))
    rules = spark.createDataFrame([(2024, 15.0, 135.0, 30.0)], "season int, auto_seconds double, teleop_seconds double, endgame_seconds double")
    return facts.match_bounds(jobs, rules).select("job_id", "match_id", "event_type", "t_seconds", "phase", "event_id", "source")


@query("""select cast(doc_id as varchar) as stem from documents where doc_id % 3 <> 0 and doc_id % 5 <> 0""")
def reviewed_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as frames that a human has looked at."""
    d = A.table(spark, sf, "documents").select("doc_id")
    manifest = d.select(F.concat(F.lit("pack/images/"), "doc_id", F.lit(".jpg")).alias("image"), F.when(F.col("doc_id") % 3 == 0, "proposed").otherwise("done").alias("status"), (F.col("doc_id") % 5 == 0).alias("human_review_required"))
    return datasets.reviewed_frames(manifest)


@query("""with d as (select rpad(source, 11, '_') as video, source, n_chars % 8 as c from documents)
select case when length(source) % 2 = 0 then upper(source) else video end as label, count(*) as frames, count(*) filter (where c >= 6) as done from d group by 1""")
def event_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as frames of their source's event."""
    d = A.table(spark, sf, "documents")
    video = F.rpad("source", 11, "_")
    frames = d.select(F.concat(video, F.lit("_"), F.col("doc_id").cast("string")).alias("stem"), (F.col("n_chars") % 8).alias("count"))
    events = d.where(F.length("source") % 2 == 0).select(video.alias("video"), F.concat(F.lit("2024"), "source").alias("event")).distinct()
    return datasets.by_event(frames, events)


@query("""with f as (select l_suppkey as robot, cast(l_orderkey as double) as start, l_orderkey + l_quantity as "end" from lineitem),
s as (select *, max("end") over (partition by robot order by start, "end" rows between unbounded preceding and 1 preceding) as seen from f)
select robot, seen as start, start as "end", 'detection_lost' as reason from s where start > seen""")
def fragment_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Holes between a supplier's line items as fragments of a robot's track."""
    li = A.table(spark, sf, "lineitem")
    return facts.merged_gaps(li.select(F.col("l_suppkey").alias("robot"), F.col("l_orderkey").cast("double").alias("start"), (F.col("l_orderkey") + F.col("l_quantity")).alias("end")), ["robot"])


@query("""with p as (select p_partkey, cast(p_size * 100 as bigint) as total from part),
o as (select p_partkey, total, unnest(case when total <= 640 then [0::bigint] else list_distinct(list_concat(range(0, total - 639, 512), [total - 640])) end) as origin from p)
select p_partkey, origin, origin > 0 and 0.001::double * (p_partkey % 5) <= 2 / 640::double or 0.5::double + 0.1::double * (p_partkey % 6) >= 1 - 2 / 640::double and origin + 640 < total as clipped,
  round((0.001::double * (p_partkey % 5) * 640 + origin) / total, 9) as x from o""")
def tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles along sides of a part's size, and a box of each tile in the frame's terms."""
    p = A.table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 100).cast("long").alias("total"))
    t = p.withColumn("origin", F.explode(datasets.tile_origins(F.col("total"), F.lit(640), 0.2)))
    x = 0.001 * (F.col("p_partkey") % 5)
    box = F.struct(x.alias("x"), F.lit(0.4).alias("y"), (0.5 + 0.1 * (F.col("p_partkey") % 6) - x).alias("w"), F.lit(0.1).alias("h"))
    tile = F.struct(F.col("origin").alias("x"), F.lit(0).alias("y"), F.lit(640).alias("w"), F.lit(640).alias("h"))
    mapped = datasets.from_tile(box, tile, F.col("total"), F.lit(640))
    return t.select("p_partkey", "origin", datasets.clipped_by_tile(box, tile, F.col("total"), F.lit(640)).alias("clipped"), F.round(mapped["x"], 9).alias("x"))


@query("""with o as (select o_orderkey, o_totalprice / 100 as total, o_orderkey % 400 as u, case when o_orderkey % 3 = 0 then cast(o_orderkey % 250 as double) end as stop from orders),
w as (select *, least(total, case when stop > u then stop else total end) as fin from o where u < total)
select o_orderkey, cast(u as double) as start, round(fin - u, 6) as duration, u = 0 and abs(fin - u - total) < 0.001 as whole from w""")
def media_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as recordings that begin at the time in their address."""
    key = F.col("o_orderkey")
    url = F.concat(F.lit("https://example.org/watch?v=abcdefghijk&t="), (key % 400).cast("string"), F.lit("s"))
    w = facts.media_window(url, F.col("o_totalprice") / 100, [F.lit(None)], [F.when(key % 3 == 0, key % 250)])
    return A.table(spark, sf, "orders").select("o_orderkey", w.alias("w")).where("w is not null").select("o_orderkey", "w.start", F.round("w.duration", 6).alias("duration"), "w.whole")


@query("""with f as (select l_discount * 6 as flat, l_extendedprice % 200::double as bright, l_quantity as spread from lineitem)
select case when flat > 0.42 then 'graphic_card' when bright > 175 then 'overbright_graphic' when bright < 35 then 'too_dark' when spread < 18 then 'no_contrast' else 'ok' end as verdict, count(*) as n from f group by 1""")
def frame_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as measured frames, by why they are refused."""
    li = A.table(spark, sf, "lineitem")
    verdict = datasets.frame_verdict(F.lit(True), F.col("l_discount") * 6, F.pmod(F.col("l_extendedprice"), F.lit(200.0)), F.col("l_quantity"))
    return li.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""with {A.FACTS}, w as (select event_id, field_x as qx, field_y as qy, lag(field_x) over o as px, lag(field_y) over o as py from facts window o as (partition by match_id, team order by t_seconds, event_id)),
t as (select *, (qx - px) * (10 - py) - (qy - py) * (10 - px) as o1, (qx - px) * (20 - py) - (qy - py) * (40 - px) as o2, 30 * (py - 10) - 10 * (px - 10) as o3, 30 * (qy - 10) - 10 * (qx - 10) as o4 from w where px is not null)
select event_id, (qx - px) * 1 + (qy - py) * 0.5::double > 0 and (o1 * o2 < 0 and o3 * o4 < 0
  or abs(o1) <= 1e-9 and 10 between least(px, qx) and greatest(px, qx) and 10 between least(py, qy) and greatest(py, qy)
  or abs(o2) <= 1e-9 and 40 between least(px, qx) and greatest(px, qx) and 20 between least(py, qy) and greatest(py, qy)
  or abs(o3) <= 1e-9 and px between 10 and 40 and py between 10 and 20 or abs(o4) <= 1e-9 and qx between 10 and 40 and qy between 10 and 20) as crossed from t""")
def directed_crossings(spark: SparkSession, sf: str) -> DataFrame:
    """Moves of a user's day that cross a line from left to right."""
    w = Window.partitionBy("match_id", "team").orderBy("t_seconds", "event_id")
    f = A.facts(spark, sf).withColumn("px", F.lag("field_x").over(w)).withColumn("py", F.lag("field_y").over(w)).where("px is not null")
    line = (F.lit(10.0), F.lit(10.0)), (F.lit(40.0), F.lit(20.0))
    return f.select("event_id", X.crosses_directed((F.col("px"), F.col("py")), (F.col("field_x"), F.col("field_y")), *line, (1.0, 0.5)).alias("crossed"))


@query(f"""with {A.POINTS}, p as (select ax / 60 * 24 as gx, ay / 29 * 12 as gy from points where team % 3 = 0), o as (select unnest(range(-2, 3)) as d),
s as (select floor(gx) + a.d as ix, floor(gy) + b.d as iy, gx, gy from p, o a, o b),
m as (select cast(ix as bigint) as ix, cast(iy as bigint) as iy, sum(exp(-(pow(ix + 0.5::double - gx, 2) + pow(iy + 0.5::double - gy, 2)) / (2 * 1.6::double * 1.6::double))) as mass from s where ix between 0 and 23 and iy between 0 and 11 group by 1, 2)
select ix, iy, round(mass / max(mass) over (), 6) as density from m""")
def launch_density(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed density of every third supplier's launch places on a coarse grid."""
    p = A.points(spark, sf).where("team % 3 = 0").select(F.lit("all").alias("k"), (F.col("ax") / 60).alias("x"), (F.col("ay") / 29).alias("y"))
    return stats.density(p, ["k"], 24, 12, reach=2).select("ix", "iy", _r("density", 6))


def _frames_of(spark: SparkSession, sf: str) -> DataFrame:
    """Users of a day as balls: their events in order, thirty frames a second, as shares of the frame."""
    f = A.facts(spark, sf)
    place = F.row_number().over(Window.partitionBy("job_id", "team").orderBy("t_seconds", "event_id"))
    return f.select("job_id", F.col("team").alias("ball"), place.cast("long").alias("frame"), (place / 30).alias("t"), (F.col("field_x") / A.LENGTH).alias("x"), (F.col("field_y") / A.WIDTH).alias("y"), F.lit(0.01).alias("r"))


GATE = flights.Gate(
    "high", "high_1", (1.0, 0.0), made=flights.Boundary((0.5, 0.0), (0.5, 1.0), (1.0, 0.0), 0.0), approach=flights.Boundary((0.3, 0.0), (0.3, 1.0), (1.0, 0.0), 0.0),
    interior=((0.2, 0.0), (1.0, 0.0), (1.0, 1.0), (0.2, 1.0)), depth=1.0, open_edge=True,
)


@query(f"""with {A.FACTS}, b as (select match_id as job_id, team as ball, row_number() over o as frame, row_number() over o / 30::double as t, field_x / 54 as x, field_y / 27 as y
  from facts window o as (partition by match_id, team order by t_seconds, event_id)),
m as (select *, lag(x) over w as px from b window w as (partition by job_id, ball order by frame)),
c as (select *, (x - px) * 1920 as step, greatest(0.01::double * sqrt(1920 * 1920 + 1080 * 1080), 1) as radius, x > 0.2 and y > 0 as inside from m),
s as (select *, case when px < 0.3::double and x >= 0.3::double or px = 0.3::double and x > px then t end as arm_t, case when step < -0.25::double * radius then t end as back_t, coalesce(step > 0, false) as inward from c),
a as (select *, last_value(arm_t ignore nulls) over w as armed, last_value(back_t ignore nulls) over w as backed, sum(case when inward and inside then 1 else 0 end) over w as sights from s
  window w as (partition by job_id, ball order by frame rows between unbounded preceding and current row)),
e as (select *, case when (px < 0.5::double and x >= 0.5::double or px = 0.5::double and x > px) and t - armed <= 0.3::double and (backed is null or backed < armed)
  then [frame, t, sights - case when inward and inside then 1 else 0 end] end as crossing from a),
l as (select *, last_value(crossing ignore nulls) over w as met from e window w as (partition by job_id, ball order by frame rows between unbounded preceding and current row)),
ok as (select *, (x - 0.5::double) * 1920 / radius as deep from l where met is not null and inside and inward and sights - met[3] >= 1 and (x - 0.5::double) * 1920 / radius >= 1 and t - met[2] <= 0.25::double
  and (backed is null or backed < met[2]))
select job_id, ball, min(frame) as frame, cast(arg_min(met[1], frame) as bigint) as crossing_frame, round(least(0.99::double, 0.7::double + 0.1::double * arg_min(deep, frame)), 6) as confidence from ok group by job_id, ball""")
def ball_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Where a user's day of places enters a goal in the right half."""
    return flights.goal_entries(_frames_of(spark, sf), [GATE], 1920, 1080).select("job_id", "ball", "frame", "crossing_frame", "confidence")


@query()
def tracked_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes and gaps of tracks over a day's minutes as frames; a state machine per day without SQL form."""
    f = A.facts(spark, sf)
    boxes = f.select("job_id", F.floor(F.col("t_seconds") / 60).cast("double").alias("t"), (F.col("field_x") / 60).alias("x"), (F.col("field_y") / 30).alias("y"), F.lit(0.1).alias("w"), F.lit(0.1).alias("h"))
    return tracking.track_boxes(boxes.dropDuplicates())


@query(f"""with recursive {A.FACTS}, p as (select distinct match_id as job_id, cast(floor(t_seconds / 900) as bigint) as frame, field_x * 30 as x, field_y * 30 as y from facts),
r as (select *, row_number() over (order by job_id, frame, x, y) as id from p),
n1 as (select a.id, b.id as next, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) as d from r a join r b on a.job_id = b.job_id and b.frame = a.frame + 1 where d <= 90),
m1 as (select id, next from (select *, row_number() over (partition by id order by d, next) as i, row_number() over (partition by next order by d, id) as j from n1) where i = 1 and j = 1),
n2 as (select a.id, b.id as next, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) as d from r a join r b on a.job_id = b.job_id and b.frame = a.frame + 2
  where d <= 180 and a.id not in (select id from m1) and b.id not in (select next from m1)),
m as (select id, next from m1 union all select id, next from (select *, row_number() over (partition by id order by d, next) as i, row_number() over (partition by next order by d, id) as j from n2) where i = 1 and j = 1),
c as (select id, id as root, 0 as place from r where id not in (select next from m) union all select m.next, c.root, c.place + 1 from c join m on m.id = c.id)
select r.job_id, r.frame, round(r.x, 6) as x, round(r.y, 6) as y, c.place, f.frame as first_frame, round(f.x, 6) as first_x, round(f.y, 6) as first_y
from c join r using (id) join r f on f.id = c.root""")
def tracked_balls(spark: SparkSession, sf: str) -> DataFrame:
    """Blobs of a day's quarter hours linked to the nearest of the next, or of the one after where that has none; where each track began."""
    f = A.facts(spark, sf)
    blobs = f.select("job_id", F.floor(F.col("t_seconds") / 900).alias("frame"), (F.col("field_x") * 30).alias("x"), (F.col("field_y") * 30).alias("y")).distinct()
    tracks = staged(chains.linked(blobs, ["job_id"], "frame", "x", "y", 90.0, missed=1))
    first = tracks.where("place = 0").select("track", F.col("frame").alias("first_frame"), _r("x", 6).alias("first_x"), _r("y", 6).alias("first_y"))
    return tracks.join(first, "track").select("job_id", "frame", _r("x", 6), _r("y", 6), "place", "first_frame", "first_x", "first_y")


@query(f"""with recursive p as (select distinct cast(user_id as integer) as team, epoch_us(ts) // 1000000 as s from events),
n as (select team, s, min(s) over (partition by team order by s range between 3600 following and unbounded following) as next from p),
k as (select team, min(s) as s from p group by team union all select k.team, n.next from k join n using (team, s) where n.next is not null)
select team, s from k""")
def spaced_events(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds at which a user acts, an hour or more after the last one kept."""
    e = A.table(spark, sf, "events").select(F.col("user_id").cast("int").alias("team"), F.floor(A.micros(F.col("ts")) / 1_000_000).alias("s"))
    return chains.spaced(e.distinct(), ["team"], "s", 3600)


@query("""with f as (select l_orderkey, l_linenumber, case when l_quantity < 5 then 'empty' when l_returnflag = 'A' then 'human' else 'machine' end as kind from lineitem),
n as (select count(*) filter (where kind = 'human') as human, count(*) filter (where kind = 'machine') as machine from f),
q as (select human, least(machine, cast(floor(human * 0.4::double / (1 - 0.4::double) + 1e-9) as bigint)) as machine from n),
r as (select *, row_number() over (partition by kind order by sha256('frames:' || l_orderkey || ':' || l_linenumber)) as i from f)
select l_orderkey, l_linenumber, kind from r, q
where i <= case kind when 'human' then human when 'machine' then q.machine else cast(floor((human + q.machine) * 0.05::double / (1 - 0.05::double) + 1e-9) as bigint) end""")
def capped_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as labelled frames: machine labels at most two fifths of all, empty frames a twentieth, sizes exact."""
    li = A.table(spark, sf, "lineitem")
    kept = sampling.capped(li, "l_returnflag = 'A'", "l_quantity < 5", ["l_orderkey", "l_linenumber"], machine_share=0.4, empty_share=0.05, seed="frames")
    return kept.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") < 5, "empty").when(F.col("l_returnflag") == "A", "human").otherwise("machine").alias("kind"))


@query()
def sure_identities(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers of an order given to discount classes, only where no other choice is as good; an exact assignment per frame."""
    li = A.table(spark, sf, "lineitem")
    s = li.groupBy(F.lit("j").alias("job_id"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("detection"), (F.col("l_partkey") % 3).alias("identity")).agg(F.max(F.when(F.col("l_discount") > 0, F.col("l_discount") * 10)).alias("score"))
    return assignment.resolve(s)


@query()
def assigned_launches(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases paired one to one with views of the same user and day within half an hour; a fold per chain."""
    f = A.facts(spark, sf)
    side = lambda kind: f.where(F.col("event_type") == kind).select("job_id", F.col("team").alias("robot"), F.col("event_id").alias("shot_id"), F.col("t_seconds").alias("t"))
    return balls.assign_shots(side("shot_made"), side("defense_start"), 1800.0)


@query(f"""with {A.FACTS}, s as (select *, lead(t_seconds) over (partition by match_id, team order by t_seconds, field_x, field_y) as next, max(t_seconds) over (partition by match_id) as stop from facts)
select match_id as job_id, team as track_id, round(t_seconds, 6) as t, event_type as owner from s
where coalesce(next, stop) - t_seconds > 7200 and field_x >= field_y and field_x < 27""")
def vanished_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Users whose day goes on without them for two hours after a place in a triangle of the field."""
    f = A.facts(spark, sf)
    s = f.select("job_id", F.col("team").alias("track_id"), F.col("t_seconds").alias("t"), F.col("field_x").alias("x"), F.col("field_y").alias("y"), F.col("event_type").alias("owner"))
    return balls.vanished(s, [(0.0, 0.0), (27.0, 0.0), (27.0, 27.0)], 7200.0).withColumn("t", F.round("t", 6))


@query(f"""with {A.FACTS}, i as (select distinct match_id, team, t_seconds as t from facts where event_type = 'shot_attempt'), o as (select distinct match_id, team, t_seconds as t from facts where event_type = 'defense_start'),
n as (select i.match_id, i.team, i.t as inner_t, o.t as outer_t from i asof join o on i.match_id = o.match_id and i.team = o.team and i.t <= o.t)
select match_id as job_id, team, round(max(inner_t), 6) as inner_t, round(outer_t, 6) as outer_t from n where outer_t - inner_t <= 1800 group by match_id, team, outer_t""")
def paired_pulses(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks and the views that follow them within half an hour, one to one."""
    f = A.facts(spark, sf)
    side = lambda kind: f.where(F.col("event_type") == kind).select("job_id", "team", F.col("t_seconds").alias("t"))
    return signals.paired_pulses(side("shot_attempt"), side("defense_start"), ["job_id", "team"], 1800.0).select("job_id", "team", _r("inner_t", 6), _r("outer_t", 6))


CONTRACT = contracts.Contract({
    "type": "object", "required": ["event_id", "event_type", "team"],
    "properties": {
        "event_id": {"type": "integer", "minimum": 10}, "event_type": {"type": "string", "enum": ["shot_attempt", "shot_made", "reload", "defense_start"]}, "team": {"type": "integer", "exclusiveMinimum": 3},
        "value": {"type": ["number", "null"], "maximum": 90}, "boxes": {"type": "array", "items": {"type": "object", "properties": {"x": {"type": "number", "maximum": 50}}}},
    },
})


@query(f"""with {A.FACTS}, v as (select case when n % 17 = 0 then '$.team' when n < 10 then '$.event_id' when event_type = 'defense_end' then '$.event_type' when team <= 3 then '$.team' when value > 90 then '$.value'
    when field_x > 50 or field_x + 1 > 50 then '$.boxes[].x' end as path,
  case when n % 17 = 0 then 'required' when n < 10 then 'minimum' when event_type = 'defense_end' then 'enum' when team <= 3 then 'exclusiveMinimum' else 'maximum' end as keyword from facts)
select path, keyword, count(*) as lines from v where path is not null group by 1, 2""")
def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON lines, counted by the first thing that breaks their contract."""
    f = A.facts(spark, sf)
    box = lambda x: F.struct(x.alias("x"))
    doc = F.struct(F.col("n").alias("event_id"), "event_type", F.when(F.col("n") % 17 != 0, F.col("team")).alias("team"), "value", F.array(box(F.col("field_x")), box(F.col("field_x") + 1)).alias("boxes"))
    _, bad = contracts.parsed(f.select(F.to_json(doc).alias("value")), CONTRACT)
    return bad.select("path", "keyword", "lines")


@query("""select o_orderkey, o_orderpriority, round(o_totalprice, 2) as o_totalprice from orders
where o_orderpriority > '3-MEDIUM' or o_orderpriority = '3-MEDIUM' and (o_totalprice < 100000 or o_totalprice = 100000 and o_orderkey > 500)
order by o_orderpriority, o_totalprice desc, o_orderkey limit 50""")
def library_page(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty orders that follow a given one in a library's order."""
    o = A.table(spark, sf, "orders")
    page = pages.page(o, ["o_orderpriority", "-o_totalprice", "o_orderkey"], 50, after={"o_orderpriority": "3-MEDIUM", "o_totalprice": 100000.0, "o_orderkey": 500})
    return page.select("o_orderkey", "o_orderpriority", _r("o_totalprice", 2))


@query(f"""with {A.FACTS}, c as (select team, t_seconds - lag(t_seconds) over (partition by match_id, team order by t_seconds, event_id) as seconds from facts where event_type = 'reload'),
b as (select team, count(seconds) as cycles, min(seconds) as best from c group by team),
p as (select team, sum({_POINTS}) as points from facts where event_type = 'shot_made' group by team)
select t.team, coalesce(cycles, 0) as cycles, round(best, 6) as best_cycle_seconds, coalesce(best = (select min(best) from b), false) as is_best, cast(points as bigint) as points
from (select distinct team from facts) t left join b on b.team = t.team left join p on p.team = t.team""")
def team_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles, the best of each team and of all, and points."""
    f = A.facts(spark, sf)
    return stats.team_cycles(f, _jobs(f), _seasons(spark)).select("team", "cycles", _r("best_cycle_seconds", 6), "is_best", F.col("points").cast("long").alias("points"))
