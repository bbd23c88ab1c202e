"""The given relational tables seen as match facts, so that every operator has data of any size to run on.

A user is a team, a day is a match, and a day's seconds are match time; clicks are attempts, purchases made shots,
sign-ups reloads, and views and errors open and close defence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"click": "shot_attempt", "purchase": "shot_made", "signup": "reload", "view": "defense_start", "error": "defense_end"}
SEASON = {"auto_seconds": 20000.0, "teleop_seconds": 60000.0, "endgame_seconds": 10000.0}
LENGTH, WIDTH = 54.0, 27.0
ZONES = [("own", 0.0, 15.0), ("neutral", 15.0, 39.0), ("opponent", 39.0, 54.0)]
LANES = [("right", 0.0, 9.0), ("centre", 9.0, 18.0), ("left", 18.0, 27.0)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event facts; confidence and field places come from the value, the goal from the id."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")]
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("n"), day.alias("job_id"), day.alias("match_id"), F.col("user_id").cast("int").alias("team"),
        F.col("user_id").cast("int").alias("track_id"), (F.pmod(micros(F.col("ts")), F.lit(86_400_000_000)) / 1_000_000).alias("t_seconds"), kind.alias("event_type"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"), F.when(F.col("event_id") % 3 == 0, "high").when(F.col("event_id") % 3 == 1, "low").alias("goal"),
        F.pmod(F.col("value"), F.lit(LENGTH)).alias("field_x"), F.pmod(F.col("value") * 3, F.lit(WIDTH)).alias("field_y"), F.lit("model").alias("source"), F.col("value"),
    ).withColumn("phase", _phase(F.col("t_seconds")))


def _phase(t: Column) -> Column:
    from matchlake.functions.exprs import phase_of_event

    return phase_of_event(t, *[F.lit(SEASON[k]) for k in ("auto_seconds", "teleop_seconds", "endgame_seconds")])


FACTS = """facts as (
  select cast(event_id as varchar) as event_id, event_id as n, strftime(ts, '%Y-%m-%d') as match_id, cast(user_id as integer) as team,
    (epoch_us(ts) % 86400000000) / 1000000::double as t_seconds,
    case event_type when 'click' then 'shot_attempt' when 'purchase' then 'shot_made' when 'signup' then 'reload' when 'view' then 'defense_start' else 'defense_end' end as event_type,
    least(1.0::double, value / 100) as confidence, case event_id % 3 when 0 then 'high' when 1 then 'low' end as goal,
    value % 54.0::double as field_x, (value * 3) % 27.0::double as field_y, value,
    case when (epoch_us(ts) % 86400000000) / 1000000::double < 20000 then 'auto' when (epoch_us(ts) % 86400000000) / 1000000::double < 70000 then 'teleop'
      when (epoch_us(ts) % 86400000000) / 1000000::double <= 80000 then 'endgame' else 'unknown' end as phase
  from events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of one robot per user and day at ten a second, in order of events; blue if the team is even."""
    from pyspark.sql import Window

    f = facts(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("job_id", "team").orderBy("t_seconds", "event_id"))
    side = F.when(F.col("team") % 2 == 0, "blue").otherwise("red")
    return f.select(
        "job_id", "match_id", F.concat(F.lit("team:"), "team").alias("robot_key"), "team", side.alias("alliance"), (place / 10).alias("t"), (place / 10).alias("mt"), "phase",
        F.col("field_x").alias("x"), F.col("field_y").alias("y"), F.col("field_x").alias("ax"), F.col("field_y").alias("ay"), (F.col("value") / 50).alias("speed"),
        F.when(F.col("field_x") < 15, "own").when(F.col("field_x") < 39, "neutral").otherwise("opponent").alias("zone"),
        F.when(F.col("field_y") < 9, "right").when(F.col("field_y") < 18, "centre").otherwise("left").alias("lane"), F.col("event_id").alias("shot_id"),
    )


SAMPLES = (
    FACTS
    + """, samples as (
  select match_id as job_id, 'team:' || team as robot_key, team, case when team % 2 = 0 then 'blue' else 'red' end as alliance,
    row_number() over (partition by match_id, team order by t_seconds, event_id) as k, row_number() over (partition by match_id, team order by t_seconds, event_id) / 10::double as t,
    phase, field_x as ax, field_y as ay, value / 50 as speed,
    case when field_x < 15 then 'own' when field_x < 39 then 'neutral' else 'opponent' end as zone, event_id as shot_id
  from facts)"""
)


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as shots: line status is the job, supplier the robot, return flag the outcome."""
    li = table(spark, sf_dir, "lineitem")
    outcome = F.when(F.col("l_returnflag") == "A", "made").when(F.col("l_returnflag") == "R", "missed").otherwise("odd")
    return li.select(F.col("l_linestatus").alias("job_id"), F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey") % 40).cast("int").alias("robot_track_id"), outcome.alias("outcome"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as launch places of suppliers over fifty matches."""
    li = table(spark, sf_dir, "lineitem")
    match = F.concat(F.lit("2024ev_qm"), (F.col("l_orderkey") % 50 + 1).cast("string"))
    return li.select(F.col("l_suppkey").cast("int").alias("team"), match.alias("match_id"), F.pmod(F.col("l_quantity") * 1.5, F.lit(60.0)).alias("ax"), F.pmod(F.col("l_extendedprice"), F.lit(29.0)).alias("ay"))


POINTS = """points as (
  select cast(l_suppkey as integer) as team, l_orderkey % 50 + 1 as m, (l_quantity * 1.5::double) % 60::double as ax, l_extendedprice % 29::double as ay from lineitem),
weights as (
  select team, m, pow(0.5::double, (count(*) over (partition by team) - row_number() over (partition by team order by m)) / 4::double) as weight from (select distinct team, m from points))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as detector boxes: an order is a frame, line numbers are two detectors' proposals."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("frame_id"), F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b").alias("source"),
        (F.col("l_quantity") / 100).alias("x"), (F.pmod(F.col("l_extendedprice"), F.lit(50.0)) / 100).alias("y"), F.lit(0.2).alias("w"), F.lit(0.2).alias("h"),
        (F.col("l_discount") * 5 + 0.3 + F.col("l_linenumber") / 1000).alias("confidence"),
    )
