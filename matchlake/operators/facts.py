"""Facts made from jobs and other tables, their identity, and small rules over rules and rosters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.exprs import phase_of_event, video_start

SCHEMA_VERSION = 3


def with_identity(rows: DataFrame, key: list[str], source: str = "model", version: int = SCHEMA_VERSION) -> DataFrame:
    """Adds what every fact has and ``rows`` lacks: schema version, source, null places, and an id from the values of ``key``.

    The id is a hash, so that the same fact has the same id whenever it is made again.
    """
    have = set(rows.columns)
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]), 256)
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    added = {"schema_version": F.lit(version), "event_id": F.concat_ws("-", *parts), "source": F.lit(source), "field_x": F.lit(None).cast("double"), "field_y": F.lit(None).cast("double")}
    return rows.select("*", *[value.alias(name) for name, value in added.items() if name not in have])


def match_bounds(jobs: DataFrame, seasons: DataFrame) -> DataFrame:
    """A ``match_start`` at 0 and a ``match_end`` at the recording's length for each job ``(job_id, match_id, season, duration)`` that names its match."""
    s = jobs.where("match_id is not null and match_id <> ''").join(seasons.select("season", "auto_seconds", "teleop_seconds", "endgame_seconds"), "season", "left")
    end = F.greatest(F.lit(0.0), F.coalesce("duration", F.lit(0.0)))
    edge = lambda kind, at: F.struct(F.lit(kind).alias("event_type"), at.alias("t_seconds"))
    rows = s.withColumn("e", F.explode(F.array(edge("match_start", F.lit(0.0)), edge("match_end", end))))
    lengths = [F.coalesce(k, F.lit(0.0)) for k in ("auto_seconds", "teleop_seconds", "endgame_seconds")]
    facts = rows.select(
        "job_id", "match_id", F.lit(None).cast("int").alias("team"), F.lit(None).cast("int").alias("track_id"), "e.t_seconds",
        phase_of_event(F.col("e.t_seconds"), *lengths).alias("phase"), "e.event_type", F.lit(1.0).alias("confidence"),
    )
    return with_identity(facts, ["job_id", "event_type"])


def timeline_order(timelines: DataFrame) -> DataFrame:
    """Timelines by alliance (none last), team (none first) and robot key."""
    return timelines.orderBy(F.coalesce("alliance", F.lit("z")), F.coalesce("team", F.lit(0)), "robot_key")


def scoring_is_meaningful(values: Column) -> Column:
    """Whether any point value of ``map<phase, map<kind, points>>`` is set; false for none."""
    return F.coalesce(F.exists(F.map_values(values), lambda m: F.exists(F.map_values(m), lambda v: v != 0)), F.lit(False))


def legal_goals(goals: Column) -> Column:
    """Distinct goals of a season, in order; null for an unknown season."""
    return F.array_sort(F.array_distinct(goals))


def season_of(features: DataFrame, fallback: int = 2026) -> DataFrame:
    """One row, ``season``: the year that the least match id with one begins with, else ``fallback``."""
    year = F.regexp_extract("match_id", r"^(\d{4})", 1).try_cast("int")
    return features.select(F.struct(F.col("match_id").alias("m"), year.alias("y")).alias("s")).where("s.y is not null").agg(F.coalesce(F.min("s")["y"], F.lit(fallback)).alias("season"))


def parse_teams(raw: str | None) -> list[int]:
    """Team numbers of a text that commas and blanks part; what is no number is left out."""
    return [int(x) for x in (raw or "").replace(",", " ").split() if x.lstrip("+-").isdigit()]


def roster_for(official: Column, detected: Column) -> Column:
    """The official roster where there is one, else the detected."""
    return F.when(F.size(F.coalesce(official, F.array().cast("array<int>"))) > 0, official).otherwise(detected)


def mark_uncertain(tracks: DataFrame, unsure: Column, issue: str) -> DataFrame:
    """Takes the team off tracks that are ``unsure`` and adds ``issue`` to their ``identity_issues``, sorted and once."""
    issues = F.array_sort(F.array_union(F.coalesce("identity_issues", F.array().cast("array<string>")), F.array(F.lit(issue))))
    sure = ~F.coalesce(unsure, F.lit(False))
    return tracks.withColumn("identity_issues", F.when(sure, F.col("identity_issues")).otherwise(issues)).withColumn("team", F.when(sure, F.col("team")))


def merged_gaps(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, start, end, reason``: the holes between a robot's fragments ``(keys, start, end)``, each ``detection_lost``."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    seen = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return fragments.withColumn("_seen", seen).where("start > _seen").select(*keys, F.col("_seen").alias("start"), F.col("start").alias("end"), F.lit("detection_lost").alias("reason"))


def media_window(url: Column, total: Column, starts: list[Column], ends: list[Column]) -> Column:
    """``struct(start, duration, whole)`` of a recording within its video of ``total`` seconds.

    The first start given counts, else that of the address; an end that does not follow it is the video's. Null without
    a length or with a start beyond it.
    """
    given = F.coalesce(*[F.nullif(s.cast("double"), F.lit(0.0)) for s in starts], video_start(url).cast("double"), F.lit(0.0))
    start = F.greatest(F.lit(0.0), given)
    end = F.coalesce(*[F.nullif(e.cast("double"), F.lit(0.0)) for e in ends])
    stop = F.least(total, F.when(end > start, end).otherwise(total))
    whole = (start == 0) & (F.abs(stop - start - total) < 0.001)
    return F.when((total > 0) & (start < total), F.struct(start.alias("start"), (stop - start).alias("duration"), whole.alias("whole")))


def to_wire(facts: DataFrame) -> DataFrame:
    """camelCase columns by their snake_case names."""
    snake = lambda name: "".join(f"_{c.lower()}" if c.isupper() else c for c in name)
    return facts.withColumnsRenamed({c: snake(c) for c in facts.columns})


def to_domain(facts: DataFrame) -> DataFrame:
    """The inverse of :func:`to_wire`."""
    camel = lambda name: name.split("_")[0] + "".join(p.capitalize() for p in name.split("_")[1:])
    return facts.withColumnsRenamed({c: camel(c) for c in facts.columns})
