"""Corrections composed onto raw facts at read time; raw facts are never changed.

An event's result depends on that event and its match's ordered patches only. Patches that can touch an event are
joined to it by match and by target (or by track) and folded in order, so no task holds more than one event's patches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Event fields that a patch may set, with their types; a patch's other keys are ignored.
PATCHABLE = {"team": "int", "track_id": "int", "t_seconds": "double", "phase": "string", "event_type": "string", "confidence": "double", "field_x": "double", "field_y": "double", "goal": "string"}


def match_corrections(corrections: DataFrame, jobs: DataFrame, match_id: str) -> DataFrame:
    """Corrections of a match, named by match or by one of its jobs, each once."""
    named = corrections.where(F.col("match_id") == match_id)
    own = jobs.where(F.col("match_id") == match_id).select("job_id")
    return named.unionByName(corrections.join(own, "job_id", "left_semi").select(named.columns)).dropDuplicates(["correction_id"])


def _patched(state: Column, patch: Column, name: str, kind: str) -> Column:
    """A key that is present overwrites, even with null; an absent one leaves the value."""
    return F.when(F.map_contains_key(patch["fields"], F.lit(name)), F.element_at(patch["fields"], F.lit(name)).try_cast(kind)).otherwise(state[name])


def apply_corrections(events: DataFrame, corrections: DataFrame) -> DataFrame:
    """Events with their match's corrections applied in order of time, without time last, by id on a tie.

    Track corrections re-attribute all events of a track of their job (or of their match, if they name no job), also
    ones deleted so far; the track compared is the one an earlier patch may have set. Event corrections edit, create
    or delete their target; only a later create revives it. Adds ``corrected`` and ``correction_id`` (of the last
    patch). Deleted events and targets never created are left out.
    """
    c = corrections.withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))
    on_event, on_track = c.where("scope = 'event'"), c.where("scope = 'track'").withColumn("target_track", F.col("target_id").try_cast("int")).where("target_track is not null")
    made = on_event.where("action = 'create'").select("match_id", "job_id", F.col("target_id").alias("event_id")).dropDuplicates(["match_id", "event_id"])
    new = made.join(events.select("match_id", "event_id"), ["match_id", "event_id"], "left_anti")
    blank = [F.lit(None).cast(events.schema[k].dataType).alias(k) for k in events.columns if k not in ("match_id", "job_id", "event_id")]
    base = events.withColumn("exists", F.lit(True)).unionByName(new.select("match_id", "job_id", "event_id", *blank, F.lit(False).alias("exists")))
    row = ["created_at", "correction_id", "scope", "action", "fields", "target_track", "job"]
    patch = lambda df, track, job: df.withColumn("target_track", track).withColumn("job", job)
    direct = patch(on_event, F.lit(None).cast("int"), F.lit(None).cast("string")).select("match_id", F.col("target_id").alias("event_id"), *row)
    tracks = patch(on_track, F.col("target_track"), F.col("job_id")).select("match_id", *row)
    moved = on_event.where(F.map_contains_key("fields", F.lit("track_id"))).select("match_id", F.col("target_id").alias("event_id"), F.element_at("fields", F.lit("track_id")).try_cast("int").alias("track"))
    on = base.select("match_id", "event_id", F.col("track_id").alias("track"), "job_id").unionByName(moved.join(base.select("match_id", "event_id", "job_id"), ["match_id", "event_id"])).where("track is not null").distinct()
    via_track = on.join(tracks, (on.match_id == tracks.match_id) & (on.track == tracks.target_track)).where("job is null or job = job_id").select(on.match_id, "event_id", *row).dropDuplicates(["match_id", "event_id", "correction_id"])
    order = F.struct(F.col("created_at").isNull().alias("late"), "created_at", "correction_id", "scope", "action", F.map_entries("fields").alias("entries"), "target_track")
    patches = direct.unionByName(via_track).groupBy("match_id", "event_id").agg(F.array_sort(F.collect_list(order)).alias("patches"))
    state = F.struct(
        *[F.col(k).cast(t).alias(k) for k, t in PATCHABLE.items()], F.col("source"), (~F.col("exists")).alias("hidden"),
        F.lit(False).alias("corrected"), F.lit(None).cast("string").alias("correction_id"), F.col("exists").alias("exists"),
    )

    def step(s: Column, raw: Column) -> Column:
        p = {"fields": F.map_from_entries(raw["entries"])}
        track, action = raw["scope"] == "track", raw["action"]
        create, delete = ~track & (action == "create"), ~track & (action == "delete")
        edits = (track & s["exists"] & F.coalesce(s["track_id"] == raw["target_track"], F.lit(False))) | (~track & (action == "edit") & s["exists"] & (F.size(raw["entries"]) > 0))
        touched = create | edits
        value = {k: F.when(create, F.when(F.map_contains_key(p["fields"], F.lit(k)), F.element_at(p["fields"], F.lit(k)).try_cast(t))).when(edits, _patched(s, p, k, t)).otherwise(s[k]) for k, t in PATCHABLE.items()}
        return F.struct(
            *[v.alias(k) for k, v in value.items()], F.when(create, F.coalesce(F.element_at(p["fields"], F.lit("source")), F.lit("manual"))).otherwise(s["source"]).alias("source"),
            F.when(create, F.lit(False)).when(delete, F.lit(True)).otherwise(s["hidden"]).alias("hidden"), (s["corrected"] | touched).alias("corrected"),
            F.when(touched, raw["correction_id"]).otherwise(s["correction_id"]).alias("correction_id"), (s["exists"] | create).alias("exists"),
        )

    folded = base.join(patches, ["match_id", "event_id"], "left").withColumn("s", F.when(F.col("patches").isNull(), state).otherwise(F.aggregate("patches", state, step)))
    keep = [k for k in events.columns if k not in PATCHABLE and k != "source"]
    return folded.where("not s.hidden and s.exists").select(*keep, *[f"s.{k}" for k in PATCHABLE], "s.source", "s.corrected", "s.correction_id")


def apply_track_corrections(tracks: DataFrame, corrections: DataFrame) -> DataFrame:
    """Team, alliance and team confidence of tracks, each by the last correction that names it, whatever its action."""
    c = corrections.where("scope = 'track'").withColumn("track_id", F.col("target_id").try_cast("int")).where("track_id is not null")
    when = F.struct(F.col("created_at").isNull().alias("late"), "created_at", "correction_id")
    kinds = {"team": "int", "alliance": "string", "team_confidence": "double"}
    has = {k: F.map_contains_key("fields", F.lit(k)) for k in kinds}
    last = c.groupBy("job_id", "track_id").agg(
        *[F.max(F.when(has[k], F.struct(when.alias("o"), F.element_at("fields", F.lit(k)).try_cast(t).alias("v")))).alias(f"p_{k}") for k, t in kinds.items()]
    )
    out = tracks.join(last, ["job_id", "track_id"], "left")
    return out.select(*[F.when(F.col(f"p_{k}").isNotNull(), F.col(f"p_{k}.v")).otherwise(F.col(k)).alias(k) if k in kinds else F.col(k) for k in tracks.columns])


def team_corrections(web: DataFrame, desktop: DataFrame) -> DataFrame:
    """``job_id, track_id, team``: the latest decision of the web list, then of the desktop list; both carry ``seq``."""
    both = web.withColumn("rank", F.lit(0)).unionByName(desktop.withColumn("rank", F.lit(1)))
    named = both.where(F.map_contains_key("fields", F.lit("team"))).withColumn("track_id", F.col("target_id").try_cast("int")).where("track_id is not null")
    return named.groupBy("job_id", "track_id").agg(F.max_by(F.element_at("fields", F.lit("team")).try_cast("int"), F.struct("rank", "seq")).alias("team"))


def view_events(corrected: DataFrame, raw: DataFrame, compare: list[str]) -> DataFrame:
    """Corrected events with the names of fields that differ from the raw event, and whether there was one."""
    r = raw.select("match_id", "event_id", F.lit(True).alias("was_raw"), *[F.col(k).alias(f"raw_{k}") for k in compare])
    changed = F.array_compact(F.array(*[F.when(~F.col(k).eqNullSafe(F.col(f"raw_{k}")), F.lit(k)) for k in compare]))
    out = corrected.join(r, ["match_id", "event_id"], "left")
    return out.withColumn("changed_fields", F.when(F.col("was_raw"), changed).otherwise(F.array().cast("array<string>"))).withColumn("was_raw", F.coalesce("was_raw", F.lit(False)))


def deleted_events(raw: DataFrame, corrected: DataFrame) -> DataFrame:
    return raw.join(corrected.select("match_id", "event_id"), ["match_id", "event_id"], "left_anti")


def last_writer(patches: DataFrame, keys: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """Per key and field, the last non-absent value of an append-only log of wide rows."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc_nulls_last() for o in order])
    ranked = patches.select(*keys, *[F.first(F.col(f), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f) for f in fields], F.row_number().over(w).alias("rn"))
    return ranked.where("rn = 1").drop("rn")
