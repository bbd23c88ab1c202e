"""One object over the tables of all runs: every read composes corrections, nothing derived is stored for good."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.functions.exprs import event_key
from matchlake.operators import clock, corrections, features, heatmap, plan, profile, stats, timeline
from matchlake.operators.isolate import isolated
from matchlake.sources import readers
from matchlake.sources.store import Change, Store


class Engine:
    """Tables are DataFrames by name: ``jobs events tracks shots corrections goal_entries``; ``season`` and ``geometry`` are one year's rules."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], season: dict, geometry: dict, work: str):
        """``work`` is a folder of shared storage for the tables that later steps read several times."""
        self.spark, self.t, self.season, self.geometry, self.work = spark, tables, season, geometry, work.rstrip("/")

    @classmethod
    def open(cls, spark: SparkSession, root: str, season: dict, geometry: dict, work: str) -> Engine:
        return cls(spark, readers.load_run_tables(spark, root), season, geometry, work)

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        """Publish a table as the next version of the work folder's store; who reads an earlier one keeps it."""
        store = Store(self.spark, f"{self.work}/tables")
        return store.read(name, store.retry(lambda base: {name: Change(df, whole=True)}))

    def jobs(self, event: str | None = None, complete_only: bool = False) -> DataFrame:
        """Jobs, newest first."""
        j = self.t["jobs"]
        j = j.where(F.col("status") == "complete") if complete_only else j
        j = j.where(event_key(F.col("match_id")) == event) if event else j
        return j.orderBy(F.desc("created_at"), "job_id")

    def events(self, match_id: str | None = None, raw: bool = False, least_confidence: float = 0.0) -> DataFrame:
        """Facts of a match (or of all), corrected unless ``raw``, at or above a confidence, in order of time."""
        of = lambda df: df if match_id is None else df.where(F.col("match_id") == match_id)
        e = of(self.t["events"]).drop("run")
        if not raw:
            e = corrections.apply_corrections(e, of(self.t["corrections"]))
        return stats.in_confidence(e, least_confidence).orderBy(F.coalesce("t_seconds", F.lit(0.0)), "event_id")

    def tracks(self, job_id: str | None = None, raw: bool = False) -> DataFrame:
        t = self.t["tracks"].drop("run")
        t = t if job_id is None else t.where(F.col("job_id") == job_id)
        return t if raw else corrections.apply_track_corrections(t, self.t["corrections"])

    def team_stats(self, event: str | None = None, least_confidence: float = 0.0) -> DataFrame:
        """Statistics of every team over an event's matches, each match once however many jobs it has."""
        e = self.events(least_confidence=least_confidence).dropDuplicates(["match_id", "event_id"])
        e = e.where(event_key(F.col("match_id")) == event) if event else e
        return stats.team_stats(e, float(self.season["auto_seconds"] + self.season["teleop_seconds"]))

    def accuracy(self, seasons: DataFrame) -> DataFrame:
        """Reconstructed against official scores of all matches."""
        official = self.t["jobs"].where("tba_score is not null").select("match_id", "tba_score.red", "tba_score.blue").dropDuplicates(["match_id"])
        return stats.accuracy(stats.reconstruct_score(self.events(), self.t["jobs"], seasons), official)

    def shots(self) -> tuple[DataFrame, DataFrame]:
        """Shot and goal counts of every job."""
        return stats.shot_statistics(self.t["shots"]), stats.goal_statistics(self.t["goal_entries"])

    def clocks(self, readings: DataFrame) -> DataFrame:
        jobs = self.t["jobs"].select("job_id")
        found = clock.match_clock(readings, self.t["events"], self.season)
        return jobs.join(found, "job_id", "left").withColumn("start", F.coalesce("start", F.lit(0.0)))

    def timelines(self, seasons: DataFrame, geometry: DataFrame, clocks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Samples and launches of all robots, written and read back."""
        samples, launches = timeline.build(self.tracks(), self.t["jobs"], self.t["shots"], seasons, geometry, clocks)
        return self._kept("samples", samples), self._kept("launches", launches)

    def features(self, samples: DataFrame, launches: DataFrame) -> DataFrame:
        """Features of every job; those of which a job's rows make the plan fail are in :meth:`failures` instead."""
        of = lambda rows, jobs: rows.join(jobs, "job_id", "left_semi")
        made, failed = isolated(samples.select("job_id"), lambda jobs: features.match_features(of(samples, jobs), of(launches, jobs), self.season, self.geometry))
        self._kept("failures", failed)
        return self._kept("features", made)

    def failures(self) -> DataFrame:
        """``job_id, error`` of the jobs that the last :meth:`features` left out."""
        return Store(self.spark, f"{self.work}/tables").read("failures")

    def profiles(self, found: DataFrame) -> DataFrame:
        return self._kept("profiles", profile.build_profiles(found))

    def maps(self, found: DataFrame) -> dict[str, DataFrame]:
        """Scoring, auto and zone maps; matches that are no official ones keep the order of their job ids."""
        with_seq = found.withColumn("seq", F.col("job_id"))
        return {name: self._kept(f"map-{name}", df) for name, df in heatmap.maps(with_seq, self.geometry).items()}

    def match_plan(self, our: list[int], their: list[int], profiles: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
        return plan.match_plan(our, their, profiles, maps["auto"], maps["zones"])

    def pick_list(self, our: list[int], available: list[int] | None, profiles: DataFrame, maps: dict[str, DataFrame], limit: int = 18) -> DataFrame:
        return plan.rank_partners(our, available, profiles.select("team", "launches_per_match"), plan.footprints(maps["auto"], maps["zones"]), limit)

    def evaluate(self, found: DataFrame, least_history: int = 2) -> DataFrame:
        return profile.next_match_test(found, least_history)
