"""Command line over the runs below a folder: ``python -m matchlake VERB --runs ROOT --season FILE --geometry FILE --work FOLDER --out FOLDER``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.engine import Engine
from matchlake.operators import clock, stats
from matchlake.operators.facts import parse_teams
from matchlake.sources import readers, sinks

VERBS = ("clock", "timeline", "features", "profile", "heatmap", "matchplan", "picklist", "evaluate", "export")


def _plain(row) -> dict:
    return {k: [tuple(x) for x in v] if isinstance(v, list) else v for k, v in row.asDict().items()}


class Command:
    """One run of a verb; each step is computed once, from the steps before it."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args = spark, args
        self.seasons, self.geometry = readers.seasons(spark, args.season), readers.geometry(spark, args.geometry)
        season = self.seasons.orderBy(F.desc("season")).first()
        place = self.geometry.where(F.col("season") == season["season"]).first()
        rules = {k: season[k] or 0.0 for k in ("auto_seconds", "teleop_seconds", "endgame_seconds")}
        self.engine = Engine.open(spark, args.runs, rules, _plain(place), args.work)

    def clocks(self) -> DataFrame:
        none = self.spark.createDataFrame([], "job_id string, t double, remaining int")
        readings = self.spark.read.schema(none.schema).json(self.args.readings) if self.args.readings else none
        return self.engine.clocks(readings)

    def fitted(self) -> DataFrame:
        if not self.args.readings:
            raise SystemExit("clock needs --readings")
        kind = "job_id string, t double, remaining int"
        return clock.fit(self.spark.read.schema(kind).json(self.args.readings), self.engine.season)

    def features(self) -> DataFrame:
        return self.engine.features(*self.engine.timelines(self.seasons, self.geometry, self.clocks()))

    def run(self) -> dict[str, DataFrame]:
        """The tables that the verb asks for, by name."""
        verb, teams = self.args.verb, parse_teams(self.args.teams)
        if verb == "clock":
            return {"clock": self.fitted()}
        if verb == "timeline":
            return dict(zip(("samples", "launches"), self.engine.timelines(self.seasons, self.geometry, self.clocks())))
        if verb == "export":
            events = self.engine.events()
            if self.args.mode == "raw":
                return {"export": sinks.export_rows(events, "raw")}
            per_match = stats.team_stats(events, self.engine.season["auto_seconds"] + self.engine.season["teleop_seconds"], by_match=True)
            return {"export": sinks.export_rows(per_match, "aggregate")}
        found = self.features()
        if verb == "features":
            return {"features": found}
        if verb == "evaluate":
            return {"evaluate": self.engine.evaluate(found)}
        if verb == "heatmap":
            return self.engine.maps(found)
        profiles = self.engine.profiles(found)
        if verb == "profile":
            return {"profile": profiles.where(F.col("team").isin(teams)) if teams else profiles}
        maps = self.engine.maps(found)
        if verb == "matchplan":
            return {"matchplan": self.engine.match_plan(teams, parse_teams(self.args.opponents), profiles, maps)}
        return {"picklist": self.engine.pick_list(teams, parse_teams(self.args.available) or None, profiles, maps)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m matchlake", description=__doc__)
    parser.add_argument("verb", choices=VERBS)
    for name in ("runs", "season", "geometry", "work", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--readings", help="JSON lines of job_id, t, remaining")
    parser.add_argument("--mode", choices=("raw", "aggregate"), default="raw")
    for name in ("teams", "opponents", "available"):
        parser.add_argument(f"--{name}", help="numbers parted by commas or blanks")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("matchlake").getOrCreate()
    for name, table in Command(spark, args).run().items():
        sinks.write_json(table, f"{args.out.rstrip('/')}/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
