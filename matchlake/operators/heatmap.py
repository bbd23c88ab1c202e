"""Recency-weighted grids and zones of where teams score and drive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.exprs import band_of, is_practice, match_order

HALF_LIFE, CELL_FT, EFFECTIVE_SHARE, MIN_MATCHES = 4.0, 3.0, 0.15, 2


def recency(matches: DataFrame, key: str = "team", official_only: bool = False, half_life: float = HALF_LIFE) -> DataFrame:
    """``matches (key, match_id, seq)`` with ``weight``: 1 for the newest, half for each ``half_life`` back.

    Practice comes first in order of ``seq``, then official matches in match order; ``official_only`` drops practice.
    """
    m = matches.withColumn("practice", is_practice(F.col("match_id")))
    m = m.where("not practice") if official_only else m
    order = [F.col("practice").desc(), F.when(F.col("practice"), F.col("seq")), match_order(F.col("match_id")), F.col("seq")]
    back = F.count("*").over(Window.partitionBy(key)) - F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return m.withColumn("weight", F.pow(F.lit(0.5), back / half_life))


def cell(value: Column, size: float, extent: float) -> Column:
    return F.least(F.floor(value / size), F.lit(int(extent // size)))


def _weighted(counted: DataFrame, weights: DataFrame, key: str, by: list[str], count_as: str) -> DataFrame:
    """Counts, summed weights ``_w`` and matches of ``counted (key, match_id, by, _n)``."""
    w = counted.join(weights.select(key, "match_id", "weight"), [key, "match_id"])
    return w.groupBy(key, *by).agg(F.sum("_n").alias(count_as), F.sum(F.col("_n") * F.col("weight")).alias("_w"), F.count("*").alias("matches"))


def grid(points: DataFrame, weights: DataFrame, length: float, width: float, key: str = "team", size: float = CELL_FT, count_as: str = "launches") -> DataFrame:
    """``points (key, match_id, ax, ay)`` binned: count, weight, matches, and intensity against the key's peak.

    Points are counted per match and cell before they meet their match's weight.
    """
    counted = points.where("ax is not null and ay is not null").groupBy(key, "match_id", cell(F.col("ax"), size, length).alias("ix"), cell(F.col("ay"), size, width).alias("iy")).agg(F.count("*").alias("_n"))
    cells = _weighted(counted, weights, key, ["ix", "iy"], count_as).withColumn("weight", F.bround("_w", 3))
    peak = F.max("weight").over(Window.partitionBy(key))
    return cells.select(key, F.bround((F.col("ix") + 0.5) * size, 1).alias("x"), F.bround((F.col("iy") + 0.5) * size, 1).alias("y"), count_as, "weight", "matches", F.when(peak > 0, F.bround(F.col("weight") / peak, 3)).otherwise(0.0).alias("intensity"))


def effective_zones(points: DataFrame, weights: DataFrame, zones: list[tuple[str, float, float]], lanes: list[tuple[str, float, float]], key: str = "team") -> DataFrame:
    """Weight and share of each zone and lane; effective with a real share over enough matches."""
    p = points.withColumn("zone", band_of(F.col("ax"), zones)).withColumn("lane", band_of(F.col("ay"), lanes)).where("zone is not null and lane is not null")
    r = _weighted(p.groupBy(key, "match_id", "zone", "lane").agg(F.count("*").alias("_n")), weights, key, ["zone", "lane"], "launches")
    part = F.col("_w") / F.sum("_w").over(Window.partitionBy(key))
    return r.select(key, "zone", "lane", "launches", F.bround("_w", 3).alias("weight"), "matches", F.bround(part, 3).alias("share"), ((part >= EFFECTIVE_SHARE) & (F.col("matches") >= MIN_MATCHES)).alias("effective"))


def hot_spot(cells: DataFrame, key: str = "team") -> DataFrame:
    """The heaviest cell of each key."""
    return cells.groupBy(key).agg(F.max_by(F.struct("x", "y"), F.struct("weight", (-F.col("x")), (-F.col("y")))).alias("hot_spot"))


def maps(features: DataFrame, season_geometry: dict) -> dict[str, DataFrame]:
    """Scoring grid, auto grid, zones and match counts of every team, from match features with ``seq``."""
    m = features.where("team is not null").select("team", "match_id", "seq").dropDuplicates(["team", "match_id"])
    every, official = recency(m), recency(m, official_only=True)
    fired = features.where("team is not null").select("team", "match_id", F.explode("points.list").alias("p")).select("team", "match_id", "p.ax", "p.ay")
    driven = features.where("team is not null").select("team", "match_id", F.explode("auto_path.points").alias("p")).where("p is not null").select("team", "match_id", F.col("p.x").alias("ax"), F.col("p.y").alias("ay"))
    length, width = season_geometry["field_length_ft"], season_geometry["field_width_ft"]
    counts = every.groupBy("team").agg(F.count("*").alias("n_matches"), F.count_if("practice").alias("n_practice"))
    return {
        "scoring": grid(fired, every, length, width), "auto": grid(driven, official, length, width, count_as="samples"),
        "zones": effective_zones(fired, every, season_geometry["zones"], season_geometry["lanes"]), "counts": counts,
    }
