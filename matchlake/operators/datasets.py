"""Building labelled frame sets: splits, caps, dealing, gaps, held-out scores, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.exprs import crc_split, sha_fraction, source_stem
from matchlake.operators.ordered import numbered


def with_split(frames: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``stem`` and ``split``; all copies of a frame fall in one split."""
    return frames.withColumn("stem", source_stem(F.col(name))).withColumn("split", crc_split(F.col("stem")))


def with_group_split(frames: DataFrame, group: str, seed: str, train: float = 0.8, valid: float = 0.9) -> DataFrame:
    u = sha_fraction(F.lit(seed), F.col(group))
    return frames.withColumn("split", F.when(u < train, "train").when(u < valid, "valid").otherwise("test"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key; Spark drops the rest before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def strided(df: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """Every n-th row of each key, the least n that leaves ``most`` or fewer."""
    w = Window.partitionBy(*keys)
    step = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) / most))
    return df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_step", step).where("_i % _step = 0").drop("_i", "_step")


def even_share(labels: DataFrame, order: Sequence[str], human: str, ratio: float) -> DataFrame:
    """All human rows and evenly strided others, at most ``ratio`` times as many."""
    h = labels.where(human)
    most = max(1, int(h.count() * ratio))
    machine = numbered(labels.where(f"not ({human})"), order, "_i")
    step = max(1, -(-machine.count() // most))
    return h.unionByName(machine.where(F.col("_i") % step == 0).drop("_i"))


def dealt(frames: DataFrame, order: Sequence[str], packs: int) -> DataFrame:
    """Adds ``pack`` by dealing rows round robin in the whole table's order."""
    return numbered(frames, order, "_i").withColumn("pack", F.col("_i") % packs).drop("_i")


def sample_times(segments: DataFrame, n: int) -> DataFrame:
    """``n`` instants evenly inside each segment ``(segment, start, end)``, listed segment by segment in turn."""
    times = segments.select("segment", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.col("start") + (F.col("end") - F.col("start")) * (i - 0.5) / n)).alias("turn", "t"))
    return times.orderBy("turn", "segment")


def held_out_report(counts: DataFrame, full: int = 6) -> DataFrame:
    """Per segment and in total (null): frames, mean robots, blind and full frames, and the ceiling of recall.

    ``counts (segment, frame_id, found, truth)``.
    """
    r = counts.rollup("segment").agg(
        F.count("*").alias("frames"), F.bround(F.avg("found"), 3).alias("mean_robots"), F.count_if(F.expr("found = 0")).alias("blind"), F.count_if(F.col("found") >= full).alias("full"),
        F.sum(F.least("found", "truth")).alias("hit"), F.sum("truth").alias("truths"),
    )
    return r.select("segment", "frames", "mean_robots", "blind", "full", F.bround(F.col("full") / F.col("frames"), 4).alias("full_share"), F.bround(F.try_divide("hit", "truths"), 4).alias("ceiling_recall"))


def models_with_scores(models: DataFrame, scores: DataFrame) -> DataFrame:
    """Registry entries, oldest first, each with its held-out score as a struct ``heldout``, null where it has none.

    ``models (id, trained_on, ...)`` and ``scores (id, ...)``; of several scores of a model that with the largest
    ``measured_on`` counts, where there is such a column.
    """
    names = [c for c in scores.columns if c != "id"]
    latest = F.max_by(F.struct(*names), F.coalesce(F.col("measured_on").cast("string"), F.lit("")) if "measured_on" in names else F.lit(""))
    return models.join(scores.groupBy("id").agg(latest.alias("heldout")), "id", "left").orderBy(F.asc_nulls_last("trained_on"), "id")


def histogram(counts: DataFrame, value: str) -> DataFrame:
    return counts.groupBy(value).agg(F.count("*").alias("n"))


def history(models: DataFrame, days: DataFrame) -> DataFrame:
    """For each day, the latest model trained up to it; ``models (trained_on, name, score)``, ``days (day)``."""
    both = days.select(F.col("day"), F.lit(1).alias("side"), F.lit(None).cast("struct<name:string,score:double>").alias("m")).unionByName(models.select(F.col("trained_on").alias("day"), F.lit(0).alias("side"), F.struct("name", F.col("score").cast("double").alias("score")).alias("m")))
    last = F.last("m", ignorenulls=True).over(Window.orderBy("day", "side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("last", last).where("side = 1").select("day", "last.name", "last.score")


def cumulative_share(done: DataFrame, total: int, day: str = "day") -> DataFrame:
    """Share of all items done by each day."""
    n = done.groupBy(day).agg(F.count("*").alias("n"))
    return n.select(day, F.bround(F.sum("n").over(Window.orderBy(day)) / total, 4).alias("share"))


def yolo_rows(lines: DataFrame) -> DataFrame:
    """``kind, cx, cy, w, h`` of white-space separated label lines; other lines are left out."""
    p = F.split(F.trim("value"), r"\s+")
    at = lambda i, t: F.try_element_at(p, F.lit(i)).try_cast(t)
    names = [c for c in lines.columns if c != "value"]
    return lines.select(*names, at(1, "int").alias("kind"), *[at(i, "double").alias(n) for i, n in ((2, "cx"), (3, "cy"), (4, "w"), (5, "h"))]).where("kind is not null and h is not null")


def coco_rows(boxes: DataFrame) -> DataFrame:
    """Annotation rows in pixels, clipped to the frame and rounded to three decimals, empty ones left out, with ids from 1 in frame order.

    ``boxes (frame_id, image_id, width, height, x, y, w, h, review_status)``; an unreviewed box fails the export.
    """
    reviewed = F.when(F.col("review_status") == "reviewed", F.lit(0)).otherwise(F.raise_error(F.concat(F.lit("unreviewed box in "), F.col("frame_id"))))
    x1, y1 = F.greatest(F.lit(0.0), F.col("x")), F.greatest(F.lit(0.0), F.col("y"))
    x2, y2 = F.least(F.lit(1.0), F.col("x") + F.col("w")), F.least(F.lit(1.0), F.col("y") + F.col("h"))
    px = lambda v, n: F.bround(v * F.col(n), 3)
    rows = boxes.where(reviewed == 0).select("image_id", px(x1, "width").alias("x"), px(y1, "height").alias("y"), px(x2 - x1, "width").alias("w"), px(y2 - y1, "height").alias("h")).where("w > 0 and h > 0")
    ids = numbered(rows, ["image_id", "x", "y", "w", "h"], "_i").withColumn("id", F.col("_i") + 1)
    return ids.select("image_id", "x", "y", "w", "h", "id", F.bround(F.col("w") * F.col("h"), 3).alias("area"))


def retained(jobs: DataFrame, now: Column, grace_days: int) -> DataFrame:
    """Media that may go: of complete jobs, downloaded, and untouched for the days of grace."""
    return jobs.where((F.col("status") == "complete") & F.col("local_path").isNotNull() & (F.col("capture_mode") != "local") & (F.col("updated_at") < now - F.make_dt_interval(F.lit(grace_days))))


def reviewed_frames(manifest: DataFrame) -> DataFrame:
    """``stem`` of the frames that a human has looked at: not merely proposed, and no review outstanding; ``manifest (image, status, human_review_required)``."""
    done = (F.col("status").isNull() | (F.col("status") != "proposed")) & ~F.coalesce("human_review_required", F.lit(False))
    return manifest.where(done).select(F.regexp_extract("image", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("stem")).distinct()


def truth_counts(lines: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """``stem, n``: label lines that are not blank per frame; a frame without any says nothing and is left out. ``lines (stem, value)``."""
    n = lines.where(F.trim("value") != "").groupBy("stem").agg(F.count("*").alias("n"))
    return n if keep is None else n.join(keep.select("stem").distinct(), "stem", "left_semi")


def by_event(frames: DataFrame, events: DataFrame, least: int = 6) -> DataFrame:
    """``label, frames, done``: frames per event, most first, and those with ``least`` robots or more.

    ``frames (stem, count)``; a stem begins with its video's 11 characters, which ``events (video, event)`` names. An
    event that begins with a year is shown without it.
    """
    named = frames.withColumn("video", F.substring("stem", 1, 11)).join(events, "video", "left").withColumn("event", F.coalesce("event", "video"))
    label = F.when(F.col("event").rlike(r"^\d{4}"), F.upper(F.expr("substring(event, 5)"))).otherwise(F.col("event"))
    return named.groupBy(label.alias("label")).agg(F.count("*").alias("frames"), F.count_if(F.col("count") >= least).alias("done")).orderBy(F.desc("frames"), "label")


def frame_verdict(readable: Column, flat_share: Column, brightness: Column, spread: Column) -> Column:
    """Why a frame is refused, by measures of its pixels, or ``ok``: graphic card, too bright, too dark, no contrast."""
    return (
        F.when(~F.coalesce(readable, F.lit(False)), "unreadable").when(flat_share > 0.42, "graphic_card").when(brightness > 175.0, "overbright_graphic")
        .when(brightness < 35.0, "too_dark").when(spread < 18.0, "no_contrast").otherwise("ok")
    )


def tile_origins(total: Column, tile: Column, overlapping: float) -> Column:
    """Offsets of tiles along one side, flush with its far end; one for a side no longer than a tile, none without size."""
    step = F.greatest(F.lit(1), F.floor(tile * (1.0 - overlapping))).cast("long")
    last = (total - tile).cast("long")
    return F.when((tile <= 0) | (total <= 0), F.array().cast("array<bigint>")).when(total <= tile, F.array(F.lit(0).cast("long"))).otherwise(F.array_union(F.sequence(F.lit(0).cast("long"), last, step), F.array(last)))


def from_tile(box: Column, tile: Column, width: Column, height: Column) -> Column:
    """A box of a tile ``struct(x, y, w, h)`` in pixels, as a box of the frame."""
    at = lambda c, w, n: (box[c] * tile[w] + tile[c]) / n
    return F.struct(at("x", "w", width).alias("x"), at("y", "h", height).alias("y"), (box["w"] * tile["w"] / width).alias("w"), (box["h"] * tile["h"] / height).alias("h"))


def clipped_by_tile(box: Column, tile: Column, width: Column, height: Column, pixels: float = 2.0) -> Column:
    """Whether a box touches an edge of its tile that is no edge of the frame."""
    mx, my = pixels / tile["w"], pixels / tile["h"]
    low = ((box["x"] <= mx) & (tile["x"] > 0)) | ((box["y"] <= my) & (tile["y"] > 0))
    high = ((box["x"] + box["w"] >= 1 - mx) & (tile["x"] + tile["w"] < width)) | ((box["y"] + box["h"] >= 1 - my) & (tile["y"] + tile["h"] < height))
    return low | high
