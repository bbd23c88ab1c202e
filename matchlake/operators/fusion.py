"""Detector proposals: clusters, consensus, fused boxes, source weights, filters, links over frames.

A frame holds a few dozen boxes, so folds run over one frame's ordered array; everything else is joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.exprs import centre_distance, iou, is_finite
from matchlake.functions.folds import suppress
from matchlake.operators.ordered import fold_whole
from matchlake.sources.work import staged

FUSE_IOU, AGREEMENT_EXPONENT, TIGHTNESS_FLOOR, LEAST_WEIGHT = 0.40, 0.5, 0.7, 0.1
#: Frames that a box must span to be confirmed by time.
CONFIRMED_FRAMES = 3
_BOX = "struct<confidence:double,source:string,x:double,y:double,w:double,h:double>"


def _frames(proposals: DataFrame) -> DataFrame:
    """``frame_id, boxes``: a frame's boxes, most confident first, ties by source and place."""
    box = F.struct((-F.col("confidence")).alias("o"), "source", "x", "y", "w", "h", "confidence")
    plain = lambda b: F.struct(*[b[k].alias(k) for k in ("confidence", "source", "x", "y", "w", "h")])
    return proposals.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(box)), plain).alias("boxes"))


def _clustered(boxes: Column, least: float, best: bool) -> Column:
    """Clusters of a frame's boxes: each joins the first (or the best) cluster that lacks its source and that it overlaps enough."""

    def add(clusters: Column, b: Column) -> Column:
        def fit(c: Column) -> Column:
            overlap = F.array_max(F.transform(c, lambda m: iou(m, b)))
            return F.when(~F.exists(c, lambda m: m["source"] == b["source"]) & (overlap >= least), overlap).otherwise(-1.0)

        fits = F.transform(clusters, fit)
        at = F.array_position(fits, F.array_max(fits)) if best else F.array_position(F.transform(fits, lambda f: f >= 0), F.lit(True))
        joins = F.coalesce(F.array_max(fits) >= 0, F.lit(False))
        grown = F.transform(clusters, lambda c, i: F.when(i == at - 1, F.concat(c, F.array(b))).otherwise(c))
        return F.when(joins, grown).otherwise(F.concat(clusters, F.array(F.array(b))))

    return F.aggregate(boxes, F.array().cast(f"array<array<{_BOX}>>"), add)


def clusters(proposals: DataFrame, least: float = FUSE_IOU, best: bool = False) -> DataFrame:
    """``frame_id, cluster, members``."""
    return _frames(proposals).select("frame_id", F.posexplode(_clustered(F.col("boxes"), least, best)).alias("cluster", "members"))


def source_weights(proposals: DataFrame, least: float = FUSE_IOU) -> DataFrame:
    """``source, weight``: the share of a source's boxes that another source overlaps, at least LEAST_WEIGHT, with mean 1."""
    rows = proposals.select("frame_id", "source", *[F.col(c).cast("double") for c in "xywh"])
    backed = fold_whole(rows, ["frame_id"], [], ["source", "x", "y", "w", "h"], lambda b, starts: _backing(b, starts, least), "source string, boxes long, backed long")
    rates = backed.groupBy("source").agg(F.greatest(F.lit(LEAST_WEIGHT), F.sum("backed") / F.sum("boxes")).alias("rate"))
    return rates.select("source", (F.col("rate") / F.avg("rate").over(Window.partitionBy())).alias("weight"))


def _numbers(batch: pa.RecordBatch, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Of each row its frame, its place there and its source's number in order of names; and the names."""
    sizes = np.diff(np.append(starts, batch.num_rows))
    of = np.repeat(np.arange(len(starts)), sizes)
    sources = batch["source"].dictionary_encode(null_encoding="encode")
    names = sources.dictionary.to_pylist()
    order = sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i]))
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    return of, np.arange(batch.num_rows) - starts[of], rank[sources.indices.to_numpy(zero_copy_only=False)], [names[i] for i in order]


def _overlaps(boxes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`overlap` of the boxes at ``a`` and at ``b``, of columns ``x, y, w, h``."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = (c[a] for c in boxes), (c[b] for c in boxes)
    w = np.maximum(0.0, np.minimum(ax + aw, bx + bw) - np.maximum(ax, bx))
    h = np.maximum(0.0, np.minimum(ay + ah, by + bh) - np.maximum(ay, by))
    union = aw * ah + bw * bh - w * h
    return np.divide(w * h, union, out=np.zeros(union.shape), where=union > 0)


def _boxes(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch[c].to_numpy(zero_copy_only=False) for c in "xywh"])


def _backing(batch: pa.RecordBatch, starts: np.ndarray, least: float) -> tuple[np.ndarray, list]:
    """Of many frames, the boxes of each source and those of them that another source overlaps."""
    of, place, source, names = _numbers(batch, starts)
    boxes, left = _boxes(batch), np.diff(np.append(starts, batch.num_rows))[of] - place
    backed, a, step = np.zeros(len(of), bool), np.arange(len(of)), 1
    while len(a := a[left[a] > step]):
        b = a + step
        met = (source[a] != source[b]) & (_overlaps(boxes, a, b) >= least)
        backed[a[met]] = backed[b[met]] = True
        step += 1
    found, at = np.unique(of * len(names) + source, return_inverse=True)
    return found // len(names), [pa.array(names, pa.string()).take(pa.array(found % len(names))), np.bincount(at), np.bincount(at, backed).astype(np.int64)]


def overlap(a: Sequence[float], b: Sequence[float]) -> float:
    """Overlap of two ``x, y, w, h`` boxes by union, 0 where they have no area."""
    w = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / union if union > 0 else 0.0


def _pairwise(members: Column) -> Column:
    n = F.size(members)
    return F.flatten(F.transform(members, lambda a, i: F.transform(F.slice(members, i + 2, n), lambda b: iou(a, b))))


def _joined(boxes: np.ndarray, of: np.ndarray, place: np.ndarray, source: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each box its cluster, and the sum and number of its overlaps with the members before it.

    Boxes of one place in all frames are taken together: each joins the first cluster that lacks its source and of which
    it overlaps a member enough, else begins one.
    """
    n = len(of)
    cluster, overlaps, pairs = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
    made = np.zeros(int(of[-1]) + 1 if n else 0, np.int64)
    order = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[order], np.arange(int(place.max()) + 2 if n else 1))
    for p, (lo, hi) in enumerate(zip(ends, ends[1:])):
        rows = order[lo:hi]
        before = rows[:, None] - np.arange(p, 0, -1)
        over = _overlaps(boxes, np.broadcast_to(rows[:, None], before.shape), before)
        at, line = cluster[before], np.broadcast_to(np.arange(len(rows))[:, None], before.shape)
        fits, taken = np.zeros((len(rows), p + 1), bool), np.zeros((len(rows), p + 1), bool)
        fits[line[over >= least], at[over >= least]] = True
        same = source[before] == source[rows, None]
        taken[line[same], at[same]] = True
        fits &= ~taken & (np.arange(p + 1) < made[of[rows], None])
        joins = fits.any(1)
        cluster[rows] = np.where(joins, fits.argmax(1), made[of[rows]])
        made[of[rows]] += ~joins
        mates = joins[:, None] & (at == cluster[rows, None])
        overlaps[rows], pairs[rows] = np.where(mates, over, 0.0).sum(1), mates.sum(1)
    return cluster, overlaps, pairs


def _fused(batch: pa.RecordBatch, starts: np.ndarray, least: float) -> tuple[np.ndarray, list]:
    """Clusters of many frames' boxes, most confident first, and the weighted mean of each.

    ``total`` is the weight of all that looked at the frame; without one, that of the sources with a box.
    """
    of, place, source, names = _numbers(batch, starts)
    boxes = _boxes(batch)
    confidence, weight, total = (batch[c].to_numpy(zero_copy_only=False).astype(float) for c in ("confidence", "weight", "total"))
    cluster, overlaps, pairs = _joined(boxes, of, place, source, least)
    first = np.sort(np.unique(of * len(names) + source, return_index=True)[1])
    seen = np.bincount(of[first], weight[first], len(starts))
    looked = np.where(np.isnan(total[starts]), seen, total[starts])
    width = int(place.max()) + 1
    key, at = np.unique(of * width + cluster, return_inverse=True)
    frame, value = key // width, weight * np.maximum(1e-6, confidence)
    whole = np.bincount(at, value)
    mean = lambda x: np.bincount(at, x * value) / whole
    n = np.bincount(at, pairs)
    tight = np.divide(np.bincount(at, overlaps), n, out=np.zeros(len(key)), where=n > 0)
    agreement = np.minimum(1.0, np.bincount(at, weight) / looked[frame])
    members = np.lexsort((source, at))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(at))])
    sources = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(names, pa.string()).take(pa.array(source[members])))
    return frame, [key % width, *[mean(c) for c in boxes], mean(confidence), agreement, tight, sources]


def fuse(proposals: DataFrame, weights: DataFrame | None = None, least: float = FUSE_IOU, frames: DataFrame | None = None) -> DataFrame:
    """Weighted mean box of each cluster, with agreement of sources, mean pairwise overlap and confidence.

    Agreement is the weight of the sources in a cluster out of that of all that looked at the frame: ``frames
    (frame_id, source)`` lists those, also where they found nothing; without it only sources with a box count.
    """
    p = proposals.select("frame_id", "source", "x", "y", "w", "h", "confidence")
    weigh = lambda df: df.withColumn("weight", F.lit(1.0)) if weights is None else df.join(weights.select("source", "weight"), "source", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    if frames is None:
        rows = weigh(p).withColumn("total", F.lit(None).cast("double"))
    else:
        ran = frames.select("frame_id", "source").union(p.select("frame_id", "source"))
        rows = weigh(p).join(weigh(ran.distinct()).groupBy("frame_id").agg(F.sum("weight").alias("total")), "frame_id")
    kind = "cluster int, x double, y double, w double, h double, strength double, agreement double, tightness double, supporting_sources array<string>"
    rows = rows.select("frame_id", "source", *[F.col(c).cast("double") for c in ("x", "y", "w", "h", "confidence", "weight", "total")])
    values = ["source", "x", "y", "w", "h", "confidence", "weight", "total"]
    g = fold_whole(rows, ["frame_id"], [F.desc("confidence"), "source", "x", "y", "w", "h"], values, lambda b, starts: _fused(b, starts, least), kind)
    conf = F.col("strength") * F.pow(F.col("agreement"), AGREEMENT_EXPONENT) * (TIGHTNESS_FLOOR + (1 - TIGHTNESS_FLOOR) * F.col("tightness"))
    return g.select(
        "frame_id", "cluster", *[F.bround(c, 6).alias(c) for c in "xywh"], F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)), 6).alias("confidence"), "supporting_sources",
        F.size("supporting_sources").alias("agreement_count"), F.bround("agreement", 4).alias("agreement"), F.bround("tightness", 4).alias("tightness"), F.bround("strength", 4).alias("strength"),
    )


def consensus(proposals: DataFrame, models: int, least: float = 0.5) -> DataFrame:
    """Clusters that enough models support (both of two or more), by their most confident box; least overlap is null for one model."""
    need = 1 if models == 1 else 2
    c = clusters(proposals, least, best=True).where(F.size("members") >= need)
    b = F.element_at("members", 1)
    return c.select("frame_id", "cluster", *[b[k].alias(k) for k in ("x", "y", "w", "h", "confidence")], F.array_sort(F.transform("members", lambda m: m["source"])).alias("models"), F.array_min(_pairwise(F.col("members"))).alias("least_overlap"))


def model_report(proposals: DataFrame, agreed: DataFrame) -> DataFrame:
    """Per model: frames, boxes, and boxes that entered a consensus."""
    votes = agreed.select(F.explode("models").alias("source")).groupBy("source").agg(F.count("*").alias("agreed"))
    return proposals.groupBy("source").agg(F.count_distinct("frame_id").alias("frames"), F.count("*").alias("boxes")).join(votes, "source", "left").withColumn("agreed", F.coalesce("agreed", F.lit(0)))


def non_max(proposals: DataFrame, threshold: float) -> DataFrame:
    """Boxes that greedy suppression keeps in each frame."""
    b = proposals.groupBy("frame_id").agg(F.collect_list(F.struct("confidence", "source", "x", "y", "w", "h")).alias("b"))
    return b.select("frame_id", F.explode(suppress(F.col("b"), threshold)).alias("b")).select("frame_id", "b.*")


def box_problem(least_area: float = 0.00015, most_area: float = 0.30, most_aspect: float = 5.0, least_confidence: float = 0.25, roi: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)) -> Column:
    """The first rule a box ``confidence, x, y, w, h`` fails, null if none; boxes that are no boxes are ``invalid``."""
    x, y, w, h = (F.col(c) for c in "xywh")
    cx, cy, area = x + w / 2, y + h / 2, w * h
    valid = is_finite(x) & is_finite(y) & is_finite(w) & is_finite(h) & (w > 0) & (h > 0) & (x >= -1e-6) & (y >= -1e-6) & (x + w <= 1 + 1e-6) & (y + h <= 1 + 1e-6)
    inside = (cx >= roi[0]) & (cy >= roi[1]) & (cx <= roi[2]) & (cy <= roi[3])
    return (
        F.when(~valid, "invalid").when(F.col("confidence") < least_confidence, "low_confidence").when(area < least_area, "too_small").when(area > most_area, "too_large")
        .when(F.greatest(w / h, h / w) > most_aspect, "aspect").when(~inside, "outside_region")
    )


def split_boxes(proposals: DataFrame, threshold: float = 0.5, **rules: float) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: boxes without a problem, after suppression, and the others with their reason."""
    marked = proposals.withColumn("reason", box_problem(**rules))
    return non_max(marked.where("reason is null").drop("reason"), threshold), marked.where("reason is not null")


def plausible_frames(boxes: DataFrame, most: int = 8) -> DataFrame:
    """Boxes of plausible area and aspect; a frame left with more than ``most`` loses all."""
    ok = boxes.where((F.col("w") * F.col("h")).between(0.0015, 0.25) & (F.greatest(F.col("w") / F.col("h"), F.col("h") / F.col("w")) <= 3))
    return ok.withColumn("n", F.count("*").over(Window.partitionBy("frame_id"))).where(F.col("n") <= most).drop("n")


def select_labels(boxes: DataFrame, frames: DataFrame, least: float = 0.6, agreement: int = 2, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Pseudo-label boxes that are confident and corroborated, in frames that exist and have not too many; and counts of what was refused."""
    known = boxes.join(frames.select("frame_id", F.lit(True).alias("known")), "frame_id", "left")
    reason = F.when(F.col("known").isNull(), "no_frame").when(F.col("confidence") < least, "low_confidence").when(F.col("agreement_count") < agreement, "uncorroborated")
    marked = known.withColumn("reason", reason)
    n = F.count(F.when(F.col("reason").isNull(), 1)).over(Window.partitionBy("frame_id"))
    marked = marked.withColumn("reason", F.when(F.col("reason").isNull() & (n > most), "crowded").otherwise(F.col("reason")))
    return marked.where("reason is null").drop("known", "reason"), marked.where("reason is not null").groupBy("reason").count()


def complete_frames(boxes: DataFrame, least: float, doubt: float = 0.25) -> DataFrame:
    """Frames whose labels look complete: no box between ``doubt`` and ``least``, and none above ``doubt`` without a second source."""
    uncertain = ((F.col("confidence") >= doubt) & (F.col("confidence") < least)) | ((F.col("confidence") >= doubt) & (F.col("agreement_count") < 2))
    return boxes.groupBy("frame_id").agg(F.bool_or(uncertain).alias("u")).where("not u").select("frame_id")


class _Links:
    """Tracks of one clip whose rows come frame by frame; of the rows, only those of a frame that may go on are held."""

    def __init__(self, least: float, misses: int):
        self.least, self.misses, self.active, self.made, self.held = least, misses, [], 0, None

    def _linked(self, rows: pd.DataFrame) -> pd.DataFrame:
        index, out, claimed = rows.frame_index.iloc[0], [], set()
        self.active = [t for t in self.active if index - t["seen"] - 1 <= self.misses]
        for b in rows[["x", "y", "w", "h"]].itertuples(index=False, name=None):
            fits = [f for f in ((overlap(t["box"], b), t["id"], t) for t in self.active if t["id"] not in claimed) if f[0] >= self.least]
            if fits:
                t = max(fits, key=lambda f: f[:2])[2]
            else:
                self.made += 1
                self.active.append(t := {"id": self.made})
            t["box"], t["seen"] = b, index
            claimed.add(t["id"])
            out.append(t["id"])
        return rows.assign(track=out)

    def push(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = rows if self.held is None else pd.concat([self.held, rows])
        last = rows.frame_index == rows.frame_index.iloc[-1]
        self.held = rows[last]
        for _, frame in rows[~last].groupby("frame_index", sort=False):
            yield self._linked(frame)

    def close(self) -> Iterator[pd.DataFrame]:
        if self.held is not None:
            yield self._linked(self.held)


def link_frames(boxes: DataFrame, least: float = 0.30, misses: int = 2) -> DataFrame:
    """Adds ``track``: boxes of consecutive frames of one clip linked by best overlap with unclaimed tracks.

    State is the clip's active tracks and one frame; a clip's rows pass through batch by batch, in frame order.
    """
    ordered = boxes.repartition("clip").sortWithinPartitions("clip", "frame_index", F.desc("confidence"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.schema) + ", track int"

    def clips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, links = None, None
        for pdf in batches:
            for clip, rows in pdf.groupby("clip", sort=False, dropna=False):
                if links is None or not (clip == key or (pd.isna(clip) and pd.isna(key))):
                    if links is not None:
                        yield from links.close()
                    key, links = clip, _Links(least, misses)
                yield from links.push(rows)
        if links is not None:
            yield from links.close()

    return ordered.mapInPandas(clips, schema)


def persistence(linked: DataFrame, full: int = 3) -> DataFrame:
    """Scales confidence by ``min(1, span / full)`` of the frames a track spans."""
    span = linked.groupBy("clip", "track").agg((F.max("frame_index") - F.min("frame_index") + 1).alias("span"))
    return linked.join(span, ["clip", "track"]).withColumn("confidence", F.col("confidence") * F.least(F.lit(1.0), F.col("span") / full))


def agreement_with(truth: DataFrame, predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """Precision, recall and F1 of boxes of one class in a frame, matched one to one, greatest overlap first.

    The pairs of one frame and class are ordered and taken in a fold; frames are independent.
    """
    t = truth.groupBy("frame_id", "kind").agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("t"))
    p = predicted.groupBy("frame_id", "kind").agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("p"))
    both = t.join(p, ["frame_id", "kind"], "full_outer").withColumn("t", F.coalesce("t", F.array().cast("array<struct<x:double,y:double,w:double,h:double>>"))).withColumn("p", F.coalesce("p", F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")))
    pairs = F.filter(F.flatten(F.transform("t", lambda a, i: F.transform("p", lambda b, j: F.struct((-iou(a, b)).alias("o"), i.alias("i"), j.alias("j"))))), lambda r: -r["o"] >= least)
    taken = F.aggregate(F.array_sort(pairs), F.slice(pairs, 1, 0), lambda k, r: F.when(F.exists(k, lambda x: (x["i"] == r["i"]) | (x["j"] == r["j"])), k).otherwise(F.concat(k, F.array(r))))
    n = both.select(F.size(taken).alias("hit"), F.size("t").alias("nt"), F.size("p").alias("np")).agg(F.sum("hit").alias("tp"), F.sum("nt").alias("truths"), F.sum("np").alias("found"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = n.withColumn("precision", ratio(F.col("tp"), F.col("found"))).withColumn("recall", ratio(F.col("tp"), F.col("truths")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def near_links(boxes: DataFrame, other: DataFrame, limit: float) -> DataFrame:
    """Pairs of boxes of one frame whose centres are within ``limit``."""
    a, b = boxes.select("frame_id", F.struct("x", "y", "w", "h").alias("a")), other.select("frame_id", F.struct("x", "y", "w", "h").alias("b"))
    return a.join(b, "frame_id").withColumn("distance", centre_distance(F.col("a"), F.col("b"))).where(F.col("distance") <= limit)


def label_sequence(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """Proposed labels of a clip: its detector's boxes fused with those of them that persist over frames.

    ``frames (clip, frame_index, t, verdict)``, ``boxes (clip, frame_index, confidence, x, y, w, h)``; boxes of frames
    whose verdict is not ``ok`` are left out. Columns as of :func:`fuse`, with ``clip, frame_index, t`` and the status of
    a proposal. Both sources look at every frame kept, so a box that does not persist has half the agreement or so.
    """
    ok = frames.where("verdict = 'ok'").select("clip", "frame_index", "t")
    seen = boxes.join(ok.select("clip", "frame_index"), ["clip", "frame_index"], "left_semi")
    spans = link_frames(seen).withColumn("span", F.max("frame_index").over(Window.partitionBy("clip", "track")) - F.min("frame_index").over(Window.partitionBy("clip", "track")) + 1)
    key = F.to_json(F.struct("clip", "frame_index")).alias("frame_id")
    cols = [F.col(c) for c in ("x", "y", "w", "h", "confidence")]
    both = staged(seen.select(key, F.lit("detector").alias("source"), *cols).unionByName(spans.where(F.col("span") >= CONFIRMED_FRAMES).select(key, F.lit("time").alias("source"), *cols)))
    looked = ok.select(key, F.explode(F.array(F.lit("detector"), F.lit("time"))).alias("source"))
    fused = fuse(both, source_weights(both), frames=looked)
    return ok.select("clip", "frame_index", "t", key).join(fused, "frame_id").drop("frame_id").withColumn("status", F.lit("proposed")).withColumn("human_review_required", F.lit(True))
