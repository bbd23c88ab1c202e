"""Work that is done once: items named by their content and the settings they are worked with.

A run plans the items that the ledger lacks, works them, and commits results and ledger rows as one version of a store; so
a second run plans nothing, changed settings plan just what they touch, and a run that dies leaves no half item.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.functions.exprs import sha_fraction
from matchlake.sources.store import Change, Store, Version

ITEMS, RESULTS = "items", "results"


def digest(settings: dict) -> str:
    """SHA-256 of settings, whatever the order of their names."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class Ledger:
    """``items`` and ``results`` of one store; an item is a row named by the columns ``identity``, its content's hash among them."""

    def __init__(self, store: Store, identity: Sequence[str]):
        self.store, self.identity = store, list(identity)

    def plan(self, work: DataFrame, settings: dict) -> tuple[DataFrame, Version]:
        """Rows of ``work`` with ``item_id`` that are not done under these settings, one of each, and the version they were compared with."""
        base = self.store.version()
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.identity]
        named = work.withColumn("item_id", F.sha2(F.concat_ws(":", *parts, F.lit(digest(settings))), 256)).dropDuplicates(["item_id"])
        if ITEMS in base.tables:
            named = named.join(self.store.read(ITEMS, base).select("item_id"), "item_id", "left_anti")
        return named, base

    def commit(self, planned: DataFrame, results: DataFrame, base: Version) -> Version:
        """Publish the results of planned items, none of which need have any, and note the items as done.

        Raises :class:`matchlake.sources.store.Conflict` if another run has committed since the plan was made.
        """
        return self.store.commit({ITEMS: Change(planned), RESULTS: Change(results)}, base)

    def results(self) -> DataFrame:
        return self.store.read(RESULTS)


def frame_rows(recordings: DataFrame, sampling_fps: float, seed: str, train: float = 0.8, valid: float = 0.9) -> DataFrame:
    """A row per sampled frame of ``(item_id, match_id, video_id, start_offset, duration, fps)``.

    ``frame_id, item_id, match_id, video_id, segment_time, source_time, frame_index, split``: frame n lies at
    ``n / sampling_fps``, and all frames of a match (of a video's offset, where the match is unknown) fall in one split.
    """
    group = F.coalesce("match_id", F.concat_ws(":", "video_id", F.col("start_offset").cast("string")))
    u = sha_fraction(F.lit(seed), group)
    n = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("duration") * sampling_fps) - 1)))
    rows = recordings.where("duration > 0").withColumn("n", n).withColumn("segment_time", F.round(F.col("n") / sampling_fps, 6))
    return rows.select(
        F.concat("item_id", F.lit("-f"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("frame_id"), "item_id", "match_id", "video_id", "segment_time",
        F.round(F.col("start_offset") + F.col("segment_time"), 6).alias("source_time"), F.bround(F.col("segment_time") * F.col("fps")).cast("long").alias("frame_index"),
        F.when(u < train, "train").when(u < valid, "valid").otherwise("test").alias("split"),
    )
