"""Lists in pages, and single jobs, without reading what lies before or beside them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _parts(order: Sequence[str]) -> list[tuple[str, bool]]:
    return [(name.lstrip("-"), name.startswith("-")) for name in order]


def after(order: Sequence[str], last: dict) -> Column:
    """Whether a row comes behind ``last``, a row's values, in ``order``: names, with ``-`` before those that fall.

    Nulls come last either way, and follow each other by the columns that come next.
    """
    behind, equal = F.lit(False), F.lit(True)
    for name, falls in _parts(order):
        c, value = F.col(name), last[name]
        if value is None:
            beyond = F.lit(False)
        else:
            beyond = c.isNull() | ((c < value) if falls else (c > value))
        behind = behind | (equal & F.coalesce(beyond, F.lit(False)))
        equal = equal & c.eqNullSafe(F.lit(value))
    return behind


def page(rows: DataFrame, order: Sequence[str], size: int, after: dict | None = None) -> DataFrame:
    """``size`` rows in ``order``, the first ones or those behind the row whose values are given.

    ``order`` must end with a column that tells rows apart, or rows equal to the last one are passed over. Each task keeps
    ``size`` rows; rows before the page go by a comparison that reaches the scan, so a late page costs no more than an
    early one and rows that come or go meanwhile shift nothing.
    """
    kept = rows if after is None else rows.where(_after(order, after))
    keys = [F.col(n).desc_nulls_last() if falls else F.col(n).asc_nulls_last() for n, falls in _parts(order)]
    return kept.orderBy(*keys).limit(size)


_after = after


def library(jobs: DataFrame, size: int, last: dict | None = None, event: str | None = None, status: str | None = None, text: str | None = None) -> DataFrame:
    """A page of the match library: the newest jobs first, ``job_id`` telling equal times apart, jobs without a time last.

    ``event`` is the part of the match id before its last ``_``; ``text`` is looked for in match and job ids, in any case.
    """
    kept = jobs if status is None else jobs.where(F.col("status") == status)
    kept = kept if event is None else kept.where(F.regexp_extract("match_id", r"^(.*)_[^_]*$", 1) == event)
    if text is not None:
        kept = kept.where(F.contains(F.lower(F.concat_ws(" ", "match_id", "job_id")), F.lit(text.lower())))
    return page(kept, ["-created_at", "job_id"], size, last)


class JobFiles:
    """A table sorted by job, with the first and last job of each file, so that one job's rows are read from few files."""

    def __init__(self, spark: SparkSession, path: str, key: str = "job_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def append(self, rows: DataFrame, files: int | None = None) -> None:
        """Add rows in files of their own; a reader knows them once their index is there."""
        part, n = uuid.uuid4().hex, files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartitionByRange(n, self.key).sortWithinPartitions(self.key)
        dealt.write.option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(f"{self.path}/data/{part}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{part}")
        ranges = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count_if(F.col(self.key).isNull()).alias("nulls"))
        ranges.coalesce(1).write.mode("append").parquet(f"{self.path}/index")

    def files(self, keys: Sequence) -> list[str]:
        """The files that may hold any of a few keys; null is a key."""
        index = self.spark.read.parquet(f"{self.path}/index")
        meets = F.lit(False)
        for k in keys:
            meets = meets | (F.col("nulls") > 0 if k is None else F.lit(k).between(F.col("low"), F.col("high")))
        return [r.file for r in index.where(meets).select("file").collect()]

    def get(self, keys: Sequence) -> DataFrame:
        """All rows of a few keys."""
        files = self.files(keys)
        if not files:
            return self.spark.read.parquet(*[r.file for r in self.spark.read.parquet(f"{self.path}/index").limit(1).collect()]).limit(0)
        rows, wanted = self.spark.read.parquet(*files), F.lit(False)
        for k in keys:
            wanted = wanted | F.col(self.key).eqNullSafe(F.lit(k))
        return rows.where(wanted)
