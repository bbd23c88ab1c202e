"""Writing results: JSON and CSV, replacement by job, keyed merges, pose logs."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.operators.temporal import heading_hold

FEET = 0.3048
#: Robot number, time, x, y, heading; 32 bytes.
RECORD = "<idddf"


def _swapped(df: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> None:
    """Write beside ``path`` and rename: what is there stays until the new folder is whole, and is missing between two renames only.

    Readers that must never meet that moment read a :class:`matchlake.sources.store.Store`.
    """
    new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    write(df, new)
    jvm = df.sparkSession.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    before = fs.exists(at) and fs.rename(at, jvm.org.apache.hadoop.fs.Path(old))
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(new), at):
        raise OSError(f"{new} could not be renamed to {path}")
    if before:
        fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in a folder that takes the place of an earlier one once it is whole."""
    _swapped(df, path, lambda d, p: d.write.json(p))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header, as :func:`write_json`."""
    _swapped(df.select(*columns), path, lambda d, p: d.write.option("header", True).csv(p))


def replace_jobs(df: DataFrame, path: str) -> None:
    """Replace the rows of the jobs in ``df`` and leave those of other jobs as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


def delete_job(spark: SparkSession, paths: list[str], job_id: str) -> None:
    """Remove a job's partition of every table."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/job_id={job_id}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def upsert_jobs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Jobs by id: new values win, a null keeps the old one."""
    n = new.select([F.col(c).alias(f"n_{c}") for c in new.columns])
    both = old.join(n, old.job_id == n.n_job_id, "full_outer")
    return both.select([F.coalesce(F.col(f"n_{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in old.columns])


def export_rows(df: DataFrame, mode: str) -> DataFrame:
    """Rows for a sheet with a stable ``row_key`` first: one per event (``raw``) or per match and team (``aggregate``)."""
    key = F.col("event_id") if mode == "raw" else F.concat_ws("|", "match_id", F.col("team").cast("string"))
    return df.select(key.alias("row_key"), *df.columns)


def keyed_merge(old: DataFrame, new: DataFrame, key: str = "row_key") -> DataFrame:
    """Old and new rows by key with ``change``: kept (only old), skipped (equal), changed or appended."""
    cols = [c for c in new.columns if c != key]
    n = new.select(F.col(key), F.struct(*cols).alias("n"))
    o = old.select(F.col(key), F.struct(*cols).alias("o"))
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "appended").when(F.col("o").eqNullSafe(F.col("n")), "skipped").otherwise("changed")
    return both.select(key, F.coalesce("n", "o").alias("r"), change.alias("change")).select(key, "r.*", "change")


def merge_counts(merged: DataFrame) -> DataFrame:
    """``written, skipped`` of a merge."""
    return merged.agg(F.count_if(F.col("change").isin("changed", "appended")).alias("written"), F.count_if(F.expr("change = 'skipped'")).alias("skipped"))


def refuse_empty(rows: DataFrame, events: DataFrame) -> DataFrame:
    """The rows, or an error that says how many events there are and how many have a team."""
    if rows.isEmpty():
        n = events.agg(F.count("*").alias("n"), F.count("team").alias("named")).first()
        raise ValueError(f"nothing to export: {n.n} events, {n.named} of them with a team")
    return rows


def pose_log(samples: DataFrame) -> DataFrame:
    """One binary row per job: 32-byte records of robot number, time, x and y in metres and heading, in order of time.

    Robots are numbered in key order. The heading of travel is held while a robot stands and forgotten where it is
    unplaced. Records of a job are formed where its sorted rows stream by.
    """
    rows = heading_hold(samples, ["job_id", "robot_key"], "t").where("x is not null")
    numbered = rows.withColumn("robot", F.dense_rank().over(Window.partitionBy("job_id").orderBy("robot_key"))).select("job_id", "t", "robot", (F.col("x") * FEET).alias("x"), (F.col("y") * FEET).alias("y"), "heading")
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for job, g in pdf.groupby("job_id", sort=False):
                body = b"".join(struct.pack(RECORD, int(r.robot), r.t, r.x, r.y, r.heading) for r in g.itertuples())
                yield pd.DataFrame({"job_id": [job], "first_t": [float(g.t.iloc[0])], "body": [body]})

    return numbered.repartition("job_id").sortWithinPartitions("job_id", "t", "robot").mapInPandas(pack, "job_id string, first_t double, body binary")


def markdown(df: DataFrame, rows: int = 200) -> str:
    """A report table of at most ``rows`` rows; reports are small by nature."""
    cells = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in df.limit(rows).collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in cells)
