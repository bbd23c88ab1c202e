"""Shared scratch space for materialised intermediate tables.

Lineage is cut by writing Parquet into the folder named by ``spark.checkpoint.dir``, which driver and
executors share; a lost executor then costs a reread, not a recomputation of everything before.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def root(spark: SparkSession) -> str:
    """The shared folder; a local session without one (tests) gets a folder of its own, a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="matchlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Short rows that one task may as well write: fewer make files that cost more to open than to read.
ROWS_A_TASK = 100_000


class Scratch:
    """A uniquely named folder below :func:`root`; ``save`` writes a table and reads it back.

    A folder of its own goes when the session's file systems close; one given as ``path`` stays.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None):
        self.spark = spark
        self.path = path or f"{root(spark)}/{name}-{uuid.uuid4().hex}"
        if path is None:
            fs, p = self._file(self.path)
            fs.mkdirs(p)
            fs.deleteOnExit(p)

    def _file(self, path: str) -> tuple:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str, small: bool = False, rows: int | None = None) -> DataFrame:
        """``small`` tables, a few bytes a row and made without a shuffle, are gathered into files of a sensible size.

        Of a table known to have about ``rows`` short rows at most, no task writes much fewer than ROWS_A_TASK.
        """
        df = df.hint("rebalance") if small else df
        df = df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_TASK)))
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more; without names, the whole folder."""
        for target in [self.at(n) for n in names] or [self.path]:
            fs, p = self._file(target)
            fs.delete(p, True)


#: Rows of a few dozen bytes that may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 200_000


def sized(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of ids or digests, marked for broadcast if its row count, which the files tell, is within a bound."""
    return F.broadcast(table) if table.count() <= rows else table


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def held(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session that holds for what is planned and run inside; its own holds again afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: What Spark and a Python worker pass each other at once inside :func:`small_batches`.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 512


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of few bytes for the Python steps that run inside, whatever the length of their cells.

    A table made inside must be written there.
    """
    with held(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)), held(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        yield


def free(table: DataFrame, *names: str) -> list[str]:
    """The names, each with as many ``_`` before it as make it unlike any column of ``table``."""
    taken, out = {c.lower() for c in table.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _is_scan(table: DataFrame) -> bool:
    """Whether a table is a scan of files, with or without a choice of rows and columns, so that no row of a file is there twice."""
    node = table._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    return node.nodeName() == "LogicalRelation"


def placed(table: DataFrame, name: str) -> DataFrame:
    """``table`` with the place of each row, from 0, in the order in which its files were written.

    File scans keep no order, but they tell a row's file and its place there; files are numbered by their writer's
    partition and sequence, and what the earlier ones hold is a running sum over one row a file. A table that is no
    plain scan is written first, in the order of its partitions.
    """
    file, at, base, path = free(table, "file", "at", "base", "path")
    scan = table if _is_scan(table) else Scratch(table.sparkSession, "placed").save(table, "rows")
    rows = scan.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
    number = lambda pattern: F.regexp_extract(path, pattern, 1).try_cast("long").asc_nulls_first()
    sizes = rows.groupBy(F.col(file).alias(path)).agg((F.max(at) + 1).alias("rows"))
    earlier = Window.orderBy(number(r"part-(\d+)-[^/]*$"), number(r"-c(\d+)[^/-]*$"), path).rowsBetween(Window.unboundedPreceding, -1)
    bases = Scratch(table.sparkSession, "files").save(sizes.select(path, F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias(base)), "bases")
    joined = rows.join(sized(bases), F.col(file) == F.col(path))
    return joined.select(*[F.col(f"`{c}`") for c in table.columns], (F.col(base) + F.col(at)).alias(name))
