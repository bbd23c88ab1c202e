"""Progress of streams as rows: what each has done, how fast, how far behind, and how it ended."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

ROW = "query string, run string, name string, at timestamp, stage string, batch long, rows long, rows_per_s double, lag_s double, state_rows long, error string"


def _seconds(text: str | None) -> datetime | None:
    return datetime.fromisoformat(text.replace("Z", "+00:00")) if text else None


class JobTable(StreamingQueryListener):
    """Writes a row for each start, batch and end of a stream below ``path``, in shared storage.

    Stages are ``started``, ``running``, ``idle`` (no new rows), ``finished`` and ``failed``. ``lag_s`` is the time between
    the newest event time read and the watermark. A row is one small file, put there whole, so a reader never meets half
    of one; :meth:`compact` gathers them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.names: dict[str, str | None] = {}

    def _put(self, event, stage: str, at: str | None = None, **more) -> None:
        row = {"query": str(event.id), "run": str(event.runId), "name": self.names.get(str(event.id)), "at": at or datetime.now(UTC).isoformat(), "stage": stage} | more
        jvm = self.spark.sparkContext._jvm
        name = uuid.uuid4().hex
        draft, target = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{name}.json") for kind in ("drafts", "rows"))
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(target.getParent())
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray((json.dumps(row) + "\n").encode()))
        finally:
            stream.close()
        fs.rename(draft, target)

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name
        self._put(event, "started", event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        times = p.eventTime or {}
        newest, mark = _seconds(times.get("max")), _seconds(times.get("watermark"))
        lag = (newest - mark).total_seconds() if newest and mark else None
        state = sum(s.numRowsTotal for s in p.stateOperators)
        self._put(p, "running" if p.numInputRows else "idle", p.timestamp, batch=p.batchId, rows=p.numInputRows, rows_per_s=p.processedRowsPerSecond if p.numInputRows else None, lag_s=lag, state_rows=state)

    def onQueryIdle(self, event) -> None:
        self._put(event, "idle", event.timestamp)

    def onQueryTerminated(self, event) -> None:
        error = event.exception
        self._put(event, "failed" if error else "finished", error=" ".join(error.split())[:2000] if error else None)

    def rows(self) -> DataFrame:
        """All rows so far, those of :meth:`compact` included."""
        jvm = self.spark.sparkContext._jvm
        out = self.spark.createDataFrame([], ROW)
        for kind, read in (("rows", self.spark.read.schema(ROW).json), ("old", self.spark.read.schema(ROW).parquet)):
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
            if p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
                out = out.unionByName(read(f"{self.path}/{kind}"))
        return out.distinct()

    def latest(self) -> DataFrame:
        """The present state of each run of a stream, with its batches and rows so far."""
        rank = F.row_number().over(Window.partitionBy("query", "run").orderBy(F.desc("at"), F.desc_nulls_last("batch"), F.col("stage").isin("failed", "finished").desc()))
        r = self.rows()
        ended = F.max(F.when(F.col("stage").isin("failed", "finished"), F.struct("stage", "error"))).over(Window.partitionBy("query", "run"))
        totals = r.groupBy("query", "run").agg(F.countDistinct("batch").alias("batches"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"))
        last = r.withColumn("_end", ended).withColumn("_rn", rank).where("_rn = 1")
        last = last.withColumn("stage", F.coalesce("_end.stage", "stage")).withColumn("error", F.coalesce("_end.error", "error"))
        return last.drop("_rn", "_end", "rows").join(totals, ["query", "run"])

    def compact(self) -> None:
        """Gather the small files into Parquet; a row read from both on the way counts once."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        if files:
            self.spark.read.schema(ROW).json([f.toString() for f in files]).coalesce(1).write.mode("append").parquet(f"{self.path}/old")
            for f in files:
                fs.delete(f, False)
