"""Exact deduplication against a persistent digest index.

The index is made of two Parquet tables bucketed and sorted by digest: ``base``, one file a bucket, and ``delta``,
to which batches append. A batch is compared with both by sort-merge anti-joins that shuffle only the batch's
digests; the files of ``base`` are merged as they lie, without a sort. When ``delta`` has grown to many files a
bucket, both are merged into the base of the next generation, and only then does that generation count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.scratch import Scratch
from matchlake.llm.text import ascii_lower

#: Files a bucket of ``delta`` above which it is merged into ``base``.
MOST_FILES = 8
#: Lets Spark see that a bucket of one file is sorted; it looks at the files when it plans.
_SORTED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class DigestIndex:
    """Digests seen so far, each with the doc_id of the row that stays for it.

    ``path`` is a folder in shared storage. The number of buckets is fixed when the index is made and read from
    the folder afterwards, so any later session can open it. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path = spark, path
        meta = f"{path}/meta"
        if self._exists(meta):
            buckets = spark.read.schema("buckets int").parquet(meta).first().buckets
        else:
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(meta)
        self.buckets, self.generation = buckets, 0
        while self._exists(f"{path}/whole-{self.generation + 1}"):
            self.generation += 1
        for kind in ("base", "delta"):
            self._create(kind)

    def _fs(self, path: str) -> tuple:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def table(self, kind: str) -> str:
        """Name of the session's table for ``base`` or ``delta`` of the present generation."""
        return f"digests_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{kind}_{self.generation}"

    def _at(self, kind: str) -> str:
        return f"{self.path}/{kind}-{self.generation}"

    def _create(self, kind: str) -> None:
        self.spark.sql(
            f"create table if not exists {self.table(kind)} (digest binary, keep_id bigint) using parquet"
            f" clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{self._at(kind)}'"
        )

    def part(self, kind: str) -> DataFrame:
        self.spark.catalog.refreshTable(self.table(kind))
        return self.spark.table(self.table(kind))

    def rows(self) -> DataFrame:
        """All digests, read as plain files."""
        held = [self._at(kind) for kind in ("base", "delta") if self.files(kind)]
        none = self.spark.createDataFrame([], "digest binary, keep_id long")
        return self.spark.read.schema(none.schema).parquet(*held) if held else none

    def files(self, kind: str) -> int:
        return len(self.part(kind).inputFiles())

    @contextmanager
    def _sorted_scans(self) -> Iterator[None]:
        before = self.spark.conf.get(_SORTED_SCAN)
        self.spark.conf.set(_SORTED_SCAN, "true")
        try:
            yield
        finally:
            self.spark.conf.set(_SORTED_SCAN, before)

    def new(self, digests: DataFrame) -> DataFrame:
        """Rows of ``digests (digest, ...)``, no digest twice, that the index lacks."""
        dealt = digests.repartition(self.buckets, "digest")
        for kind in ("base", "delta"):
            dealt = dealt.join(self.part(kind).hint("merge"), "digest", "left_anti")
        return dealt

    def _append(self, rows: DataFrame, kind: str) -> None:
        to = rows.select("digest", "keep_id").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        to.option("path", self._at(kind)).saveAsTable(self.table(kind))

    def compact(self) -> None:
        """Merge both tables into the base of the next generation and remove this one's files."""
        old = [(self.table(kind), self._at(kind)) for kind in ("base", "delta")]
        both = self.rows().repartition(self.buckets, "digest")
        self.generation += 1
        for kind in ("base", "delta"):
            fs, p = self._fs(self._at(kind))
            fs.delete(p, True)
            self._create(kind)
        self._append(both, "base")
        fs, p = self._fs(f"{self.path}/whole-{self.generation}")
        fs.mkdirs(p)
        for table, at in old:
            self.spark.sql(f"drop table if exists {table}")
            fs, p = self._fs(at)
            fs.delete(p, True)

    def close(self) -> None:
        """Forget the session's tables; the files stay."""
        for kind in ("base", "delta"):
            self.spark.sql(f"drop table if exists {self.table(kind)}")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
        """Deduplicate ``docs`` against the index and itself, append what is new, and return one row per row of ``docs``.

        ``doc_id, keep_id, group_size, kept, text_sha256``: the row that stays for this text (one of an earlier
        batch if the index has it, else the largest doc_id here), how many rows of this batch have the text,
        whether this row stays, and the SHA-256 of the normalised text.

        Texts are equal when identical after lower-casing A-Z; null is the empty text, and very long texts are
        hashed whole. Repeated rows of the doc_id that stays are all marked kept, and rows without doc_id where no
        row of their text has one; with ``row_col``, a column that numbers the rows, which is returned as ``row``,
        only the least of them is kept, and none if an earlier batch has the text. An empty batch gives no rows.
        Other columns are ignored, whatever their names.
        """
        scratch = Scratch(self.spark, "exact")
        text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
        row = F.col(row_col).cast("long") if row_col else F.lit(0).cast("long")
        hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), F.unhex(F.sha2(text, 256)).alias("digest"))
        hashed = scratch.save(hashed if row_col else hashed.drop("row"), "hashed", small=True)
        last = F.max(F.struct("doc_id", (-F.col("row")).alias("back")) if row_col else F.struct("doc_id")).alias("last")
        groups = scratch.save(hashed.groupBy("digest").agg(last, F.count("*").alias("group_size")), "groups")
        with self._sorted_scans():
            fresh = self.new(groups.select("digest", F.col("last.doc_id").alias("keep_id")))
            if row_col:
                fresh = scratch.save(fresh, "fresh").repartition(self.buckets, "digest")
            self._append(fresh, "delta" if self.files("base") else "base")
        if row_col:
            groups = groups.join(fresh.select("digest", F.lit(True).alias("first")), "digest", "left").withColumn("keep_row", F.when(F.col("first"), -F.col("last.back")))
        groups = groups.drop("last", "first")
        owners = scratch.save(groups.join(self.part("base"), "digest").union(groups.join(self.part("delta"), "digest")), "owners")
        kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)) if row_col else F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
        found = hashed.join(owners, "digest")
        if self.files("delta") > MOST_FILES * self.buckets:
            self.compact()
        return found.select(*["row"] * bool(row_col), "doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Deduplicate one table: :meth:`DigestIndex.add` on an index of its own, gone with the session."""
    spark = docs.sparkSession
    index = DigestIndex(spark, Scratch(spark, "digest-index").path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = index.add(docs, id_col, text_col, row_col)
    index.close()
    return found


ORACLE = """
with h as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
  doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
from h
"""
