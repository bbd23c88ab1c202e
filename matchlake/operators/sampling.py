"""Samples of an exact size per stratum, the same rows however a table is partitioned, without ordering any stratum.

A row's place in its stratum is the order of a hash of its id. Counting rows by the first bits of the hash tells in which
bucket the last place falls; rows of the buckets before it stay, and that bucket alone is counted again by further bits,
so that in the end a few rows of equal bits are placed one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.sources.work import staged

#: Bits of a hash, and of them those that a round counts by.
HASH_BITS, ROUND_BITS, ROUNDS = 60, 12, 2


def drawn(seed: str, ids: Sequence[str]) -> Column:
    """The first HASH_BITS bits of the SHA-256 of ``seed`` and the ids, parted by colons."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids])
    return F.conv(F.substring(F.sha2(text, 256), 1, HASH_BITS // 4), 16, 10).cast("long")


def exact_sample(df: DataFrame, stratum: str, quotas: DataFrame, ids: Sequence[str], seed: str = "0") -> DataFrame:
    """``take`` rows of each stratum, all if it has fewer, by ``quotas (stratum, take)``; other strata give none.

    ``ids`` name a row. Rows that share them tie, and only as many of them stay as the quota leaves room for. A null
    stratum is one like any other, a null quota takes nothing, and an empty table stays empty.
    """
    want = quotas.select(F.coalesce(F.col(stratum).cast("string"), F.lit("\0")).alias("_s"), F.col("take").cast("long").alias("_need")).where("_need > 0")
    rows = staged(df.withColumn("_s", F.coalesce(F.col(stratum).cast("string"), F.lit("\0"))).withColumn("_u", drawn(seed, ids)))
    open_, cuts = staged(want.groupBy("_s").agg(F.max("_need").alias("_need")).withColumn("_from", F.lit(0).cast("long"))), []
    for k in range(1, ROUNDS + 1):
        width = 1 << (HASH_BITS - k * ROUND_BITS)
        inside = rows.join(open_, "_s").where((F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_from") + F.lit(width << ROUND_BITS)))
        counts = inside.groupBy("_s", "_need", (F.col("_u") - F.col("_u") % width).alias("_lo")).agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counts.withColumn("_before", before)
        cut = placed.where((F.col("_before") < F.col("_need")) & (F.col("_before") + F.col("_n") > F.col("_need")))
        whole = placed.groupBy("_s").agg(F.max(F.when(F.col("_before") + F.col("_n") <= F.col("_need"), F.col("_lo") + width)).alias("_below"))
        cuts.append(staged(whole.where("_below is not null")))
        open_ = staged(cut.select("_s", (F.col("_need") - F.col("_before")).alias("_need"), F.col("_lo").alias("_from")))
    below = cuts[0]
    for more in cuts[1:]:
        below = below.union(more)
    below = below.groupBy("_s").agg(F.max("_below").alias("_below"))
    kept = rows.join(below, "_s").where("_u < _below").drop("_below")
    last = 1 << (HASH_BITS - ROUNDS * ROUND_BITS)
    edge = staged(rows.join(open_, "_s").where((F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_from") + F.lit(last))).drop("_from").withColumn("_part", F.spark_partition_id()))
    parts = edge.groupBy("_s", "_u", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_s").orderBy("_u", "_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_s", "_u", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    place = F.col("_base") + F.row_number().over(Window.partitionBy("_s", "_u", "_part").orderBy(F.lit(1)))
    few = edge.join(parts, ["_s", "_u", "_part"]).withColumn("_place", place).where("_place <= _need")
    return kept.select(*df.columns).union(few.select(*df.columns))


def capped(frames: DataFrame, human: str, empty: str, ids: Sequence[str], machine_share: float = 0.5, empty_share: float = 0.1, seed: str = "0") -> DataFrame:
    """All human frames, machine ones up to ``machine_share`` of both, and frames without labels up to ``empty_share`` of all.

    ``human`` and ``empty`` are conditions; an empty frame counts as empty whoever labelled it. Sizes are exact, and
    rounded down; which frames stay depends on their ids alone, so no match is dropped for its place in an order.
    """
    kind = F.when(F.expr(empty), "empty").when(F.expr(human), "human").otherwise("machine")
    sorted_ = staged(frames.withColumn("_kind", F.coalesce(kind, F.lit("machine"))))
    n = {r["_kind"]: r["n"] for r in sorted_.groupBy("_kind").agg(F.count("*").alias("n")).collect()}
    share = lambda of, part: int(of * part / (1 - part) + 1e-9)
    machine = min(n.get("machine", 0), share(n.get("human", 0), machine_share))
    quotas = {"human": n.get("human", 0), "machine": machine, "empty": share(n.get("human", 0) + machine, empty_share)}
    table = frames.sparkSession.createDataFrame(list(quotas.items()), "_kind string, take long")
    return exact_sample(sorted_, "_kind", table, ids, seed).drop("_kind")
