"""Folds over a key's rows in order, streamed with the fold's state alone, and numbers over a whole ordered table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from matchlake.sources.work import staged

BATCH = 4096


class Fold(Protocol):
    """State of one key: takes its rows in order and gives result rows, without the key, on the way and at the end."""

    def row(self, *values) -> Iterable[tuple]: ...

    def close(self) -> Iterable[tuple]: ...


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: Sequence[str], make: Callable[[], Fold], result: str) -> DataFrame:
    """``keys`` and ``result`` columns: a fold made by ``make`` for each key takes ``values`` of its rows in ``order``.

    Rows are dealt by key and sorted, and pass through Python batch by batch; a key of any number of rows takes no
    more memory than its fold's state and one batch. Null is a key like any other.
    """
    names = list(dict.fromkeys([*keys, *values]))
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*names)
    kinds = StructType([*[rows.schema[k] for k in keys], *StructType.fromDDL(result).fields])
    out_schema = to_arrow_schema(kinds)
    n, at = len(keys), [names.index(v) for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def made() -> pa.RecordBatch:
            nonlocal out
            columns = list(zip(*out)) or [()] * len(out_schema)
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                columns = [c.slice(lo, BATCH).to_pylist() for c in batch.columns]
                for row in zip(*columns, strict=True):
                    if state is None or row[:n] != key:
                        if state is not None:
                            out += [(*key, *r) for r in state.close()]
                        key, state = row[:n], make()
                    out += [(*key, *r) for r in state.row(*[row[i] for i in at])]
                if len(out) >= BATCH:
                    yield made()
        if state is not None:
            out += [(*key, *r) for r in state.close()]
        if out:
            yield made()

    return rows.mapInArrow(run, kinds)


def fold_whole(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: Sequence[str], solve: Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, list]], result: str) -> DataFrame:
    """As :func:`fold` for keys of few rows each: ``solve`` takes the ``values`` of many whole keys at once, and where each key begins.

    It gives for each result row the number of its key among those, and the ``result`` columns. A task holds one batch
    and one key's rows.
    """
    names = list(dict.fromkeys([*keys, *values]))
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*names)
    kinds = StructType([*[rows.schema[k] for k in keys], *StructType.fromDDL(result).fields])
    out_schema = to_arrow_schema(kinds)

    def solved(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        of, columns = solve(batch, starts)
        found = batch.select(list(keys)).take(pa.array(starts[of]))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip([*found.columns, *columns], out_schema, strict=True)], schema=out_schema)

    def key_at(batch: pa.RecordBatch, row: int) -> list:
        return [batch[k][row].as_py() for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if len(held) > 1 and key_at(held[0], 0) == key_at(batch, batch.num_rows - 1):
                continue
            whole = pa.concat_batches(held)
            starts = _starts(whole, keys)
            if len(starts) > 1:
                yield solved(whole.slice(0, int(starts[-1])), starts[:-1])
            held = [whole.slice(int(starts[-1]))]
        if held:
            yield solved(pa.concat_batches(held), np.zeros(1, np.int64))

    return rows.mapInArrow(run, kinds)


def _starts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Rows at which another key begins."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        codes = batch[k].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Adds ``name``, the place of each row, from 0, in the whole table's order.

    Rows are range-partitioned and sorted; a part's rows come after those of all earlier parts, whose counts are summed
    over one row a part. No task sees all rows.
    """
    cut = (1 << 33) - 1
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = staged(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(cut))))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(bases, "_part").withColumn(name, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


class Leaders:
    """Leader clustering in order: a point joins the first cluster whose running centroid is within ``radius``, else makes one."""

    def __init__(self, radius: float):
        self.radius2 = radius * radius
        self.sums: list[list[float]] = []  # sx, sy, n

    def add(self, x: float, y: float) -> None:
        for c in self.sums:
            dx, dy = c[0] / c[2] - x, c[1] / c[2] - y
            if dx * dx + dy * dy <= self.radius2:
                c[0], c[1], c[2] = c[0] + x, c[1] + y, c[2] + 1
                return
        self.sums.append([x, y, 1])

    def ranked(self) -> list[list[float]]:
        """Largest first, the earlier one first on a tie."""
        return sorted(self.sums, key=lambda c: -c[2])
