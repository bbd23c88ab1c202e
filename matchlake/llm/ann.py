"""Nearest neighbours by additive quantisation, with a bound that makes them exact.

A unit vector is approximated by a sum of codewords, one from each of several codebooks of full dimension. The
codebooks are learnt one after another by k-means on what the earlier ones leave over; a vector is encoded by beam
search over these residuals. The index holds codes, the norm of each sum, the sine between a vector and its sum, and the
vector. A query's inner products with all codewords make a lookup table, whose entries add up to the cosine of query and
sum. With the stored sine it bounds the true cosine from above: no vector whose bound reaches the k-th best exact cosine
found in its block is left out, however many there are, and those are ranked by exact cosine in double precision.

Equal vectors are indexed once and carry their smallest ids, so a vector that fills a third of the table costs one
entry. Queries and vectors meet in blocks of bounded size; each block pair gives its k nearest ids per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.llm.scratch import Scratch, parallelism

#: Vectors that the codebooks are learnt on at most, and codebooks, codewords of each, rounds of k-means.
TRAIN_VECTORS, CODEBOOKS, WORDS, ROUNDS = 16_384, 16, 256, 8
BEAM = 8
#: Candidates per query that are scored first, to find what the others must reach; rows of a block, and of a small table's.
FIRST, QUERY_BLOCK, CODE_BLOCK, LEAST_BLOCK = 64, 16_384, 32_768, 4096
#: Sums shorter than this bound nothing. Above it, lookup-table cosines in single precision are off by less than SLACK.
LEAST_NORM, SLACK = 0.5, 1e-5


def _nearest_words(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(axis=1) - 2 * x @ words.T, axis=1)


def learn_codebooks(x: np.ndarray, books: int = CODEBOOKS, words: int = WORDS) -> np.ndarray:
    """Residual codebooks ``(books, words, d)``; rows of ``x`` in a fixed order give the same books again."""
    rng, left, out = np.random.default_rng(11), x.astype(np.float32).copy(), []
    words = max(1, min(words, len(x)))
    for _ in range(books):
        centres = left[rng.choice(len(left), words, replace=False)].copy()
        for _ in range(ROUNDS):
            of = _nearest_words(left, centres)
            order = np.argsort(of, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], np.diff(of[order]) > 0)))
            sums = np.add.reduceat(left[order], starts, axis=0)
            centres[of[order][starts]] = sums / np.diff(np.append(starts, len(of)))[:, None]
        out.append(centres)
        left -= centres[_nearest_words(left, centres)]
    return np.array(out, dtype=np.float32)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes ``(n, books)`` of unit vectors found by beam search, the norms of the sums they stand for, and the sines between."""
    n, count = len(x), len(books)
    left = x[:, None, :].astype(np.float32)
    codes = np.zeros((n, 1, 0), dtype=np.uint8)
    for words in books:
        cost = (left * left).sum(axis=2)[:, :, None] + (words * words).sum(axis=1) - 2 * left @ words.T
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        parent, word = best // len(words), best % len(words)
        rows = np.arange(n)[:, None]
        left = left[rows, parent] - words[word]
        codes = np.concatenate((codes[rows, parent], word[:, :, None].astype(np.uint8)), axis=2)
    best = (left * left).sum(axis=2).argmin(axis=1)
    codes = codes[np.arange(n), best]
    made = books[np.arange(count), codes].sum(axis=1, dtype=np.float64)
    norm = np.linalg.norm(made, axis=1)
    to = made / np.maximum(norm, 1e-12)[:, None]
    return codes, norm, np.linalg.norm(x - (x * to).sum(axis=1, keepdims=True) * to, axis=1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision by the power of two that brings their largest component near 1, which changes no digit."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


class _Block:
    """Encoded vectors that meet queries, from a table of ``v, ids, code, norm, sine``."""

    def __init__(self, table: pa.Table, books: np.ndarray):
        rows = len(table)
        self.books, self.raw, self.ids = books, _matrix(table.column("v"), rows), table.column("ids").to_pylist()
        self.unit = _unit(self.raw).astype(np.float32)
        self.codes = np.frombuffer(b"".join(table.column("code").to_pylist()), dtype=np.uint8).reshape(rows, -1).T.copy()
        self.norm, self.sine = (table.column(c).to_numpy() for c in ("norm", "sine"))
        self.cosine = np.sqrt(np.maximum(0, 1 - self.sine * self.sine))
        self.unbounded = self.norm < LEAST_NORM
        self.tolerance = 1e-6 + 1.2e-7 * self.raw.shape[1]

    def tables(self, unit: np.ndarray) -> np.ndarray:
        books, words, d = self.books.shape
        return (unit @ self.books.reshape(-1, d).T.astype(np.float64)).astype(np.float32).reshape(len(unit), books, words)

    def _reach(self, rows: np.ndarray, score: np.ndarray, query: int, k: int) -> float:
        """What a vector must score, by single-precision cosines of ``rows``, to be among the ``k`` nearest ids."""
        seen, count = set(), min(FIRST, len(rows))
        while True:
            some = np.argpartition(-score, count - 1)[:count]
            for i in some[np.argsort(-score[some])]:
                seen.update(x for x in self.ids[rows[i]] if x != query)
                if len(seen) >= k:
                    return score[i] - 2 * self.tolerance
            if count == len(rows):
                return -np.inf
            seen, count = set(), min(8 * count, len(rows))

    def nearest(self, query: int, v: np.ndarray, unit: np.ndarray, table: np.ndarray, k: int) -> list[tuple[float, int]]:
        """``(-cosine, id)`` of the ``k`` ids nearest to ``v``, without the query's own."""
        near = table[0][self.codes[0]]
        for words, code in zip(table[1:], self.codes[1:]):
            near += words[code]
        near /= np.maximum(self.norm, 1e-12)
        bound = near * self.cosine + np.sqrt(np.maximum(0, 1 - near * near) + 3 * SLACK) * self.sine + SLACK
        bound[self.unbounded] = np.inf
        first = np.argpartition(-near, min(FIRST, len(near)) - 1)[:FIRST]
        rows = np.flatnonzero(bound >= self._reach(first, self.unit[first] @ unit, query, k))
        score = self.unit[rows] @ unit if 4 * len(rows) < len(near) else (self.unit @ unit)[rows]
        rows = rows[score >= self._reach(rows, score, query, k)]
        a, b = _scaled(v[None, :]), _scaled(self.raw[rows]) if len(rows) else self.raw[rows].astype(np.float64)
        cosine = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
        best: dict[int, float] = {}
        for row, c in zip(rows, cosine.tolist()):
            for x in self.ids[row]:
                if x != query:
                    best[x] = max(c, best.get(x, c))
        return sorted((-c, x) for x, c in best.items())[:k]


class VectorIndex:
    """Codes of all distinct vectors of one length."""

    def __init__(self, rows: DataFrame, copies: int):
        """``rows (vec_id, v)`` of one length, none unusable; ``copies`` of the smallest ids of each distinct vector are kept: one more than a search may return."""
        self.spark: SparkSession = rows.sparkSession
        self.scratch = Scratch(self.spark, "ann")
        save = self.scratch.save
        self.kind, self.rows = rows.schema["v"].dataType.simpleString(), rows
        rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
        few = self.rows.withColumn("rank", rank).where(F.col("rank") <= copies)
        classes = few.groupBy("v").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
        self.classes = save(classes.withColumn("key", F.xxhash64("rep", "v")), "classes")
        sample = self.classes.orderBy(F.xxhash64("key"), "key").limit(TRAIN_VECTORS).select("v").toArrow()
        self.books = learn_codebooks(_unit(_matrix(sample.column(0), len(sample)))) if len(sample) else None
        if self.books is not None:
            self.codes = save(self._encoded(), "codes")
            self.scratch.drop("classes")

    def _encoded(self) -> DataFrame:
        books = self.books

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    codes, norms, sines = encode(_unit(_matrix(part.column(1), len(part))), books)
                    made = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32()), pa.array(sines, pa.float32())]
                    yield pa.RecordBatch.from_arrays([*part.columns, *made], names=["key", "v", "ids", "code", "norm", "sine"])

        return self.classes.select("key", "v", "ids").mapInArrow(run, f"key long, v {self.kind}, ids array<bigint>, code binary, norm float, sine float")

    def search(self, queries: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
        """``query_id, rank, vec_id, score``: the ``k`` nearest of each of the index's rows named by ``queries``.

        Ids that the index does not hold give nothing. Of an id with several vectors the least vector asks.
        """
        if self.books is None:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        save, books = self.scratch.save, self.books
        asked = self.rows.join(queries.select(F.col(id_col).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
        asked = save(asked.withColumnRenamed("vec_id", "query_id"), "queries")
        blocks = lambda n, size: max(1, -(-n // size))
        n = self.codes.count()
        nq, nc = blocks(asked.count(), QUERY_BLOCK), max(blocks(n, CODE_BLOCK), min(blocks(n, LEAST_BLOCK), parallelism(self.spark)))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("i"), every(nc).alias("j"), "query_id", "v")
        c = self.codes.select(every(nq).alias("i"), F.pmod(F.xxhash64("key"), F.lit(nc)).cast("int").alias("j"), "v", "ids", "code", "norm", "sine")

        def score(queries: pa.Table, codes: pa.Table) -> pa.Table:
            ids, out = queries.column("query_id").to_pylist(), []
            if len(ids) and len(codes):
                block, raw = _Block(codes, books), _matrix(queries.column("v"), len(ids))
                for lo in range(0, len(ids), 256):
                    unit = _unit(raw[lo : lo + 256])
                    for i, table in enumerate(block.tables(unit), lo):
                        out += [(ids[i], x, -c) for c, x in block.nearest(ids[i], raw[i], unit[i - lo].astype(np.float32), table, k)]
            cols = list(zip(*out)) or [(), (), ()]
            return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

        found = q.groupBy("i", "j").cogroup(c.groupBy("i", "j")).applyInArrow(score, "query_id long, vec_id long, score double")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` of the distinct rows that can be compared: neither null nor zero, and of finite components alone."""
    given = vectors.schema[vector_col].dataType.simpleString()
    kind = given if given in ("array<float>", "array<double>") else "array<double>"
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    return v.where("vec_id is not null and v is not null").where(~bad).dropDuplicates(["vec_id", "v"])


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Index all rows and search the ``k`` nearest others of each row whose id is divisible by ``every``.

    Vectors that are null, zero or hold a null, NaN or infinite component take no part. Only vectors of one length can
    be compared, so each length has an index and a search of its own; a table should hold few lengths, as it costs one
    plan each. Vectors of floats stay so, others are taken as doubles. Repeated rows count once; of an id with several
    vectors of one length the least asks, and an id with several lengths asks in each, the best answers counting. With
    fewer candidates than ``k`` all are returned; an empty table gives no rows. Ties in score go to the smaller id.
    Other columns are ignored, whatever their names.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows = scratch.save(usable(vectors, id_col, vector_col).withColumn("d", F.size("v")), "rows")
    found = []
    for (d,) in rows.select("d").distinct().orderBy("d").collect():
        own = rows.where(F.col("d") == d).select("vec_id", "v")
        found.append(VectorIndex(own, copies=k + 1).search(own.where(F.col("vec_id") % every == 0), k))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if len(found) == 1:
        return found[0]
    every_length = found[0]
    for more in found[1:]:
        every_length = every_length.unionByName(more)
    best = every_length.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
