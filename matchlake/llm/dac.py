"""Token ids as directly addressable codes.

Documents in ascending doc_id order are cut into segments of whole documents. A segment's ids are split into 8-bit
chunks, lowest first. Level 0 has a chunk of every id; each further level has one for every id that is not yet
complete. A level's bitmap says which of its ids continue, and a rank directory holds, for every 512 bits, the
number of set bits before them. The chunk of id ``i`` on the next level is found at ``rank(i)``, so any token is
read by one probe per level without decoding its block.

On disk a store is two Parquet tables: ``segments``, one row a segment, and ``directory``, one row a written part
with the number of ids before it.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchlake.llm.bpe import CACHE_PARTS, LONG_PART, PIECE_CHARS, RAW, cuts_alike, load_spec, parts_of, pieces_of
from matchlake.llm.scratch import Scratch, parallelism

RANK_BITS = 512
SEGMENT_TOKENS = 1 << 18
LEVEL = pa.struct([("chunks", pa.binary()), ("bits", pa.binary()), ("ranks", pa.binary())])
SEGMENT = "part int, seq int, before long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, levels array<struct<chunks:binary,bits:binary,ranks:binary>>"


def pack(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of an array of ids."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = np.cumsum(np.concatenate(([0], counts[:-1])), dtype=np.uint32) if len(counts) else counts
        levels.append({"chunks": (rest & 0xFF).astype(np.uint8).tobytes(), "bits": bits.tobytes(), "ranks": ranks.astype("<u4").tobytes()})
        if not more.any():
            return levels
        rest = rest[more] >> np.uint32(8)


def unpack(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids of a segment."""
    ids = np.frombuffer(levels[0]["chunks"], dtype=np.uint8).astype(np.uint32)
    at = np.arange(len(ids))
    for k, level in enumerate(levels[:-1], 1):
        at = at[np.unpackbits(np.frombuffer(level["bits"], dtype=np.uint8), count=len(at), bitorder="little").astype(bool)]
        ids[at] |= np.frombuffer(levels[k]["chunks"], dtype=np.uint8).astype(np.uint32) << np.uint32(8 * k)
    return ids


def access(levels: list[dict[str, bytes]], i: int) -> int:
    """Id ``i`` of a segment, by one probe a level."""
    value, shift = 0, 0
    for level in levels:
        value |= level["chunks"][i] << shift
        bits = level["bits"]
        if not bits[i >> 3] >> (i & 7) & 1:
            break
        block = i // RANK_BITS
        within = int.from_bytes(bits[block * RANK_BITS // 8 : (i >> 3) + 1], "little") & ((1 << (i - block * RANK_BITS)) - 1)
        i = int.from_bytes(level["ranks"][4 * block : 4 * block + 4], "little") + within.bit_count()
        shift += 8
    return value


class _Encoder:
    """The tokenizers library behind a bounded cache of parts of texts that encode alone.

    Pieces of plain words are encoded many at a time, parted by blanks; each gives just one token with a word end.
    Texts of a vocabulary file with other rules of normalising or splitting go to the library whole.
    """

    TOGETHER = 512

    def __init__(self, spec: str):
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.cuts_alike = cuts_alike(json.loads(spec))
        if not self.cuts_alike:
            return
        end = self.library.model.end_of_word_suffix
        self.ends = np.zeros(self.library.get_vocab_size(), dtype=bool)
        self.ends[[i for token, i in self.library.get_vocab(with_added_tokens=False).items() if token.endswith(end)]] = True
        self.parts: dict[str, bytes] = {}

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        joined = [" ".join(pieces[lo : lo + self.TOGETHER]) for lo in range(0, len(pieces), self.TOGETHER)]
        ids = array("I")
        for e in self.library.encode_batch_fast(joined, add_special_tokens=False):
            ids.extend(e.ids)
        raw, cuts = ids.tobytes(), (np.flatnonzero(self.ends[np.frombuffer(ids, dtype=np.uint32)]) * 4 + 4).tolist() if ids else []
        return [raw[lo:hi] for lo, hi in zip([0, *cuts], cuts)]

    def _learn(self, missing: list[str]) -> None:
        plain = [p for p in missing if p[0] != RAW]
        self.parts.update(zip(plain, self._pieces(plain), strict=True))
        other = [p for p in missing if p[0] == RAW]
        found = self.library.encode_batch_fast([p[1:] for p in other], add_special_tokens=False)
        self.parts.update((p, array("I", e.ids).tobytes()) for p, e in zip(other, found, strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Native 32-bit ids of each text."""
        if not self.cuts_alike:
            return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        split = [parts_of(text) for text in texts]
        missing = [p for p in set().union(*split) if p not in self.parts]
        self._learn(missing)
        known = self.parts.__getitem__
        out = [b"".join(map(known, parts)) for parts in split]
        for part in missing:
            if len(part) > LONG_PART:
                del self.parts[part]
        return out

    def documents(self, texts: list[str | None]) -> list[bytes]:
        """As ``ids``, for texts of any length, null for empty; very long ones are taken part by part."""
        short = iter(self.ids([t for t in texts if t and len(t) <= PIECE_CHARS]))
        return [next(short) if t and len(t) <= PIECE_CHARS else b"".join([self.ids([p])[0] for p in pieces_of(t or "", self.cuts_alike)]) for t in texts]


@cache
def _encoder(spec: str) -> _Encoder:
    return _Encoder(spec)


def _segments(spec: Broadcast, end_id: int):
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        encoder, part = _encoder(spec.value), TaskContext.get().partitionId()
        seq, before, doc_ids, texts, size = 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, before, doc_ids, texts, size
            ids = np.frombuffer(b"".join(texts), dtype=np.uint32)
            columns = [[part], [seq], [before], [len(ids)], [doc_ids], [[len(t) // 4 for t in texts]], [pack(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(LEVEL)]
            names = ["part", "seq", "before", "n_tokens", "doc_ids", "lengths", "levels"]
            seq, before, doc_ids, texts, size = seq + 1, before + len(ids), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part_ids, part_texts = (batch.column(k).slice(lo, 128).to_pylist() for k in (0, 1))
                for doc_id, ids in zip(part_ids, encoder.documents(part_texts), strict=True):
                    doc_ids.append(doc_id), texts.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= SEGMENT_TOKENS:
                        yield flush()
        if doc_ids:
            yield flush()

    return run


class TokenStore:
    """A written store of token ids; ``path`` is a folder in shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, docs: DataFrame, vocabulary: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> TokenStore:
        """Encode every text with the tokenizers library, end each with ``end_id``, and write all in doc_id order.

        Rows without doc_id come first; rows that share a doc_id follow each other in a fixed order. Null and
        empty texts hold just the end id. Other columns are ignored, whatever their names.
        """
        spark = docs.sparkSession
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        order = ["doc_id", F.xxhash64("text")]
        dealt = rows.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
        made = dealt.mapInArrow(_segments(load_spec(spark, vocabulary), end_id), SEGMENT)
        made.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/segments")
        parts = spark.read.schema(SEGMENT).parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n"))
        earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        directory = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
        directory.write.mode("overwrite").parquet(f"{path}/directory")
        return cls(spark, path)

    def segments(self) -> DataFrame:
        """Segments with the position of their first id among all."""
        segments = self.spark.read.schema(SEGMENT).parquet(f"{self.path}/segments")
        directory = self.spark.read.schema("part int, base long").parquet(f"{self.path}/directory")
        return segments.join(directory, "part").select((F.col("base") + F.col("before")).alias("start"), "n_tokens", "doc_ids", "lengths", "levels")

    def documents(self) -> DataFrame:
        """``doc_id, start, n_tokens, ids_crc32`` read from the files: place and checksum of each document's ids."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    start, doc_ids, lengths, levels = (batch.column(k)[i].as_py() for k in (0, 2, 3, 4))
                    ids = unpack(levels).astype("<u4")
                    ends = np.cumsum(lengths)
                    crc = [zlib.crc32(ids[hi - n : hi].tobytes()) for hi, n in zip(ends.tolist(), lengths, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

        return self.segments().mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def ids_of(self, doc_ids: list[int]) -> DataFrame:
        """``doc_id, ids`` of some documents; only segments that hold them are unpacked."""
        wanted = set(doc_ids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    own, lengths, levels = (batch.column(k)[i].as_py() for k in (2, 3, 4))
                    ids, hi, rows = unpack(levels), 0, []
                    for doc_id, n in zip(own, lengths, strict=True):
                        hi += n
                        if doc_id in wanted:
                            rows.append({"doc_id": doc_id, "ids": ids[hi - n : hi].tolist()})
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

        held = self.segments().where(F.arrays_overlap("doc_ids", F.array(*[F.lit(d).cast("long") for d in doc_ids])))
        return held.mapInArrow(run, "doc_id long, ids array<int>")

    def tokens_at(self, positions: Iterable[int]) -> DataFrame:
        """``position, id`` of some places in the whole sequence, each by direct access."""
        wanted = np.unique(np.fromiter(positions, dtype=np.int64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    start, n, levels = (batch.column(k)[i].as_py() for k in (0, 1, 4))
                    own = wanted[(wanted >= start) & (wanted < start + n)]
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([access(levels, int(p - start)) for p in own], pa.int64())], names=["position", "id"])

        inside = F.exists(F.array(*[F.lit(int(p)) for p in wanted]), lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n_tokens")))
        return self.segments().where(inside).mapInArrow(run, "position long, id long")


def token_file(docs: DataFrame, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a store of its own for one table and read every document's place and checksum back from it.

    An empty table gives an empty store and no rows; repeated rows are documents of their own.
    """
    return TokenStore.write(docs, vocabulary, end_id, Scratch(docs.sparkSession, "tokens").path, id_col, text_col).documents()
