"""Language identification by hyperdimensional n-gram profiles.

Every letter has a random vector of +1 and -1. A trigram binds its letters' vectors, each rotated by its place, by
multiplication; a text bundles its trigrams' vectors, weighted by the square root of their counts; a language's
prototype bundles unit vectors of its training texts. A text gets the language whose prototype is nearest by cosine
after the mean of all prototypes is taken from both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from matchlake.llm.scratch import Scratch

UNKNOWN = "und"
DIMENSIONS = 1024
#: Training rows taken of each language, in expectation, at most.
TRAIN_PER_LANGUAGE = 4000
#: Labels that are learnt at most; each is a prototype of DIMENSIONS numbers on the driver.
MOST_LANGUAGES = 8192
#: Trigram vectors that one worker holds; the table starts anew when full.
TABLE_ROWS = 32_768
#: Distinct trigrams from which on a text can be refused, and standard deviations of noise below which it is.
CHANCE_EVIDENCE, CHANCE_SIGMAS = 100, 4
PIECE_CHARS = 1 << 20
SCALE = 1 << 20


@cache
def _letters() -> np.ndarray:
    """Of each code point, its letter in lower case, or 0 if it is no letter."""
    table = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams, as three 21-bit code points, and counts; other characters part words like one space.

    A very long text is taken piece by piece; the last two letters of a piece go before the next.
    """
    table, keys, counts, before = _letters(), [], [], np.zeros(1, dtype=np.int64)
    for lo in range(0, len(text), PIECE_CHARS):
        chars = np.frombuffer(text[lo : lo + PIECE_CHARS].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        end = np.zeros(int(lo + PIECE_CHARS >= len(text)), dtype=np.int64)
        letters = np.concatenate((before, table[chars], end))
        letters = letters[(letters > 0) | np.concatenate(([True], letters[:-1] > 0))]
        if len(letters) > 2:
            a, b, c = letters[:-2], letters[1:-1], letters[2:]
            k, n = np.unique(((a << 42) | (b << 21) | c)[b > 0], return_counts=True)
            keys.append(k), counts.append(n)
        before = letters[-2:]
    if not keys:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    if len(keys) == 1:
        return keys[0], counts[0].astype(float)
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, weights=np.concatenate(counts))


class Bundler:
    """Vectors of texts; holds the vectors of letters and of recent trigrams."""

    def __init__(self) -> None:
        self.of_letter: dict[int, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.table = np.zeros((TABLE_ROWS, DIMENSIONS), dtype=np.int8)

    def letter(self, c: int) -> np.ndarray:
        found = self.of_letter.get(c)
        if found is None:
            found = self.of_letter[c] = (np.random.default_rng([17, c]).integers(0, 2, DIMENSIONS) * 2 - 1).astype(np.int8)
        return found

    def _rows_of(self, keys: list[int]) -> np.ndarray:
        rows, out = self.rows, []
        for k in keys:
            at = rows.get(k)
            if at is None:
                at = rows[k] = len(rows)
                a, b, c = (self.letter(k >> s & 0x1FFFFF) for s in (42, 21, 0))
                self.table[at] = np.roll(a, 2) * np.roll(b, 1) * c
            out.append(at)
        return self.table[out]

    def bundle(self, text: str) -> np.ndarray | None:
        """Unit vector of a text; none if it has no letter."""
        return self.described(text)[0]

    def described(self, text: str) -> tuple[np.ndarray | None, int]:
        """As :meth:`bundle`, with the number of distinct trigrams."""
        keys, counts = trigrams(text)
        if not len(keys):
            return None, 0
        total, weights = np.zeros(DIMENSIONS, dtype=np.float64), np.sqrt(counts).astype(np.float32)
        for lo in range(0, len(keys), 4096):
            part = keys[lo : lo + 4096].tolist()
            if len(self.rows) + len(part) > TABLE_ROWS:
                self._clear()
            total += weights[lo : lo + 4096] @ self._rows_of(part).astype(np.float32)
        norm = np.linalg.norm(total)
        return (total / norm if norm > 0 else None), len(keys)


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 by 4; a missing id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


class LanguageModel:
    """Prototypes by language; as large as the number of languages, whatever the number of texts."""

    def __init__(self, languages: list[str], prototypes: np.ndarray):
        self.languages, self.prototypes = languages, prototypes

    @staticmethod
    def training_rows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_PER_LANGUAGE, id_col: str = "doc_id") -> DataFrame:
        """``lang, text`` of rows with both, of each language a fixed pseudo-random part of ``per_language`` rows or so.

        Rows are drawn by id and text, so a text that many rows repeat takes its share of the draw and no more. Of
        more labels than MOST_LANGUAGES the most frequent are learnt.
        """
        rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
        rows = rows.where("lang is not null and text is not null")
        counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
        counts = F.broadcast(Scratch(docs.sparkSession, "languages").save(counts, "counts"))
        return rows.join(counts, "lang").where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < F.lit(per_language * 1_000_000) / F.col("n")).select("lang", "text")

    @classmethod
    def fit(cls, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_PER_LANGUAGE, id_col: str = "doc_id") -> LanguageModel:
        """Learn from :meth:`training_rows`; without any, every text is of unknown language.

        Sums of vectors meet per language, as many as it has training rows at most; the driver takes one row a language,
        which is 64 MB for MOST_LANGUAGES.
        """
        sample = cls.training_rows(docs, text_col, lang_col, per_language, id_col)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bundler, total = Bundler(), {}
            for batch in batches:
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if (v := bundler.bundle(text.as_py())) is not None:
                        total[lang] = total.get(lang, 0) + np.rint(v * SCALE).astype(np.int64)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.list_(pa.int64()))], names=["lang", "v"])

        def added(lang: tuple[pa.Scalar], parts: pa.Table) -> pa.Table:
            vectors = parts.column("v").combine_chunks().flatten().to_numpy().reshape(len(parts), -1)
            return pa.table([pa.array([lang[0].as_py()]), pa.array([vectors.sum(axis=0)], pa.list_(pa.int64()))], names=["lang", "v"])

        kind = "lang string, v array<bigint>"
        found = sample.mapInArrow(sums, kind).groupBy("lang").applyInArrow(added, kind).orderBy("lang").toArrow()
        if not len(found):
            return cls([], np.zeros((0, DIMENSIONS)))
        raw = found.column("v").combine_chunks().flatten().to_numpy().reshape(len(found), -1).astype(np.float64)
        return cls(found.column("lang").to_pylist(), raw / np.linalg.norm(raw, axis=1, keepdims=True))

    def annotate(self, docs: DataFrame, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score", evidence_as: str | None = None) -> DataFrame:
        """``docs`` with the language chosen and the cosine that chose it, 0 at least; no row moves to another partition.

        ``evidence_as`` adds the number of distinct trigrams that the cosine is taken over.
        """
        languages = self.languages
        mean = self.prototypes.mean(axis=0) if len(languages) > 1 else np.zeros(DIMENSIONS)
        centred = self.prototypes - mean
        centred = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
        at = docs.columns.index(text_col)
        shared = docs.sparkSession.sparkContext.broadcast((centred, mean))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bundler, (centred, mean) = Bundler(), shared.value
            for batch in batches:
                langs, scores, seen = [], [], []
                for text in batch.column(at):
                    v, n = bundler.described(text.as_py() or "")
                    seen.append(n)
                    if v is None or not languages:
                        langs.append(UNKNOWN), scores.append(0.0)
                        continue
                    cosines = centred @ (v - mean) / max(float(np.linalg.norm(v - mean)), 1e-12)
                    best = int(np.argmax(cosines))
                    langs.append(languages[best]), scores.append(float(min(1.0, max(0.0, cosines[best]))))
                made = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(seen, pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made[: len(added)]], names=[*batch.schema.names, *added])

        added = {lang_as: StringType(), score_as: DoubleType()} | ({evidence_as: LongType()} if evidence_as else {})
        return docs.mapInArrow(run, StructType([*docs.schema.fields, *[StructField(n, t) for n, t in added.items()]]))


def chance(score: Column, evidence: Column) -> Column:
    """Whether a cosine is what a text of no learnt language would reach: many trigrams, and no more than noise in common.

    Vectors without relation have cosines of about ``1 / sqrt(DIMENSIONS)``. Short texts are never held to it, as
    a few words need not share anything with the prototype of their language.
    """
    return (evidence >= CHANCE_EVIDENCE) & (score < CHANCE_SIGMAS / DIMENSIONS**0.5)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out and predict all: ``doc_id, held_out, lang_pred, score``.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if no row has a language.
    Languages that tie go to the smaller name; very long texts are read whole; repeated rows get a row each; an empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    model = LanguageModel.fit(docs.where(~held_out(F.col(id_col))), text_col, lang_col, id_col=id_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return model.annotate(rows).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
