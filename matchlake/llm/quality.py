"""Quality scores from Bradley-Terry comparisons of labelled texts.

A text is described by shares of its bytes, words and lines and by the shares of its words that fall in each of
WORD_BUCKETS hash buckets. Of two labelled texts the one marked good should win;
the chance that it does is logistic in the difference of their linear scores. Weights minimise the mean logistic
loss over preference pairs with a small ridge, by Newton's method. The score below which the share of training
texts equals the share of bad labels becomes 0.7 on a logistic scale.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.language import held_out
from matchlake.llm.shingles import words_of

#: Labelled texts that the model is fitted on at most, and partners of each text in its preference pairs.
TRAIN_ROWS, PARTNERS = 16_000, 8
RIDGE, STEPS = 1e-3, 25
CUT = 0.7
WORD_BUCKETS = 128
#: Preference pairs that are taken at once.
PAIR_BLOCK = 8192
_PUNCTUATION = np.frombuffer(bytes(c for c in range(33, 127) if not chr(c).isalnum()), dtype=np.uint8)


def _surface(text: str) -> np.ndarray:
    """Shares and lengths of bytes, words and lines; all zero for an empty text."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = text.split()
    if not words:
        return np.zeros(len(_PUNCTUATION) + 13)
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    lines = [x for x in text.split("\n") if x.strip()]
    repeated = len(lines) - len(set(lines))
    upper = sum(1 for w in words if w.isupper())
    top = Counter(words).most_common(1)[0][1]
    shares = np.log1p(10 * counts[_PUNCTUATION] / n)
    plain = [
        np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(set(words)) / n, top / n, upper / n,
        counts[48:58].sum() / len(raw), counts[65:91].sum() / len(raw), np.log1p(n / len(lines)), repeated / len(lines),
        np.log1p(len(lines)), (counts[9:14].sum() + counts[32]) / len(raw),
    ]
    return np.concatenate((shares, plain))


def features(texts: list[str]) -> np.ndarray:
    """A row of fixed length for each text, whatever its length; all zero for an empty one."""
    out = np.zeros((len(texts), len(_PUNCTUATION) + 13 + WORD_BUCKETS))
    for row, text, words in zip(out, texts, words_of([t.encode("utf-8", "surrogatepass") for t in texts]), strict=True):
        row[:-WORD_BUCKETS] = _surface(text)
        if len(words):
            row[-WORD_BUCKETS:] = np.sqrt(np.bincount((words >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS, minlength=WORD_BUCKETS) / len(words))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class QualityModel:
    """A linear score and its calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float, spread: float):
        self.mean, self.scale, self.weights, self.cut, self.spread = mean, scale, weights, cut, spread

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Row by row, so that a text's score does not depend on which others it is scored with."""
        return (np.clip((x - self.mean) / self.scale, -5, 5) * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(_sigmoid((self.raw(x) - self.cut) / self.spread + np.log(CUT / (1 - CUT))), 12)

    @classmethod
    def fit_rows(cls, x: np.ndarray, good: np.ndarray) -> QualityModel:
        """Fit on feature rows in a fixed order; without both labels every score is the cut itself."""
        mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        model = cls(mean, scale, np.zeros(x.shape[1]), 0.0, 1.0)
        yes, no = np.flatnonzero(good), np.flatnonzero(~good)
        if not len(yes) or not len(no):
            return model
        z, rng = np.clip((x - mean) / scale, -5, 5), np.random.default_rng(5)
        better, worse = cls.pairs(yes, no, rng)
        w = model.weights
        for _ in range(STEPS):
            gradient, hessian = RIDGE * w, (RIDGE + 1e-9) * np.eye(len(w))
            for lo in range(0, len(better), PAIR_BLOCK):
                d = z[better[lo : lo + PAIR_BLOCK]] - z[worse[lo : lo + PAIR_BLOCK]]
                p = _sigmoid(-(d @ w))
                gradient = gradient - d.T @ p / len(better)
                hessian += (d * (p * (1 - p))[:, None]).T @ d / len(better)
            step = np.linalg.solve(hessian, gradient)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        model.weights = w
        scores = model.raw(x)
        model.cut = float(np.quantile(scores, len(no) / len(x)))
        model.spread = float(scores.std()) / 4 + 1e-9
        return model

    @staticmethod
    def pairs(yes: np.ndarray, no: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Rows preferred and rows that they beat: PARTNERS for each row of the rarer label, and one for each other row."""
        few, many = (no, yes) if len(no) < len(yes) else (yes, no)
        rare = np.concatenate((np.repeat(few, PARTNERS), rng.choice(few, len(many))))
        other = np.concatenate((rng.choice(many, len(few) * PARTNERS), many))
        return (other, rare) if len(no) < len(yes) else (rare, other)

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
        """Learn from labelled documents that are not held out.

        Ids with both labels are left out, null labels too. The ``rows`` labels with the smallest hash of the id
        are used, so the rows that reach the driver and the broadcast side of the join are bounded by it.
        """
        own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
        marked = own.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("doc_id", "y")
        taken = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    x = features([t.as_py() or "" for t in part.column(2)])
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

        chosen = texts.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
        got = sorted(map(tuple, chosen.mapInArrow(describe, "doc_id long, y int, x array<double>").collect()), key=lambda r: r[0])
        width = features([""]).shape[1]
        return cls.fit_rows(np.array([r[2] for r in got]).reshape(-1, width), np.array([r[1] == 1 for r in got], dtype=bool))

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id, score, predicted`` for every row, from its text alone."""
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    score = model.score(features([t.as_py() or "" for t in part.column(1)]))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def rank_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that are not held out and score all documents: ``doc_id, held_out, score, predicted``.

    Null and empty texts have all features 0 and are scored like any other; very long texts are described whole.
    Repeated rows get a row each, repeated labels count once, and of a repeated id with a label the least text is
    learnt. Scores that tie get one prediction. Without labels of both kinds every score is 0.7. An empty table gives no rows. Language,
    source and id are never features. Other columns are ignored, whatever their names.
    """
    scored = QualityModel.fit(docs, labels).predict(docs)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
