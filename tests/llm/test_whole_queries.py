"""Whole queries recomputed without Spark, and tables with columns of clashing names."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from matchlake.llm import chat, language, quality
from matchlake.llm.queries import QUERIES


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_quality_query_as_a_whole(spark):
    """Rows, held-out labels, hashed features, fit and prediction of every document; held-out labels play no part."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    marked = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    learnt = sorted(i for i in marked if not held(i) and i in texts)
    model = quality.QualityModel.fit_rows(quality.features([texts[i] for i in learnt]), np.array([marked[i] == 1 for i in learnt]))
    ids = sorted(texts)
    want = dict(zip(ids, model.score(quality.features([texts[i] for i in ids])).tolist()))
    got = {r.doc_id: r for r in QUERIES["op6_quality"](spark, sf).collect()}
    assert set(got) == set(want) and all(got[i].score == want[i] and got[i].predicted == (want[i] >= 0.7) and got[i].held_out == held(i) for i in ids)
    turned = labels.withColumn("quality", F.when(language.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.rank_quality(docs, turned).collect()} == want


def test_quality_with_clashing_names(spark):
    rows = [(i, f"{'good words here' if i % 2 else 'bad!! $$'} {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    plain = quality.rank_quality(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    odd = spark.createDataFrame([(*r, 1, [2.0], 0.5, 7, True) for r in rows], "doc_id long, text string, y int, x array<double>, score double, predicted int, held_out boolean")
    more = labels.select("*", F.lit(1).alias("y"), F.lit("z").alias("most"), F.lit("t").alias("text"))
    assert sorted(quality.rank_quality(odd, more).collect()) == sorted(plain)


def test_preferences_with_clashing_names(spark):
    turns = [(c, t, "assistant" if t % 2 else "user", f"turn {t} of {c}") for c in range(6) for t in range(4)]
    kind = "conv_id long, turn long, role string, text string"
    plain = spark.createDataFrame(turns, kind)
    odd = plain.select("*", *[F.lit(1).alias(n) for n in ("final", "chosen_id", "rejected_id", "prompt", "prompt_turns", "rank", "n", "pair", "side")])
    for prefer in (chat.answer_preferences, lambda d: chat.preference_pairs(d, chat.neighbouring_pairs(d))):
        want = prefer(plain)
        assert sorted(prefer(odd).select(*want.columns).collect()) == sorted(want.collect()) and want.count() > 0


def test_many_languages_reach_the_driver_as_a_row_each(spark):
    """Prototypes of 600 labels are those of plain sums of the texts' vectors."""
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnop "))
    rows = [(i, f"l{i % 600:03}", "".join(rng.choice(letters, 40))) for i in range(1800)]
    model = language.LanguageModel.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert model.languages == sorted({r[1] for r in rows}) and model.prototypes.shape == (600, language.DIMENSIONS)
    bundler = language.Bundler()
    for k in (0, 123, 599):
        total = sum(np.rint(bundler.bundle(t) * language.SCALE).astype(np.int64) for _, lang, t in rows if lang == f"l{k:03}")
        assert np.allclose(model.prototypes[k], total / np.linalg.norm(total))
    assert Counter(r[1] for r in rows)["l000"] == 3
