"""Corpus preparation as written stages over ``documents``.

Language identification, exact deduplication, near deduplication and mixing filter or repeat documents and keep
their columns; the last stage encodes what is left. Every stage is written as Parquet and read again, so a lost
executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.bpe import tokens
from matchlake.llm.exact import exact_duplicates
from matchlake.llm.language import UNKNOWN, LanguageModel, chance, held_out
from matchlake.llm.minhash import near_duplicates
from matchlake.llm.mixing import mix, training_order
from matchlake.llm.queries import VOCABULARY
from matchlake.llm.scratch import Scratch, free, placed, sized, small_batches

def _without(docs: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows numbered in ``gone (row)``; few numbers are broadcast, many shuffled."""
    (own,) = free(docs, "gone")
    gone = sized(gone.select(F.col("row").alias(own)))
    return docs.join(gone, F.col(row) == F.col(own), "left_anti").drop(row)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter are rejected; the others keep their label, and those without one get the language found.

    No document goes for its score: one that has no more in common with any learnt language than noise has, as texts
    of several or of unlearnt languages may, stays, with ``und`` where it has no label. Null and empty texts have no
    letter; very long texts are read whole. Repeated rows are judged alike, ids play no part, an empty table stays
    empty, and columns may have any names beside those of ``documents``.
    """
    found, score, evidence = free(docs, "found", "score", "evidence")
    with small_batches(spark):
        model = LanguageModel.fit(docs.where(~held_out(docs.doc_id)))
        judged = model.annotate(docs, lang_as=found, score_as=score, evidence_as=evidence).where(F.col(evidence) > 0)
        label = F.when(~chance(F.col(score), F.col(evidence)), F.col(found)).otherwise(UNKNOWN)
        return Scratch(spark, "pipeline-language").save(judged.withColumn("lang", F.coalesce("lang", label)).select(*docs.columns), "labelled")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z one row stays: that with the largest doc_id, of several the first.

    Null and empty texts are equal; rows without doc_id give way to those with one; very long texts are hashed
    whole. Rows are told apart by their place in the files, so repeated rows, ids and nulls need no rule of their
    own. An empty table stays empty; columns may have any names beside those of ``documents``.
    """
    (row,) = free(docs, "row")
    numbered = placed(docs, row)
    found = exact_duplicates(numbered, row_col=row)
    return _without(numbered, row, Scratch(spark, "pipeline-exact").save(found.where("not kept").select("row"), "gone", small=True)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more.

    It is the one with the smallest doc_id, null last, of several the first. Rows are told apart by their place in
    the files, so rows with a null or shared doc_id are grouped like all others. Documents without words are like
    none and stay; very long texts are compared whole; an empty table stays empty; columns may have any names beside
    those of ``documents``.
    """
    (row,) = free(docs, "row")
    numbered, scratch = placed(docs, row), Scratch(spark, "pipeline-near")
    found = scratch.save(near_duplicates(numbered, width=5, num=80, den=100, id_col=row), "found", small=True)
    few = found.where("not kept").count()
    copied = sized(scratch.save(found.where("not kept").select("component_id").distinct(), "copied", rows=few))
    members = found.join(copied, "component_id", "left_semi").select(F.col("doc_id").alias("row"), "component_id")
    ids = scratch.save(numbered.select(F.col(row).alias("row"), "doc_id").join(members, "row"), "ids")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    first = scratch.save(first.select("component_id", F.col("first.row").alias("stays")), "first", rows=few)
    gone = scratch.save(ids.join(first, "component_id").where("row <> stays").select("row"), "gone", rows=few)
    return _without(numbered, row, gone).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, one row for each pass of its source that takes any of its words.

    Rows of no words are never taken; null is a source like any other; rows that share a doc_id follow one plan;
    very long texts are counted whole; an empty table stays empty; columns may have any names beside those of
    ``documents``. The order is that of the files written, from which :func:`encode` reads it.
    """
    return training_order(docs, mix(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row that the mix takes, with its place in the training order.

    ``place, doc_id, n_tokens, ids_sha256, decoded_sha256, ids``: places run from 0 in the order in which the mix
    wrote its rows. Null and empty texts have no ids; repeated rows get a row each; a very long text is one row; an
    empty table gives no rows; other columns are left out, whatever their names.
    """
    (place,) = free(docs, "place")
    numbered = placed(docs, place)
    with small_batches(spark):
        return Scratch(spark, "pipeline-encode").save(tokens(numbered, VOCABULARY, carry={"place": place}, keep=False), "tokens")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: SQL expresses neither the language model nor the merges of the tokenizer; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
