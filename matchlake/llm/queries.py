"""The registered queries of this subpackage: thin calls of its operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import ann, bpe, chat, dac, exact, language, lexical, merkle, mixing, quality, secrets, warc
from matchlake.llm.minhash import near_duplicates

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan with the training positions of both passes, rounded so that SQL gives the same digits."""
    plan = mixing.mix(_table(spark, sf_dir, "documents"))
    position = lambda k, name: F.round(F.get("positions", F.lit(k)), 9).alias(name)
    return plan.select("doc_id", "size", "source_size", "target", "taken", position(0, "first_position"), position(1, "second_position"))


def op2_training_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.training_positions(mixing.mix(_table(spark, sf_dir, "documents")))


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fails on a record whose payload is not what its header states."""
    sound = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))).cast("string"))
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rank_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_file(_table(spark, sf_dir, "documents"), VOCABULARY, end_id=1)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), VOCABULARY)


def op10_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with another's last answer: pairs that share all turns before it."""
    return chat.answer_preferences(_table(spark, sf_dir, "conversations"))


def op10_neighbouring_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even conversations against the next odd ones, whose first turns are as a rule different."""
    turns = _table(spark, sf_dir, "conversations")
    return chat.preference_pairs(turns, chat.neighbouring_pairs(turns))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op2_training_positions": op2_training_positions,
    "op3_vector_search": op3_vector_search,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_token_binary": op7_token_binary,
    "op8_language": op8_language,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_preference_chat": op10_preference_chat,
    "op10_neighbouring_chats": op10_neighbouring_chats,
    "op11_secrets": op11_secrets,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": exact.ORACLE,
    "op2_mix_sources": mixing.ORACLE,
    "op5_warc": warc.ORACLE,
    "op10_preference_chat": chat.ANSWER_ORACLE,
    "op10_neighbouring_chats": chat.ORACLE,
    "op11_secrets": secrets.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
