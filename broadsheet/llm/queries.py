"""One named query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from broadsheet.llm import bagminhash, chat, decontamination, lexical, manifest, minhash, mixing, pii, quality, rules, sentencepiece, toxicity, warc
from broadsheet.llm.common import table


def op1_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.fixity(table(spark, sf_dir, "pages"))


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_probe(spark, table(spark, sf_dir, "conversations")))


def op6_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op7_threshold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited(table(spark, sf_dir, "documents"))


def op9_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encoded(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_limited_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audited(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_factorisation_machine": op1_factorisation_machine,
    "op2_string_kernel": op2_string_kernel,
    "op3_merkle_audit": op3_merkle_audit,
    "op4_bagminhash": op4_bagminhash,
    "op5_reply_trees": op5_reply_trees,
    "op6_fair_queueing": op6_fair_queueing,
    "op7_threshold_rules": op7_threshold_rules,
    "op8_minhash": op8_minhash,
    "op9_transducer": op9_transducer,
    "op10_surrogates": op10_surrogates,
    "op11_limited_accumulators": op11_limited_accumulators,
    "op12_positional_index": op12_positional_index,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE: dict[str, str] = {
    "op3_merkle_audit": warc.ORACLE_SQL,
    "op5_reply_trees": chat.ORACLE_SQL,
    "op6_fair_queueing": mixing.oracle_sql(),
    "op7_threshold_rules": rules.oracle_sql(),
    "op11_limited_accumulators": lexical.ORACLE_SQL,
    "op12_positional_index": decontamination.ORACLE_SQL,
    "op13_merkle_manifest": manifest.ORACLE_SQL,
}
