"""One query for each operator of this subpackage, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from srcloom.llm import chat, hard_negatives, licenses, line_dedup, manifest, nearest, ngram_join, packing, quality_classifier, quality_rules, sentencepiece_codec, substrings, toxicity
from srcloom.sources.tables import table

#: Fixed values of the contract of op8: phrases and their labels.
LICENSE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def tokenizer_file(name: str) -> str:
    """A file of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.report(table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(table(spark, folder, "embeddings"), queries_each=50, k=5)


def op3_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.digest(chat.events_of_messages(chat.with_probe(spark, table(spark, folder, "conversations"))))


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"), width=5, percent=75)


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.report(table(spark, folder, "documents"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digest(table(spark, folder, "documents"))


def op8_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.report(table(spark, folder, "documents"), base=LICENSE_PHRASES)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.report(table(spark, folder, "documents"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.report(table(spark, folder, "embeddings"))


def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.report(table(spark, folder, "documents"), window=50)


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.report(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scans": op8_license_scans,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

SQL: dict[str, str] = {
    "op2_nearest_neighbours": nearest.SQL,
    "op3_chat_formatting": chat.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op13_merkle_manifest": manifest.SQL,
}
