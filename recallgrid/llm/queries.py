"""The queries of the text problems 6, 8, 9 and 10, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from .confusable import look_alike_pairs, look_alikes, one_form
from .mixture import mixture
from .pii import personal_information
from .tokenizer import count_column, encode_column


def _personal(spark: SparkSession, d: str, what: str) -> DataFrame:
    names = load(spark, d, "name_lexicon")
    parts = []
    for table, key, column, places in (("episodic", F.lower("id"), "payload", "payload"), ("locomo_samples", F.col("sample_id"), "turns", "turns")):
        df = load(spark, d, table).select(key.alias("row_id"), column)
        found = personal_information(df, "row_id", column, places, names, what)
        parts.append(found.select(F.lit(table).alias("table_name"), *found.columns))
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d, "find").distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d, "redact")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return docs.select("doc_id", encode_column(spark, F.col("text")).alias("ids"))


def p8_sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return docs.select("doc_id", count_column(spark, F.col("text")).alias("n_tokens"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(load(spark, d, "documents"), load(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture(load(spark, d, "documents"), load(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(load(spark, d, "documents"), "doc_id", "text")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return look_alikes(load(spark, d, "documents"), "doc_id", "text")


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return one_form(load(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "form")


QUERIES = {
    "p6_found": p6_found,
    "p6_redacted": p6_redacted,
    "p8_ids": p8_ids,
    "p8_sizes": p8_sizes,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_classes": p10_classes,
    "p10_forms": p10_forms,
}
#: No SQL form: trained tagger, byte-pair merges, seeded selection and script sets are tested by brute force.
ORACLE: dict[str, str] = {}
