"""Queries of the problems on texts, p8 to p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import leakage, spam, tokens
from tidelog.session import shared_dir, table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"), shared_dir(spark))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, same): whether the ids decode to the text (to the empty text for null)."""
    documents = table(spark, sf_dir, "documents")
    ids = tokens.token_ids(documents, shared_dir(spark))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("original"))
    joined = tokens.decoded(ids).join(texts, "doc_id").join(ids.select("doc_id", F.size("ids").alias("n_ids")), "doc_id")
    return joined.select("doc_id", "n_ids", (F.coalesce("text", F.lit("")) == F.col("original")).alias("same"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf_dir, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p8_ids, p8_roundtrip, p9_found, p9_clean, p10_found)}


def _grams(table_: str, key: str) -> str:
    """Every run of the least number of words of a table's texts."""
    words = f"SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table_} WHERE text IS NOT NULL"
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + {leakage.LEAST_WORDS - 1}], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {leakage.LEAST_WORDS - 2})) AS i FROM ({words}))"


#: Tokenizing, cleaning and line shapes have no SQL; they are tested against brute force.
ORACLE_SQL: dict[str, str] = {"p9_found": f"WITH d AS ({_grams('documents', 'doc_id')}), e AS ({_grams('eval_item', 'item_id')}) SELECT DISTINCT doc_id, item_id FROM d JOIN e ON d.g = e.g"}
