"""Problem 10: sentence units of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwork.llm.sentences import split_sentences
from tarnwork.sources.tables import table


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "sent_end")


QUERIES = {"p10_found": p10_found, "p10_sentences": p10_sentences}
#: Sentence rules have no SQL; tests hold the operator against hand-made cases.
ORACLE: dict[str, str] = {}
