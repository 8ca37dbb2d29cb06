"""Problem 8: passages of eval_items in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm.leaks import find_leaks
from tarnwork.sources.tables import table


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item that leaked: documents holding it, those holding it nearly whole (edit similarity 0.8 or more), largest share, those the long windows alone would find."""
    per = _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("edit_similarity") >= 0.8).alias("nearly_whole"), F.max("share").alias("largest_share"), F.count_if("found_with_edits").alias("found_with_edits"))
    return per.join(table(spark, sf_dir, "eval_items").select("item_id", "suite"), "item_id")


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
#: Word rules (NFKC, invisible characters, Han) have no SQL; tests hold the operator against brute force.
ORACLE: dict[str, str] = {}
