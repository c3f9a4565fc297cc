"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import leaks, packing, reading, sql, tokens, topn
from loomspan.queries.common import table, ymd


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "signal_panel").select("factor", "date", "code", "loaded_at", "row_id", "signal")
    one = topn.latest_version(t, ["factor", "date", "code"], ["loaded_at", "row_id"], ["signal"])
    return topn.top_n(one, ["factor", "date"], "signal", ["code"], 5).select("factor", ymd("date").alias("ymd"), "code")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in containers of 2,048 tokens."""
    d = table(spark, sf_dir, "documents").select("doc_id", tokens.token_count(F.col("text")).alias("n_tokens"))
    return packing.containers(d, "doc_id", "n_tokens", 2048)


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the share carried and where."""
    return leaks.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grade of every English document."""
    return reading.reading_level(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "reading_labels"), "doc_id", "grade").select("doc_id", "grade")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_levels(spark, sf_dir).where("grade = 5").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p8_containers, p9_found, p9_leaks, p10_found, p10_levels)}
ORACLE = {"p2_found": sql.P2}
