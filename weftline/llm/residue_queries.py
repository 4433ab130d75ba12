"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm.residue import residue_scores
from weftline.session import table


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """tbl, rec_id, text of crawl_results and responses."""
    crawl = table(spark, folder, "crawl_results").select(F.lit("crawl_results").alias("tbl"), F.col("result_id").alias("rec_id"), F.col("content").alias("text"))
    responses = table(spark, folder, "responses").select(F.lit("responses").alias("tbl"), F.col("response_id").alias("rec_id"), "text")
    return crawl.unionByName(responses)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records in which residue stands in place of content."""
    return residue_scores(pages(spark, folder)).where("score > 0").select("tbl", "rec_id")


def p1_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The records without such residue, blank ones left out."""
    return residue_scores(pages(spark, folder)).where("score <= 0").select("tbl", "rec_id")


QUERIES = {"p1_found": p1_found, "p1_kept": p1_kept}
ORACLES: dict[str, str] = {}
