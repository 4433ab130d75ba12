"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm.seen import chains, error_report, probe, request_keys
from weftline.session import table

#: Keys that the first layer of a chain takes in the reports, which are to show chains of several layers on small tables too.
REPORT_CAPACITY = 64


def _visited(spark: SparkSession, folder: str) -> DataFrame:
    return request_keys(table(spark, folder, "visited"), "-1", None)


def _frontier(spark: SparkSession, folder: str) -> DataFrame:
    return request_keys(table(spark, folder, "frontier"), "seq", "method")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Frontier rows whose key is in visited or in an earlier frontier row."""
    return probe(_visited(spark, folder), _frontier(spark, folder)).where("seen").select(F.col("arrival").alias("seq"))


def p3_error_report(spark: SparkSession, folder: str) -> DataFrame:
    """The rate of wrong answers of the chains, measured and bounded."""
    return error_report(probe(_visited(spark, folder), _frontier(spark, folder), capacity=REPORT_CAPACITY))


def p3_resumed_report(spark: SparkSession, folder: str) -> DataFrame:
    """The same where the chains of visited are built first and asked in a second run."""
    kept = chains(_visited(spark, folder), capacity=REPORT_CAPACITY)
    return error_report(probe(_visited(spark, folder), _frontier(spark, folder), capacity=REPORT_CAPACITY, kept=kept))


def p3_stored_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Of the rows whose fp is stored: how many the operator finds seen, by job."""
    visited, frontier = (table(spark, folder, t).where("fp IS NOT NULL") for t in ("visited", "frontier"))
    seen = probe(request_keys(visited, "-1", None), request_keys(frontier, "seq", "method")).where("seen").select(F.col("arrival").alias("seq"))
    return frontier.select("seq", "job_id").join(seen, "seq").groupBy("job_id").agg(F.count(F.lit(1)).alias("seen"))


QUERIES = {f.__name__: f for f in (p3_found, p3_error_report, p3_resumed_report, p3_stored_keys)}
ORACLES = {
    "p3_stored_keys": """
        WITH f AS (SELECT job_id, seq, fp, min(seq) OVER (PARTITION BY fp) AS first FROM frontier WHERE fp IS NOT NULL)
        SELECT job_id, count(*) AS seen FROM f WHERE first < seq OR fp IN (SELECT fp FROM visited WHERE fp IS NOT NULL) GROUP BY job_id""",
}
