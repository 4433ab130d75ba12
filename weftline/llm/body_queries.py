"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.body import body_lines, body_text
from weftline.llm.residue_queries import pages


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of every page's main body; pages that are all residue have none."""
    return body_lines(pages(spark, folder))


def p4_body(spark: SparkSession, folder: str) -> DataFrame:
    """The plain text of every page's main body."""
    return body_text(pages(spark, folder))


QUERIES = {"p4_found": p4_found, "p4_body": p4_body}
ORACLES: dict[str, str] = {}
