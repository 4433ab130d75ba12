"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm.encoding import decode, encode
from weftline.session import table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids, without special tokens."""
    return encode(table(spark, folder, "documents"), "doc_id", "text")


def p6_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and tokens in all, and how many different ids occur."""
    ids = encode(table(spark, folder, "documents"), "doc_id", "text")
    # distinct ids are at most the vocabulary, so that the set that each task keeps is bounded
    each = ids.select(F.size("ids").alias("n"), F.explode_outer("ids").alias("id"))
    return each.groupBy("id").agg(F.count("id").alias("k")).agg(F.sum("k").alias("tokens"), F.count("id").alias("distinct_ids"))


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The way there and back: a digest of what every document's ids stand for."""
    ids = encode(table(spark, folder, "documents"), "doc_id", "text")
    return decode(ids, "doc_id", "ids").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"), F.length("text").alias("chars"))


QUERIES = {"p6_ids": p6_ids, "p6_totals": p6_totals, "p6_decoded": p6_decoded}
ORACLES = {
    "p6_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest, length(coalesce(text, ''))::INT AS chars FROM documents",
}
