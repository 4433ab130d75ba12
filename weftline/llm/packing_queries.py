"""Queries of problem 7: documents into containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm.encoding import token_counts
from weftline.llm.packing import CAPACITY, pack
from weftline.session import table


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """One row a piece of a document, with its container."""
    return pack(token_counts(table(spark, folder, "documents"), "doc_id", "text"), "doc_id", "n_tokens")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that had to be split, being larger than a container."""
    return p7_containers(spark, folder).where("piece = 1").select("doc_id").distinct()


def _use(pieces: DataFrame) -> DataFrame:
    """Containers, their contents, and in how many blocks the greedy grouping was the best possible or the islands evolved."""
    c = pieces.groupBy("container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("pieces"))
    how, block = F.split_part("container", F.lit("-"), F.lit(2)), F.concat_ws("-", F.split_part("container", F.lit("-"), F.lit(1)), F.split_part("container", F.lit("-"), F.lit(3)))
    return c.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("used").alias("tokens"),
        F.sum("pieces").alias("pieces"),
        F.ceil(F.sum("used") / CAPACITY).alias("least_containers"),
        F.max("used").alias("most_used"),
        (1 - F.sum("used") / (F.count(F.lit(1)) * CAPACITY)).alias("unused_share"),
        F.count_distinct(F.when(how == "greedy", block)).alias("greedy_blocks"),
        F.count_distinct(F.when(how == "evolved", block)).alias("evolved_blocks"),
    )


def p7_use(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, the tokens in them, the least number of containers that could hold them, and the share of room left unused."""
    return _use(p7_containers(spark, folder))


def _hard(spark: SparkSession, folder: str) -> DataFrame:
    """An item a document, of a size by rule between a fifth and a half of a container: two or three fill it, seldom well."""
    return table(spark, folder, "documents").select("doc_id", (F.lit(410) + F.pmod(F.col("doc_id") * 7919, F.lit(613))).cast("long").alias("size"))


def p7_hard(spark: SparkSession, folder: str) -> DataFrame:
    """Containers of sizes that greedy filling packs badly, by the islands and by greedy filling alone."""
    evolved = _use(pack(_hard(spark, folder), "doc_id", "size"))
    greedy = _use(pack(_hard(spark, folder), "doc_id", "size", rounds=0)).select(F.col("containers").alias("greedy_containers"))
    return evolved.select("containers", "least_containers", "unused_share", "greedy_blocks", "evolved_blocks").crossJoin(greedy)  # one row each


def p7_hard_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What packing must keep: of each document one whole piece of its size, and no container over its capacity."""
    pieces = pack(_hard(spark, folder), "doc_id", "size")
    over = pieces.groupBy("container").agg(F.sum("size").alias("used")).where(F.col("used") > CAPACITY).agg(F.count(F.lit(1)).alias("overfull"))
    whole = pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("size"))
    return whole.crossJoin(F.broadcast(over))  # one row


QUERIES = {f.__name__: f for f in (p7_found, p7_containers, p7_use, p7_hard, p7_hard_kept)}
ORACLES = {
    "p7_hard_kept": "SELECT doc_id, count(*) AS pieces, CAST(sum(410 + (doc_id * 7919) % 613) AS BIGINT) AS size, 0::BIGINT AS overfull FROM documents GROUP BY doc_id",
}
