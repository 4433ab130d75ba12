"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions.urls import site_key
from weftline.llm.repeated import line_keys, repeated_lines, site_lines, without_repeated
from weftline.plans.skew_plans import HOST_SQL
from weftline.session import table


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "crawl_results").where("content IS NOT NULL").select(F.col("result_id").alias("id"), "frontier_seq", F.col("content").alias("text"))


def crawl_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of crawl_results with their site (of the frontier row) and day. Hashes of lines meet the frontier, not texts."""
    frontier = table(spark, folder, "frontier").select(F.col("seq").alias("frontier_seq"), site_key(F.col("hostname"), F.col("url")).alias("site"), F.to_date(F.timestamp_seconds("added_at")).alias("day"))
    return site_lines(line_keys(_texts(spark, folder)).join(frontier, "frontier_seq"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that recur through the records of their hostname."""
    return repeated_lines(crawl_lines(spark, folder)).select(F.col("id").alias("result_id"), "line_no")


def p2_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Every content without those lines."""
    return without_repeated(_texts(spark, folder), repeated_lines(crawl_lines(spark, folder))).select(F.col("id").alias("result_id"), F.col("text").alias("content"))


def p2_by_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that recur through the distinct contents of their hostname: those of an article that was merely crawled again are spared."""
    return repeated_lines(crawl_lines(spark, folder), by="clusters").select(F.col("id").alias("result_id"), "line_no", F.col("clusters").cast("long").alias("clusters"))


def p2_by_days(spark: SparkSession, folder: str) -> DataFrame:
    """The same, if on three days or more."""
    return repeated_lines(crawl_lines(spark, folder), by="days").select(F.col("id").alias("result_id"), "line_no", F.col("days").cast("long").alias("days"))


_BASE = rf"""
    r AS (SELECT c.result_id, h.site, string_split(c.content, chr(10)) AS ls
          FROM crawl_results c JOIN (SELECT seq, {HOST_SQL} AS site FROM frontier) h ON c.frontier_seq = h.seq WHERE c.content IS NOT NULL AND site IS NOT NULL),
    x AS (SELECT result_id, site, unnest(range(len(ls)))::INT AS line_no, unnest(ls) AS line FROM r),
    k AS (SELECT result_id, site, line_no, regexp_replace(lower(trim(regexp_replace(line, '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', ' ', 'g'))), '[0-9]+', '0', 'g') AS key FROM x),
    n AS (SELECT site, key, count(DISTINCT result_id) AS n FROM k WHERE regexp_matches(key, '\p{{L}}') GROUP BY 1, 2),
    s AS (SELECT site, count(*) AS m FROM r GROUP BY 1),
    f AS (SELECT site, key FROM n JOIN s USING (site) WHERE n >= 4 AND n >= 0.25 * m),
    found AS (SELECT result_id, line_no FROM k JOIN f USING (site, key))"""

_CLUSTERED = rf"""
    r AS (SELECT c.result_id, h.site, h.day, content, string_split(c.content, chr(10)) AS ls
          FROM crawl_results c JOIN (SELECT seq, {HOST_SQL} AS site, CAST(to_timestamp(added_at) AS DATE) AS day FROM frontier) h ON c.frontier_seq = h.seq WHERE c.content IS NOT NULL AND site IS NOT NULL),
    x AS (SELECT result_id, site, day, content, unnest(range(len(ls)))::INT AS line_no, unnest(ls) AS line FROM r),
    k AS (SELECT result_id, site, day, content, line_no, regexp_replace(lower(trim(regexp_replace(line, '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', ' ', 'g'))), '[0-9]+', '0', 'g') AS key FROM x),
    n AS (SELECT site, key, count(DISTINCT content) AS n, count(DISTINCT day) AS days FROM k WHERE regexp_matches(key, '\p{{L}}') GROUP BY 1, 2),
    s AS (SELECT site, count(DISTINCT content) AS m FROM r GROUP BY 1),
    f AS (SELECT site, key, n, days FROM n JOIN s USING (site) WHERE n >= 4 AND n >= 0.25 * m)"""

QUERIES = {f.__name__: f for f in (p2_found, p2_cleaned, p2_by_clusters, p2_by_days)}
ORACLES = {
    "p2_by_clusters": f"WITH {_CLUSTERED} SELECT result_id, line_no, n AS clusters FROM k JOIN f USING (site, key)",
    "p2_by_days": f"WITH {_CLUSTERED} SELECT result_id, line_no, f.days AS days FROM k JOIN f USING (site, key) WHERE f.days >= 3",
    "p2_found": f"WITH {_BASE} SELECT result_id, line_no FROM found",
    "p2_cleaned": f"""WITH {_BASE},
        g AS (SELECT result_id, list(line_no) AS gone FROM found GROUP BY 1)
        SELECT c.result_id, CASE WHEN gone IS NULL THEN content ELSE coalesce(array_to_string(list_filter(string_split(content, chr(10)), lambda l, i: NOT list_contains(gone, (i - 1)::INT)), chr(10)), '') END AS content
        FROM crawl_results c LEFT JOIN g USING (result_id) WHERE content IS NOT NULL""",
}
