"""Queries of videos, walls, robots rules, differences and design tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftline.functions import walls
from weftline.functions.urls import origin_of
from weftline.operators import robots
from weftline.session import table

def wall_responses(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "responses")
    return r.select(walls.wall(F.col("status_code"), F.col("headers"), F.col("text")).alias("w")).groupBy("w.blocked", "w.vendor", "w.kind").agg(F.count(F.lit(1)).alias("n"))


def archive_wanted(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "crawl_results").select("result_id", walls.wants_archive(F.col("content")).alias("wanted"))


RULES = "User-agent: other\nDisallow: /\n\nUser-agent: *\nCrawl-delay: 1.5\nDisallow: /docs\nAllow: /docs/*/print$\nDisallow: /news/2\n"


def robots_allowed(spark: SparkSession, folder: str) -> DataFrame:
    """All frontier urls against one set of rules that half of the origins have."""
    f = table(spark, folder, "frontier").select("seq", "url")
    origins = f.select(origin_of(F.col("url")).alias("origin")).where("origin LIKE 'https://%'").distinct().select("origin", F.lit(RULES).alias("body"))
    return robots.permitted(f, origins, "weftbot").select("seq", "allowed", "delay")


def text_difference(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("frontier_seq").orderBy("result_id")
    c = table(spark, folder, "crawl_results").where("content IS NOT NULL").select("result_id", F.lag("content").over(w).alias("before"), "content").where("before IS NOT NULL")
    return c.select("result_id", robots.difference("before", "content").alias("d")).select("result_id", "d.added", "d.removed")


QUERIES = {f.__name__: f for f in (wall_responses, archive_wanted, robots_allowed, text_difference)}
_PATH = r"coalesce(nullif(regexp_replace(regexp_replace(url, '^[^:/?#]+://[^/?#]*', ''), '#.*$', ''), ''), '/')"
ORACLES = {
    "wall_responses": "SELECT coalesce(status_code = 429, false) AS blocked, '' AS vendor, CASE WHEN status_code = 429 THEN 'rate_limited' ELSE '' END AS kind, count(*) AS n FROM responses GROUP BY 1, 2, 3",
    "archive_wanted": "SELECT result_id, length(trim(coalesce(content, ''))) < 50 OR (contains(substring(coalesce(content, ''), 1, 200), '404') AND contains(lower(substring(coalesce(content, ''), 1, 500)), 'not found')) AS wanted FROM crawl_results",
    "robots_allowed": rf"""WITH a AS (SELECT seq, url, {_PATH} AS p, nullif(regexp_extract(url, '^[^:/?#]+://[^/?#]+', 0), '') AS o FROM frontier)
        SELECT seq, CASE WHEN url IS NULL THEN NULL WHEN o IS NULL OR o NOT LIKE 'https://%' THEN true WHEN regexp_matches(p, '^/docs/.*/print$') THEN true WHEN starts_with(p, '/docs') OR starts_with(p, '/news/2') THEN false ELSE true END AS allowed, CASE WHEN o LIKE 'https://%' THEN 1.5::DOUBLE END AS delay FROM a""",
}
