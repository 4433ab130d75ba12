"""Queries of problem 5: the few keys that hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions.urls import site_key
from weftline.operators.skew import LEFT_N, RIGHT_N, eager_join, key_states, roll_up
from weftline.session import table

HOT_SHARE = 0.02


def host_states(spark: SparkSession, folder: str) -> DataFrame:
    """Row count in frontier and sum of urls_fetched in domain_stats of each hostname (null: rows without one).

    The raw spellings are aggregated first, as they are what the rows hold; they are tidied on one row a spelling and rolled up.
    """
    # a url only matters where the hostname is blank, so that all other rows of a spelling fall into one state before the shuffle
    frontier = table(spark, folder, "frontier").select(
        "hostname", F.when(F.regexp_replace(F.coalesce("hostname", F.lit("")), r"(?U)[\s.]|:\d*", "") == "", site_key(F.lit(None).cast("string"), F.col("url"))).alias("of_url")
    )
    left = key_states(frontier, {"spelling": F.col("hostname"), "of_url": F.col("of_url")}, {}, LEFT_N)
    left = roll_up(left, {"hostname": F.coalesce(site_key(F.col("spelling"), F.lit(None).cast("string")), F.col("of_url"))}, [LEFT_N])
    stats = key_states(table(spark, folder, "domain_stats"), {"spelling": F.col("hostname")}, {"urls_fetched": F.col("urls_fetched")}, RIGHT_N)
    right = roll_up(stats, {"hostname": site_key(F.col("spelling"), F.lit(None).cast("string"))}, [RIGHT_N, "urls_fetched"])
    return eager_join(left, right, ["hostname"], right_sums=["urls_fetched"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Hostnames of at least 2 % of all frontier rows, those without a hostname included in the rows."""
    total = table(spark, folder, "frontier").count()  # one number, from the files' footers
    return host_states(spark, folder).where(F.col("hostname").isNotNull() & (F.col(LEFT_N) >= HOT_SHARE * total) & (F.col(LEFT_N) > 0)).select("hostname")


def p5_host_totals(spark: SparkSession, folder: str) -> DataFrame:
    """All hostnames with rows, the sum of urls_fetched, and the size and sum of the join that is never formed."""
    s = host_states(spark, folder)
    return s.select(
        "hostname",
        F.col(LEFT_N).alias("frontier_rows"),
        F.col(RIGHT_N).alias("stats_rows"),
        "urls_fetched",
        "pairs",
        F.col("urls_fetched_over_pairs").alias("urls_fetched_over_pairs"),
    )


def p5_site_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The join's size and sums rolled up after it, by the last two labels of a hostname: pairs and sums of the compact states add up."""
    s = host_states(spark, folder)
    labels = F.split("hostname", "\\.")
    site = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.col("hostname"))
    return roll_up(s, {"site": site}, [LEFT_N, "pairs", "urls_fetched", "urls_fetched_over_pairs"]).withColumnRenamed(LEFT_N, "frontier_rows")


_TIDY = r"nullif(regexp_replace(regexp_replace(regexp_replace(lower({h}), '^\s+|\s+$', '', 'g'), ':[0-9]*$', ''), '\.$', ''), '')"
_OF_URL = r"CASE WHEN regexp_matches(trim(url), '^(?i:https?):') THEN lower(regexp_extract(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^(?:[^@]*@)*([^:@]*)', 1)) END"
HOST_SQL = f"coalesce({_TIDY.format(h='hostname')}, {_TIDY.format(h='(' + _OF_URL + ')')})"

QUERIES = {"p5_found": p5_found, "p5_host_totals": p5_host_totals, "p5_site_totals": p5_site_totals}
ORACLES = {
    "p5_site_totals": f"""
        WITH f AS (SELECT {HOST_SQL} AS hostname, count(*) AS n FROM frontier GROUP BY 1),
        s AS (SELECT {_TIDY.format(h='hostname')} AS hostname, count(*) AS m, CAST(sum(urls_fetched) AS BIGINT) AS urls FROM domain_stats GROUP BY 1),
        j AS (SELECT coalesce(f.hostname, s.hostname) AS h, coalesce(n, 0) AS n, coalesce(m, 0) AS m, urls FROM f FULL JOIN s ON f.hostname IS NOT DISTINCT FROM s.hostname),
        k AS (SELECT *, string_split(h, '.') AS ls FROM j)
        SELECT CASE WHEN len(ls) > 2 THEN ls[-2] || '.' || ls[-1] ELSE h END AS site, CAST(sum(n) AS BIGINT) AS frontier_rows, CAST(sum(n * m) AS BIGINT) AS pairs, CAST(sum(urls) AS BIGINT) AS urls_fetched, CAST(sum(urls * n) AS BIGINT) AS urls_fetched_over_pairs FROM k GROUP BY 1""",
    "p5_found": f"""
        WITH f AS (SELECT {HOST_SQL} AS hostname FROM frontier)
        SELECT hostname FROM f WHERE hostname IS NOT NULL GROUP BY hostname HAVING count(*) >= {HOT_SHARE} * (SELECT count(*) FROM f)""",
    "p5_host_totals": f"""
        WITH f AS (SELECT {HOST_SQL} AS hostname, count(*) AS n FROM frontier GROUP BY 1),
        s AS (SELECT {_TIDY.format(h='hostname')} AS hostname, count(*) AS m, CAST(sum(urls_fetched) AS BIGINT) AS urls FROM domain_stats GROUP BY 1)
        SELECT coalesce(f.hostname, s.hostname) AS hostname, coalesce(n, 0) AS frontier_rows, coalesce(m, 0) AS stats_rows, urls AS urls_fetched,
               coalesce(n, 0) * coalesce(m, 0) AS pairs, urls * coalesce(n, 0) AS urls_fetched_over_pairs
        FROM f FULL JOIN s ON f.hostname IS NOT DISTINCT FROM s.hostname""",
}
