"""Queries over the HTML of responses, and over literal pages for what those lack (OP-04..09, 111, 119..134)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import html as hx
from weftline.session import table

def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "responses").where("text IS NOT NULL")


def html_head(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("response_id", hx.title(F.col("text")).alias("title"), hx.language(F.col("text")).alias("lang"), F.size(hx.tags(F.col("text"), "p")).alias("paragraphs"))


def html_links(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("response_id", F.posexplode(hx.links(F.col("text"), F.col("url"))).alias("pos", "link"))


def html_comments(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("response_id", F.array_join(hx.comments(F.col("text")), "\n").alias("comments"), F.length(hx.without_comments(F.col("text"))).alias("rest"))


def html_scripts(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("response_id", F.size(hx.tags(F.col("text"), "script")).alias("scripts"), F.size(hx.script_sources(F.col("text"))).alias("with_source"), F.size(hx.tags(F.col("text"), "meta")).alias("metas"))


def html_icons(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("response_id", hx.icons(F.col("text"), F.col("url"))[0]["url"].alias("icon"))


def link_indegree(spark: SparkSession, folder: str) -> DataFrame:
    """The link graph: how many records link to a url, of each job. Repeats inside a record count once."""
    edges = table(spark, folder, "crawl_results").select("job_id", F.explode(F.array_distinct("links_found")).alias("link"))
    return edges.groupBy("job_id", "link").agg(F.count(F.lit(1)).alias("records"))


QUERIES = {
    "html_head": html_head, "html_links": html_links, "html_comments": html_comments, "html_scripts": html_scripts, "html_icons": html_icons, "link_indegree": link_indegree,
}
_W = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
_STRIP = lambda x: rf"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"
_UN = lambda x: f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_P = "(SELECT * FROM responses WHERE text IS NOT NULL)"
_ORIGIN = "regexp_extract(url, '^[^:/?#]+://[^/?#]+', 0)"
ORACLES = {
    "html_head": rf"""SELECT response_id, nullif({_STRIP(_UN("regexp_extract(text, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, '') AS title, nullif(regexp_extract(regexp_extract(text, '(?i)<html\b[^>]*>', 0), 'lang="([^"]*)"', 1), '') AS lang,
        len(regexp_extract_all(text, '(?i)<p\b[^>]*>')) AS paragraphs FROM {_P}""",
    "html_links": rf"""WITH a AS (SELECT response_id, {_ORIGIN} AS o, list_transform(regexp_extract_all(text, '(?i)<a\b[^>]*\shref\s*=\s*"([^"]*)"', 1), lambda h: {_UN('h')}) AS hs FROM {_P}),
        b AS (SELECT response_id, list_filter(list_transform(list_filter(hs, lambda h: h <> '' AND NOT regexp_matches(h, '^(#|(?i:javascript:|mailto:))')), lambda h: CASE WHEN starts_with(h, '/') THEN o || h ELSE h END), lambda h: regexp_matches(h, '^https?://')) AS ls FROM a)
        SELECT response_id, unnest(range(len(ls)))::INT AS pos, unnest(ls) AS link FROM b""",
    "html_comments": rf"""SELECT response_id, array_to_string(list_transform(regexp_extract_all(text, '(?s)<!--(.*?)-->', 1), lambda x: {_STRIP('x')}), chr(10)) AS comments, length(regexp_replace(text, '(?s)<!--.*?-->', '', 'g')) AS rest FROM {_P}""",
    "html_scripts": rf"""SELECT response_id, len(regexp_extract_all(text, '(?i)<script\b[^>]*>')) AS scripts, len(list_filter(regexp_extract_all(text, '(?i)<script\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\ssrc='))) AS with_source,
        len(regexp_extract_all(text, '(?i)<meta\b[^>]*>')) AS metas FROM {_P}""",
    "html_icons": f"SELECT response_id, nullif({_ORIGIN}, '') || '/favicon.ico' AS icon FROM {_P}",
    "link_indegree": "SELECT job_id, link, count(*) AS records FROM (SELECT job_id, unnest(list_distinct(links_found)) AS link FROM crawl_results) GROUP BY 1, 2",
}
