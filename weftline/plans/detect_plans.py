"""Queries of technologies, design tokens and response walls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftline.operators import tech
from weftline.session import spread, table


#: Fingerprints of what the test pages show, over those to begin with.
SHOWN = {
    "Appd": {"cats": [22], "headers": {"server": r"^appd/(\d+)\;version:\1"}},
    "Edge proxy": {"cats": ["CDN"], "headers": {"server": r"^edge$\;confidence:60"}},
    "Page info": {"cats": [10], "html": [r"window\.pageInfo\s*="]},
    "Table layout": {"cats": [19], "html": [r"<body>\s*(?:<!--[^>]*-->\s*)*<table><tr>\;confidence:50"]},
}


def _technologies(spark: SparkSession, folder: str) -> DataFrame:
    pages = spread(table(spark, folder, "responses").select("response_id", "text", "url", "headers"))
    return tech.detect(pages, "response_id", "text", "url", "headers", book=tech.Book.of(tech.overlay(tech.FINGERPRINTS, SHOWN)))


def tech_detect(spark: SparkSession, folder: str) -> DataFrame:
    rows = _technologies(spark, folder).select("response_id", F.explode("technologies").alias("x"))
    return rows.select("response_id", "x.tech", F.get("x.categories", F.lit(0)).alias("category"), "x.confidence", "x.version")


def tech_counts(spark: SparkSession, folder: str) -> DataFrame:
    kept = _technologies(spark, folder).select(F.explode(tech.filtered(F.col("technologies"), 60, without=("Analytics",))).alias("x"))
    return kept.groupBy("x.tech").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("x.version").alias("versions"))


#: Made pages show one of so many technologies a signal.
KINDS, PAGES = 200, 1000


def made_fingerprints() -> dict[str, dict]:
    """Two thousand patterns, two hundred a signal, by rule; and five technologies that are only implied."""
    out: dict[str, dict] = {f"base-{j}": {"cats": [27]} for j in range(5)}
    for k in range(KINDS):
        out |= {
            f"scriptSrc-{k}": {"cats": [59], "scriptSrc": [rf"/lib{k}x-(\d+)\.js\;version:\1"]},
            f"headers-{k}": {"cats": [22], "headers": {f"X-Made-{k}": r"v(\d+)\;version:1.\1"}, "implies": rf"base-{k % 5}\;confidence:60"},
            f"cookies-{k}": {"cats": [10], "cookies": {f"made{k}_*": r"^(\d+)$\;version:\1"}},
            f"meta-{k}": {"cats": [1], "meta": {"generator": rf"^Gen{k}x (.+)\;version:\1\;confidence:70"}},
            f"html-{k}": {"cats": [19], "html": [rf"<i id=.h{k}x.>"]},
            f"scripts-{k}": {"cats": [10], "scripts": [rf"startMade{k}x\("]},
            f"css-{k}": {"cats": [66], "css": [rf"\.made{k}x\s*\{{"]},
            f"url-{k}": {"cats": [6], "url": [rf"^https://u{k}x\.example/\;confidence:30"]},
            f"js-{k}": {"cats": [12, 999], "js": {f"Made{k}.version": r"(.+)\;version:\1"}},
            f"dom-{k}": {"cats": [6], "dom": {f"b[made='d{k}x']": {"text": "shown"}}},
        }
    return out


def _made_pages(spark: SparkSession) -> DataFrame:
    k = lambda m: f"CAST((id * {m}) % {KINDS} AS STRING)"
    page = f"""concat('<head><meta content="Gen', {k(7)}, 'x ', id, '" name="generator"><style>.made', {k(13)}, 'x {{ color: red }}</style><script src="/lib', {k(3)}, 'x-', id, '.js"></script><script>startMade', {k(11)}, 'x()</script></head><i id="h', {k(9)}, 'x"></i><b made="d', {k(17)}, 'x"></b>',
        CASE WHEN id % 2 = 0 THEN 'shown' ELSE '' END)"""
    return spark.range(PAGES).select(
        "id", F.expr(page).alias("html"), F.expr(f"concat('https://u', {k(19)}, 'x.example/')").alias("url"), F.expr(f"map(concat('x-MADE-', {k(5)}), concat('v', id))").alias("headers"),
        F.expr(f"map(concat('made', {k(23)}, '_a'), CASE WHEN id % 3 = 0 THEN 'none' ELSE CAST(id AS STRING) END)").alias("cookies"), F.expr(f"map(concat('Made', {k(29)}, '.version'), CAST(id AS STRING))").alias("js"),
    )


def tech_signals(spark: SparkSession, folder: str) -> DataFrame:
    """OP-149..153: made pages against two thousand patterns of all signals."""
    found = tech.detect(_made_pages(spark), "id", "html", "url", "headers", "cookies", "js", tech.Book.of(made_fingerprints()))
    return found.select("id", F.explode("technologies").alias("x")).select("id", "x.tech", "x.confidence", "x.version", F.array_join("x.categories", "|").alias("categories"), F.array_join("x.groups", "|").alias("groups"))


def tech_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """OP-83, 155: how the made pages' technologies read in a line."""
    pages = _made_pages(spark).withColumn("content", F.lit("text")).select("id", "html", "content", "url")
    return tech.attached(pages, "id", "html", "content", tech.Book.of(made_fingerprints()), url="url").select("id", F.size("technologies").alias("n"), "tech_summary")


def response_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of answers by status and size, with the hints that came along."""
    r = table(spark, folder, "responses")
    kind = F.when(F.col("status_code") == 429, "rate_limited").when((F.col("status_code") == 403) & (F.length("text") <= 512), "short_deny").when(F.col("status_code") == 304, "unchanged").when(F.col("status_code").isin(408, 429, 500, 502, 503, 504, 522, 524), "retry").when(F.col("status_code") >= 400, "final").otherwise("ok")
    return r.groupBy(kind.alias("kind_seen"), "blocked").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def changes_between(spark: SparkSession, folder: str) -> DataFrame:
    """OP-53, 101: each record against the one before it of the same frontier row: whether its content differs, and the lines that came and went."""
    w = Window.partitionBy("frontier_seq").orderBy("result_id")
    c = table(spark, folder, "crawl_results").where("content IS NOT NULL").select("result_id", "frontier_seq", "content", F.lag("content").over(w).alias("before"))
    now, then = F.split("content", "\n", -1), F.split("before", "\n", -1)
    return c.where("before IS NOT NULL").select("result_id", (F.md5("content") != F.md5("before")).alias("changed"), F.size(F.array_except(now, then)).alias("new_lines"), F.size(F.array_except(then, now)).alias("gone_lines"))


QUERIES = {f.__name__: f for f in (tech_detect, tech_counts, tech_signals, tech_summaries, response_codes, changes_between)}
_SERVER = "list_filter(map_entries(headers), lambda e: lower(e.key) = 'server')[1].value"
_TECH = rf"""r AS (SELECT response_id, coalesce(text, '') AS t, {_SERVER} AS s FROM responses),
    d AS (SELECT response_id, 'Nginx' AS tech, 'Web servers' AS category, 100 AS confidence, nullif(regexp_extract(s, '(?i)nginx(?:/([\d.]+))?', 1), '') AS version FROM r WHERE regexp_matches(s, '(?i)nginx')
      UNION ALL SELECT response_id, 'Apache', 'Web servers', 100, nullif(regexp_extract(s, '(?i)(?:Apache(?:$|/([\d.]+)|[^/-])|(?:^|\b)HTTPD)', 1), '') FROM r WHERE regexp_matches(s, '(?i)(?:Apache(?:$|/([\d.]+)|[^/-])|(?:^|\b)HTTPD)')
      UNION ALL SELECT response_id, 'Appd', 'Web servers', 100, regexp_extract(s, '(?i)^appd/(\d+)', 1) FROM r WHERE regexp_matches(s, '(?i)^appd/(\d+)')
      UNION ALL SELECT response_id, 'Edge proxy', 'CDN', 60, NULL FROM r WHERE regexp_matches(s, '(?i)^edge$')
      UNION ALL SELECT response_id, 'Page info', 'Analytics', 100, NULL FROM r WHERE regexp_matches(t, '(?is)window\.pageInfo\s*=')
      UNION ALL SELECT response_id, 'Table layout', 'Miscellaneous', 50, NULL FROM r WHERE regexp_matches(t, '(?is)<body>\s*(?:<!--[^>]*-->\s*)*<table><tr>'))"""
ORACLES = {
    "tech_detect": f"WITH {_TECH} SELECT * FROM d",
    "tech_counts": f"WITH {_TECH} SELECT tech, count(*) AS pages, count(DISTINCT version) AS versions FROM d WHERE confidence >= 60 AND category <> 'Analytics' GROUP BY 1",
    "tech_signals": f"""WITH p AS (SELECT unnest(range({PAGES})) AS i),
        d AS (SELECT i, 'scriptSrc-' || (i * 3) % {KINDS} AS tech, 100 AS c, i::VARCHAR AS version, 'JavaScript libraries' AS cat, 'Web development' AS grp FROM p UNION ALL SELECT i, 'headers-' || (i * 5) % {KINDS}, 100, '1.' || i, 'Web servers', 'Servers' FROM p
          UNION ALL SELECT i, 'cookies-' || (i * 23) % {KINDS}, 100, CASE WHEN i % 3 = 0 THEN NULL ELSE i::VARCHAR END, 'Analytics', 'Analytics' FROM p UNION ALL SELECT i, 'meta-' || (i * 7) % {KINDS}, 70, i::VARCHAR, 'CMS', 'Content' FROM p
          UNION ALL SELECT i, 'html-' || (i * 9) % {KINDS}, 100, NULL, 'Miscellaneous', 'Other' FROM p UNION ALL SELECT i, 'scripts-' || (i * 11) % {KINDS}, 100, NULL, 'Analytics', 'Analytics' FROM p UNION ALL SELECT i, 'css-' || (i * 13) % {KINDS}, 100, NULL, 'UI frameworks', 'Web development' FROM p
          UNION ALL SELECT i, 'url-' || (i * 19) % {KINDS}, 30, NULL, 'Ecommerce', 'Sales' FROM p UNION ALL SELECT i, 'js-' || (i * 29) % {KINDS}, 100, i::VARCHAR, 'JavaScript frameworks|999', 'Web development' FROM p
          UNION ALL SELECT i, 'dom-' || (i * 17) % {KINDS}, 100, NULL, 'Ecommerce', 'Sales' FROM p WHERE i % 2 = 0 UNION ALL SELECT i, 'base-' || ((i * 5) % {KINDS}) % 5, 60, NULL, 'Programming languages', 'Web development' FROM p)
        SELECT i AS id, tech, c AS confidence, version, cat AS categories, grp AS groups FROM d""",
    "tech_summaries": f"""WITH p AS (SELECT unnest(range({PAGES})) AS i),
        d AS (SELECT i, 'css-' || (i * 13) % {KINDS} || ' (UI frameworks)' AS t, 0 AS o FROM p UNION ALL SELECT i, 'dom-' || (i * 17) % {KINDS} || ' (Ecommerce)', 1 FROM p WHERE i % 2 = 0 UNION ALL SELECT i, 'html-' || (i * 9) % {KINDS} || ' (Miscellaneous)', 2 FROM p
          UNION ALL SELECT i, 'scriptSrc-' || (i * 3) % {KINDS} || ' ' || i || ' (JavaScript libraries)', 3 FROM p UNION ALL SELECT i, 'scripts-' || (i * 11) % {KINDS} || ' (Analytics)', 4 FROM p UNION ALL SELECT i, 'meta-' || (i * 7) % {KINDS} || ' ' || i || ' (CMS)', 5 FROM p
          UNION ALL SELECT i, 'url-' || (i * 19) % {KINDS} || ' (Ecommerce)', 6 FROM p),
        g AS (SELECT i, list(t ORDER BY o) AS ts FROM d GROUP BY 1)
        SELECT i AS id, len(ts)::INT AS n, array_to_string(ts[1:6], ' + ') || CASE WHEN len(ts) > 6 THEN ' +' || (len(ts) - 6) || ' more' ELSE '' END AS tech_summary FROM g""",
    "response_codes": """SELECT CASE WHEN status_code = 429 THEN 'rate_limited' WHEN status_code = 403 AND length(text) <= 512 THEN 'short_deny' WHEN status_code = 304 THEN 'unchanged' WHEN status_code IN (408, 429, 500, 502, 503, 504, 522, 524) THEN 'retry' WHEN status_code >= 400 THEN 'final' ELSE 'ok' END AS kind_seen,
        blocked, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM responses GROUP BY 1, 2""",
    "changes_between": """WITH c AS (SELECT result_id, content, lag(content) OVER (PARTITION BY frontier_seq ORDER BY result_id) AS b FROM crawl_results WHERE content IS NOT NULL),
        l AS (SELECT result_id, content, b, list_distinct(string_split(content, chr(10))) AS x, list_distinct(string_split(b, chr(10))) AS y FROM c WHERE b IS NOT NULL)
        SELECT result_id, content <> b AS changed, len(list_filter(x, lambda v: NOT list_contains(y, v))) AS new_lines, len(list_filter(y, lambda v: NOT list_contains(x, v))) AS gone_lines FROM l""",
}
