"""Queries of the functions over records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import html as hx
from weftline.functions import records as rc
from weftline.operators.frontier import latest_visit
from weftline.session import table


def conditional_requests(spark: SparkSession, folder: str) -> DataFrame:
    v = latest_visit(table(spark, folder, "visited"))
    h = rc.conditional_headers(F.col("etag"), F.col("last_modified"))
    return v.select(F.lower(F.hex("fp")).alias("fp"), h["If-None-Match"].alias("etag"), h["If-Modified-Since"].alias("since"), F.size(h).alias("n"))


def url_globs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "frontier").select("seq", rc.glob_match(F.col("url"), "*-1??").alias("by_name"), rc.glob_match(F.col("url"), "https://*/docs/*").alias("by_url"))


def body_file_names(spark: SparkSession, folder: str) -> DataFrame:
    return rc.body_names(table(spark, folder, "responses"), "response_id", "url")


def rule_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Rules made from the budget's hosts: built-in ones for all, the user's for those without a cap of urls."""
    b = table(spark, folder, "domain_budget")
    rules = b.select(F.col("hostname").alias("domain"), F.create_map(F.lit("X"), F.lit("built-in")).alias("headers"))
    own = b.where("max_urls IS NULL").select(F.col("hostname").alias("domain"), F.create_map(F.lit("X"), F.lit("own")).alias("headers"))
    return rc.with_rules(table(spark, folder, "responses").select("response_id", "url"), "url", rules, own).select("response_id", F.col("rule_headers")["X"].alias("x"))


def answers_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The frontier's urls with the status that visited kept for them in the last 30 days of the table."""
    v = table(spark, folder, "visited").where("fp IS NOT NULL AND fetched_at IS NOT NULL AND status_code IS NOT NULL")
    kept = v.groupBy("fp", F.col("fetched_at").alias("cached_at")).agg(F.max("status_code").alias("answer"))
    return rc.fresh_answers(table(spark, folder, "frontier").select("seq", "fp"), kept, "fp", 1767225600.0, 30 * 86400.0).select("seq", "answer")


def topics_literal(spark: SparkSession, folder: str) -> DataFrame:
    q = spark.createDataFrame([("crawl",), ("Crawl ",), ("pro",), ("rob",), ("e",), ("zzz",), (None,)], "query string")
    return rc.resolve_topic(q, spark.createDataFrame([("crawl",), ("crawling-fast",), ("profiles",), ("robots",)], "slug string"))


def values_sanitised(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "responses").where("headers IS NOT NULL")
    return r.select("response_id", F.array_join(F.array_sort(F.transform(F.map_entries(rc.sanitised_values(F.col("headers"))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), ";").alias("headers"))


def payment_asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "responses").where("text IS NOT NULL").select("response_id", rc.asks_payment(F.col("text")).alias("asked"))


def site_maps(spark: SparkSession, folder: str) -> DataFrame:
    """OP-186: of every response its first five links inside its site."""
    r = table(spark, folder, "responses").where("text IS NOT NULL")
    links = r.select("response_id", "url", F.posexplode(hx.links(F.col("text"), F.col("url"))).alias("pos", "link"))
    return rc.pages_map(links, "response_id", "url", "link", 5).select("response_id", "link", "place")


def sessions_of_events(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of a user's events with gaps under 30 minutes."""
    e = table(spark, folder, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value")).select("user_id", F.col("w.start").alias("began"), "events", "value")


QUERIES = {f.__name__: f for f in (conditional_requests, url_globs, body_file_names, rule_headers, answers_kept, topics_literal, values_sanitised, payment_asked, site_maps, sessions_of_events)}
_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY coalesce(fetched_at, '-infinity'::DOUBLE) DESC, coalesce(url, '') DESC, coalesce(job_id, '') DESC, coalesce(status_code, -1) DESC) AS k FROM visited WHERE fp IS NOT NULL) WHERE k = 1)"
_HOST = r"lower(regexp_extract(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^(?:[^@]*@)*(\[[^\]]*\]|[^:@]*)', 1))"
_UN = lambda x: f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
ORACLES = {
    "conditional_requests": f"SELECT lower(hex(fp)) AS fp, nullif(etag, '') AS etag, nullif(last_modified, '') AS since, (coalesce(etag, '') <> '')::INT + (coalesce(last_modified, '') <> '')::INT AS n FROM {_LATEST}",
    "url_globs": r"SELECT seq, regexp_matches(url, '(?s)^.*-1..$') OR regexp_matches(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '(?s)^.*-1..$') AS by_name, regexp_matches(url, '(?s)^https://.*/docs/.*$') AS by_url FROM frontier",
    "body_file_names": r"WITH a AS (SELECT response_id, url, coalesce(nullif(regexp_extract(url, '([^/?#]+)(?:[?#].*)?$', 1), ''), 'index') AS b FROM responses) SELECT response_id, CASE WHEN count(*) OVER (PARTITION BY b) > 1 THEN b || '-' || substring(sha256(url), 1, 8) ELSE b END AS name FROM a",
    "rule_headers": f"SELECT response_id, CASE WHEN hostname IS NULL THEN NULL WHEN max_urls IS NULL THEN 'own' ELSE 'built-in' END AS x FROM responses LEFT JOIN domain_budget ON hostname = {_HOST.format(u='url')}",
    "answers_kept": "WITH k AS (SELECT fp, arg_max(status_code, (fetched_at, status_code)) AS answer FROM visited WHERE fp IS NOT NULL AND fetched_at >= 1767225600.0 - 30 * 86400.0 AND status_code IS NOT NULL GROUP BY 1) SELECT seq, answer FROM frontier LEFT JOIN k USING (fp)",
    "topics_literal": "SELECT * FROM (VALUES ('crawl', 'crawl'), ('Crawl ', 'crawl'), ('pro', 'profiles'), ('rob', 'robots'), ('e', 'profiles'), ('zzz', NULL), (NULL, NULL)) t(query, slug)",
    "values_sanitised": "SELECT response_id, array_to_string(list_sort(list_transform(map_entries(headers), lambda e: e.key || '=' || coalesce(e.value, ''))), ';') AS headers FROM responses WHERE headers IS NOT NULL",
    "payment_asked": """WITH t AS (SELECT response_id, text, lower(right(regexp_replace(text, '(?s)<script.*?</script>|<[^>]+>', ' ', 'g'), 1000)) AS e FROM responses WHERE text IS NOT NULL)
        SELECT response_id, regexp_matches(text, '(?i)"isAccessibleForFree"\\s*:\\s*"?false') OR regexp_matches(text, '(?i)class\\s*=\\s*["''][^"'']*(?:paywall|subscriber-only|premium-content|metered-content|piano-offer|regwall|locked-content|gated-content)[^"'']*["'']') OR regexp_matches(e, 'subscribe to read|sign in to continue|members only|subscribe to continue|already a subscriber|log in to read|create a free account|start your free trial|this content is for subscribers|unlock this article|premium subscribers|to continue reading') AS asked FROM t""",
    "site_maps": rf"""WITH a AS (SELECT response_id, url, regexp_extract(url, '^[^:/?#]+://[^/?#]+', 0) AS o, list_transform(regexp_extract_all(text, '(?i)<a\b[^>]*\shref\s*=\s*"([^"]*)"', 1), lambda h: {_UN('h')}) AS hs FROM responses WHERE text IS NOT NULL),
        b AS (SELECT response_id, url, unnest(ls) AS link, unnest(range(len(ls))) AS pos FROM (SELECT response_id, url, list_filter(list_transform(list_filter(hs, lambda h: h <> '' AND NOT regexp_matches(h, '^(#|(?i:javascript:|mailto:))')), lambda h: CASE WHEN starts_with(h, '/') THEN o || h ELSE h END), lambda h: regexp_matches(h, '^https?://')) AS ls FROM a)),
        c AS (SELECT response_id, link, min(pos) AS pos FROM b WHERE {_HOST.format(u='url')} = {_HOST.format(u='link')} GROUP BY 1, 2)
        SELECT response_id, link, place FROM (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY pos)::INT AS place FROM c) WHERE place <= 5""",
    "sessions_of_events": """WITH a AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL),
        b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS began, count(*) AS events, round(sum(value), 4) AS value FROM b GROUP BY user_id, s""",
}
