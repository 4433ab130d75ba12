"""Queries over frontier, visited, fetch_log, domain_stats and domain_budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.functions.urls import site_key
from weftline.operators import frontier as fr
from weftline.plans.skew_plans import HOST_SQL
from weftline.session import table

LOG_HOST = r"nullif(regexp_replace(regexp_replace(regexp_replace(lower(hostname), '^\s+|\s+$', '', 'g'), ':[0-9]*$', ''), '\.$', ''), '')"


def _host() -> Column:
    return site_key(F.col("hostname"), F.lit(None).cast("string"))


def frontier_visits(spark: SparkSession, folder: str) -> DataFrame:
    return fr.with_visits(table(spark, folder, "frontier"), table(spark, folder, "visited")).select("seq", "visit_etag", "visit_last_modified", "visit_fetched_at")


def frontier_unseen(spark: SparkSession, folder: str) -> DataFrame:
    """OP-45, 46 over stored keys; rows without one are keyed in ``frontier_unseen_keyed``."""
    return fr.unseen(table(spark, folder, "frontier").select("fp", "seq", "url"), table(spark, folder, "visited")).select("seq", "url")


def frontier_unseen_keyed(spark: SparkSession, folder: str) -> DataFrame:
    """OP-45, 46, 108: the same with null keys derived from method and url (BLAKE2, which SQL lacks)."""
    f = fr.keyed(table(spark, folder, "frontier").select("fp", "seq", "url", "method"), "method")
    return fr.unseen(f, fr.keyed(table(spark, folder, "visited").select("fp", "url"))).select("seq", "url")


def _stats(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "domain_stats").dropDuplicates(["job_id", "hostname"])


#: A moment within the tables' times.
NOW = 1767225600.0


def frontier_stats(spark: SparkSession, folder: str) -> DataFrame:
    """OP-42"""
    return fr.with_stats(table(spark, folder, "frontier").select("seq", "job_id", "hostname"), _stats(spark, folder)).select("seq", "consecutive_fails", "snooze_until", "sick_until", "ewma_response_ms")


def frontier_budget(spark: SparkSession, folder: str) -> DataFrame:
    """OP-43"""
    return fr.with_budget(table(spark, folder, "frontier").select("seq", "hostname"), table(spark, folder, "domain_budget")).select("seq", "max_urls", "max_bytes", "max_seconds")


def frontier_eligible(spark: SparkSession, folder: str) -> DataFrame:
    """OP-171: what may be fetched."""
    return fr.eligible(table(spark, folder, "frontier"), _stats(spark, folder), table(spark, folder, "domain_budget"), NOW).select("seq", "hostname", "priority")


def frontier_next_batch(spark: SparkSession, folder: str) -> DataFrame:
    """OP-171: the next hundred."""
    return fr.next_batch(table(spark, folder, "frontier"), _stats(spark, folder), table(spark, folder, "domain_budget"), NOW, 100).select("seq", "hostname", "priority", "added_at")


def frontier_statuses(spark: SparkSession, folder: str) -> DataFrame:
    return fr.by_status(table(spark, folder, "frontier"))


def frontier_dead(spark: SparkSession, folder: str) -> DataFrame:
    return fr.dead_letters(table(spark, folder, "frontier"))


def frontier_admission(spark: SparkSession, folder: str) -> DataFrame:
    """OP-31: what would be skipped or given up, and why."""
    f = table(spark, folder, "frontier")
    a = fr.admission(F.col("depth"), F.col("url").rlike("^https?://"), ~F.col("url").contains("/private"), 2)
    return f.select("seq", a.alias("a")).select("seq", "a.*")


def visited_upserted(spark: SparkSession, folder: str) -> DataFrame:
    """OP-175, 176: earlier visits with those of the last 30 days put in."""
    v = table(spark, folder, "visited").withColumn("fetched_at", F.coalesce("fetched_at", F.lit(0.0)))
    late = F.col("fetched_at") >= NOW - 30 * 86400.0
    return fr.upserted(v.where(~late), v.where(late), 7.0).select(F.lower(F.hex("fp")).alias("fp"), "status_code", "etag", "fetched_at", "next_refresh_at")


def visited_due(spark: SparkSession, folder: str) -> DataFrame:
    return fr.due(table(spark, folder, "visited"), NOW).select(F.lower(F.hex("fp")).alias("fp"), "next_refresh_at")


def frontier_starts(spark: SparkSession, folder: str) -> DataFrame:
    """OP-178: when each frontier row could start at two a second and host."""
    f = table(spark, folder, "frontier").select("seq", F.coalesce("hostname", F.lit("")).alias("hostname"), "added_at")
    return fr.earliest_starts(f, "hostname", "seq", "added_at", 2.0).select("seq", F.round("start", 3).alias("start"))


def crawl_counts(spark: SparkSession, folder: str) -> DataFrame:
    """OP-73, 74: records by job: fetched, failed, unchanged."""
    c = table(spark, folder, "crawl_results").groupBy("job_id").agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    v = table(spark, folder, "visited").groupBy("job_id").agg(F.count_if(F.col("status_code") == 304).alias("unchanged"))
    return c.join(v, c["job_id"].eqNullSafe(v["job_id"]), "left").select(c["job_id"], "ok", "errors", F.coalesce("unchanged", F.lit(0)).alias("unchanged"))


def outcomes_until_terminal(spark: SparkSession, folder: str) -> DataFrame:
    """OP-72: answers of each site by kind; those after its first terminal one are skipped."""
    r = table(spark, folder, "responses").select(site_key(F.lit(None).cast("string"), F.col("url")).alias("site"), "response_id", F.coalesce("kind", F.lit("ok")).alias("outcome"), F.coalesce("terminal", F.lit(False)).alias("terminal"))
    return fr.until_terminal(r, "site", "response_id", "outcome", "terminal")


def log_noted(spark: SparkSession, folder: str) -> DataFrame:
    """OP-56, 59: totals where failures that will be tried again are only noted."""
    t = fr.host_totals(log_distinct(spark, folder), _host(), fr.event_kind(F.col("ok"), F.col("status_code")))
    return t.withColumn("seconds_spent", F.round("seconds_spent", 4))


def log_pauses(spark: SparkSession, folder: str) -> DataFrame:
    """OP-58, 61: until when hosts pause and rest at a moment, by their statistics."""
    s = table(spark, folder, "domain_stats")
    pause = fr.snoozed_until(F.col("snooze_until"), F.lit(NOW), F.coalesce(F.col("ewma_response_ms") / 10, F.lit(5.0)))
    return s.select("job_id", "hostname", F.round(pause, 3).alias("snooze_until"), fr.sick_until(F.col("sick_until"), F.lit(NOW), F.col("consecutive_fails")).alias("sick_until"))


def log_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """OP-71: time spent by day, the newest thirty days."""
    d = log_distinct(spark, folder).where("fetched_at IS NOT NULL").groupBy(F.to_date("fetched_at").alias("day")).agg(F.round(F.sum("response_ms"), 2).alias("ms"))
    return d.orderBy(F.desc("day")).limit(30)


def frontier_one_per_host(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "frontier").select(site_key(F.col("hostname"), F.col("url")).alias("hostname"), "seq", "priority", "added_at")
    return fr.one_per_host(f)


def frontier_by_depth(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "frontier").groupBy("job_id", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("added_at").alias("first_added"), F.countDistinct("fp").alias("keys"))


def log_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """The log without exact repeats."""
    return table(spark, folder, "fetch_log").distinct()


def log_totals(spark: SparkSession, folder: str) -> DataFrame:
    t = fr.host_totals(log_distinct(spark, folder), _host())
    return t.withColumn("seconds_spent", F.round("seconds_spent", 4))


def log_ewma(spark: SparkSession, folder: str) -> DataFrame:
    log = log_distinct(spark, folder)
    e = fr.ewma(log.where(fr.event_kind(F.col("ok"), F.col("status_code")) != "noted"), _host())  # ok ones and failures that are final
    return e.select("hostname", F.round("ewma_ms", 4).alias("ewma_ms"), F.round(fr.delay_seconds(F.col("ewma_ms")), 6).alias("delay_s"))


def log_fails_in_a_row(spark: SparkSession, folder: str) -> DataFrame:
    return fr.failures_in_a_row(log_distinct(spark, folder), _host()).select("hostname", "consecutive_fails", (F.col("consecutive_fails") >= fr.SICK_AFTER).alias("sick"))


def log_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    return log_distinct(spark, folder).groupBy(F.date_trunc("hour", "fetched_at").alias("hour"), "status_code").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def stats_within_budget(spark: SparkSession, folder: str) -> DataFrame:
    """OP-44, 62: statistics of hosts with a budget. The budget table has a row a host (a fixed, small one)."""
    s, b = table(spark, folder, "domain_stats"), table(spark, folder, "domain_budget")
    under = lambda used, cap: F.col(cap).isNull() | (F.col(used) < F.col(cap))
    s = s.groupBy(_host().alias("hostname")).agg(F.sum("urls_fetched").alias("urls"), F.sum("bytes_fetched").alias("bytes"), F.round(F.sum("seconds_spent"), 3).alias("seconds"))
    return b.join(s, "hostname", "left").select(
        "hostname", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("urls", "bytes", "seconds")],
        (F.coalesce(under("urls", "max_urls"), F.lit(True)) & F.coalesce(under("bytes", "max_bytes"), F.lit(True)) & F.coalesce(under("seconds", "max_seconds"), F.lit(True))).alias("within"),
    )


def frontier_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """OP-79, 80: of each job and depth, seq's distance to the one before, and rows so far."""
    f = table(spark, folder, "frontier").select("job_id", "depth", "seq")
    return fr.in_order(f, ["job_id", "depth"], "seq").select("seq", (F.col("seq") - F.col("before")).alias("gap"), F.col("place").alias("so_far"))


def urls_first_source(spark: SparkSession, folder: str) -> DataFrame:
    """OP-90, 64: urls of frontier, then of visited, then of links, each with its first source."""
    u = lambda name, col, prio: table(spark, folder, name).select(F.col(col).alias("url"), F.lit(prio).alias("prio"), F.lit(name).alias("source"))
    links = table(spark, folder, "crawl_results").select(F.explode("links_found").alias("url"), F.lit(3).alias("prio"), F.lit("links").alias("source"))
    return fr.first_of_each(u("frontier", "url", 1).unionByName(u("visited", "url", 2)).unionByName(links), "url", "prio", "source").groupBy("source").agg(F.count(F.lit(1)).alias("urls"))


QUERIES = {f.__name__: f for f in (frontier_visits, frontier_unseen, frontier_unseen_keyed, frontier_stats, frontier_budget, frontier_eligible, frontier_next_batch, frontier_statuses, frontier_dead, frontier_admission, visited_upserted, visited_due, frontier_starts, crawl_counts, outcomes_until_terminal, log_noted, log_pauses, log_by_day, frontier_one_per_host, frontier_by_depth, log_totals, log_ewma, log_fails_in_a_row, log_by_hour, stats_within_budget, frontier_gaps, urls_first_source)}
_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY coalesce(fetched_at, '-infinity'::DOUBLE) DESC, coalesce(url, '') DESC, coalesce(job_id, '') DESC, coalesce(status_code, -1) DESC) AS k FROM visited WHERE fp IS NOT NULL) WHERE k = 1)"
_LOG = f"(SELECT DISTINCT *, {LOG_HOST} AS h FROM fetch_log)"
_FROM = "FROM frontier f LEFT JOIN (SELECT DISTINCT ON (job_id, hostname) * FROM domain_stats) d ON f.job_id IS NOT DISTINCT FROM d.job_id AND f.hostname IS NOT DISTINCT FROM d.hostname LEFT JOIN domain_budget b ON f.hostname = b.hostname"
_FREE = f"status = 'pending' AND coalesce(next_retry_at, 0) <= {NOW} AND coalesce(snooze_until, 0) <= {NOW} AND coalesce(sick_until, 0) <= {NOW} AND NOT coalesce(coalesce(urls_fetched, 0) >= max_urls, false)"
_KIND = "CASE WHEN coalesce(ok, false) THEN 'ok' WHEN coalesce(status_code IN (408, 429, 500, 502, 503, 504, 522, 524), false) THEN 'noted' ELSE 'fail' END"
_V = "(SELECT * REPLACE (coalesce(fetched_at, 0) AS fetched_at) FROM visited WHERE fp IS NOT NULL)"
_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY fetched_at DESC, coalesce(url, '') DESC, coalesce(job_id, '') DESC, coalesce(status_code, -1) DESC) AS k FROM {v} WHERE fetched_at {op}) WHERE k = 1)"
ORACLES = {
    "frontier_stats": f"SELECT seq, consecutive_fails, coalesce(snooze_until, 0) AS snooze_until, coalesce(sick_until, 0) AS sick_until, ewma_response_ms {_FROM}",
    "frontier_budget": "SELECT seq, max_urls, max_bytes, max_seconds FROM frontier LEFT JOIN domain_budget USING (hostname)",
    "frontier_eligible": f"SELECT seq, f.hostname AS hostname, priority {_FROM} WHERE {_FREE}",
    "frontier_next_batch": f"""WITH e AS (SELECT seq, f.hostname AS hostname, priority, added_at, row_number() OVER (PARTITION BY f.hostname ORDER BY coalesce(priority, -2147483648) DESC, coalesce(added_at, 'infinity'::DOUBLE), seq) AS k {_FROM} WHERE {_FREE} AND f.hostname IS NOT NULL)
        SELECT seq, hostname, priority, added_at FROM e WHERE k = 1 ORDER BY priority DESC NULLS LAST, added_at NULLS FIRST, seq LIMIT 100""",
    "frontier_statuses": "SELECT status, count(*) AS n FROM frontier GROUP BY 1",
    "frontier_dead": "SELECT lower(hex(fp)) AS fp, url, hostname, depth, attempts, last_error, added_at, seq FROM frontier WHERE status = 'dead'",
    "frontier_admission": """SELECT seq, CASE WHEN depth > 2 OR NOT coalesce(regexp_matches(url, '^https?://'), false) THEN 'skipped' WHEN contains(url, '/private') THEN 'dead' END AS status,
        CASE WHEN depth > 2 THEN 'depth' WHEN NOT coalesce(regexp_matches(url, '^https?://'), false) THEN 'pattern' WHEN contains(url, '/private') THEN 'robots' END AS reason FROM frontier""",
    "visited_upserted": f"""WITH o AS {_LAST.format(v=_V, op=f'< {NOW - 30 * 86400.0}')}, n AS {_LAST.format(v=_V, op=f'>= {NOW - 30 * 86400.0}')}
        SELECT lower(hex(coalesce(n.fp, o.fp))) AS fp, CASE WHEN n.fp IS NULL OR n.status_code = 304 AND o.fp IS NOT NULL THEN o.status_code ELSE n.status_code END AS status_code, CASE WHEN n.fp IS NULL OR n.status_code = 304 AND o.fp IS NOT NULL THEN o.etag ELSE n.etag END AS etag,
          coalesce(n.fetched_at, o.fetched_at) AS fetched_at, CASE WHEN n.fp IS NULL THEN o.next_refresh_at ELSE n.fetched_at + 604800.0 END AS next_refresh_at FROM o FULL JOIN n ON o.fp = n.fp""",
    "visited_due": f"SELECT lower(hex(fp)) AS fp, next_refresh_at FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY coalesce(fetched_at, '-infinity'::DOUBLE) DESC, coalesce(url, '') DESC, coalesce(job_id, '') DESC, coalesce(status_code, -1) DESC) AS k FROM visited WHERE fp IS NOT NULL) WHERE k = 1 AND next_refresh_at <= {NOW}",
    "frontier_starts": """WITH a AS (SELECT seq, coalesce(hostname, '') AS h, added_at FROM frontier WHERE added_at IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY seq) AS i FROM a)
        SELECT seq, round(max(added_at - i / 2.0) OVER (PARTITION BY h ORDER BY seq ROWS UNBOUNDED PRECEDING) + i / 2.0, 3) AS start FROM b""",
    "crawl_counts": "WITH c AS (SELECT job_id, count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (error IS NOT NULL) AS errors FROM crawl_results GROUP BY 1), v AS (SELECT job_id, count(*) FILTER (status_code = 304) AS u FROM visited GROUP BY 1) SELECT c.job_id AS job_id, ok, errors, coalesce(u, 0) AS unchanged FROM c LEFT JOIN v ON c.job_id IS NOT DISTINCT FROM v.job_id",
    "outcomes_until_terminal": f"""WITH r AS (SELECT {HOST_SQL.replace('hostname', 'NULL::VARCHAR')} AS site, response_id, coalesce(kind, 'ok') AS o, coalesce(terminal, false) AS t FROM responses), x AS (SELECT *, min(CASE WHEN t THEN response_id END) OVER (PARTITION BY site) AS f FROM r)
        SELECT site, CASE WHEN response_id > f THEN 'skipped' ELSE o END AS outcome, count(*) AS n FROM x GROUP BY 1, 2""",
    "log_noted": f"WITH l AS (SELECT *, {_KIND} AS k FROM {_LOG}) SELECT h AS hostname, count(*) FILTER (k = 'ok') AS ok_count, count(*) FILTER (k <> 'ok') AS fail_count, count(*) FILTER (k <> 'noted') AS urls_fetched, CAST(coalesce(sum(bytes) FILTER (k = 'ok'), 0) AS BIGINT) AS bytes_fetched, round(coalesce(sum(response_ms) FILTER (k <> 'noted') / 1000, 0), 4) AS seconds_spent FROM l GROUP BY 1",
    "log_pauses": f"SELECT job_id, hostname, round(greatest(coalesce(snooze_until, 0), {NOW} + least(coalesce(ewma_response_ms / 10, 5), 120)), 3) AS snooze_until, CASE WHEN consecutive_fails >= 10 THEN {NOW} + 600 ELSE coalesce(sick_until, 0) END AS sick_until FROM domain_stats",
    "log_by_day": f"SELECT CAST(fetched_at AS DATE) AS day, round(sum(response_ms), 2) AS ms FROM {_LOG} WHERE fetched_at IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 30",
    "frontier_visits": f"SELECT seq, v.etag AS visit_etag, v.last_modified AS visit_last_modified, v.fetched_at AS visit_fetched_at FROM frontier LEFT JOIN {_LATEST} v USING (fp)",
    "frontier_unseen": "SELECT seq, url FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY seq) AS k FROM frontier WHERE fp IS NOT NULL) f WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM visited v WHERE v.fp = f.fp)",
    "frontier_one_per_host": f"SELECT hostname, seq, priority, added_at FROM (SELECT *, row_number() OVER (PARTITION BY hostname ORDER BY coalesce(priority, -2147483648) DESC, coalesce(added_at, 'infinity'::DOUBLE), seq) AS k FROM (SELECT {HOST_SQL} AS hostname, seq, priority, added_at FROM frontier) WHERE hostname IS NOT NULL) WHERE k = 1",
    "frontier_by_depth": "SELECT job_id, depth, count(*) AS n, min(added_at) AS first_added, count(DISTINCT fp) AS keys FROM frontier GROUP BY 1, 2",
    "log_totals": f"SELECT h AS hostname, count(*) FILTER (coalesce(ok, false)) AS ok_count, count(*) FILTER (NOT coalesce(ok, false)) AS fail_count, count(*) AS urls_fetched, CAST(coalesce(sum(bytes) FILTER (ok), 0) AS BIGINT) AS bytes_fetched, round(coalesce(sum(response_ms) / 1000, 0), 4) AS seconds_spent FROM {_LOG} GROUP BY 1",
    "log_ewma": f"""WITH s AS (SELECT h, response_ms AS x, row_number() OVER (PARTITION BY h ORDER BY seq, response_ms) AS i, count(*) OVER (PARTITION BY h) AS n FROM {_LOG} WHERE {_KIND} <> 'noted' AND response_ms IS NOT NULL AND seq IS NOT NULL),
        e AS (SELECT h, sum(CASE WHEN i = 1 THEN pow(0.7, n - 1) * x ELSE 0.3 * pow(0.7, n - i) * x END) AS e FROM s GROUP BY 1)
        SELECT h AS hostname, round(e, 4) AS ewma_ms, round(greatest(200, least(10000, e * 2)) / 1000, 6) AS delay_s FROM e""",
    "log_fails_in_a_row": f"""WITH l AS (SELECT h, seq, coalesce(ok, false) AS ok FROM {_LOG} WHERE seq IS NOT NULL), m AS (SELECT h, max(seq) FILTER (ok) AS last_ok FROM l GROUP BY 1)
        SELECT m.h AS hostname, count(l.seq) AS consecutive_fails, count(l.seq) >= 10 AS sick FROM m LEFT JOIN l ON l.h IS NOT DISTINCT FROM m.h AND NOT l.ok AND (last_ok IS NULL OR l.seq > last_ok) GROUP BY 1""",
    "log_by_hour": f"SELECT date_trunc('hour', fetched_at) AS hour, status_code, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM {_LOG} GROUP BY 1, 2",
    "stats_within_budget": f"""WITH s AS (SELECT {LOG_HOST} AS h, CAST(sum(urls_fetched) AS BIGINT) AS urls, CAST(sum(bytes_fetched) AS BIGINT) AS bytes, round(sum(seconds_spent), 3) AS seconds FROM domain_stats GROUP BY 1)
        SELECT hostname, coalesce(urls, 0) AS urls, coalesce(bytes, 0) AS bytes, coalesce(seconds, 0) AS seconds, coalesce(max_urls IS NULL OR urls < max_urls, true) AND coalesce(max_bytes IS NULL OR bytes < max_bytes, true) AND coalesce(max_seconds IS NULL OR seconds < max_seconds, true) AS within
        FROM domain_budget LEFT JOIN s ON s.h = hostname""",
    "frontier_gaps": "SELECT seq, seq - lag(seq) OVER w AS gap, count(*) OVER (PARTITION BY job_id, depth ORDER BY seq ROWS UNBOUNDED PRECEDING) AS so_far FROM frontier WINDOW w AS (PARTITION BY job_id, depth ORDER BY seq)",
    "urls_first_source": "WITH u AS (SELECT url, 1 AS p, 'frontier' AS source FROM frontier UNION ALL SELECT url, 2, 'visited' FROM visited UNION ALL SELECT unnest(links_found), 3, 'links' FROM crawl_results) SELECT source, count(*) AS urls FROM (SELECT url, arg_min(source, p) AS source FROM u WHERE url IS NOT NULL GROUP BY 1) GROUP BY 1",
}
