"""Queries of walks, network logs, sources and streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import html as hx
from weftline.functions import walls
from weftline.operators import crawl, netlog
from weftline.operators.skew import lookup
from weftline.session import cut_lineage, remove, shared_folder, table
from weftline.sources import files
from weftline.streaming import folds


def crawl_bfs(spark: SparkSession, folder: str) -> DataFrame:
    """OP-177: urls within three links of the records of depth 0."""
    c = table(spark, folder, "crawl_results")
    edges = c.select(F.col("url").alias("src"), F.explode("links_found").alias("dst"))
    return crawl.bfs(edges, c.where("depth = 0").select(F.col("url").alias("node")), 3)


def crawl_bfs_first(spark: SparkSession, folder: str) -> DataFrame:
    """OP-177: the first five hundred pages of that walk."""
    c = table(spark, folder, "crawl_results")
    edges = c.select(F.col("url").alias("src"), F.explode("links_found").alias("dst"))
    return crawl.bfs(edges, c.where("depth = 0").select(F.col("url").alias("node")), 3, 500)


#: A made site: one index of so many indices, each of so many sitemaps of three pages; a third of the sitemaps don't answer.
INDICES, MAPS = 20, 30


def _sitemaps(spark: SparkSession) -> DataFrame:
    index = lambda locs: f"concat('<sitemapindex>', array_join(transform({locs}, x -> concat('<sitemap><loc>', x, '</loc></sitemap>')), ''), '</sitemapindex>')"
    root = spark.range(1).select(F.lit("root").alias("url"), F.expr(index(f"transform(sequence(0, {INDICES - 1}), i -> concat('index', i))")).alias("body"), F.lit(200).alias("status"))
    middle = spark.range(INDICES).select(F.expr("concat('index', id)").alias("url"), F.expr(index(f"array_append(transform(sequence(0, {MAPS - 1}), j -> concat('map', id * {MAPS} + j)), 'root')")).alias("body"), F.lit(None).cast("int").alias("status"))
    leaf = "concat('<urlset>', array_join(transform(sequence(0, 2), k -> concat('<url><loc>https://s.example/', id DIV 2, '/', k, '</loc></url>')), ''), '</urlset>')"
    maps = spark.range(INDICES * MAPS).select(F.expr("concat('map', id)").alias("url"), F.expr(leaf).alias("body"), F.expr("CAST(CASE WHEN id % 3 = 0 THEN 404 ELSE 200 END AS INT)").alias("status"))
    return root.unionByName(middle).unionByName(maps)


def sitemap_discover(spark: SparkSession, folder: str) -> DataFrame:
    """OP-06"""
    return crawl.discover(_sitemaps(spark), spark.createDataFrame([("root",)], "url string"))


def urls_discovered(spark: SparkSession, folder: str) -> DataFrame:
    """OP-07: urls of made sitemaps, of the links of responses, and of the frontier, each with its first source."""
    r = table(spark, folder, "responses").where("text IS NOT NULL")
    links = r.select(F.explode(hx.links(F.col("text"), F.col("url"))).alias("url"))
    specs = r.select(F.explode(hx.spec_links(F.col("text"), F.col("url"))).alias("s")).select(F.col("s.url").alias("url"))
    maps = crawl.discover(_sitemaps(spark), spark.createDataFrame([("root",)], "url string"))
    found = crawl.discovered({"sitemap": maps, "links": links, "specs": specs, "frontier": table(spark, folder, "frontier").select("url")})
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("urls"))


def site_overview(spark: SparkSession, folder: str) -> DataFrame:
    """OP-191: of each response what its sections tell: head, links, images, structured data, wall; a section that fails would be null and named."""
    r = table(spark, folder, "responses")
    t = F.col("text")
    sections = {
        "title": hx.title(t), "links": F.size(hx.links(t, F.col("url"))), "images": F.size(hx.images(t, F.col("url"))), "structured": F.size(hx.json_ld(t)), "blocked": walls.wall(F.col("status_code"), F.col("headers"), t)["blocked"],
    }
    out = r.select("response_id", *[c.alias(k) for k, c in sections.items()])
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(k).isNull(), k) for k in sections]), lambda x: x.isNotNull()), ",")
    return out.withColumn("errors", missing)


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a network log: views and clicks are sent, signups answered, purchases finished; the user is the request."""
    kind = F.when(F.col("event_type").isin("view", "click"), "sent").when(F.col("event_type") == "signup", "answered").when(F.col("event_type") == "purchase", "finished")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("request_id"), kind.alias("kind"), F.col("event_id").cast("double").alias("at"), F.concat(F.lit("https://s.example/"), "event_id").alias("url"), F.lit("GET").alias("method"),
        (F.col("event_id") % 5 * 100 + 100).cast("int").alias("status"), F.lit("application/json").alias("mime"), F.col("event_id").alias("size"),
    )


def netlog_requests(spark: SparkSession, folder: str) -> DataFrame:
    return netlog.requests(_events(spark, folder)).drop("mime", "method")


def netlog_data(spark: SparkSession, folder: str) -> DataFrame:
    return netlog.data_sources(netlog.requests(_events(spark, folder)), "https://s.example")


def netlog_har(spark: SparkSession, folder: str) -> DataFrame:
    return netlog.har(netlog.requests(_events(spark, folder))).select("request_id", F.get_json_object("entry", "$.request.url").alias("url"))


def main_documents(spark: SparkSession, folder: str) -> DataFrame:
    """OP-166: a user's events as the answers of a session, the wanted url being that of its least click."""
    e = _events(spark, folder).where("request_id IS NOT NULL").select("request_id", "at", F.concat("url", F.lit("/?q=1")).alias("url"), F.concat(F.lit("h"), F.col("size").cast("string")).alias("headers"))
    wanted = table(spark, folder, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("request_id")).agg(F.concat(F.lit("https://s.example/"), F.min("event_id")).alias("wanted"))
    return netlog.main_headers(lookup(e, wanted, ["request_id"]), "request_id", "wanted")


def batches_made(spark: SparkSession, folder: str) -> DataFrame:
    """OP-01, 88: items of batch texts of four forms, in order."""
    text = """CASE id % 4 WHEN 0 THEN concat('["a', id, '", "b"]') WHEN 1 THEN concat('# note\\nhttps://x.example/', id, '\\n\\n https://y.example/ ') WHEN 2 THEN concat('{"u": ', id, '}\\n{"u": 2}') ELSE ' ' END"""
    return files.batch_items(spark.range(500).select("id", F.expr(text).alias("text")), keep=("id",))


def cookies_made(spark: SparkSession, folder: str) -> DataFrame:
    """OP-02, 19: cookies of three forms as lines of one."""
    text = """CASE id % 3 WHEN 0 THEN concat('[{"name": "a', id, '", "value": "1", "domain": ".x.example"}, {"name": "", "value": "2"}]') WHEN 1 THEN concat('# c\\n.y.example\\tTRUE\\t/\\tTRUE\\t', id, '\\tb', id, '\\t2\\nbad line') ELSE concat('{"cookies": [{"name": "c', id, '", "value": "3"}]}') END"""
    return files.netscape_lines(files.cookies(spark.range(600).select(F.expr(text).alias("text"))))


def stream_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """OP-170 run to its end over the visited table as a stream; what the stream wrote goes once it is read."""
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{folder}/visited.parquet"
    static = spark.read.parquet(path)
    src = spark.readStream.schema(static.schema).parquet(path if os.path.isdir(path) else f"{folder}/visited.parquet*")
    q = folds.first_seen(src.where("fp IS NOT NULL").select("fp"), ["fp"]).writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    found = cut_lineage(spark.read.schema("fp binary").parquet(f"{out}/data").select(F.lower(F.hex("fp")).alias("fp")))
    remove(spark, out)
    return found


QUERIES = {f.__name__: f for f in (crawl_bfs, crawl_bfs_first, sitemap_discover, urls_discovered, site_overview, netlog_requests, netlog_data, netlog_har, main_documents, batches_made, cookies_made, stream_first_seen)}
_REQ = """r AS (SELECT user_id AS request_id, max(event_id) FILTER (event_type IN ('view', 'click'))::DOUBLE AS sent_at, 'https://s.example/' || max(event_id) FILTER (event_type IN ('view', 'click')) AS url,
    (max(event_id) FILTER (event_type = 'signup') % 5 * 100 + 100)::INT AS status, max(event_id) FILTER (event_type = 'purchase')::DOUBLE AS finished_at, max(event_id) FILTER (event_type = 'purchase') AS size FROM events WHERE user_id IS NOT NULL GROUP BY 1)"""
ORACLES = {
    "crawl_bfs": """WITH RECURSIVE e AS (SELECT DISTINCT url AS src, unnest(links_found) AS dst FROM crawl_results), w(node, depth) AS (SELECT DISTINCT url, 0 FROM crawl_results WHERE depth = 0 AND url IS NOT NULL UNION SELECT dst, depth + 1 FROM w JOIN e ON e.src = w.node WHERE depth < 3 AND dst IS NOT NULL)
        SELECT node, min(depth) AS depth FROM w GROUP BY 1""",
    "crawl_bfs_first": """WITH RECURSIVE e AS (SELECT DISTINCT url AS src, unnest(links_found) AS dst FROM crawl_results), w(node, depth) AS (SELECT DISTINCT url, 0 FROM crawl_results WHERE depth = 0 AND url IS NOT NULL UNION SELECT dst, depth + 1 FROM w JOIN e ON e.src = w.node WHERE depth < 3 AND dst IS NOT NULL)
        SELECT node, min(depth) AS depth FROM w GROUP BY 1 ORDER BY 2, 1 LIMIT 500""",
    "sitemap_discover": f"SELECT DISTINCT 'https://s.example/' || i // 2 || '/' || k AS url FROM (SELECT unnest(range({INDICES * MAPS})) AS i), (SELECT unnest(range(3)) AS k) WHERE i % 3 > 0",
    "urls_discovered": rf"""WITH p AS (SELECT regexp_extract(url, '^[^:/?#]+://[^/?#]+', 0) AS o, list_transform(regexp_extract_all(text, '(?i)<a\b[^>]*\shref\s*=\s*"([^"]*)"', 1), lambda h: replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')) AS hs FROM responses WHERE text IS NOT NULL),
        l AS (SELECT unnest(list_filter(list_transform(list_filter(hs, lambda h: h <> '' AND NOT regexp_matches(h, '^(#|(?i:javascript:|mailto:))')), lambda h: CASE WHEN starts_with(h, '/') THEN o || h ELSE h END), lambda h: regexp_matches(h, '^https?://'))) AS url FROM p),
        u AS (SELECT 'https://s.example/' || i // 2 || '/' || k AS url, 0 AS p FROM (SELECT unnest(range({INDICES * MAPS})) AS i), (SELECT unnest(range(3)) AS k) WHERE i % 3 > 0 UNION ALL SELECT url, 1 FROM l UNION ALL SELECT url, 3 FROM frontier)
        SELECT CASE p WHEN 0 THEN 'sitemap' WHEN 1 THEN 'links' ELSE 'frontier' END AS source, count(*) AS urls FROM (SELECT url, min(p) AS p FROM u WHERE url IS NOT NULL GROUP BY 1) GROUP BY 1""",
    "main_documents": """WITH a AS (SELECT user_id, max(event_id) AS last, min(event_id) FILTER (event_type = 'click') AS c FROM events WHERE user_id IS NOT NULL GROUP BY 1) SELECT user_id AS request_id, 'h' || coalesce(c, last) AS headers FROM a""",
    "batches_made": """WITH i AS (SELECT unnest(range(500)) AS id) SELECT id, 0 AS "index", CASE id % 4 WHEN 0 THEN 'a' || id WHEN 1 THEN 'https://x.example/' || id ELSE '{"u": ' || id || '}' END AS item FROM i WHERE id % 4 < 3 UNION ALL
        SELECT id, 1, CASE id % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'https://y.example/' ELSE '{"u": 2}' END FROM i WHERE id % 4 < 3""",
    "cookies_made": """SELECT array_to_string(CASE id % 3 WHEN 0 THEN ['.x.example', 'TRUE', '/', 'FALSE', '0', 'a' || id, '1'] WHEN 1 THEN ['.y.example', 'TRUE', '/', 'TRUE', id::VARCHAR, 'b' || id, '2'] ELSE ['', 'FALSE', '/', 'FALSE', '0', 'c' || id, '3'] END, chr(9)) AS line FROM (SELECT unnest(range(600)) AS id)""",
    "netlog_requests": f"WITH {_REQ} SELECT request_id, sent_at, url, status, finished_at, size, finished_at - sent_at AS elapsed FROM r WHERE sent_at IS NOT NULL",
    "netlog_data": f"WITH {_REQ} SELECT url, request_id FROM r WHERE sent_at IS NOT NULL AND (size IS NULL OR size >= 1024) AND status IS NOT NULL",
    "netlog_har": f"WITH {_REQ} SELECT request_id, url FROM r WHERE sent_at IS NOT NULL",
    "stream_first_seen": "SELECT DISTINCT lower(hex(fp)) AS fp FROM visited WHERE fp IS NOT NULL",
}
