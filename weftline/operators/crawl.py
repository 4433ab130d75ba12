"""Walks over a link graph: breadth-first layers, link ranks, sitemaps in sitemaps (OP-06, 07, 177)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from weftline.session import cut_lineage


BROADCAST_ROWS, SALTS = 100_000, 16
#: Sitemaps larger than this are left out, as crawlers do.
MOST_CHARACTERS = 10 * 1024 * 1024


def _leaving(edges: DataFrame, layer: DataFrame) -> DataFrame:
    """Edges that leave a layer's nodes. A small layer is broadcast; beyond that each node meets a part of its edges, so that a hub is spread."""
    nodes = layer.select(F.col("node").alias("src"))
    if nodes.count() <= BROADCAST_ROWS:
        return edges.join(F.broadcast(nodes), "src", "left_semi")
    salted = nodes.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("_s", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int")).join(salted, ["src", "_s"], "left_semi").drop("_s")


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """node, depth: every node within ``depth`` links of the seeds, at its least depth. edges: src, dst; seeds: node. Nulls are left out. most: only so
    many nodes, those of least depth, then by name; the walk ends with the round that has them.

    Only the frontier of each round is joined with the edges, and only its new nodes go on; a round is cut off by a checkpoint. Targets are made
    distinct before the anti join, so that a node to which many link is one row."""
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    layer = cut_lineage(seeds.where("node IS NOT NULL").select("node").distinct().withColumn("depth", F.lit(0)))
    reached, n = layer, layer.count()
    for d in range(1, depth + 1):
        if most is not None and n >= most:
            break
        found = _leaving(e, layer).select(F.col("dst").alias("node")).distinct()
        layer = cut_lineage(found.join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        if layer.isEmpty():
            break
        reached, n = reached.unionByName(layer), n + layer.count()
    return reached if most is None else reached.orderBy("depth", "node").limit(most)


def discover(bodies: DataFrame, seeds: DataFrame) -> DataFrame:
    """OP-06: url of every page in the sitemaps reachable from the seeds. bodies: url, body, and status if it is known (in place of a network); seeds: url.
    Answers of 400 and above and sitemaps over ``MOST_CHARACTERS`` are left out. Ends when no sitemap is found that wasn't seen."""
    from weftline.functions.html import sitemap_entries

    good = bodies.where(F.length("body") <= MOST_CHARACTERS)
    if "status" in bodies.columns:
        good = good.where(F.coalesce("status", F.lit(200)) < 400)
    seen = cut_lineage(seeds.select("url").where("url IS NOT NULL").distinct())
    now, pages = seen, None
    while True:
        maps = good.join(now, "url").select("body", F.substring("body", 1, 200).contains("<sitemapindex").alias("is_index"))
        entries = cut_lineage(maps.select("is_index", F.explode(sitemap_entries(F.col("body"))).alias("e")).select("is_index", "e.loc"))
        found = entries.where("NOT is_index").select(F.col("loc").alias("url"))
        pages = found if pages is None else pages.unionByName(found)
        now = cut_lineage(entries.where("is_index").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti"))
        if now.isEmpty():
            break
        seen = seen.unionByName(now)
    return pages.distinct()


def discovered(sources: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """OP-07: url, source: the union of sources of urls (each with a column url), in their order of precedence, each url with its first. limit: so many of
    them, by precedence, then by url."""
    named = [df.select("url", F.lit(i).alias("_p"), F.lit(name).alias("source")) for i, (name, df) in enumerate(sources.items())]
    every = reduce(DataFrame.unionByName, named).where("url IS NOT NULL")
    first = every.groupBy("url").agg(F.min(F.struct("_p", "source")).alias("s")).select("url", "s._p", "s.source")
    return (first if limit is None else first.orderBy("_p", "url").limit(limit)).select("url", "source")
