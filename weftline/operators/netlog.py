"""A log of network events joined to one row a request (OP-38, 50, 166, 167)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

DATA_TYPES = ("application/json", "application/ld+json", "application/geo+json", "application/x-ndjson", "application/xml", "text/xml", "text/csv", "application/rss+xml", "application/atom+xml")


def requests(events: DataFrame) -> DataFrame:
    """events: request_id, kind (sent, answered, finished), at, url, method, status, mime, size. One aggregation instead of two joins of the table with
    itself; requests that were never answered keep nulls. Rows without request_id are left out; of repeated events the latest holds."""
    of = lambda kind, c: F.max_by(c, F.when(F.col("kind") == kind, F.col("at")))
    return (
        events.where("request_id IS NOT NULL")
        .groupBy("request_id")
        .agg(
            F.max(F.when(F.col("kind") == "sent", F.col("at"))).alias("sent_at"), of("sent", "url").alias("url"), of("sent", "method").alias("method"),
            of("answered", "status").alias("status"), of("answered", "mime").alias("mime"), F.max(F.when(F.col("kind") == "finished", F.col("at"))).alias("finished_at"), of("finished", "size").alias("size"),
        )
        .where("sent_at IS NOT NULL")
        .withColumn("elapsed", F.col("finished_at") - F.col("sent_at"))
    )


def data_sources(reqs: DataFrame, origin: str, least: int = 1024) -> DataFrame:
    """OP-38: the structured-data answers of one origin, the first of each url."""
    mime = F.lower(F.coalesce("mime", F.lit("")))
    kind = F.lit(False)
    for t in DATA_TYPES:
        kind = kind | mime.startswith(t)
    ok = kind & (F.col("size").isNull() | (F.col("size") >= least)) & F.col("url").startswith(origin + "/")
    return reqs.where(ok).groupBy("url").agg(F.min_by("request_id", F.struct("sent_at", "request_id")).alias("request_id"))


def har(reqs: DataFrame) -> DataFrame:
    """OP-167: each request as an entry of an HTTP archive."""
    entry = F.struct(
        F.struct("method", "url").alias("request"),
        F.struct("status", F.struct(F.col("mime").alias("mimeType"), F.col("size")).alias("content")).alias("response"),
        F.col("elapsed").alias("time"),
    )
    return reqs.select("request_id", F.to_json(entry).alias("entry"))


def main_headers(answers: DataFrame, session: str, wanted: str) -> DataFrame:
    """OP-166: session, headers: of each session's answers (url, at, headers) the first whose url is the wanted one, query and closing slashes aside, else the
    last. wanted: a column with the url that was asked for. One aggregation."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"\?.*$", ""), "/+$", "")
    fits = F.coalesce(plain(F.col("url")) == plain(F.col(wanted)), F.lit(False))
    return answers.groupBy(session).agg(F.coalesce(F.min_by("headers", F.when(fits, F.col("at"))), F.max_by("headers", "at")).alias("headers"))
