"""Queries over documents' texts and urls (OP-11..18, 27..33, 76, 86..99, 102..112)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import text as tx
from weftline.functions import urls
from weftline.operators.skew import lookup
from weftline.session import spread, table

QUERY = "budget rate report"


def text_clean(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "crawl_results").select("result_id", "content")).select("result_id", tx.clean_content(F.col("content")).alias("content"))


def text_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", tx.content_metadata(F.col("text")).alias("m")).select("doc_id", "m.*")


def text_cut_off(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "crawl_results").select("result_id", "content")).select("result_id", tx.is_cut_off(F.col("content")).alias("cut_off"))


def text_truncated(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", tx.truncate_at_line(F.col("text"), 400).alias("text"))


def text_sections(spark: SparkSession, folder: str) -> DataFrame:
    return tx.sections(spread(table(spark, folder, "documents").where("doc_id IS NOT NULL").select("doc_id", "text")), "doc_id", "text").select("doc_id", F.col("no").alias("line_no"), "level", "title", "slug", "body")


def text_relevant(spark: SparkSession, folder: str) -> DataFrame:
    return tx.relevant_paragraphs(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text", QUERY)


def content_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """OP-76: of equal contents the first record, by md5."""
    c = table(spark, folder, "crawl_results").where("content <> ''").select("result_id", F.md5(F.encode("content", "UTF-8")).alias("hash"))
    # min is aggregated before the shuffle, unlike a row number over each hash
    return c.groupBy("hash").agg(F.min("result_id").alias("result_id"), F.count(F.lit(1)).alias("copies"))


def url_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "frontier").select("seq", urls.canonical_url_native(F.col("url")).alias("canonical"))


def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("url")
    return table(spark, folder, "frontier").select(
        "seq", urls.is_web_url(u).alias("is_web"), urls.origin_of(u).alias("origin"), urls.host_of(u).alias("host"), urls.path_of(u).alias("path"), urls.query_of(u).alias("query"),
        F.regexp_replace(F.regexp_replace(u, r"\?.*$", ""), "/+$", "").alias("main_form"),
    )


def url_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """OP-108, 16 bytes in hex, of method and url."""
    return table(spark, folder, "frontier").select("seq", F.lower(F.hex(urls.fingerprint("method", "url"))).alias("fp"))


def url_file_names(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("url")
    return table(spark, folder, "frontier").where(urls.is_web_url(u)).select("seq", tx.safe_file_name(urls.path_of(u), urls.query_of(u)).alias("file_name"))


def url_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """OP-28..30: same origin as the job's first url, not excluded, included. Seeds are found by an aggregate, a row a job, and looked up."""
    f = table(spark, folder, "frontier").where("url IS NOT NULL AND job_id IS NOT NULL").select("seq", "job_id", "url")
    seeds = f.where(urls.origin_of(F.col("url")).isNotNull()).groupBy("job_id").agg(F.min_by(urls.origin_of(F.col("url")), "seq").alias("seed"))
    u = F.col("url")
    return lookup(f, seeds, ["job_id"]).select(
        "seq", F.coalesce(urls.origin_of(u) == F.col("seed"), F.lit(False)).alias("same_origin"),
        (urls.matches_patterns(u, ["/(docs|wiki|news)/"]) & ~urls.matches_patterns(u, ["/(print|archive)/?", "[a-"])).alias("admitted"),
        urls.wanted(u, F.col("seed"), ["/(docs|wiki|news)/"], ["/(print|archive)/?"]).alias("wanted"),
    )


def job_id_valid(spark: SparkSession, folder: str) -> DataFrame:
    """OP-33"""
    return table(spark, folder, "crawl_results").select("job_id").distinct().select("job_id", F.col("job_id").rlike(r"^[A-Za-z0-9._-]{1,128}\z").alias("valid"))


def content_routes(spark: SparkSession, folder: str) -> DataFrame:
    """OP-11, 13"""
    r = table(spark, folder, "crawl_results")
    name = F.regexp_extract(urls.path_of(F.col("url")), r"([^/]*)$", 1)
    return r.groupBy("content_type", tx.route(F.col("content_type"), name).alias("route")).agg(F.count(F.lit(1)).alias("records"), F.max(tx.is_binary_type(F.col("content_type")).cast("int")).alias("is_binary"))


def content_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """OP-13: responses by the decoder that they need, JSON tried first."""
    r = table(spark, folder, "responses")
    kind = tx.route(F.lit("text/html"), F.regexp_extract(urls.path_of(F.col("url")), r"([^/]*)$", 1), F.col("text"))
    return r.select("response_id", kind.alias("route"), F.when(kind == "json", F.size(F.array_distinct(F.json_object_keys(tx.decoded(F.col("text"), kind))))).alias("keys"))


def cache_keys(spark: SparkSession, folder: str) -> DataFrame:
    """OP-14, 15: key of an answer and whether it is worth caching."""
    r = table(spark, folder, "responses")
    return r.select(
        "response_id",
        tx.cache_key(F.lit("content"), tx.sorted_json(F.create_map(F.lit("url"), "url", F.lit("format"), F.lit("html")))).alias("cache_key"),
        tx.cacheable(F.col("status_code"), F.lit("html"), F.col("text")).alias("cacheable"),
    )


_S = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


_LINE = _strip("l")
_CRUFT = ", ".join(f"'{x}'" for x in tx.CRUFT_LINES)
_U = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"
_QRY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
_NAME = rf"CASE WHEN {_QRY} <> '' THEN concat(coalesce(nullif(regexp_replace({_PATH}, '^/+|/+$', '', 'g'), ''), 'index'), '--', {_QRY}) ELSE coalesce(nullif(regexp_replace({_PATH}, '^/+|/+$', '', 'g'), ''), 'index') END"
_DEC = "url_decode(replace({x}, '+', ' '))"
_TRACK = ", ".join(f"'{x}'" for x in urls.TRACKING_KEYS)
_TEXT = " OR ".join(f"starts_with(m, '{t}')" for t in tx.TEXT_TYPES)
_TERMS = QUERY.split()


QUERIES = {
    "text_clean": text_clean, "text_metadata": text_metadata, "text_cut_off": text_cut_off, "text_truncated": text_truncated, "text_sections": text_sections, "text_relevant": text_relevant,
    "content_dedupe": content_dedupe, "url_canonical": url_canonical, "url_parts": url_parts, "url_fingerprints": url_fingerprints, "url_file_names": url_file_names, "url_patterns": url_patterns,
    "job_id_valid": job_id_valid, "content_routes": content_routes, "content_decoded": content_decoded, "cache_keys": cache_keys,
}
ORACLES = {
    "text_clean": f"""SELECT result_id, {_strip(f"regexp_replace(array_to_string(list_filter(string_split(content, chr(10)), lambda l: {_LINE} = '' OR NOT (lower({_LINE}) IN ({_CRUFT}) OR (length({_LINE}) < 80 AND regexp_matches(lower({_LINE}), '{tx.CRUFT_PATTERN}')))), chr(10)), chr(10) || '{{3,}}', chr(10) || chr(10), 'g')")} AS content FROM crawl_results""",
    "text_metadata": rf"""SELECT doc_id, nullif(regexp_extract(text, '(?m)^#{{1,2}}\s+(.+?)$', 1), '') AS title,
        substring(list_filter(list_transform(string_split(text, chr(10)), lambda l: {_LINE}), lambda l: length(l) > 20 AND NOT regexp_matches(l, '^[#\[]'))[1], 1, 200) AS description,
        length(text) AS content_length, len(regexp_extract_all(text, '[^\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+')) AS word_count,
        len(regexp_extract_all(text, '(?m)^#{{1,6}}\s+')) AS heading_count, len(regexp_extract_all(text, '\[.*?\]\(.*?\)')) AS link_count FROM documents""",
    "text_cut_off": "SELECT result_id, " + " OR ".join(f"contains(lower(right(content, 500)), '{p}')" for p in tx.CUT_OFF) + " AS cut_off FROM crawl_results",
    "text_truncated": """SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN contains(substring(text, 1, 400), chr(10)) THEN regexp_extract(substring(text, 1, 400), '(?s)^(.*)\\n', 1) ELSE substring(text, 1, 400) END AS text FROM documents""",
    "text_sections": rf"""WITH l AS (SELECT doc_id, unnest(range(len(ls)))::INT AS no, unnest(ls) AS line, ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
        v AS (SELECT *, nullif(length(regexp_extract(line, '^(#{{1,3}})\s+\S', 1)), 0) AS level FROM l),
        e AS (SELECT *, min(CASE WHEN level <= 2 THEN no END) OVER w AS e2, min(CASE WHEN level <= 3 THEN no END) OVER w AS e3 FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
        h AS (SELECT doc_id, no AS line_no, level::INT AS level, {_strip("regexp_replace(line, '^#+[ ]+|^#+" + chr(92) + "s+', '')")} AS title,
              {_strip("array_to_string(ls[no + 2 : coalesce(CASE WHEN level = 2 THEN e2 ELSE e3 END, len(ls))], chr(10))")} AS body FROM e WHERE level IN (2, 3))
        SELECT doc_id, line_no, level, title, regexp_replace(regexp_replace(lower(regexp_replace(title, '\([^)]*\)', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, body FROM h""",
    "text_relevant": rf"""WITH d AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda l: {_LINE}), lambda p: p <> '') AS ps FROM documents),
        p AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i, len(ps)::DOUBLE AS n FROM d),
        f AS (SELECT doc_id, {', '.join(f"count(*) FILTER (contains(lower(p), '{t}')) AS d{k}" for k, t in enumerate(_TERMS))} FROM p GROUP BY 1),
        w AS (SELECT *, regexp_extract_all(lower(p), '[^\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+') AS ws FROM p JOIN f USING (doc_id)),
        s AS (SELECT doc_id, p, i, CASE WHEN len(ws) < 5 THEN 0 ELSE ({' + '.join(f"len(list_filter(ws, lambda w: w = '{t}'))::DOUBLE / len(ws) * ln(n / (1 + d{k}))" for k, t in enumerate(_TERMS))})
              * CASE WHEN starts_with(p, '#') AND ({' OR '.join(f"contains(lower(p), '{t}')" for t in _TERMS)}) THEN 2 ELSE 1 END
              * CASE WHEN (length(p) - length(replace(p, '[', '')))::DOUBLE / len(ws) > 0.3 THEN 0.3 ELSE 1 END END AS s FROM w),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, i) AS k FROM s WHERE s > 0),
        b AS (SELECT doc_id, string_agg(p, chr(10) || chr(10) ORDER BY i) AS t FROM r WHERE k <= 10 GROUP BY 1)
        SELECT d.doc_id, coalesce(t, text) AS text FROM d LEFT JOIN b USING (doc_id)""",
    "content_dedupe": "SELECT md5(content) AS hash, min(result_id) AS result_id, count(*) AS copies FROM crawl_results WHERE content <> '' GROUP BY 1",
    "url_canonical": rf"""WITH a AS (SELECT seq, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS s, {_U} AS pl, {_PATH} AS pa, {_QRY} AS q FROM frontier),
        b AS (SELECT *, regexp_extract(pl, '^(.*@)', 1) AS login, lower(regexp_extract(pl, '([^@]*)$', 1)) AS rest FROM a),
        c AS (SELECT *, list_sort(list_filter(list_transform(list_filter(string_split(q, '&'), lambda p: contains(p, '=')), lambda p: {{'k': {_DEC.format(x="regexp_extract(p, '^([^=]*)=', 1)")}, 'v': {_DEC.format(x="regexp_extract(p, '^[^=]*=(.*)$', 1)")}}}), lambda p: p.v <> '' AND p.k NOT IN ({_TRACK}))) AS ps FROM b),
        d AS (SELECT *, array_to_string(list_transform(ps, lambda p: url_encode(p.k) || '=' || url_encode(p.v)), '&') AS qq,
              string_split(pa, '%') AS bits FROM c)
        SELECT seq, CASE WHEN s IN ('http', 'https') AND contains(url, '://') THEN s || '://' || login ||
            CASE WHEN s = 'http' THEN regexp_replace(rest, '(.):0*80$', '\1') ELSE regexp_replace(rest, '(.):0*443$', '\1') END ||
            array_to_string(list_concat(bits[1:1], list_transform(bits[2:], lambda x: CASE WHEN regexp_matches(x, '^[0-9A-Fa-f]{{2}}') THEN upper(substring(x, 1, 2)) || substring(x, 3) ELSE x END)), '%') ||
            CASE WHEN qq = '' THEN '' ELSE '?' || qq END END AS canonical FROM d""",
    "url_parts": rf"""SELECT seq, regexp_matches(url, '^https?://') AS is_web, nullif(regexp_extract(url, '^[^:/?#]+://[^/?#]+', 0), '') AS origin, lower(regexp_extract({_U}, '^(?:[^@]*@)*(\[[^\]]*\]|[^:@]*)', 1)) AS host,
        {_PATH} AS path, {_QRY} AS query, regexp_replace(regexp_replace(url, '\?.*$', ''), '/+$', '') AS main_form FROM frontier""",
    "url_file_names": rf"""WITH a AS (SELECT seq, regexp_replace(regexp_replace(regexp_replace({_NAME}, '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\-.]', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS x FROM frontier WHERE regexp_matches(url, '^https?://'))
        SELECT seq, coalesce(nullif(CASE WHEN length(x) > 200 THEN substring(x, 1, 190) || '--' || substring(md5(x), 1, 8) ELSE x END, ''), 'index') AS file_name FROM a""",
    "url_patterns": r"""WITH a AS (SELECT seq, job_id, url, nullif(regexp_extract(url, '^[^:/?#]+://[^/?#]+', 0), '') AS o FROM frontier WHERE url IS NOT NULL AND job_id IS NOT NULL),
        f AS (SELECT job_id, arg_min(o, seq) AS seed FROM a WHERE o IS NOT NULL GROUP BY 1)
        SELECT seq, coalesce(o = seed, false) AS same_origin, NOT regexp_matches(url, '/(print|archive)/?') AND NOT contains(url, '[a-') AND regexp_matches(url, '/(docs|wiki|news)/') AS admitted, coalesce(o = seed, false) AND NOT regexp_matches(url, '/(print|archive)/?') AND regexp_matches(url, '/(docs|wiki|news)/') AS wanted FROM a LEFT JOIN f USING (job_id)""",
    "job_id_valid": "SELECT DISTINCT job_id, regexp_matches(job_id, '^[A-Za-z0-9._-]{1,128}\\z') AS valid FROM crawl_results",
    "content_routes": rf"""WITH a AS (SELECT content_type, trim(split_part(lower(content_type), ';', 1)) AS m, regexp_extract({_PATH}, '([^/]*)$', 1) AS name FROM crawl_results),
        b AS (SELECT *, NOT ({_TEXT} OR regexp_matches(m, '\+(json|xml)$')) AND regexp_matches(m, '^(application|image|audio|video|font)/') AS bin FROM a)
        SELECT content_type, CASE WHEN bin OR regexp_matches(lower(name), '\.({'|'.join(tx.BINARY_EXTENSIONS)})$') THEN 'binary' WHEN regexp_matches(m, '(^application/(x-ndjson|json|x-jsonlines|jsonlines)|\+json)$') THEN 'json'
          WHEN regexp_matches(m, '^(text/html|application/xhtml\+xml$)') THEN 'html' ELSE 'text' END AS route, count(*) AS records, max(bin::INT) AS is_binary FROM b GROUP BY 1, 2""",
    "content_decoded": rf"""WITH a AS (SELECT response_id, text, regexp_matches(lower(regexp_extract({_PATH}, '([^/]*)$', 1)), '\.({'|'.join(tx.BINARY_EXTENSIONS)})$') AS bin FROM responses),
        b AS (SELECT *, NOT bin AND regexp_matches(text, '^\s*[\[{{]') AND json_valid(text) AS j FROM a)
        SELECT response_id, CASE WHEN j THEN 'json' WHEN bin THEN 'binary' ELSE 'html' END AS route, CASE WHEN j THEN len(list_distinct(json_keys(text)))::INT END AS keys FROM b""",
    "cache_keys": """SELECT response_id, substring(sha256('content:{"format": "html", "url": "' || url || '"}'), 1, 16) AS cache_key, coalesce(status_code, 200) = 200 AND length(coalesce(text, '')) >= 1024 AS cacheable FROM responses""",
}
