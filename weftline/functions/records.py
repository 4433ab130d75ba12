"""Functions over records around a page: headers, cookies, names, rules, answers kept (OP-12, 20, 24, 27, 35, 37, 39, 40, 51, 52, 70, 86, 92, 99, 103, 105, 106, 113, 147, 156, 159, 160, 168)."""

from __future__ import annotations

import fnmatch
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions.text import last_of_keys
from weftline.functions.urls import host_of


def conditional_headers(etag: Column, last_modified: Column) -> Column:
    """OP-35: the headers that ask only for what is new; empty where nothing is known."""
    entries = F.map_from_arrays(F.array(F.lit("If-None-Match"), F.lit("If-Modified-Since")), F.array(etag, last_modified))
    return F.map_filter(entries, lambda k, v: v.isNotNull() & (v != ""))


def header_map(text: Column) -> Column:
    """OP-103: headers from a JSON object or from "Name: value" lines; lines without a colon are left out, of a repeated name the last holds."""
    from_json = F.from_json(text, "map<string,string>")
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)).alias("value")))
    return F.when(F.trim(text).startswith("{"), from_json).otherwise(last_of_keys(pairs))


def basic_auth(user: Column, password: Column) -> Column:
    return F.concat(F.lit("Basic "), F.base64(F.encode(F.concat(user, F.lit(":"), password), "UTF-8")))


def glob_match(url: Column, glob: str) -> Column:
    """OP-39: a shell pattern against a url or its last part."""
    form = fnmatch.translate(glob).replace(r"\Z", "$").replace(r"\z", "$")
    base = F.regexp_extract(url, r"([^/?#]*)(?:[?#].*)?$", 1)
    return url.rlike(f"^(?:{form})") | base.rlike(f"^(?:{form})")


def captured(url: Column, mime: Column, size: Column, glob: str | None = None, mime_part: str | None = None, most: int = 50 * 1024 * 1024) -> Column:
    """OP-39: whether a body is wanted: its url or last part fits the pattern, its type holds the text, and it isn't too large; what isn't given allows all."""
    ok = F.coalesce(size, F.lit(0)) <= most
    if glob:
        ok = ok & F.coalesce(glob_match(url, glob), F.lit(False))
    return ok & F.coalesce(F.lower(mime).contains(mime_part.lower()), F.lit(False)) if mime_part else ok


def disposition_name(header: Column) -> Column:
    """OP-12: the file name of a content-disposition header, decoded; null if it has none."""
    raw = F.regexp_extract(header, r"(?i)filename\*?=['\"]?(?:UTF-8'')?([^'\";\s]+)", 1)
    return F.nullif(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), F.lit(""))


def url_name(url: Column) -> Column:
    """OP-12: the last part of a url's path, decoded, if it has a dot; else "download"."""
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(last.contains("."), F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)).otherwise("download")


def binary_name(name: Column) -> Column:
    """OP-12: whether a file name ends like a file that is no text."""
    from weftline.functions.text import BINARY_EXTENSIONS

    return F.coalesce(F.lower(name).rlike(r"\.(" + "|".join(BINARY_EXTENSIONS) + ")$"), F.lit(False))


def cookie_header(cookies: Column, host: Column) -> Column:
    """OP-37: the cookie header for a host: of an array of (name, value, domain) those whose domain fits."""
    from weftline.sources.files import domain_matches

    return F.array_join(F.transform(F.filter(cookies, lambda c: domain_matches(c["domain"], host)), lambda c: F.concat(c["name"], F.lit("="), c["value"])), "; ")


# Where flat arguments of a rendering request go in its body.
BODY_PLACES = {
    "wait_until": ("gotoOptions", "waitUntil"), "timeout": ("gotoOptions", "timeout"), "wait_for": ("waitForSelector", "selector"), "user_agent": ("userAgent",), "cookies": ("cookies",), "authenticate": ("authenticate",),
    "extra_headers": ("setExtraHTTPHeaders",), "reject_resources": ("rejectResourceTypes",), "full_page": ("screenshotOptions", "fullPage"), "quality": ("screenshotOptions", "quality"), "image_type": ("screenshotOptions", "type"),
    "omit_background": ("screenshotOptions", "omitBackground"), "max_depth": ("depth",),
}


def request_body(arguments: Mapping[str, Column]) -> Column:
    """OP-24: flat arguments as the JSON of a nested body; a format becomes a list of formats, unknown names stay as they are, null ones are left out."""
    flat: dict[str, Column] = {}
    nested: dict[str, list[Column]] = {}
    for name, value in arguments.items():
        if name == "format":
            flat["formats"] = F.when(value.isNotNull(), F.array(value))
            continue
        place = BODY_PLACES.get(name, (name,))
        if len(place) == 1:
            flat[place[0]] = value
        else:
            nested.setdefault(place[0], []).append(value.alias(place[1]))
    for name, fields in nested.items():
        given = reduce(lambda a, b: a | b, [f.isNotNull() for f in fields])
        flat[name] = F.when(given, F.struct(*fields))
    return F.to_json(F.struct(*[c.alias(n) for n, c in flat.items()]))


def projected(df: DataFrame, fields: str) -> DataFrame:
    """OP-27: the columns that a comma list names; names that aren't there are left out, as long as one is."""
    wanted = [f.strip() for f in fields.split(",") if f.strip() in df.columns]
    if not wanted:
        raise ValueError(f"no column of {fields!r}")
    return df.select(*wanted)


def schema_part(json_ld: Column, opengraph: Column, twitter: Column, kind: str) -> Column:
    """OP-40: one kind of structured data, or all."""
    parts = {"ld-json": json_ld.alias("ld_json"), "opengraph": opengraph.alias("opengraph"), "twitter": twitter.alias("twitter_card")}
    if kind == "all":
        return F.struct(*parts.values())
    if kind not in parts:
        raise ValueError(f"kind {kind!r}")
    return F.struct(parts[kind])


def within_characters(texts: Column, most: int) -> Column:
    """OP-86: an array of texts cut so that all together have at most so many characters: each at the last line end within what is left."""
    def cut(t: Column, left: Column) -> Column:
        head = F.substring(t, F.lit(1), left)
        return F.when(F.length(t) <= left, t).when(head.contains("\n"), F.regexp_extract(head, r"(?s)^(.*)\n", 1)).otherwise(head)

    zero = F.struct(F.lit(most).alias("left"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, t: Column) -> Column:
        piece = F.transform(F.array(F.when(acc["left"] > 0, cut(F.coalesce(t, F.lit("")), acc["left"])).otherwise("")), lambda x: F.struct((acc["left"] - F.length(x)).alias("left"), F.concat(acc["kept"], F.array(x)).alias("kept")))
        return piece[0]

    return F.aggregate(texts, zero, step)["kept"]


# What a recipe and its steps may hold.
RECIPE_KEYS = ("version", "goto", "browser", "headed", "steps", "stealth", "viewport", "user_agent", "timeout")
STEP_KEYS = ("click", "fill", "press", "wait", "wait_for", "eval", "capture", "screenshot", "get_content", "for_each", "capture_download")


def recipe_problems(text: Column) -> Column:
    """OP-92, 105: what is wrong with a recipe in JSON, as an array: unknown or missing keys, another version than 1, no http(s) page, steps of none or several
    kinds or of an unknown one. Null and what is no JSON object: "no mapping"."""
    v = F.try_parse_json(text)
    keys = F.json_object_keys(text)
    version, goto, steps = (F.try_variant_get(v, f"$.{k}", "string") for k in ("version", "goto", "steps"))
    each = F.coalesce(F.from_json(steps, "array<string>"), F.array().cast("array<string>"))
    unknown = F.array_except(keys, F.array(*[F.lit(k) for k in RECIPE_KEYS]))
    of_step = lambda s, i: F.when(F.coalesce(F.size(F.json_object_keys(s)), F.lit(-1)) != 1, F.concat(F.lit("step "), i.cast("string"), F.lit(": one kind"))).when(
        ~F.json_object_keys(s)[0].isin(*STEP_KEYS), F.concat(F.lit("step "), i.cast("string"), F.lit(": unknown "), F.json_object_keys(s)[0])
    )
    found = F.concat(
        F.transform(unknown, lambda k: F.concat(F.lit("unknown "), k)),
        F.array(
            F.when(~F.array_contains(keys, "goto"), "missing goto"),
            F.when(F.array_contains(keys, "version") & ~F.coalesce(version == "1", F.lit(False)), "version"),
            F.when(F.array_contains(keys, "goto") & ~F.coalesce(goto.rlike("^https?://"), F.lit(False)), "goto"),
            F.when(steps.isNotNull() & ~steps.startswith("["), "steps"),
        ),
        F.transform(each, of_step),
    )
    return F.when(keys.isNull(), F.array(F.lit("no mapping"))).otherwise(F.filter(found, lambda x: x.isNotNull()))


def short_id(path: Column) -> Column:
    """OP-106: sixteen hex digits that name a recipe's journal."""
    return F.substring(F.sha2(path, 256), 1, 16)


# Cookies of walls against machines, by name and by how it begins, and the seconds before its end from which on one counts as ending.
WALL_COOKIES = {"_abck": "akamai", "bm_sz": "akamai", "bm_mi": "akamai", "bm_sv": "akamai", "bm_so": "akamai", "bm_lso": "akamai", "ak_bmsc": "akamai", "__cf_bm": "cloudflare", "cf_clearance": "cloudflare", "__cfruid": "cloudflare", "datadome": "datadome"}
WALL_PREFIXES = (("visid_incap_", "imperva"), ("incap_ses_", "imperva"), ("nlbi_", "imperva"), ("cf_chl_", "cloudflare"), ("_px", "perimeterx"))
ENDING_SECONDS = 300.0


def wall_vendor(name: Column) -> Column:
    """OP-159: whose cookie it is; null for an ordinary one."""
    out = F.lit(None).cast("string")
    for prefix, vendor in reversed(WALL_PREFIXES):
        out = F.when(name.startswith(prefix), vendor).otherwise(out)
    for exact, vendor in WALL_COOKIES.items():
        out = F.when(name == exact, vendor).otherwise(out)
    return out


def jar_state(cookies: Column, now: Column) -> Column:
    """OP-70, 159: struct(verdict, shells, vendors) of an array of cookies (name, expires): "empty" without any, "expired" if a wall's cookie has ended, "stale" if one ends
    soon or with the session, else "fresh". Ordinary cookies don't count."""
    each = F.transform(cookies, lambda c: F.struct(wall_vendor(c["name"]).alias("vendor"), F.when(c["expires"] > 0, c["expires"] - now).alias("left")))
    told = F.coalesce(each, F.array().cast("array<struct<vendor:string,left:double>>"))
    of = F.filter(told, lambda c: c["vendor"].isNotNull())
    verdict = (
        F.when(F.size(told) == 0, "empty")
        .when(F.exists(of, lambda c: F.coalesce(c["left"] <= 0, F.lit(False))), "expired")
        .when(F.exists(of, lambda c: c["left"].isNull() | (c["left"] <= ENDING_SECONDS)), "stale")
        .otherwise("fresh")
    )
    return F.struct(verdict.alias("verdict"), F.size(of).alias("shells"), F.array_distinct(F.transform(of, lambda c: c["vendor"])).alias("vendors"))


# For how long it is believed that a site offers Markdown, that it doesn't, and of how many sites this is kept.
OFFERS_SECONDS, OFFERS_NOT_SECONDS, OFFERS_KEPT = 7 * 86400.0, 24 * 3600.0, 500


def offers_markdown(checks: DataFrame, now: float) -> DataFrame:
    """OP-160: domain, offers of the newest kept domains; null: too old to know. checks: domain, offers, checked_at; the latest of a domain holds."""
    latest = checks.where("domain IS NOT NULL").groupBy("domain").agg(F.max_by("offers", "checked_at").alias("offers"), F.max("checked_at").alias("checked_at"))
    newest = latest.orderBy(F.desc("checked_at"), "domain").limit(OFFERS_KEPT)
    known = now - F.col("checked_at") <= F.when(F.col("offers"), OFFERS_SECONDS).otherwise(OFFERS_NOT_SECONDS)
    return newest.select("domain", F.when(known, F.col("offers")).alias("offers"))


def envelope(data: Column, **meta: Column) -> Column:
    """OP-16, 168: a result and what is told of it, as JSON."""
    return F.to_json(F.struct(data.alias("data"), F.struct(*[c.alias(k) for k, c in meta.items()]).alias("meta")))


def body_names(df: DataFrame, key: str, url: str) -> DataFrame:
    """OP-113: a file name a row: the url's last part, with a short hash of the url where others have the same."""
    base = F.coalesce(F.nullif(F.regexp_extract(F.col(url), r"([^/?#]+)(?:[?#].*)?$", 1), F.lit("")), F.lit("index"))
    named = df.select(key, url, base.alias("_base"))
    taken = named.groupBy("_base").agg(F.count(F.lit(1)).alias("_n"))
    out = named.join(taken, "_base")
    return out.select(key, F.when(F.col("_n") > 1, F.concat("_base", F.lit("-"), F.substring(F.sha2(F.col(url), 256), 1, 8))).otherwise(F.col("_base")).alias("name"))


def with_rules(df: DataFrame, url: str, rules: DataFrame, own: DataFrame) -> DataFrame:
    """OP-20, 51: df with the headers of its host's rule, the user's rules replacing the built-in ones a host. rules, own: domain, headers (small, checked by their loader)."""
    every = own.unionByName(rules.join(own.select("domain"), "domain", "left_anti")).dropDuplicates(["domain"])
    r = every.select(F.lower("domain").alias("_d"), F.col("headers").alias("rule_headers"))
    return df.withColumn("_h", host_of(F.col(url))).join(r, F.col("_h") == F.col("_d"), "left").drop("_h", "_d")


def fresh_answers(wanted: DataFrame, kept: DataFrame, key: str, now: float, ttl: float = 3600.0) -> DataFrame:
    """OP-52: wanted rows with the latest answer kept under their key, if not older than ttl seconds. kept: key, cached_at, answer."""
    latest = kept.where(F.col("cached_at") >= now - ttl).groupBy(key).agg(F.max_by("answer", "cached_at").alias("answer"))
    return wanted.join(latest, key, "left")


def resolve_topic(queries: DataFrame, topics: DataFrame) -> DataFrame:
    """OP-99: query, slug: an exact name, else the only one that begins so, else the only one that contains it. topics: slug, few and fixed."""
    t = topics.agg(F.sort_array(F.collect_set("slug")).alias("_all"))
    q = queries.crossJoin(F.broadcast(t))  # one row
    low = F.lower(F.trim("query"))
    begins = F.filter("_all", lambda s: s.startswith(low))
    inside = F.filter("_all", lambda s: s.contains(low))
    return q.select("query", F.when(F.array_contains("_all", low), low).when(F.size(begins) == 1, begins[0]).when((F.size(begins) == 0) & (F.size(inside) == 1), inside[0]).alias("slug"))


def sanitised_values(values: Column) -> Column:
    """OP-147: each string of a map without hidden signs and injected lines."""
    from weftline.functions.safety import hidden_signs, injection_lines

    return F.transform_values(values, lambda k, v: injection_lines(hidden_signs(F.coalesce(v, F.lit("")))["text"])["text"])


# Classes of a subscription wall.
WALL_CLASSES = "paywall|subscriber-only|premium-content|metered-content|piano-offer|regwall|locked-content|gated-content"
WALL_CLASS = rf"(?i)<(?!(?:script|style|meta)\b)[a-z][^<>]*\sclass\s*=\s*[\"'][^\"']*(?:{WALL_CLASSES})"


def asks_payment(html: Column) -> Column:
    """OP-156: says so in its structured data or by a class, or ends in a phrase that does."""
    from weftline.functions.text import CUT_OFF

    tail = F.lower(F.right(F.regexp_replace(html, r"(?s)<script.*?</script>|<[^>]+>", " "), F.lit(1000)))
    said = F.lit(False)
    for p in CUT_OFF:
        said = said | tail.contains(p)
    return html.rlike(r'(?i)"isAccessibleForFree"\s*:\s*"?false') | html.rlike(WALL_CLASS) | said


def pages_map(links: DataFrame, key: str, url: str, link: str, limit: int, subdomains: bool = False) -> DataFrame:
    """OP-186: of each page (key) its first links inside the site of its url, each once; with subdomains those below the site's host too. links: key, url,
    pos, link. A page's links are one window."""
    here, there = host_of(F.col(url)), host_of(F.col(link))
    inside = (here == there) | there.endswith(F.concat(F.lit("."), here)) if subdomains else here == there
    first = links.where(inside).groupBy(key, link).agg(F.min("pos").alias("pos"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("place") <= limit)
