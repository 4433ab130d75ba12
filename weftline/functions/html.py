"""What can be read from HTML by patterns alone, inside Catalyst: links, images, metadata, structured data, icons, scripts, comments, sitemaps, feeds.

Patterns see the raw page, so that a tag inside a comment or script counts too; ``dom`` has the functions that need a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weftline.functions.text import first_of, last_of_keys, strip
from weftline.functions.urls import is_web_url, origin_of

_SPACE_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescape_basic(text: Column) -> Column:
    """The five entities that markup needs."""
    for a, b in _SPACE_ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def tags(html: Column, name: str) -> Column:
    """The start tags of a name, whole."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b[^>]*>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a start tag, entities resolved; null if it has none."""
    double = F.regexp_extract(tag, rf'(?i)\s{name}\s*=\s*"([^"]*)"', 1)
    single = F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*'([^']*)'", 1)
    bare = F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*([^\s\"'>]+)", 1)
    return unescape_basic(F.coalesce(*[F.nullif(x, F.lit("")) for x in (double, single, bare)]))


def resolve(base: Column, link: Column) -> Column:
    """OP-111 for whole urls, //place, /path, ?query and #fragment; others (bare relative ones) give null and need ``urls.join_url``."""
    origin = origin_of(base)
    scheme = F.regexp_extract(base, r"^([^:/?#]+):", 1)
    plain = F.regexp_replace(base, r"#.*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(F.regexp_replace(plain, r"\?.*$", ""), link))
        .when(link.startswith("#"), F.concat(plain, link))
    )


def links(html: Column, base: Column) -> Column:
    """OP-123: absolute http(s) urls of all anchors in order, repeats kept."""
    hrefs = F.transform(tags(html, "a"), lambda t: strip(attribute(t, "href")))
    wanted = F.filter(hrefs, lambda h: h.isNotNull() & (h != "") & ~h.rlike(r"^(#|(?i:javascript:|mailto:))"))
    return F.filter(F.transform(wanted, lambda h: resolve(base, h)), is_web_url)


def title(html: Column) -> Column:
    return F.nullif(strip(unescape_basic(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


def language(html: Column) -> Column:
    return attribute(F.regexp_extract(html, r"(?i)<html\b[^>]*>", 0), "lang")


def comments(html: Column) -> Column:
    """OP-134"""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<!--(.*?)-->"), F.lit(1)), strip)


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def images(html: Column, base: Column) -> Column:
    """OP-119: array of (url, alt, width, height), first of each url: img (src, else data-src), source (first of srcset), og:image."""
    shape = lambda u, alt, w, h: F.struct(resolve(base, strip(u)).alias("url"), alt.alias("alt"), w.alias("width"), h.alias("height"))
    null = F.lit(None).cast("string")
    img = F.transform(tags(html, "img"), lambda t: shape(F.coalesce(attribute(t, "src"), attribute(t, "data-src")), F.coalesce(attribute(t, "alt"), F.lit("")), attribute(t, "width"), attribute(t, "height")))
    source = F.transform(tags(html, "source"), lambda t: shape(F.split(F.split(attribute(t, "srcset"), ",")[0], " ")[0], F.lit(""), null, null))
    og = F.transform(F.filter(tags(html, "meta"), lambda t: attribute(t, "property") == "og:image"), lambda t: shape(attribute(t, "content"), F.lit(""), null, null))
    found = F.filter(F.concat(img, source, og), lambda x: x["url"].isNotNull())
    return first_of(found, lambda x: x["url"])


def meta_map(html: Column, attribute_name: str, prefix: str) -> Column:
    """OP-120: the meta tags whose name begins so, without the prefix; empty contents left out, of a repeated name the last holds."""
    entries = F.transform(tags(html, "meta"), lambda t: F.struct(attribute(t, attribute_name).alias("key"), attribute(t, "content").alias("value")))
    kept = F.filter(entries, lambda e: e["key"].startswith(prefix) & (F.coalesce(e["value"], F.lit("")) != ""))
    cut = F.transform(kept, lambda e: F.struct(F.substring(e["key"], len(prefix) + 1, 1 << 30).alias("key"), e["value"].alias("value")))
    return last_of_keys(cut)


def json_ld(html: Column) -> Column:
    """OP-120: the texts of all ld+json scripts that are JSON."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"), F.lit(1))
    return F.filter(F.transform(found, strip), lambda x: F.try_parse_json(x).isNotNull())


def script_sources(html: Column) -> Column:
    """OP-126"""
    return F.filter(F.transform(tags(html, "script"), lambda t: attribute(t, "src")), lambda x: x.isNotNull())


def icons(html: Column, base: Column) -> Column:
    """OP-124: array of (size, apple, url), largest first, in the page's order among equals; the site's /favicon.ico if there is none."""
    rel = F.filter(tags(html, "link"), lambda t: F.lower(attribute(t, "rel")).isin("icon", "shortcut icon", "apple-touch-icon", "apple-touch-icon-precomposed"))
    each = F.transform(
        rel,
        lambda t, i: F.struct(
            (-F.coalesce(F.regexp_extract(attribute(t, "sizes"), r"^(\d+)", 1).try_cast("int"), F.lit(0))).alias("order"),
            (~F.lower(attribute(t, "rel")).contains("apple")).alias("plain"),
            i.alias("i"),
            resolve(base, attribute(t, "href")).alias("url"),
        ),
    )
    found = F.filter(F.array_sort(each), lambda x: x["url"].isNotNull())
    shaped = F.transform(found, lambda x: F.struct((-x["order"]).alias("size"), (~x["plain"]).alias("apple"), x["url"].alias("url")))
    return F.when(F.size(shaped) > 0, shaped).otherwise(F.array(F.struct(F.lit(0).alias("size"), F.lit(False).alias("apple"), F.concat(origin_of(base), F.lit("/favicon.ico")).alias("url"))))


# What a link to a machine-readable description of an interface looks like, and where it usually is.
SPEC_LINK = r"(?i)(swagger\.json|openapi\.json|openapi\.ya?ml|api-docs|swagger/.*\.json|openapi/.*\.(json|ya?ml))"
SPEC_PATHS = ("/swagger/v1/swagger.json", "/swagger.json", "/openapi.json", "/openapi.yaml", "/api-docs", "/v2/api-docs", "/v3/api-docs", "/api/swagger.json", "/api/openapi.json", "/_api/swagger.json")


def spec_links(html: Column, base: Column) -> Column:
    """OP-129: array of (url, source, format, confidence), first of each url: links, urls in scripts (one, or a list of them), api links of the head, links
    whose text speaks of one."""
    fmt = lambda u: F.when(u.rlike(r"(?i)\.ya?ml$"), "yaml").otherwise("json")
    shape = lambda u, s, c: F.struct(resolve(base, u).alias("url"), F.lit(s).alias("source"), fmt(u).alias("format"), F.lit(c).alias("confidence"))
    anchors = F.transform(tags(html, "a"), lambda t: attribute(t, "href"))
    a = F.transform(F.filter(anchors, lambda h: h.rlike(SPEC_LINK)), lambda h: shape(h, "link", 0.9))
    one = F.regexp_extract_all(html, F.lit(r"(?i)\burl\s*:\s*[\"']([^\"']+)[\"']"), F.lit(1))
    like = lambda u: u.rlike(r"(?i)(swagger|openapi|api-docs)|\.(json|ya?ml)$")
    s = F.transform(F.filter(one, like), lambda u: shape(u, "script", 0.95))
    lists = F.regexp_extract_all(html, F.lit(r"(?is)\burls\s*:\s*\[(.*?)\]"), F.lit(1))
    many = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(r"(?i)\burl[\"']?\s*:\s*[\"']([^\"']+)[\"']"), F.lit(1))))
    m = F.transform(many, lambda u: shape(u, "script", 0.9))
    rel = F.transform(F.filter(tags(html, "link"), lambda t: F.lower(attribute(t, "rel")).contains("api")), lambda t: shape(attribute(t, "href"), "rel", 0.85))
    named = F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*>)[^<]*(?:swagger|openapi|api (?:docs|spec|definition))[^<]*</a>"), F.lit(1))
    n = F.transform(F.filter(F.transform(named, lambda t: attribute(t, "href")), lambda h: h.isNotNull()), lambda h: shape(h, "text", 0.7))
    found = F.filter(F.concat(a, m, s, rel, n), lambda x: x["url"].isNotNull())
    return first_of(found, lambda x: x["url"])


def spec_candidates(origin: Column) -> Column:
    """OP-130: where a site's description would be."""
    return F.transform(F.array(*[F.lit(p) for p in SPEC_PATHS]), lambda p: F.concat(origin, p))


_VERBS = "get|post|put|delete|patch|head|options"


def spec_valid(body: Column) -> Column:
    """OP-131: valid, version, title, and the number of operations, of JSON or of YAML in block form (a key a line)."""
    v = F.try_parse_json(body)
    in_json = F.coalesce(F.try_variant_get(v, "$.openapi", "string"), F.try_variant_get(v, "$.swagger", "string"))
    paths = F.from_json(F.try_variant_get(v, "$.paths", "string"), "map<string,map<string,string>>")
    verbs = F.flatten(F.transform(F.map_values(paths), lambda m: F.filter(F.map_keys(m), lambda k: F.lower(k).rlike(f"^(?:{_VERBS})$"))))
    bare = lambda x: F.nullif(F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""), F.lit(""))
    is_json = v.isNotNull()
    in_yaml = bare(F.regexp_extract(body, r"(?m)^(?:openapi|swagger):[ \t]*(\S+)[ \t]*$", 1))
    title = bare(F.regexp_extract(body, r"(?m)^info:[ \t]*\n(?:[ \t]+.*\n)*?[ \t]+title:[ \t]*(.+)$", 1))
    of_paths = F.regexp_extract(body, r"(?s)(?:^|\n)paths:[ \t]*\n((?:[ \t#][^\n]*(?:\n|$)|\n)*)", 1)
    version = F.when(is_json, in_json).otherwise(in_yaml)
    n = F.when(is_json, F.greatest(F.size(verbs), F.lit(0))).when(in_yaml.isNotNull(), F.regexp_count(of_paths, F.lit(rf"(?im)^[ \t]+(?:{_VERBS}):"))).otherwise(0)
    named = F.when(is_json, F.try_variant_get(v, "$.info.title", "string")).when(in_yaml.isNotNull(), title)
    return F.struct(version.isNotNull().alias("valid"), version.alias("version"), named.alias("title"), n.alias("endpoint_count"))


def loc_urls(xml: Column) -> Column:
    """OP-08: array of (url, is_sitemap) of all http(s) locs of a sitemap or feed, however it is wrapped."""
    found = F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc\b[^>]*>(.*?)</loc>"), F.lit(1)), lambda x: strip(unescape_basic(x)))
    return F.transform(F.filter(found, lambda u: u.startswith("http")), lambda u: F.struct(u.alias("url"), (u.endswith(".xml") | F.lower(u).contains("sitemap")).alias("is_sitemap")))


def sitemap_entries(xml: Column) -> Column:
    """OP-04: array of (loc, lastmod); only where there are none, the locs of other sitemaps."""
    loc = lambda b: strip(unescape_basic(F.regexp_extract(b, r"(?is)<loc>\s*(.*?)\s*</loc>", 1)))
    mod = lambda b: F.nullif(strip(F.regexp_extract(b, r"(?is)<lastmod>\s*(.*?)\s*</lastmod>", 1)), F.lit(""))
    read = lambda tag: F.filter(
        F.transform(F.regexp_extract_all(xml, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)), lambda b: F.struct(loc(b).alias("loc"), mod(b).alias("lastmod"))), lambda e: e["loc"] != ""
    )
    pages = read("url")
    return F.when(F.size(pages) > 0, pages).otherwise(read("sitemap"))


def robots_sitemaps(body: Column) -> Column:
    """OP-05"""
    return F.regexp_extract_all(body, F.lit(r"(?imd)^[ \t]*Sitemap:[ \t]*(\S+)\s*$"), F.lit(1))


# Where a site's feeds usually are.
FEED_PATHS = ("/feed", "/rss", "/atom.xml", "/feed.xml", "/rss.xml", "/feed/", "/rss/", "/index.xml")


def feed_candidates(html: Column, base: Column) -> Column:
    """OP-09: urls of a page's feeds, those it names first, then the usual ones, each once."""
    named = F.transform(F.filter(tags(html, "link"), lambda t: F.lower(attribute(t, "type")).rlike("rss|atom")), lambda t: resolve(base, attribute(t, "href")))
    usual = F.transform(F.array(*[F.lit(p) for p in FEED_PATHS]), lambda p: F.concat(origin_of(base), p))
    return F.array_distinct(F.concat(F.filter(named, lambda u: u.isNotNull()), usual))


def feed_links(xml: Column) -> Column:
    """OP-09: http links of the items of an RSS feed, also where the link's tag was closed at once and its url stands behind it, and of the entries of an Atom feed."""
    items = F.regexp_extract_all(xml, F.lit(r"(?is)<item\b(.*?)</item>"), F.lit(1))
    rss = F.transform(items, lambda x: strip(unescape_basic(F.coalesce(F.nullif(strip(F.regexp_extract(x, r"(?is)<link\b[^>]*[^/>]?>([^<]*)</link>", 1)), F.lit("")), F.regexp_extract(x, r"(?is)<link\b[^>]*/?>\s*([^<\s]*)", 1)))))
    entries = F.regexp_extract_all(xml, F.lit(r"(?is)<entry\b(.*?)</entry>"), F.lit(1))
    atom = F.flatten(F.transform(entries, lambda x: F.transform(tags(x, "link"), lambda t: attribute(t, "href"))))
    return F.filter(F.concat(rss, atom), lambda u: u.startswith("http"))
