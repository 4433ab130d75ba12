"""Videos of a page (OP-84, 127, 128): the page's own url, tags, embeds, cards, links, attributes, meta tags, structured data, scripts and styles.

Each place where a video can be named is a source that yields (type, url, format or None); what a url is follows from tables of forms. The first of each url
counts, and the result is in the order of types, then of the sources, then of the page.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.functions.dom import View

# File endings that are videos, hosts of advertising and tracking, and the order of types.
ENDINGS = ("mp4", "webm", "m3u8", "mpd", "mov", "avi")
ADVERTISING = re.compile(
    r"doubleclick\.net|googlesyndication|googleadservices|facebook\.com/tr|analytics|pixel|tracking|adserver|adform|adsystem|ad\.doubleclick"
    r"|imasdk\.googleapis|pagead|securepubads|moat\.com|outbrain|taboola|criteo|prebid|bidswitch|openx\.net|pubmatic", re.I,
)
TYPES = ("page", "direct", "embed", "og", "jsonld", "script", "other")
# Urls of players with the page of their video, by which they are known; None: the url itself.
EMBEDS = [
    (r"https?://(?:www\.)?(?:youtube\.com|youtube-nocookie\.com)/embed/([A-Za-z0-9_-]+)", "youtube", "https://www.youtube.com/watch?v={}"),
    (r"https?://player\.vimeo\.com/video/(\d+)", "vimeo", "https://vimeo.com/{}"),
    (r"https?://(?:www\.)?dailymotion\.com/embed/video/([A-Za-z0-9]+)", "dailymotion", "https://www.dailymotion.com/video/{}"),
    (r"https?://fast\.wistia\.(?:net|com)/embed/iframe/([A-Za-z0-9]+)", "wistia", "https://fast.wistia.net/embed/iframe/{}"),
    (r"https?://(?:www\.)?loom\.com/embed/([A-Za-z0-9]+)", "loom", "https://www.loom.com/share/{}"),
    (r"https?://clips\.twitch\.tv/embed\?clip=([A-Za-z0-9_-]+)", "twitch", "https://clips.twitch.tv/{}"),
    (r"https?://(?:www\.)?twitch\.tv/(?:videos|[^/]+/clip)/([A-Za-z0-9_-]+)", "twitch", "https://www.twitch.tv/videos/{}"),
    (r"https?://(?:www\.)?tiktok\.com/embed/(?:v2/)?(\d+)", "tiktok", "https://www.tiktok.com/video/{}"),
    (r"https?://(?:www\.)?facebook\.com/plugins/video", "facebook", None),
    (r"https?://play\.vidyard\.com/([A-Za-z0-9]+)", "vidyard", "https://play.vidyard.com/{}"),
    (r"https?://(?:www\.)?rumble\.com/embed/([A-Za-z0-9]+)", "rumble", "https://rumble.com/embed/{}"),
    (r"https?://(?:www\.)?bitchute\.com/embed/([A-Za-z0-9]+)", "bitchute", "https://www.bitchute.com/video/{}"),
    (r"https?://player\.bilibili\.com/player\.html\?.*?bvid=([A-Za-z0-9]+)", "bilibili", "https://www.bilibili.com/video/{}"),
    (r"https?://coub\.com/embed/([A-Za-z0-9]+)", "coub", "https://coub.com/view/{}"),
    (r"https?://open\.spotify\.com/embed/episode/([A-Za-z0-9]+)", "spotify", "https://open.spotify.com/episode/{}"),
]
# Urls of pages that are a video.
PAGES = [
    (r"https?://(?:www\.)?(?:youtube\.com/watch\?v=|youtu\.be/)([A-Za-z0-9_-]+)", "youtube", "https://www.youtube.com/watch?v={}"),
    (r"https?://(?:www\.)?vimeo\.com/(\d+)", "vimeo", "https://vimeo.com/{}"),
    (r"https?://(?:www\.)?(?:x|twitter)\.com/\w+/status/(\d+)", "twitter", None),
    (r"https?://(?:www\.)?instagram\.com/(?:reel|p)/([A-Za-z0-9_-]+)", "instagram", None),
    (r"https?://(?:www\.)?tiktok\.com/@[^/]+/video/(\d+)", "tiktok", None),
    (r"https?://(?:www\.)?facebook\.com/(?:watch/?\?v=|reel/|.*?/videos/)(\d+)", "facebook", None),
    (r"https?://fb\.watch/([A-Za-z0-9_-]+)", "facebook", None),
    (r"https?://(?:www\.)?streamable\.com/([A-Za-z0-9]+)", "streamable", None),
    (r"https?://(?:www\.)?dailymotion\.com/video/([A-Za-z0-9]+)", "dailymotion", None),
    (r"https?://(?:www\.)?twitch\.tv/videos/(\d+)", "twitch", None),
    (r"https?://clips\.twitch\.tv/([A-Za-z0-9_-]+)", "twitch", None),
    (r"https?://(?:www\.)?rumble\.com/v([A-Za-z0-9_-]+)", "rumble", None),
    (r"https?://(?:www\.)?bitchute\.com/video/([A-Za-z0-9]+)", "bitchute", None),
    (r"https?://(?:www\.)?imgur\.com/(?:a/)?([A-Za-z0-9]+)", "imgur", None),
    (r"https?://(?:www\.)?bilibili\.com/video/(BV[A-Za-z0-9]+)", "bilibili", None),
    (r"https?://(?:www\.)?linkedin\.com/(?:posts|feed/update)/([^\s?]+)", "linkedin", None),
    (r"https?://(?:www\.)?loom\.com/share/([A-Za-z0-9]+)", "loom", None),
    (r"https?://(?:www\.|old\.)?reddit\.com/r/\w+/comments/([A-Za-z0-9]+)", "reddit", None),
]
_EMBEDS, _PAGES = ([(re.compile(p), fmt, form) for p, fmt, form in table] for table in (EMBEDS, PAGES))
_IN_SCRIPT = re.compile(r"https?://[^\s\"'<>]+\.(?:mp4|webm|m3u8|mpd)(?:\?[^\s\"'<>]*)?", re.I)
_IN_STYLE = re.compile(r"url\([\"']?([^\"')\s]+\.(?:mp4|webm|m3u8|mpd))[\"']?\)", re.I)
_WISTIA = re.compile(r"fast\.wistia\.(?:com|net)/embed/medias/([A-Za-z0-9]+)")
_OWN_ATTRIBUTES = ("data-src", "data-video-url", "data-video-id")

Found = tuple[str, str, str | None]


def file_format(url: str) -> str | None:
    ending = url.lower().split("?")[0].rpartition(".")[2]
    return ending if ending in ENDINGS else None


def _known(url: str, forms: list) -> tuple[str, str] | None:
    """The url and format by which a table of forms knows a url."""
    for pattern, fmt, form in forms:
        if m := pattern.search(url):
            return (form.format(m[1]) if form else url), fmt
    return None


def _page(v: View, base: str) -> Iterator[Found]:
    if found := _known(base, _PAGES):
        yield "page", *found


def _tags(v: View, base: str) -> Iterator[Found]:
    for n in v.select("video"):
        for src in [n.attrs.get("src"), *[s.attrs.get("src") for s in v.below(n).select("source")]]:
            if src:
                yield "direct", urljoin(base, src), None


def _frames(v: View, base: str) -> Iterator[Found]:
    for n in v.select("iframe"):
        if found := _known(n.attrs.get("src", ""), _EMBEDS):
            yield "embed", *found


def _cards(v: View, base: str) -> Iterator[Found]:
    for n in v.select("meta[name^='twitter:player']"):
        content = n.attrs.get("content")
        if content and n.attrs["name"] == "twitter:player:stream":
            yield "direct", urljoin(base, content), None
        elif content and n.attrs["name"] == "twitter:player":
            yield "embed", urljoin(base, content), "twitter"


def _players(v: View, base: str) -> Iterator[Found]:
    for n in v.select("script[src]"):
        if m := _WISTIA.search(n.attrs["src"]):
            yield "embed", f"https://fast.wistia.net/embed/iframe/{m[1]}", "wistia"
    for n in v.select("video-js[data-account]"):
        if n.attrs.get("data-video-id"):
            yield "embed", f"https://players.brightcove.net/{n.attrs['data-account']}/default_default/index.html?videoId={n.attrs['data-video-id']}", "brightcove"


def _links(v: View, base: str) -> Iterator[Found]:
    for n in v.select("a[href]"):
        if file_format(n.attrs["href"]):
            yield "direct", urljoin(base, n.attrs["href"]), None


def _attributes(v: View, base: str) -> Iterator[Found]:
    for name in _OWN_ATTRIBUTES:
        for n in v.select(f"[{name}]"):
            url = urljoin(base, n.attrs[name])
            if n.attrs[name].startswith(("http", "/")) and file_format(url):
                yield "direct", url, None


def _meta(v: View, base: str) -> Iterator[Found]:
    for n in v.select("meta[property='og:video'], meta[property='og:video:url']"):
        if n.attrs.get("content"):
            yield "og", urljoin(base, n.attrs["content"]), None


def _structured(v: View, base: str) -> Iterator[Found]:
    for n in v.select("script[type='application/ld+json']"):
        try:
            data = json.loads("".join(c for c in n.children if isinstance(c, str)))
        except (ValueError, RecursionError):
            continue
        for item in data if isinstance(data, list) else [data]:
            if isinstance(item, dict) and item.get("@type") == "VideoObject":
                for key in ("contentUrl", "embedUrl"):
                    if isinstance(item.get(key), str) and item[key]:
                        yield "jsonld", urljoin(base, item[key]), None


def _scripts(v: View, base: str) -> Iterator[Found]:
    for n in v.select("script"):
        if n.attrs.get("type") != "application/ld+json":
            for m in _IN_SCRIPT.finditer("".join(c for c in n.children if isinstance(c, str))):
                yield "script", m[0], None


def _styles(v: View, base: str) -> Iterator[Found]:
    for n in v.select("[style]"):
        for m in _IN_STYLE.finditer(n.attrs["style"]):
            yield "direct", urljoin(base, m[1]), None


SOURCES: tuple[Callable[[View, str], Iterator[Found]], ...] = (_page, _tags, _frames, _cards, _players, _links, _attributes, _meta, _structured, _scripts, _styles)


def videos(v: View, base: str) -> list[dict]:
    """(type, url, format): the first of each url by the order of types, then of places. Urls of scripts, blobs, data and advertising are left out; players of
    two hosts are known by their video's page wherever they are named."""
    out: dict[str, dict] = {}
    for source in SOURCES:
        for kind, url, fmt in source(v, base):
            if kind != "page":
                if url.startswith(("blob:", "data:", "javascript:")) or ADVERTISING.search(url):
                    continue
                if found := _known(url, _EMBEDS[:2]):
                    url, fmt = found
                    kind = "embed" if fmt == "youtube" and kind != "og" else kind
            out.setdefault(url, {"type": kind, "url": url, "format": fmt or file_format(url) or "unknown"})
    return sorted(out.values(), key=lambda x: TYPES.index(x["type"]))


_SHAPE = "array<struct<type:string,url:string,format:string>>"
_ARROW = pa.list_(pa.struct([("type", pa.string()), ("url", pa.string()), ("format", pa.string())]))


def page_videos(df: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """key, videos of each page. Null pages and urls count as empty. Other columns are not read."""
    from weftline.functions.dom import parse

    def run(batches):
        for b in batches:
            found = [videos(View(parse(page or "")), base or "") for page, base in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _ARROW)], names=[key, "videos"])

    return df.select(F.col(key), F.col(html), F.col(url).alias("_url")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, videos {_SHAPE}")


def site_videos(found: DataFrame, key: str) -> DataFrame:
    """OP-128: the videos of many pages, each url once, with its first page and how many pages name it. found: from ``page_videos``."""
    rows = found.select(key, F.explode("videos").alias("v"))
    return rows.groupBy("v.url").agg(F.min(key).alias("first"), F.min_by("v.type", key).alias("type"), F.min_by("v.format", key).alias("format"), F.count(F.lit(1)).alias("pages"))
