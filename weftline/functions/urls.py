"""URL functions: canonical form, fingerprint, host, origin, joining.

Every function has a plain Python form (``py_...``); those that Catalyst can express also have a Column form.
Null urls give null; urls that are not http(s), or that cannot be split, give null as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import parse_qsl, quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

# Schemes that have a canonical form, their default ports, and the query keys that only track visits.
SCHEMES = ("http", "https")
DEFAULT_PORT = {"http": "80", "https": "443"}
TRACKING_KEYS = (
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "utm_id",
    "utm_name",
    "gclid",
    "fbclid",
    "mc_eid",
    "_ga",
    "ref",
    "source",
    "igshid",
    "mkt_tok",
    "_hsenc",
    "_hsmi",
)

_HEX = frozenset("0123456789abcdefABCDEF")


def _raise_escapes(text: str) -> str:
    """Upper-case the hex digits of each %hh."""
    if "%" not in text:
        return text
    head, *rest = text.split("%")
    return head + "".join("%" + (r[:2].upper() + r[2:] if len(r) > 1 and r[0] in _HEX and r[1] in _HEX else r) for r in rest)


def _ascii_host(name: str) -> str:
    if name.isascii():
        # the IDNA codec also refuses empty and overlong labels; those names stay as they are, as would its failure
        return name.lower()
    try:
        return name.encode("idna").decode("ascii").lower()
    except UnicodeError:
        return name.lower()


def _network_place(netloc: str, scheme: str) -> str:
    login, at, place = netloc.rpartition("@")
    if place.startswith("["):
        close = place.find("]")
        if close < 0:
            return (login + at + place).lower()
        name, port = place[: close + 1].lower(), place[close + 1 :]
    else:
        name, colon, number = place.partition(":")
        name, port = _ascii_host(name), colon + number
    if port[1:].isdigit() and name and str(int(port[1:])) == DEFAULT_PORT[scheme]:
        port = ""
    return login + at + name + port


def py_canonical_url(url: str | None) -> str | None:
    """One spelling for all urls that lead to the same page, or None.

    Lower-case scheme and host (IDNA for other scripts), no default port, no fragment, query without tracking keys and empty values,
    sorted by key and value and escaped in one way, %hh in upper case. The path is kept, also if empty.
    """
    if url is None:
        return None
    try:
        parts = urlsplit(url)
        scheme = parts.scheme.lower()
        if scheme not in SCHEMES:
            return None
        pairs = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if v and k not in TRACKING_KEYS)
        query = "&".join(f"{quote(k, safe='')}={quote(v, safe='')}" for k, v in pairs)
        return urlunsplit((scheme, _network_place(parts.netloc, scheme), _raise_escapes(parts.path), query, ""))
    except ValueError:
        return None


_NO_BODY = hashlib.blake2b(b"", digest_size=16).digest()


def py_fingerprint(method: str | None, url: str | None, body: bytes | None = None) -> bytes | None:
    """16 bytes that name a request; None without a canonical url. A null method counts as GET."""
    canonical = py_canonical_url(url)
    if canonical is None:
        return None
    inner = hashlib.blake2b(body, digest_size=16).digest() if body else _NO_BODY
    try:
        return hashlib.blake2b(b"\0".join(((method or "GET").upper().encode(), canonical.encode(), inner)), digest_size=16).digest()
    except UnicodeEncodeError:
        return None


@F.pandas_udf(T.StringType())
def canonical_url(url: pd.Series) -> pd.Series:
    """OP-107 for any script, Arrow batches."""
    return url.map(py_canonical_url, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def fingerprint(method: pd.Series, url: pd.Series) -> pd.Series:
    """OP-108 with an empty body, Arrow batches."""
    return pd.Series([py_fingerprint(m, u) for m, u in zip(method, url)], dtype=object)


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """OP-111: a link as seen from a base; null if either is null or cannot be split."""

    def one(b, u):
        try:
            return None if b is None or u is None else urljoin(b, u)
        except ValueError:
            return None

    return pd.Series([one(b, u) for b, u in zip(base, link)], dtype=object)


def _encode(text: Column) -> Column:
    """Percent-encoding with nothing kept but letters, digits and ``_.-~`` (Spark's own differs in three characters)."""
    out = F.url_encode(text)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def place_of(url: Column) -> Column:
    """What stands between ``//`` and the path."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def is_web_url(url: Column) -> Column:
    """OP-32: starts with http:// or https://."""
    return url.rlike(r"^https?://")


def origin_of(url: Column) -> Column:
    """OP-110: scheme://place, else null."""
    return F.nullif(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]+", 0), F.lit(""))


def host_of(url: Column) -> Column:
    """OP-109: host in lower case without login and port, empty if there is none."""
    return F.lower(F.regexp_extract(place_of(url), r"^(?:[^@]*@)*(\[[^\]]*\]|[^:@]*)", 1))


def canonical_url_native(url: Column) -> Column:
    """OP-107 inside whole-stage codegen, for ASCII hosts and well-formed escapes; null where there is no canonical form."""
    scheme = scheme_of(url)
    place = place_of(url)
    login = F.regexp_extract(place, r"^(.*@)", 1)
    rest = F.lower(F.regexp_extract(place, r"([^@]*)$", 1))
    port = F.when(scheme == "http", F.regexp_replace(rest, r"(?<=.):0*80$", "")).otherwise(F.regexp_replace(rest, r"(?<=.):0*443$", ""))
    raised = _raise_native(path_of(url))
    pairs = F.transform(
        F.filter(F.split(query_of(url), "&"), lambda p: p.contains("=")),
        lambda p: F.struct(
            F.try_url_decode(F.regexp_extract(p, r"^([^=]*)=", 1)).alias("k"),
            F.try_url_decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: (p["v"] != "") & ~p["k"].isin(*TRACKING_KEYS)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    return F.when(
        scheme.isin(*SCHEMES) & url.contains("://"),
        F.concat(scheme, F.lit("://"), login, port, raised, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))),
    )


def _raise_native(text: Column) -> Column:
    """%hh in upper case: split at %, lift the two digits of each later part."""
    parts = F.split(text, "%")
    lifted = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substring(p, 1, 2)), F.substring(p, 3, 1 << 30))).otherwise(p),
    )
    return F.array_join(F.concat(F.slice(parts, 1, 1), lifted), "%")


def site_key(hostname: Column, url: Column) -> Column:
    """The hostname by which records are grouped: without surrounding blanks, port and final dot, in lower case;
    where that is null or empty, the one of the http(s) url; else null."""

    def tidy(h: Column) -> Column:
        h = F.regexp_replace(F.lower(h), r"(?U)^\s+|\s+$", "")
        return F.nullif(F.regexp_replace(F.regexp_replace(h, r":\d*$", ""), r"\.$", ""), F.lit(""))

    of_url = F.when(scheme_of(F.trim(url)).isin(*SCHEMES), host_of(F.trim(url)))
    return F.coalesce(tidy(hostname), tidy(of_url))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def matches_patterns(url: Column, patterns: Sequence[str]) -> Column:
    """OP-29: whether any of the patterns is in the url; one that is no regular expression counts as a text. No patterns match all."""
    out = F.lit(not patterns)
    for p in patterns:
        try:
            re.compile(p)
            out = out | url.rlike(p)
        except re.error:
            out = out | url.contains(p)
    return F.coalesce(out, F.lit(False))


def wanted(url: Column, seed_origin: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """OP-28, 30: of the seed's origin, not excluded, included."""
    out = F.coalesce(origin_of(url) == seed_origin, F.lit(False)) & matches_patterns(url, include)
    return out & ~matches_patterns(url, exclude) if exclude else out
