"""What kind of answer stands in place of a page: the first rule that holds (OP-148), and truncated or missing bodies (OP-187)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

SCANNED = 65_536
# The rules in order: vendor, kind, terminal, signal, and the texts of which one must be in the lower-case body.
CHALLENGE = ("cf-browser-verification", "challenge-platform", "cf_chl_opt", "_cf_chl", "/cdn-cgi/challenge-platform")
INTERSTITIAL = ("powered and protected by akamai", "errors.edgesuite.net", "reference&#32;&#35;", "akamai reference")
INCAPSULA = ("incapsula incident id", "_incapsula_resource", "powered by incapsula", "visid_incap", "/_incapsula_")
HUMAN = ("px-captcha", "/_px/", "perimeterx", "_pxhd", "px-cdn")


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def wall(status: Column, headers: Column, body: Column) -> Column:
    """struct(blocked, vendor, kind, terminal, signal). Null status counts as 0, null headers and bodies as empty."""
    low = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, SCANNED))
    h = F.transform_keys(F.coalesce(headers, F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    head = lambda name: F.lower(F.coalesce(F.element_at(h, name), F.lit("")))
    code = F.coalesce(status, F.lit(0))
    cf = low.contains("cloudflare")
    near = cf | low.contains("cdn-cgi") | F.map_contains_key(h, "cf-ray")
    interstitial = _any(low, INTERSTITIAL)
    say = lambda vendor, kind, signal, terminal=False: F.struct(F.lit(True).alias("blocked"), (vendor if isinstance(vendor, Column) else F.lit(vendor)).alias("vendor"), F.lit(kind).alias("kind"), F.lit(terminal).alias("terminal"), F.lit(signal).alias("signal"))
    stub = code.isin(0, 200) & (F.length(F.coalesce(body, F.lit(""))) <= 512) & low.contains("reference #") & _any(low, ("edgesuite", "akamai", "/_sec/"))
    return (
        F.when(low.contains("error code: 1020") | (cf & low.contains("access denied") & low.contains("1020")), say("cloudflare", "cf_1020_hard", "cf error code 1020", True))
        .when((head("cf-mitigated") == "challenge") | _any(low, CHALLENGE) | (low.contains("just a moment") & near), say("cloudflare", "js_challenge", "cloudflare challenge page"))
        .when(cf & _any(low, ("attention required", "sorry, you have been blocked")), say("cloudflare", "edge_deny", "cloudflare edge block"))
        .when(interstitial & low.contains("access denied"), say("akamai", "edge_deny", "akamai access denied"))
        .when(interstitial, say("akamai", "interstitial", "akamai interstitial"))
        .when(stub, say("akamai", "interstitial", "akamai short reference stub"))
        .when(_any(low, INCAPSULA), say("imperva", "js_challenge", "imperva/incapsula challenge"))
        .when(_any(low, ("datadome", "geo.captcha-delivery.com")) | head("set-cookie").contains("datadome") | F.map_contains_key(h, "x-datadome"), say("datadome", "captcha", "datadome captcha"))
        .when(_any(low, HUMAN), say("perimeterx", "captcha", "perimeterx human challenge"))
        .when((code == 403) & (low.contains("generated by cloudfront") | head("server").contains("cloudfront") | head("x-cache").contains("error from cloudfront")), say("cloudfront", "edge_deny", "cloudfront 403"))
        .when(code == 429, say(F.when(cf | head("server").contains("cloudflare"), "cloudflare").otherwise(""), "rate_limited", "http 429"))
        .otherwise(F.struct(F.lit(False).alias("blocked"), F.lit("").alias("vendor"), F.lit("").alias("kind"), F.lit(False).alias("terminal"), F.lit("").alias("signal")))
    )


def wants_archive(content: Column) -> Column:
    """OP-187: too short a content, or a page that says it is not there."""
    c = F.coalesce(content, F.lit(""))
    return (F.length(F.trim(c)) < 50) | (F.substring(c, 1, 200).contains("404") & F.lower(F.substring(c, 1, 500)).contains("not found"))
