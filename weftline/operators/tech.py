r"""Technologies of pages from a table of fingerprints (OP-34, 48, 49, 83, 93, 149..153, 155).

Fingerprints come in the public JSON form, technology by technology, with signals (scriptSrc, headers, cookies, meta, html, scripts, css, url, js, dom), a
pattern being ``regex\;confidence:n\;version:template``. They are compiled to a ``Book`` on the driver: a table of patterns that
grows with the fingerprints, not with the data, checked against ``MAX_PATTERNS`` and broadcast. Each page is read once: an automaton
tells which patterns' fixed parts are in it at all, and only those are tried. Pages meet no table by a join, so that nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

try:
    import ahocorasick
except ImportError:  # all patterns are tried then
    ahocorasick = None

MAX_PATTERNS = 200_000
#: In the order in which they are read: of versions the last counts.
SIGNALS = ("scriptSrc", "headers", "cookies", "meta", "html", "scripts", "css", "url", "js", "dom")
KEYED = frozenset(("headers", "cookies", "meta", "js"))

#: Fingerprints to begin with; users load theirs.
FINGERPRINTS: dict[str, dict] = {
    "Nginx": {"cats": [22], "headers": {"Server": r"nginx(?:/([\d.]+))?\;version:\1"}},
    "Apache": {"cats": [22], "headers": {"Server": r"(?:Apache(?:$|/([\d.]+)|[^/-])|(?:^|\b)HTTPD)\;version:\1"}},
    "Caddy": {"cats": [22], "headers": {"Server": r"^Caddy"}},
    "LiteSpeed": {"cats": [22], "headers": {"Server": r"^LiteSpeed"}},
    "IIS": {"cats": [22], "headers": {"Server": r"^(?:Microsoft-)?IIS(?:/([\d.]+))?\;version:\1"}},
    "Varnish": {"cats": [23], "headers": {"X-Varnish": "", "Via": r"varnish(?: \(Varnish/([\d.]+)\))?\;version:\1"}},
    "PHP": {"cats": [27], "cookies": {"PHPSESSID": ""}, "headers": {"X-Powered-By": r"^PHP/?([\d.]+)?\;version:\1"}, "url": [r"\.php(?:$|\?)\;confidence:60"]},
    "ASP.NET": {"cats": [18], "cookies": {"ASP.NET_SessionId": "", "ASPSESSION*": ""}, "headers": {"X-AspNet-Version": r"(.+)\;version:\1"}},
    "Express": {"cats": [18], "headers": {"X-Powered-By": r"^Express"}, "implies": "Node.js"},
    "Node.js": {"cats": [27]},
    "Next.js": {"cats": [18], "headers": {"X-Powered-By": r"^Next\.js ?([\d.]+)?\;version:\1"}, "html": [r'<script[^>]+id="__NEXT_DATA__"'], "js": {"next.version": r"(.+)\;version:\1"}, "implies": ["React", "Node.js"]},
    "React": {"cats": [12], "html": [r"<[^>]+data-reactroot\;confidence:80"], "js": {"React.version": r"^(.+)$\;version:\1"}, "scriptSrc": [r"react(?:-dom)?[.@-]([\d.]*\d)[^/]*\.js\;version:\1"]},
    "Vue.js": {"cats": [12], "html": [r"<[^>]+\sdata-v-[0-9a-f]{8}"], "js": {"Vue.version": r"^(.+)$\;version:\1"}, "scriptSrc": [r"vue[.@-]([\d.]*\d)[^/]*\.js\;version:\1"]},
    "Angular": {"cats": [12], "html": [r'ng-version="([\d.]+)"\;version:\1']},
    "jQuery": {"cats": [59], "js": {"jQuery.fn.jquery": r"([\d.]+)\;version:\1"}, "scriptSrc": [r"jquery(?:-|\.)([\d.]*\d)[^/]*\.js\;version:\1"]},
    "Bootstrap": {"cats": [66], "css": [r"\.container-fluid\{[^}]*padding-right\;confidence:50"], "scriptSrc": [r"bootstrap(?:[.-]([\d.]*\d))?[^/]*\.js\;version:\1"]},
    "WordPress": {"cats": [1], "html": [r"/wp-(?:content|includes)/"], "meta": {"generator": r"^WordPress ?([\d.]+)?\;version:\1"}, "implies": ["PHP", r"MySQL\;confidence:80"]},
    "Drupal": {"cats": [1], "headers": {"X-Drupal-Cache": ""}, "meta": {"generator": r"^Drupal(?: ([\d.]+))?\;version:\1"}, "implies": "PHP"},
    "MySQL": {"cats": [34], "implies": "SQL"},
    "SQL": {"cats": [34]},
    "Google Analytics": {"cats": [10], "cookies": {"_ga": "", "_ga_*": r"\;confidence:80"}, "scripts": [r"google-analytics\.com/(?:ga|analytics)\.js"], "scriptSrc": [r"googletagmanager\.com/gtag/js"]},
    "Shopify": {"cats": [6], "cookies": {"_shopify_s": ""}, "dom": ["link[href*='cdn.shopify.com']"], "headers": {"X-ShopId": r"\;confidence:50"}},
    "Schema.org": {"cats": [19], "html": [r"application/ld\+json"]},
}
#: Names and groups of the categories that the fingerprints above use.
CATEGORIES: dict[str, dict] = {
    "1": {"name": "CMS", "groups": [3]}, "6": {"name": "Ecommerce", "groups": [1]}, "10": {"name": "Analytics", "groups": [8]}, "12": {"name": "JavaScript frameworks", "groups": [9]}, "18": {"name": "Web frameworks", "groups": [9]},
    "19": {"name": "Miscellaneous", "groups": [6]}, "22": {"name": "Web servers", "groups": [7]}, "23": {"name": "Caching", "groups": [7]}, "27": {"name": "Programming languages", "groups": [9]}, "34": {"name": "Databases", "groups": [7]},
    "59": {"name": "JavaScript libraries", "groups": [9]}, "66": {"name": "UI frameworks", "groups": [9]},
}
GROUPS: dict[str, dict] = {"1": {"name": "Sales"}, "3": {"name": "Content"}, "6": {"name": "Other"}, "7": {"name": "Servers"}, "8": {"name": "Analytics"}, "9": {"name": "Web development"}}


@dataclass(frozen=True)
class Pattern:
    """One pattern: of a keyed signal only the value under its key is tried (any whose name fits, if the key holds *). No regex: being there is enough.
    also: for dom, more that the raw page must show."""

    tech: str
    signal: str
    key: str
    regex: str
    confidence: int = 100
    version: str = ""
    also: tuple[str, ...] = ()


def parse_pattern(tech: str, signal: str, key: str, text: str) -> Pattern | None:
    """OP-150; None for what is no regular expression."""
    regex, *rest = text.split("\\;")
    options = dict(x.partition(":")[::2] for x in rest)
    try:
        re.compile(regex)
        confidence = int(options.get("confidence", 100))
    except re.error:
        return None
    except ValueError:
        confidence = 100
    return Pattern(tech, signal, key.lower() if signal in ("headers", "meta") else key, regex, confidence, options.get("version", ""))


# Fixed value: an attribute test of a selector.
_BY_ATTRIBUTE = re.compile(r"\[(\w+)([*^$~|]?)=[\"']([^\"']*)[\"']")


def selector_regexes(selector: str) -> tuple[str, ...] | None:
    """OP-152: a selector as regular expressions that the raw page must show, all of them: its attribute tests, else a class of five letters or more, else
    an id. None: it can't be told from the raw page."""
    tests = _BY_ATTRIBUTE.findall(selector)
    if tests:
        form = {"*": r"{a}=[\"'][^\"']*{v}[^\"']*[\"']", "^": r"{a}=[\"']\s*{v}", "$": r"{v}\s*[\"']"}
        return tuple(form.get(op, r"{a}=[\"']\s*{v}\s*[\"']").replace("{a}", a).replace("{v}", re.escape(v)) for a, op, v in tests)
    if "[" in selector and "=" not in selector:
        return None
    named = re.search(r"\.(\w[\w-]+)", selector)
    if named:
        return (rf"class=[\"'][^\"']*{re.escape(named[1])}",) if len(named[1]) >= 5 else None
    named = re.search(r"#(\w[\w-]+)", selector)
    return (rf"id=[\"'][^\"']*{re.escape(named[1])}",) if named else None


def _dom_patterns(tech: str, value) -> Iterator[Pattern]:
    """The dom signal: selectors, or selectors with checks (text, attributes; properties can't be told)."""
    for entry in value if isinstance(value, list) else [value]:
        for selector, checks in (entry.items() if isinstance(entry, dict) else [(entry, None)]):
            shown = selector_regexes(selector)
            if shown is None or isinstance(checks, dict) and "properties" in checks:
                continue
            confidence, more = 100, list(shown)
            if isinstance(checks, dict):
                found = [parse_pattern(tech, "dom", "", x) for x in [*([checks["text"]] if "text" in checks else []), *(checks.get("attributes") or {}).values()]]
                if None in found:
                    continue
                confidence = min([100, *[p.confidence for p in found if p.confidence != 100]])
                more += [p.regex for p in found if p.regex]
            yield Pattern(tech, "dom", selector, more[0], confidence, "", tuple(more[1:]))


def patterns_of(fingerprints: Mapping[str, Mapping]) -> list[Pattern]:
    """All patterns of fingerprints in the public form; a field may be a text, a list or a map."""
    out: list[Pattern | None] = []
    for tech, fp in fingerprints.items():
        for signal in SIGNALS:
            value = fp.get(signal)
            if not value:
                continue
            if signal == "dom":
                out += _dom_patterns(tech, value)
            elif signal in KEYED:
                out += [parse_pattern(tech, signal, k, x) for k, xs in value.items() for x in (xs if isinstance(xs, list) else [xs])]
            else:
                out += [parse_pattern(tech, signal, "", x) for x in (value if isinstance(value, list) else [value])]
    return [p for p in out if p is not None]


def _implied(value) -> list[tuple[str, int]]:
    found = [parse_pattern("", "", "", re.escape(x.split("\\;")[0]) + x[len(x.split("\\;")[0]) :]) for x in ([value] if isinstance(value, str) else value or [])]
    names = [x.split("\\;")[0] for x in ([value] if isinstance(value, str) else value or [])]
    return [(n, p.confidence) for n, p in zip(names, found)]


def overlay(base: Mapping[str, Mapping], extra: Mapping[str, Mapping], disabled: frozenset[str] | set[str] = frozenset()) -> dict[str, dict]:
    """OP-93: lists get what they lack, maps are updated, a list of selectors meets a map as selectors without checks, what base lacks is added; disabled
    technologies go, and nothing implies them."""

    def joined(old, new):
        if isinstance(old, Mapping) and isinstance(new, list):
            return {x: {} for x in new if isinstance(x, str)} | dict(old)
        if isinstance(old, list) and isinstance(new, Mapping):
            return {x: {} for x in old if isinstance(x, str)} | dict(new)
        if isinstance(old, Mapping) and isinstance(new, Mapping):
            return dict(old) | dict(new)
        if isinstance(old, list) and isinstance(new, list):
            return [*old, *[x for x in new if x not in old]]
        return old

    out = {}
    for tech in {**base, **extra}:
        if tech in disabled:
            continue
        old, new = base.get(tech, {}), extra.get(tech, {})
        out[tech] = {k: joined(old[k], new[k]) if k in old and k in new else old.get(k, new.get(k)) for k in {**old, **new}}
        if "implies" in out[tech]:
            given = out[tech]["implies"]
            out[tech]["implies"] = [x for x in ([given] if isinstance(given, str) else given) if x.split("\\;")[0] not in disabled]
    return out


def closure(implies: Mapping[str, list[tuple[str, int]]]) -> dict[str, dict[str, int]]:
    """OP-153: all that a technology implies, near and far, each with its highest confidence (that of the last step, not multiplied)."""
    out = {}
    for a in implies:
        best: dict[str, int] = {}
        todo = list(implies[a])
        while todo:
            b, c = todo.pop()
            if b != a and best.get(b, -1) < c:
                best[b] = c
                todo += implies.get(b, [])
        if best:
            out[a] = best
    return out


def fixed_part(regex: str) -> str:
    """The longest text that every match holds, in lower case; empty if there is none of three signs."""
    try:
        from re import _parser as parser  # the pattern as the standard library reads it
    except ImportError:
        return ""
    best = run = ""
    for op, value in parser.parse(regex, re.I):
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
        elif name != "AT":
            run = ""
        best = max(best, run, key=len)
    return best if len(best) >= 3 else ""


@dataclass
class Book:
    """Compiled fingerprints: what is broadcast."""

    patterns: list[Pattern]
    about: dict[str, tuple[list[str], list[str]]]  # categories and groups of each technology
    implies: dict[str, dict[str, int]]
    _ready: dict = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, fingerprints: Mapping[str, Mapping] | None = None, categories: Mapping[str, Mapping] | None = None, groups: Mapping[str, Mapping] | None = None) -> Book:
        """OP-49: categories and groups by their ids; an unknown id stands for itself."""
        fps = FINGERPRINTS if fingerprints is None else fingerprints
        cats, grps = CATEGORIES if categories is None else categories, GROUPS if groups is None else groups
        patterns = patterns_of(fps)
        if len(patterns) > MAX_PATTERNS:
            raise ValueError(f"{len(patterns)} patterns; at most {MAX_PATTERNS}")
        about = {}
        for tech, fp in fps.items():
            ids = [str(c) for c in fp.get("cats", [])]
            names = [grps.get(str(g), {}).get("name", str(g)) for c in ids for g in cats.get(c, {}).get("groups", [])]
            about[tech] = [cats.get(c, {}).get("name", c) for c in ids], list(dict.fromkeys(names))
        known = {t: [(b, c) for b, c in _implied(fp.get("implies")) if b in fps] for t, fp in fps.items()}
        return cls(patterns, about, closure(known))

    @classmethod
    def from_json(cls, fingerprints: str, categories: str = "{}", groups: str = "{}") -> Book:
        return cls.of(json.loads(fingerprints), json.loads(categories), json.loads(groups))

    def ready(self) -> dict:
        """Of each signal: its patterns by key, compiled, and an automaton over their fixed parts. Made once a process."""
        if not self._ready:
            for signal in SIGNALS:
                own = [(p, re.compile(p.regex, re.I) if p.regex else None, tuple(re.compile(x, re.I) for x in p.also)) for p in self.patterns if p.signal == signal]
                always, parts = [], {}
                for i, (p, _, _) in enumerate(own):
                    part = fixed_part(p.regex) if ahocorasick is not None and signal not in KEYED else ""
                    (parts.setdefault(part, []) if part else always).append(i)
                machine = None
                if parts:
                    machine = ahocorasick.Automaton()
                    for part, ids in parts.items():
                        machine.add_word(part, ids)
                    machine.make_automaton()
                self._ready[signal] = own, always, machine
        return self._ready

    def __getstate__(self):
        return {"patterns": self.patterns, "about": self.about, "implies": self.implies, "_ready": {}}


def version_of(m: re.Match, template: str) -> str:
    """OP-150: the template with its groups put in, from the first to the tenth; what is left of a choice between texts goes."""
    for i in range(1, 11):
        template = template.replace(f"\\{i}", (m.group(i) or "") if i <= m.re.groups else "")
    return re.sub(r"\\\d\?[^:]*:[^\\]*", "", template).strip()


# What scripts, styles and meta tags look like in a raw page.
_SRC = re.compile(r"<script[^>]+src=[\"']([^\"']+)", re.I)
_INLINE = re.compile(r"<script[^>]*>(.*?)</script>", re.I | re.S)
_STYLE = re.compile(r"<style[^>]*>(.*?)</style>", re.I | re.S)
_META = (re.compile(r"<meta[^>]+(?:name|property)=[\"']([^\"']+)[\"'][^>]+content=[\"']([^\"']*)[\"']", re.I), re.compile(r"<meta[^>]+content=[\"']([^\"']*)[\"'][^>]+(?:name|property)=[\"']([^\"']+)[\"']", re.I))


def signals_of(html: str, url: str, headers: Mapping[str, str], cookies: Mapping[str, str], js: Mapping[str, str]) -> dict[str, list[str] | dict[str, str]]:
    """What each signal has to show of one page."""
    meta = {name.lower(): value for value, name in _META[1].findall(html)} | {name.lower(): value for name, value in _META[0].findall(html)}
    return {
        "scriptSrc": _SRC.findall(html), "headers": {k.lower(): v or "" for k, v in headers.items()}, "cookies": {k: v or "" for k, v in cookies.items()}, "meta": meta, "html": [html],
        "scripts": ["\n".join(_INLINE.findall(html))], "css": ["\n".join(_STYLE.findall(html))], "url": [url], "js": {k: v for k, v in js.items() if v is not None}, "dom": [html],
    }


def _keyed_hits(p: Pattern, compiled: re.Pattern | None, shown: Mapping[str, str]) -> Iterator[re.Match | None]:
    """Matches of a keyed pattern; None: it counts by being there. OP-151: a cookie counts whatever its value, a header or meta tag needs one."""
    if p.signal == "cookies" and "*" in p.key:
        names = [n for n in shown if re.search(p.key.replace("*", ".*"), n, re.I)]
    else:
        names = [p.key] if p.key in shown else []
    for n in names:
        value = shown[n]
        m = compiled.search(value) if compiled is not None and value else None
        if m is not None:
            yield m
        elif p.signal == "cookies" or (compiled is None and (value or p.signal == "js")):
            yield None


def found_in(book: Book, shown: Mapping[str, list[str] | Mapping[str, str]]) -> list[tuple[str, int, str]]:
    """(technology, confidence, version) of a page, surest first, then by name."""
    confidence: dict[str, int] = {}
    version: dict[str, str] = {}
    for signal, (own, always, machine) in book.ready().items():
        values = shown[signal]
        candidates = always
        if machine is not None:
            hit = {i for v in values for _, ids in machine.iter(v.lower()) for i in ids}
            candidates = sorted({*always, *hit})
        for i in candidates:
            p, compiled, also = own[i]
            if signal in KEYED:
                matches = list(_keyed_hits(p, compiled, values))
            else:
                matches = [m for v in values if v and compiled is not None and (m := compiled.search(v)) and all(x.search(v) for x in also)]
            if not matches:
                continue
            confidence[p.tech] = max(p.confidence, confidence.get(p.tech, 0))
            if p.version and signal != "url":
                for m in matches:
                    version[p.tech] = (version_of(m, p.version) if m is not None else "") or version.get(p.tech, "")
    seen = {t: min(100, c) for t, c in confidence.items() if c > 0}
    implied: dict[str, int] = {}
    for t in seen:
        for b, c in book.implies.get(t, {}).items():
            if b not in seen:
                implied[b] = max(c, implied.get(b, 0))
    return sorted([(t, c, version.get(t, "")) for t, c in (seen | implied).items()], key=lambda x: (-x[1], x[0]))


_SHAPE = "array<struct<tech:string,confidence:int,version:string,categories:array<string>,groups:array<string>>>"
_ARROW = pa.list_(pa.struct([("tech", pa.string()), ("confidence", pa.int32()), ("version", pa.string()), ("categories", pa.list_(pa.string())), ("groups", pa.list_(pa.string()))]))


def detect(pages: DataFrame, key: str, html: str, url: str | None = None, headers: str | None = None, cookies: str | None = None, js: str | None = None, book: Book | None = None) -> DataFrame:
    """key, technologies: of each page what it is made with, surest first, then by name (tech, confidence, version or null, categories, groups).

    html, url: texts; headers, cookies, js: maps of texts. Null ones show nothing, columns not given neither; without a column of cookies those of the
    set-cookie header count. Equal rows have equal results. Other columns are not read."""
    shared = pages.sparkSession.sparkContext.broadcast(book or Book.of())
    empty_map = F.lit(None).cast("map<string,string>")
    c = lambda name, otherwise: F.col(name) if name else otherwise
    rows = pages.select(F.col(key), c(html, None), c(url, F.lit(None).cast("string")).alias("_u"), c(headers, empty_map).alias("_h"), c(cookies, empty_map).alias("_c"), c(js, empty_map).alias("_j"))
    from_headers = cookies is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book_ = shared.value
        for b in batches:
            out = []
            for page, address, *maps in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
                head, jar, names = (dict(m or ()) for m in maps)
                if from_headers:
                    jar = {n.strip(): v for h, text in head.items() if h.lower() == "set-cookie" for n, _, v in [(text or "").split(";")[0].partition("=")] if n.strip()}
                found = found_in(book_, signals_of(page or "", address or "", head, jar, names))
                out.append([{"tech": t, "confidence": s, "version": v or None, "categories": book_.about[t][0], "groups": book_.about[t][1]} for t, s, v in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, _ARROW)], names=[key, "technologies"])

    return rows.mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, technologies {_SHAPE}")


def filtered(technologies: Column, least: int = 0, only: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> Column:
    """OP-34: by confidence and category, in any letter case; one category that fits is enough."""
    low = lambda x: F.transform(x["categories"], lambda c: F.lower(c))
    some = lambda x, names: F.arrays_overlap(low(x), F.array(*[F.lit(n.lower()) for n in names]))
    out = F.filter(technologies, lambda x: x["confidence"] >= least)
    if only:
        out = F.filter(out, lambda x: some(x, only))
    return F.filter(out, lambda x: ~some(x, without)) if without else out


def summary(technologies: Column, most: int = 6) -> Column:
    """OP-155: the surest technologies in a line, with versions and their first category, and how many more there are."""
    piece = lambda x: F.concat(
        x["tech"], F.coalesce(F.concat(F.lit(" "), x["version"]), F.lit("")), F.coalesce(F.concat(F.lit(" ("), F.get(x["categories"], F.lit(0)), F.lit(")")), F.lit(""))
    )
    more = F.size(technologies) - most
    return F.concat(F.array_join(F.transform(F.slice(technologies, 1, most), piece), " + "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def attached(records: DataFrame, key: str, html: str, content: str, book: Book | None = None, **columns: str) -> DataFrame:
    """OP-155: records with technologies and tech_summary, read from their html, else from a content that begins with a tag. Records that have technologies
    already stay as they are. key must be unique; columns: url, headers, cookies, js as in ``detect``."""
    if "technologies" in records.columns:
        return records
    page = F.coalesce(F.nullif(F.col(html), F.lit("")), F.when(F.ltrim(content).startswith("<"), F.col(content)))
    found = detect(records.withColumn("_page", page), key, "_page", book=book, **columns)
    return records.join(found, key, "left").withColumn("tech_summary", summary(F.col("technologies")))
