"""Text and Markdown functions as Catalyst expressions. Null texts give null; empty ones empty results, unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Lines that are interface and not content, whole and by pattern.
CRUFT_LINES = (
    "advertisement", "ad", "sponsored", "promoted", "share this article", "share this", "share", "sign up", "sign in", "log in", "subscribe",
    "newsletter", "get the app", "open in app", "read more", "continue reading", "see more", "skip to content", "skip to main content",
    "skip advertisement", "skip ad", "recommended for you", "more from", "follow us", "follow", "like", "comment", "bookmark", "save", "print",
    "email", "copy link", "copied", "link copied", "advertisements",
)
CRUFT_PATTERN = (
    r"^(advertisement|sponsored content|promoted|sign up for|subscribe to|get our|join our|download the app|open in app"
    r"|share on (twitter|facebook|linkedin|email)|follow us on|connect with us|related articles?|trending now|most (read|popular|viewed)"
    r"|you (may|might) (also )?like|more (stories|articles) from|this (article|story) (is|was)|©\s*\d{4}.*|all rights reserved"
    r"|terms (of|and) (use|service)|privacy policy|cookie policy)$"
)
# What a text that was cut off by a subscription ends with.
CUT_OFF = (
    "subscribe to read", "sign in to continue", "members only", "subscribe to continue", "already a subscriber", "log in to read",
    "create a free account", "start your free trial", "this content is for subscribers", "unlock this article", "premium subscribers",
    "to continue reading",
)

WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(text: Column) -> Column:
    """White space of any script off both ends."""
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^\s\x1c-\x1f\x85\p{Z}]+"), F.lit(0))


def clean_content(text: Column) -> Column:
    """OP-94: lines of interface out, at most one blank line in a row, stripped."""

    def keep(line: Column) -> Column:
        s = strip(line)
        low = F.lower(s)
        return (s == "") | ~(low.isin(*CRUFT_LINES) | ((F.length(s) < 80) & low.rlike(CRUFT_PATTERN)))

    kept = F.array_join(F.filter(F.split(text, "\n", -1), keep), "\n")
    return strip(F.regexp_replace(kept, r"\n{3,}", "\n\n"))


def content_metadata(text: Column) -> Column:
    """OP-95: title, description, and counts of a Markdown text."""
    lines = F.transform(F.split(text, "\n", -1), strip)
    first = F.get(F.filter(lines, lambda x: (F.length(x) > 20) & ~x.rlike(r"^[#\[]")), F.lit(0))
    return F.when(
        text.isNotNull(),
        F.struct(
            F.nullif(F.regexp_extract(text, r"(?md)^#{1,2}\s+(.+?)$", 1), F.lit("")).alias("title"),
            F.substring(first, 1, 200).alias("description"),
            F.length(text).cast("long").alias("content_length"),
            F.size(words(text)).cast("long").alias("word_count"),
            F.regexp_count(text, F.lit(r"(?md)^#{1,6}\s+")).cast("long").alias("heading_count"),
            F.regexp_count(text, F.lit(r"\[.*?\]\(.*?\)")).cast("long").alias("link_count"),
        ),
    )


def is_cut_off(text: Column) -> Column:
    """OP-96: one of twelve phrases in the last 500 characters."""
    tail = F.lower(F.right(text, F.lit(500)))
    out = F.lit(False)
    for phrase in CUT_OFF:
        out = out | tail.contains(phrase)
    return out


def truncate_at_line(text: Column, limit: int) -> Column:
    """OP-87: the text up to the last line end before ``limit`` characters; without one, cut there."""
    head = F.substring(text, 1, limit)
    return F.when(F.length(text) <= limit, text).when(head.contains("\n"), F.regexp_extract(head, r"(?s)^(.*)\n", 1)).otherwise(head)


def first_of(items: Column, key) -> Column:
    """The items of an array whose key has not come before. Places are looked up in the array of distinct keys, which keeps their first order."""
    keys = F.transform(items, key)
    return F.transform(F.array_distinct(keys), lambda k: F.element_at(items, F.array_position(keys, k).cast("int")))


def last_of_keys(pairs: Column) -> Column:
    """An array of (key, value) as a map; of a repeated key the last holds."""
    back = F.reverse(pairs)
    keys = F.transform(back, lambda p: p["key"])
    return F.map_from_entries(F.reverse(F.transform(F.array_distinct(keys), lambda k: F.element_at(back, F.array_position(keys, k).cast("int")))))


def signal_map(header: Column) -> Column:
    """OP-102: "a=b, c=d" to a map with lower-case keys; parts without = are left out, of a repeated key the last holds."""
    pairs = F.transform(F.filter(F.split(header, ","), lambda p: p.contains("=")), lambda p: F.struct(F.lower(F.trim(F.regexp_extract(p, r"^([^=]*)=", 1))).alias("key"), F.trim(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("value")))
    return last_of_keys(pairs)


def duration_seconds(text: Column) -> Column:
    """OP-104: 500ms, 2s, 1.5m or a bare number of seconds; else null."""
    form = r"^\s*(\d+(?:\.\d+)?)\s*(ms|s|m)?\s*$"
    number = F.regexp_extract(text, form, 1).try_cast("double")
    unit = F.regexp_extract(text, form, 2)
    return F.when(unit == "ms", number / 1000).when(unit == "m", number * 60).otherwise(number)


def slug(text: Column) -> Column:
    """A heading's name: without parentheses, other signs as single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(text, r"\([^)]*\)", "")), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """OP-98: no (of the line), level, title, slug and body of each H2 and H3 of a Markdown text; a body runs to the next heading of its own or a higher
    level. All inside array functions: nothing is shuffled."""
    lines = F.split(text, "\n", -1)
    level = lambda x: F.length(F.regexp_extract(x, r"^(#{1,3})\s+\S", 1))
    heads = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("no"), level(x).alias("level"))), lambda h: h["level"] > 0)
    cut = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), lines.alias("_lines")).select("k", "_lines", heads.alias("_heads")).where(F.size("_heads") > 0)
    each = cut.select("k", "_lines", "_heads", F.posexplode("_heads").alias("_at", "h")).where("h.level IN (2, 3)")
    after = F.filter(F.slice("_heads", F.col("_at") + 2, F.size("_heads")), lambda g: g["level"] <= F.col("h.level"))
    end = F.coalesce(F.get(after, F.lit(0))["no"], F.size("_lines"))
    title = strip(F.regexp_replace(F.get("_lines", F.col("h.no")), r"^#+\s+", ""))
    body = strip(F.array_join(F.slice("_lines", F.col("h.no") + 2, end - F.col("h.no") - 1), "\n"))
    return each.select(F.col("k").alias(key), F.col("h.no").alias("no"), F.col("h.level").cast("int").alias("level"), title.alias("title"), slug(title).alias("slug"), body.alias("body"))


def relevant(text: Column, query: str, top: int = 10) -> Column:
    """OP-97: the paragraphs of a text that match a query best, in their order; the whole text where none does.

    Score of a paragraph of five words or more: the sum over terms of (count / words) * ln(n / (1 + df)), df being the paragraphs that contain the
    term anywhere; twice that for headings with a term, 0.3 of it where over 0.3 brackets a word stand. Inside array functions: no shuffle. Each
    term's paragraphs are counted once a text, and each paragraph is split once.
    """
    terms = list(dict.fromkeys(query.lower().split()))
    equals = lambda t: lambda w: w == t
    paras = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    # a paragraph with what its score needs: words, and of each term its count and whether it is anywhere in it
    told = F.transform(
        paras,
        lambda p, i: F.struct(
            i.alias("i"), p.alias("p"), F.size(words(p)).alias("size"),
            F.array(*[F.size(F.filter(words(F.lower(p)), equals(t))) for t in terms]).alias("n"), F.array(*[F.lower(p).contains(t) for t in terms]).alias("has"),
        ),
    )
    zero = F.array(*[F.lit(0)] * len(terms))
    holding = F.aggregate(told, zero, lambda acc, x: F.zip_with(acc, x["has"], lambda a, h: a + h.cast("int")))
    # the counts are put into every paragraph as an array of one, so that they are computed once
    rarity = F.transform(F.array(F.struct(told.alias("ps"), holding.alias("df"))), lambda y: F.struct(y["ps"].alias("ps"), F.transform(y["df"], lambda d: F.ln(F.size(y["ps"]).cast("double") / (1 + d))).alias("idf")))

    def score(x: Column, idf: Column) -> Column:
        total = F.aggregate(F.zip_with(x["n"], idf, lambda n, r: n / x["size"] * r), F.lit(0.0), lambda acc, v: acc + v)
        total = F.when(x["p"].startswith("#") & F.exists(x["has"], lambda h: h), total * 2).otherwise(total)
        crowded = (F.length(x["p"]) - F.length(F.replace(x["p"], F.lit("["), F.lit("")))) / x["size"] > 0.3
        return F.when(x["size"] < 5, F.lit(0.0)).otherwise(F.when(crowded, total * 0.3).otherwise(total))

    def best(y: Column) -> Column:
        scored = F.filter(F.transform(y["ps"], lambda x: F.struct((-score(x, y["idf"])).alias("s"), x["i"].alias("i"), x["p"].alias("p"))), lambda x: x["s"] < 0)
        chosen = F.slice(F.array_sort(scored), 1, top)
        return F.array_join(F.transform(F.array_sort(F.transform(chosen, lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p")))), lambda x: x["p"]), "\n\n")

    if not terms:
        return text
    return F.coalesce(F.nullif(F.transform(rarity, best)[0], F.lit("")), text)


def relevant_paragraphs(df: DataFrame, key: str, text: str, query: str, top: int = 10) -> DataFrame:
    """OP-97 over a table: key, text."""
    return df.select(key, relevant(F.col(text), query, top).alias("text"))


# Content types that are text, and file extensions that are not.
TEXT_TYPES = (
    "text/", "application/json", "application/xml", "application/xhtml+xml", "application/javascript", "application/ecmascript",
    "application/x-yaml", "application/yaml", "application/toml", "application/x-ndjson", "application/x-jsonlines", "application/jsonlines",
)
BINARY_EXTENSIONS = "zip gz tar bz2 xz 7z rar pdf doc docx xls xlsx ppt pptx png jpg jpeg gif webp svg ico mp3 mp4 wav avi mkv mov woff woff2 ttf otf eot exe msi dmg deb rpm whl egg".split()


def media_type(content_type: Column) -> Column:
    return F.trim(F.split_part(F.lower(content_type), F.lit(";"), F.lit(1)))


def is_binary_type(content_type: Column) -> Column:
    """OP-11: whether a content type is no text."""
    m = media_type(content_type)
    text = m.rlike(r"\+(json|xml)$")
    for t in TEXT_TYPES:
        text = text | m.startswith(t)
    return ~text & m.rlike("^(application|image|audio|video|font)/")


def is_html_type(content_type: Column) -> Column:
    return media_type(content_type).rlike(r"^(text/html|application/xhtml\+xml$)")


def route(content_type: Column, file_name: Column, body: Column | None = None) -> Column:
    """OP-13: which decoder a body goes to: binary, json, html, text. With a body given, JSON is tried first, whatever the type says, unless the file's
    name is binary."""
    m = media_type(content_type)
    binary_name = F.coalesce(F.lower(file_name).rlike(r"\.(" + "|".join(BINARY_EXTENSIONS) + ")$"), F.lit(False))
    is_json = m.rlike(r"(^application/(x-ndjson|json|x-jsonlines|jsonlines)|\+json)$")
    by_type = F.when(is_binary_type(content_type) | binary_name, "binary").when(is_json, "json").when(is_html_type(content_type), "html").otherwise("text")
    return by_type if body is None else F.when(~binary_name & body.rlike(r"^\s*[\[{]") & F.get_json_object(body, "$").isNotNull(), "json").otherwise(by_type)


def decoded(body: Column, kind: Column) -> Column:
    """OP-13: a body as its route reads it: JSON without white space between its signs (null if it is none; names that come twice stay), text and HTML as they
    are, nothing of binary ones."""
    return F.when(kind == "json", F.get_json_object(body, "$")).when(kind != "binary", body)


def safe_file_name(path: Column, query: Column) -> Column:
    """OP-17: a url's path and query as a file name of at most 200 characters."""
    base = F.coalesce(F.nullif(F.regexp_replace(path, "^/+|/+$", ""), F.lit("")), F.lit("index"))
    full = F.when(query != "", F.concat(base, F.lit("--"), query)).otherwise(base)
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(full, r"(?U)[^\w\-.]", "-"), "-+", "-"), "^-+|-+$", "")
    short = F.when(F.length(name) > 200, F.concat(F.substring(name, 1, 190), F.lit("--"), F.substring(F.md5(F.encode(name, "UTF-8")), 1, 8))).otherwise(name)
    return F.coalesce(F.nullif(short, F.lit("")), F.lit("index"))


def cache_key(endpoint: Column, body: Column) -> Column:
    """OP-14: 16 hex digits that name a cached answer."""
    return F.substring(F.sha2(F.concat(endpoint, F.lit(":"), body), 256), 1, 16)


def sorted_json(arguments: Column) -> Column:
    """OP-14: a map of texts as JSON with its names in order, so that equal arguments have equal keys."""
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    pairs = F.transform(F.array_sort(F.map_entries(arguments)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


#: Fixed value: what a page has at least to be worth keeping.
LEAST_CACHED = 1024


def cacheable(status: Column, kind: Column, content: Column, allow_empty: bool = False) -> Column:
    """OP-15: whether an answer is worth keeping: no recorded failure, not empty, and of HTML and Markdown no stub. Null status: none was recorded."""
    ok = F.coalesce(status == 200, F.lit(True))
    full = F.length(F.coalesce(content, F.lit(""))) > 0
    stub = kind.isin("html", "markdown") & (F.length(content) < LEAST_CACHED)
    listed = content.isin("[]", "{}")
    return ok if allow_empty else ok & full & ~F.coalesce(stub, F.lit(False)) & ~F.coalesce(listed, F.lit(False))
