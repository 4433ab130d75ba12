"""Colours, spacing, type scales and what else makes a page's design, as expressions (OP-47, 54, 65..69, 91, 161..163, 165)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

# Known ratios of type scales; marks of grades.
SCALES = (1.125, 1.2, 1.25, 1.333, 1.5, 1.618)
GRADES = ((95, "A+"), (90, "A"), (85, "A-"), (80, "B+"), (75, "B"), (70, "B-"), (65, "C+"), (60, "C"), (50, "D"))


def to_hex(colour: Column) -> Column:
    """#abc, #aabbcc and rgb(a)() as #aabbcc; else null."""
    c = F.lower(F.trim(colour))
    part = lambda i: F.lpad(F.hex(F.regexp_extract(c, r"^rgba?\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})", i).try_cast("int")), 2, "0")
    return (
        F.when(c.rlike("^#[0-9a-f]{6}$"), c)
        .when(c.rlike("^#[0-9a-f]{3}$"), F.concat(F.lit("#"), *[F.repeat(F.substring(c, i, 1), 2) for i in (2, 3, 4)]))
        .when(c.rlike(r"^rgba?\(\s*\d{1,3}\s*,\s*\d{1,3}\s*,\s*\d{1,3}"), F.lower(F.concat(F.lit("#"), part(1), part(2), part(3))))
    )


def _channel(hex_colour: Column, i: int) -> Column:
    return F.conv(F.substring(hex_colour, i, 2), 16, 10).cast("double") / 255


def luminance(hex_colour: Column) -> Column:
    def linear(i: int) -> Column:
        v = _channel(hex_colour, i)
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(2) + 0.7152 * linear(4) + 0.0722 * linear(6)


def contrast(a: Column, b: Column) -> Column:
    """OP-162: the ratio of two colours' luminances, 1 to 21."""
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def grade(ratio: Column) -> Column:
    return F.when(ratio >= 7, "AAA").when(ratio >= 4.5, "AA").when(ratio >= 3, "AA-large").otherwise("fail")


def gcd(values: Column) -> Column:
    """Of an array of positive integers (Euclid unrolled over the steps that ints can need); 0 for an empty one."""

    def pair(a: Column, b: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(48))
        zero = F.struct(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
        return F.aggregate(steps, zero, lambda acc, _: F.when(acc["y"] == 0, acc).otherwise(F.struct(acc["y"].alias("x"), (acc["x"] % acc["y"]).alias("y"))))["x"]

    return F.aggregate(values, F.lit(0), pair)


def spacing(values: Column) -> Column:
    """OP-66: struct(base, outliers) of an array of pixels: base is the greatest common divisor of the whole ones (4 if there is none), outliers are no
    multiples of it. Null and non-positive values are left out."""
    kept = F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: v.cast("double")), lambda v: v > 0)))
    whole = F.transform(F.filter(kept, lambda v: v == F.floor(v)), lambda v: v.cast("int"))
    base = F.when(F.size(whole) > 0, gcd(whole)).otherwise(4)
    return F.transform(F.array(F.struct(kept.alias("v"), base.alias("b"))), lambda x: F.struct(x["b"].alias("base"), F.filter(x["v"], lambda v: v % x["b"] != 0).alias("outliers")))[0]


def type_scale(sizes: Column) -> Column:
    """OP-67: the known ratio that the mean step between sorted sizes comes near, by 0.08; null for under three sizes."""
    s = F.array_sort(F.array_distinct(sizes))
    n = F.size(s)
    steps = F.zip_with(F.slice(s, 2, F.greatest(n - 1, F.lit(0))), F.slice(s, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: a / b)
    mean = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x) / (n - 1)
    out = F.lit(None).cast("double")
    for r in reversed(SCALES):
        out = F.when(F.abs(mean - r) <= 0.08, F.lit(r)).otherwise(out)
    return F.when(n >= 3, out)


def colour_role(name: Column) -> Column:
    """OP-65, 161: what a colour is for, by its property."""
    return F.when(name == "background-color", "background").when(name == "color", "text").when(name == "border-color", "border").otherwise("accent")


def colour_uses(df: DataFrame, keys: list[str], colour: str, name: str, n: str) -> DataFrame:
    """OP-65: how often each colour is used for what on each page (keys), and whether it is used but once. Colours that can't be read are left out."""
    rows = df.select(*keys, to_hex(F.col(colour)).alias("hex"), colour_role(F.col(name)).alias("role"), F.col(n).alias("_n")).where("hex IS NOT NULL")
    return rows.groupBy(*keys, "hex", "role").agg(F.sum("_n").alias("uses")).withColumn("alone", F.col("uses") == 1)


def contrasts(texts: Column, backgrounds: Column) -> Column:
    """OP-47: all colours of texts against all backgrounds of one page (a handful each): array of (text, background, ratio, grade)."""

    def pair(t: Column, b: Column) -> Column:
        r = contrast(t, b)
        return F.struct(t.alias("text"), b.alias("background"), F.round(r, 2).alias("ratio"), grade(r).alias("grade"))

    return F.flatten(F.transform(texts, lambda t: F.transform(backgrounds, lambda b: pair(t, b))))


def shadow_tier(shadow: Column) -> Column:
    """OP-161: by the blur, the third length; small where there is none."""
    blur = F.regexp_extract(shadow, r"(?:[\d.]+px\s+){2}([\d.]+)px", 1).try_cast("double")
    return F.when(blur.isNull() | (blur <= 2), "sm").when(blur <= 8, "md").when(blur <= 16, "lg").otherwise("xl")


def gradient_stops(gradient: Column) -> Column:
    """OP-161: commas outside the inner brackets, which part direction and stops; one at least."""
    inside = F.regexp_replace(F.regexp_extract(gradient, r"(?s)^[^(]*\((.*)\)[^)]*$", 1), r"\([^()]*\)", "")
    return F.greatest(F.length(inside) - F.length(F.replace(inside, F.lit(","), F.lit(""))), F.lit(1))


def gradient_kind(gradient: Column) -> Column:
    n = gradient_stops(gradient)
    return F.when(n <= 2, "subtle").when(n == 3, "brand").otherwise("bold")


def font_source(url: Column) -> Column:
    low = F.lower(url)
    return F.when(url.contains("fonts.googleapis.com"), "google-fonts").when(low.contains("cdn") | low.contains("jsdelivr"), "cdn").when(url.rlike(r"^\.{0,2}/"), "self-hosted").otherwise("system")


def image_kind(width: Column, height: Column) -> Column:
    size = F.greatest(F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0)))
    return F.when(size < 64, "avatar").when(size < 200, "thumbnail").when(size > 600, "hero").otherwise("gallery")


def stacking(z: Column) -> Column:
    """OP-68: struct(wars, gaps) of an array of stacking values: those out of bounds, and how many neighbours in order are over a hundred apart."""
    s = F.array_sort(z)
    n = F.greatest(F.size(s) - 1, F.lit(0))
    far = F.filter(F.zip_with(F.slice(s, 2, n), F.slice(s, 1, n), lambda a, b: a - b), lambda d: d > 100)
    return F.struct(F.filter(s, lambda v: F.abs(v) > 9999).alias("wars"), F.size(far).alias("gaps"))


def shared_keys(a: Column, b: Column) -> Column:
    """OP-54, 91: the names that two maps share, sorted."""
    return F.array_sort(F.array_intersect(F.map_keys(a), F.map_keys(b)))


def semantic_hues(hex_colours: Column) -> Column:
    """How many of the three groups success (green), error (red) and warning (yellow) an array of colours shows, by hue, of colours that aren't grey."""

    def group(h: Column) -> Column:
        r, g, b = (_channel(h, i) for i in (2, 4, 6))
        most, least = F.greatest(r, g, b), F.least(r, g, b)
        span, light = most - least, (most + least) / 2
        saturation = F.when(span == 0, 0.0).otherwise(span / F.when(light <= 0.5, most + least).otherwise(2 - most - least))
        hue = F.when(most == r, (g - b) / span).when(most == g, 2 + (b - r) / span).otherwise(4 + (r - g) / span) * 60
        hue = F.when(hue < 0, hue + 360).otherwise(hue)
        return F.when(saturation > 0.3, F.when((hue > 90) & (hue < 160), 1).when((hue < 30) | (hue > 340), 2).when((hue > 30) & (hue < 70), 3))

    return F.size(F.filter(F.array_distinct(F.transform(hex_colours, lambda h: F.when(h.rlike("^#[0-9a-f]{6}$"), group(h)))), lambda x: x.isNotNull()))


#: The names of the scores of ``coherence``, in their order.
SCORE_NAMES = ("color", "typography", "spacing", "shadows", "radii", "accessibility", "tokenisation", "layout", "responsiveness")


def report(site: Column, scores: Column, colours: Column) -> Column:
    """OP-163, in part: a design as Markdown: its coherence with a bar a score, what is under 70, and its colours by role. scores: from ``coherence``;
    colours: array of (role, hex, uses), in the order in which they are told."""
    bar = lambda v: F.concat(F.repeat(F.lit("\u2588"), F.bround(v / 10, 0).cast("int")), F.repeat(F.lit("\u2591"), 10 - F.bround(v / 10, 0).cast("int")))
    named = F.zip_with(F.array(*[F.lit(n) for n in SCORE_NAMES]), scores["scores"], lambda n, v: F.concat(F.rpad(n, 16, " "), F.lit(" "), bar(v), F.lit(" "), v.cast("string"), F.lit("%")))
    issues = F.transform(scores["issues"], lambda x: F.concat(F.lit("- "), x))

    def palette(role: str) -> Column:
        own = F.filter(colours, lambda c: c["role"] == role)
        rows = F.transform(own, lambda c: F.concat(F.lit("| `"), c["hex"], F.lit("` | "), c["uses"].cast("string"), F.lit(" |")))
        head = F.array(F.lit(""), F.lit(f"### {role.title()}"), F.lit(""), F.lit("| Hex | Count |"), F.lit("|-----|-------|"))
        return F.when(F.size(own) > 0, F.concat(head, rows)).otherwise(F.array().cast("array<string>"))

    lines = F.concat(
        F.array(F.concat(F.lit("# Design of "), site), F.lit(""), F.concat(F.lit("**Overall: "), scores["overall"].cast("string"), F.lit("/100 ("), scores["grade"], F.lit(")**")), F.lit("")), named,
        F.when(F.size(issues) > 0, F.concat(F.array(F.lit(""), F.lit("### Issues"), F.lit("")), issues)).otherwise(F.array().cast("array<string>")), *[palette(r) for r in ("background", "text", "border", "accent")],
    )
    return F.array_join(lines, "\n")


def coherence(t: Mapping[str, Column]) -> Column:
    """OP-69: struct of nine scores from 0 to 100, overall, grade and the names of those under 70. t: hexes (array), orphans, families, has_ratio, headings,
    outliers, spacings, shadow_tiers, radii, pairs, passing, variables, grids, gaps, widths, breakpoints (numbers, has_ratio a boolean). Halves
    round to the even number."""
    unit = lambda cond, n: F.when(cond, n).otherwise(0)
    colours = F.size(F.array_distinct(t["hexes"]))
    raw = {
        "color": 100 - unit(colours > 20, 2 * (colours - 20)) - 5 * t["orphans"] + unit(semantic_hues(t["hexes"]) >= 2, 10),
        "typography": 100 - unit(t["families"] > 3, 5 * (t["families"] - 3)) - unit(~t["has_ratio"], 10) + unit(t["headings"] >= 4, 10),
        "spacing": 100 - 5 * t["outliers"] + unit((t["outliers"] == 0) & (t["spacings"] > 0), 10),
        "shadows": 100 + unit(t["shadow_tiers"].between(3, 5), 20) - unit(t["shadow_tiers"] > 6, 10 * (t["shadow_tiers"] - 6)) - unit(t["shadow_tiers"] <= 1, 20),
        "radii": 100 + unit(t["radii"].between(3, 6), 10) - unit(t["radii"] > 8, 5 * (t["radii"] - 8)),
        "accessibility": F.when(t["pairs"] > 0, t["passing"] / F.greatest(t["pairs"], F.lit(1)) * 100).otherwise(50),
        "tokenisation": F.when(t["variables"] + colours > 0, t["variables"] / F.greatest(t["variables"] + colours, F.lit(1)) * 100).otherwise(0),
        "layout": 100 + unit(t["grids"] > 0, 10) + unit(t["gaps"].between(1, 3), 10) - unit(t["widths"] > 5, 10),
        "responsiveness": 70 + F.least(t["breakpoints"] * 10, F.lit(30)),
    }
    scores = {k: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), v.cast("double"))), 0).cast("int") for k, v in raw.items()}
    every = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("score")) for k, v in scores.items()])

    def told(xs: Column) -> Column:
        overall = F.bround(F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x["score"]) / len(scores), 0).cast("int")
        mark = F.lit("F")
        for least, g in reversed(GRADES):
            mark = F.when(overall >= least, g).otherwise(mark)
        return F.struct(
            F.transform(xs, lambda x: x["score"]).alias("scores"), overall.alias("overall"), mark.alias("grade"), F.transform(F.filter(xs, lambda x: x["score"] < 70), lambda x: x["name"]).alias("issues")
        )

    return F.transform(F.array(every), told)[0]
