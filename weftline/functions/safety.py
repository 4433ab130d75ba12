"""Text meant for machines that read pages, not for people: found and taken out, as Catalyst expressions (OP-63, 132, 134, 136, 141..145).

Each pass takes a text and gives struct(text, n): the text after it, and how many places it found. What a whole text must show before any of its
lines can be meant is tried first, so that most texts are never split into lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, functions as F

from weftline.functions.text import strip

# The gate (one of these words must be in a line before the pattern is tried) and the patterns.
GATE = ("ignore", "you are now", "instructions", "forget", "disregard", "override", "system", "admin", "act as", "pretend", "enter ", "obey", "decode", "execute")
INJECTION = (
    r"(?:ignore\s+(?:(?:all|your|the|my)\s+)*(?:previous|prior|above|safety)\s+(?:instructions?|context|rules?|guidelines?|constraints?|restrictions?)"
    r"|you\s+are\s+now\s+(?:a\s+)?"
    r"|new\s+(?:system\s+)?instructions?\s*:"
    r"|forget\s+(?:all\s+|everything\s+)?(?:above|previous|prior|you\s+(?:know|were|have))"
    r"|disregard\s+(?:all\s+)?(?:previous|prior|above)"
    r"|override\s+(?:all\s+)?(?:previous|prior|your|safety)\s*(?:protocols?|restrictions?|rules?|guidelines?|instructions?)?"
    r"|(?:system|assistant)\s*(?:prompt|message)\s*:"
    r"|(?:ADMIN|SYSTEM|ROOT)\s*:\s*(?:override|ignore|forget|disregard|enter|enable|disable|reveal|execute|you\s)"
    r"|act\s+as\s+(?:if\s+you\s+(?:are|were)\s+)?(?:a\s+)?(?:different|new|another|unrestricted|evil|unfiltered|jailbroken)"
    r"|pretend\s+(?:you\s+are|to\s+be)\s+"
    r"|enter\s+(?:developer|debug|unrestricted|jailbreak)\s+mode"
    r"|(?:you\s+(?:must|should|will)\s+)?(?:always\s+)?obey\s+(?:the\s+following|these|my)"
    r"|do\s+(?:not|anything)\s+(?:i\s+say|regardless)"
    r"|(?:decode|execute)\s+(?:the\s+following|these|this)\s+(?:base64|instructions?|commands?))"
)
ROLE_TAG = r"^</?(?:system|instructions?|context|prompt|user|assistant|message|task)>"
URGENCY = ("immediately", "urgent", "urgently", "critical", "critically", "must act now", "time-sensitive", "expires", "deadline", "act now", "right now", "without delay", "asap")
AUTHORITY = (
    r"(?:(?:officially|authoritatively)\s+confirmed|according\s+to\s+(?:internal|classified|confidential)|classified\s+(?:information|document|data)"
    r"|confidential\s+(?:source|information|data)|leaked\s+(?:document|information|data|memo)"
    r"|internal\s+(?:memo|document|source)s?\s+(?:reveal|show|confirm|indicate)|(?:official|authorized)\s+notice\s+from)"
)
AUTHORITY_GATE = ("confirmed", "according", "classified", "confidential", "leaked", "internal", "notice")
HIDDEN_SIGNS = "\u200b\u200c\u200d\ufeff\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
LOOKALIKES = ("аеорсухіАЕОРСТНМВКαεορΑΕΟΒΚΜΝΤ", "aeopcyxiAEOPCTHMBKaeopAEOBKMNT")
LEAKING_URL = r"(?:\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|[?&](?:secret|token|key|api[_-]?key|password|auth|session|data|exfil)=|\.(?:php|cgi)\?.*=)"


def _finding(text: Column, n: Column) -> Column:
    return F.struct(text.alias("text"), n.cast("int").alias("n"))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: Spark shares nothing between the uses of an expression inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _without(text: Column, may: Column, bad) -> Column:
    """The text without its bad lines, and their number. may: what must hold of a whole text that has a bad line, so that most texts are never split."""
    kept = _bound(F.split(text, "\n", -1), lambda ls: F.struct(F.filter(ls, lambda x: ~bad(x)).alias("kept"), F.size(ls).alias("all")))
    done = _bound(kept, lambda k: _finding(F.array_join(k["kept"], "\n"), k["all"] - F.size(k["kept"])))
    return F.when(may, done).otherwise(_finding(text, F.lit(0)))


def _within(words: tuple[str, ...]) -> str:
    return "(?i)(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")"


def gated(text: Column) -> Column:
    return text.rlike(_within(GATE))


def injects(text: Column) -> Column:
    return text.rlike("(?i)" + INJECTION)


def hidden_signs(text: Column) -> Column:
    """OP-136: zero-width and direction signs out."""
    clean = F.translate(text, HIDDEN_SIGNS, "")
    return _finding(clean, F.length(text) - F.length(clean))


def injection_lines(text: Column) -> Column:
    """OP-141: short lines that pass the gate and match, out."""
    return _without(text, gated(text) & injects(text), lambda x: (F.length(strip(x)) < 200) & gated(x) & injects(x))


def role_tag_lines(text: Column) -> Column:
    """OP-141: very short lines that begin with a role tag, out."""
    tag = "(?i)" + ROLE_TAG
    return _without(text, text.rlike(tag.replace("^", "")), lambda x: (F.length(strip(x)) < 80) & strip(x).rlike(tag))


def pressing_lines(text: Column) -> Column:
    """OP-142: lines that press (two of the urgent words) or claim authority; flagged only."""
    hurry = lambda x: F.regexp_count(x, F.lit(_within(URGENCY))) >= 2
    claims = lambda x: x.rlike(_within(AUTHORITY_GATE)) & x.rlike("(?i)" + AUTHORITY)
    n = F.size(F.filter(F.split(text, "\n", -1), lambda x: hurry(x) | claims(x)))
    return _finding(text, F.when(hurry(text) | claims(text), n).otherwise(0))


def lookalike_lines(text: Column) -> Column:
    """OP-143: lines that match only after letters of other scripts are read as the Latin ones they look like, out."""
    plain = lambda x: F.translate(x, *LOOKALIKES)
    bad = lambda x: (plain(x) != x) & x.rlike("[A-Za-z]") & ~injects(x) & (F.length(plain(x)) < 200) & injects(plain(x))
    return _without(text, (plain(text) != text) & injects(plain(text)), bad)


def leaking_images(text: Column) -> Column:
    """OP-144: Markdown images whose url would carry data away; flagged only."""
    urls = F.regexp_extract_all(text, F.lit(r"!\[([^\]]*)\]\(([^)]+)\)"), F.lit(2))
    return _finding(text, F.when(text.contains("]("), F.size(F.filter(urls, lambda u: u.rlike("(?i)" + LEAKING_URL)))).otherwise(0))


#: An entity, named or by number.
ENTITY = r"&(?:#(?:[xX][0-9a-fA-F]+|\d+)|[a-zA-Z]+);"
#: The named entities that stand for a sign of ASCII or a blank: what an instruction can be written with.
NAMED = {
    k: v for k, v in sorted(html5.items()) if k.endswith(";") and len(v) == 1 and (v.isascii() or v.isspace()) and v not in "\n&" and k[:-1].isalpha()
} | {"amp;": "&"}


def entity_lines(text: Column) -> Column:
    """OP-145: lines that match only after their entities (by number, and the named ones of ASCII signs and blanks) are resolved, out."""

    def resolved(x: Column) -> Column:
        parts = F.split(x, "&#", -1)
        # each later part begins with a number and ";" if it is an entity
        char = lambda n: F.when(n < 0x110000, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("")
        dec = lambda p: char(F.regexp_extract(p, r"^0*(\d{1,7});", 1).try_cast("bigint"))
        hexa = lambda p: char(F.conv(F.regexp_extract(p, r"^[xX]0*([0-9a-fA-F]{1,6});", 1), 16, 10).try_cast("bigint"))
        rest = F.transform(
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda p: F.when(p.rlike(r"^0*\d{1,7};"), F.concat(dec(p), F.regexp_replace(p, r"^\d+;", "")))
            .when(p.rlike(r"^[xX]0*[0-9a-fA-F]{1,6};"), F.concat(hexa(p), F.regexp_replace(p, r"^[xX][0-9a-fA-F]+;", "")))
            .otherwise(F.concat(F.lit("&#"), p)),
        )
        out = F.array_join(F.concat(F.slice(parts, 1, 1), rest), "")
        for name, sign in NAMED.items():
            out = F.replace(out, F.lit("&" + name), F.lit(sign))
        return out

    def bad(x: Column) -> Column:
        return x.rlike(ENTITY) & ~injects(x) & _bound(resolved(x), lambda y: (y != x) & (F.length(y) < 200) & injects(y))

    return _without(text, text.rlike(ENTITY), bad)


#: (category, what is done, the pass) in their order. A pass gives struct(text, n) of a text that isn't null.
PASSES: list[tuple[str, str, Callable[[Column], Column]]] = [
    ("unicode-tricks", "removed", hidden_signs),
    ("prompt-injection", "removed", injection_lines),
    ("delimiter", "removed", role_tag_lines),
    ("semantic-manipulation", "flagged", pressing_lines),
    ("homoglyph", "removed", lookalike_lines),
    ("exfiltration", "flagged", leaking_images),
    ("entity-evasion", "removed", entity_lines),
]


def sanitised(text: Column) -> Column:
    """OP-132: all passes in their order: struct(text, findings), findings being an array of (category, action, n) of those with any. Null counts as empty.
    Each pass is bound, so that the next ones don't compute it again."""
    none = F.array().cast("array<struct<category:string,action:string,n:int>>")

    def after(state: Column, category: str, action: str, run) -> Column:
        found = lambda r: F.when(r["n"] > 0, F.array(F.struct(F.lit(category).alias("category"), F.lit(action).alias("action"), r["n"].alias("n")))).otherwise(none)
        return _bound(state, lambda s: _bound(run(s["text"]), lambda r: F.struct(r["text"].alias("text"), F.concat(s["findings"], found(r)).alias("findings"))))

    state = F.struct(F.coalesce(text, F.lit("")).alias("text"), none.alias("findings"))
    for category, action, run in PASSES:
        state = after(state, category, action, run)
    return state


def sanitise(df, text: str):
    """OP-132 over a table: columns ``clean`` and ``findings``."""
    out = df.withColumn("_s", sanitised(F.col(text)))
    return out.withColumns({"clean": F.col("_s")["text"], "findings": F.col("_s")["findings"]}).drop("_s")
