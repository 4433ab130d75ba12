"""Whether robots rules allow a url (OP-10), and line differences between two texts (OP-100)."""

from __future__ import annotations

import difflib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from weftline.functions.urls import origin_of
from weftline.operators.skew import lookup


@lru_cache(4096)
def rules(body: str, agent: str) -> tuple[tuple[int, bool, re.Pattern], ...]:
    """The rules of the agent's own groups, else of *; each with its length. * stands for anything, a final $ for the end."""
    groups: dict[str, list] = {}
    names: list[str] = []
    in_rules = False
    for line in body.splitlines():
        field, colon, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "user-agent":
            names = [] if in_rules else names
            names.append(value.lower())
            groups.setdefault(value.lower(), [])
            in_rules = False
        elif field in ("allow", "disallow"):
            in_rules = True
            if value:
                end = value.endswith("$")
                form = re.compile(".*".join(map(re.escape, value.rstrip("$").split("*"))) + ("$" if end else ""))
                for n in names:
                    groups[n].append((len(value), field == "allow", form))
    own = [r for n, rs in groups.items() if n != "*" and n and n in agent.lower() for r in rs]
    return tuple(own or groups.get("*", []))


@lru_cache(4096)
def crawl_delay(body: str | None, agent: str) -> float | None:
    """OP-10: the seconds that a site asks the agent (else all) to leave between requests; None if it says nothing or no number."""
    found: dict[str, float] = {}
    names: list[str] = []
    in_rules = False
    for line in (body or "").splitlines():
        field, colon, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            names = [value.lower()] if in_rules else [*names, value.lower()]
            in_rules = False
        elif colon:
            in_rules = True
            if field == "crawl-delay" and re.fullmatch(r"\d+(?:\.\d+)?", value):
                found |= {n: float(value) for n in names if n not in found}
    return next((d for n, d in found.items() if n not in ("", "*") and n in agent.lower()), found.get("*"))


def allows(body: str | None, url: str, agent: str) -> bool:
    """The longest rule that fits decides, allow on ties; without any the url is allowed."""
    if not body:
        return True
    path = re.sub(r"^[^:/?#]+://[^/?#]*", "", url).split("#", 1)[0] or "/"
    fits = [(n, ok) for n, ok, form in rules(body, agent) if form.match(path)]
    return max(fits)[1] if fits else True


def permitted(urls: DataFrame, robots: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """urls with ``allowed`` and ``delay`` (seconds that the site asks for, or null). robots: origin, body, a row an origin; urls of other origins are allowed,
    null ones get null."""

    @F.pandas_udf(T.BooleanType())
    def judge(body: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else allows(b, x, agent) for b, x in zip(body, u)], dtype=object)

    @F.pandas_udf(T.DoubleType())
    def pause(body: pd.Series) -> pd.Series:
        return pd.Series([crawl_delay(b, agent) for b in body], dtype=object)

    r = robots.where("origin IS NOT NULL").select(F.col("origin").alias("_o"), F.col("body").alias("_body"))
    met = lookup(urls.withColumn("_o", origin_of(F.col(url))), r, ["_o"])
    return met.withColumns({"allowed": judge("_body", url), "delay": pause("_body")}).drop("_o", "_body")


@F.pandas_udf(T.StructType([T.StructField("added", T.IntegerType()), T.StructField("removed", T.IntegerType()), T.StructField("diff", T.StringType())]))
def difference(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Unified difference of two texts by lines, with the counts of added and removed lines; null texts count as empty."""
    out = []
    for a, b in zip(before, after):
        x, y = (a or "").split("\n"), (b or "").split("\n")
        ops = [o for o in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if o[0] != "equal"] if x != y else []
        out.append((sum(o[4] - o[3] for o in ops), sum(o[2] - o[1] for o in ops), "\n".join(difflib.unified_diff(x, y, "before", "after", lineterm=""))))
    return pd.DataFrame(out, columns=["added", "removed", "diff"])
