"""From raw pages to clean, safe text: the composed pipeline (OP-146, 184, 185, 188, 189) and single results of a page's tree.

One order for all ways in: main content (or its precise or wide form), included or excluded tags, passes over the tree, Markdown; then, in
Catalyst, the relevance filter, the line filter, the passes over lines, and metadata. A page is parsed once, in one Arrow pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions import dom, page_safety
from weftline.functions import safety as sf
from weftline.functions import text as tx
from weftline.functions.dom import View

DEGREES: Mapping[str, Callable[[View], View]] = {"main": dom.main_content, "precise": dom.precise_content, "wide": dom.wide_content}


@dataclass(frozen=True)
class PageOptions:
    """What is taken from a page. degree: "main", "precise", "wide", or None for all of it. include and exclude rule each other out. query: only the
    paragraphs that match it best. clean: without promotion (HTML) and lines of interface. safe: without what is meant for machines."""

    degree: str | None = "main"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    query: str | None = None
    clean: bool = True
    safe: bool = True

    def __post_init__(self):
        if self.include and self.exclude:
            raise ValueError("include and exclude rule each other out")
        if self.degree is not None and self.degree not in DEGREES:
            raise ValueError(f"degree {self.degree!r}")
        for s in (*self.include, *self.exclude):
            dom.compile_selector(s)


def taken(page: str, options: PageOptions) -> tuple[View, dict[str, int]]:
    """The view of a page that the options ask for, and what the passes over it found."""
    v = View(dom.parse(page))
    if options.degree:
        v = DEGREES[options.degree](v)
    if options.include:
        v = dom.included(v, options.include)
    elif options.exclude:
        v = dom.excluded(v, options.exclude)
    found = page_safety.sanitise_view(v) if options.safe else {}
    return (dom.without_promotion(v) if options.clean else v), found


def read_trees(df: DataFrame, key: str, html: str, results: Mapping[str, tuple[Callable[[View], object], str, pa.DataType]]) -> DataFrame:
    """key, and of each page the results by name: (function of a view of its own, Spark type, Arrow type). Pages are parsed once. Null pages count as
    empty ones. A function must only hide, not change, what it reads, unless it is the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: dict[str, list] = {name: [] for name in results}
            for page in b.column(1).to_pylist():
                root = dom.parse(page or "")
                for name, (of, _, _) in results.items():
                    columns[name].append(of(View(root)))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(columns[n], t) for n, (_, _, t) in results.items()]], names=[key, *results])

    key_type = df.schema[key].dataType.simpleString()
    return df.select(key, html).mapInArrow(run, ", ".join([f"`{key}` {key_type}", *[f"`{n}` {t}" for n, (_, t, _) in results.items()]]))


def prepared(df: DataFrame, key: str, html: str, options: PageOptions = PageOptions()) -> DataFrame:
    """key, html (what was taken), content (its Markdown after all filters), findings (array of category, action, n: of the tree, then of the lines) and
    metadata of each page. Null and empty pages have empty contents; pages that are no HTML are taken as text. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page in b.column(1).to_pylist():
                v, found = taken(page or "", options)
                rows.append((v.outer(), dom.to_markdown(v), list(found.items())))
            arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.map_(pa.string(), pa.int32())))]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=[key, "html", "content", "_found"])

    key_type = df.schema[key].dataType.simpleString()
    out = df.select(key, html).mapInArrow(run, f"`{key}` {key_type}, html string, content string, _found map<string,int>")
    if options.query:
        out = out.withColumn("content", tx.relevant(F.col("content"), options.query))
    if options.clean:
        out = out.withColumn("content", tx.clean_content(F.col("content")))
    action = F.create_map(*[F.lit(x) for name, _, done, _ in page_safety.PASSES for x in (name, done)])
    findings: Column = F.transform(F.map_entries("_found"), lambda e: F.struct(e["key"].alias("category"), action[e["key"]].alias("action"), e["value"].alias("n")))
    if options.safe:
        out = out.withColumn("_s", sf.sanitised(F.col("content")))
        out = out.withColumn("content", F.col("_s")["text"])
        findings = F.concat(findings, F.col("_s")["findings"])
    return out.select(key, "html", "content", findings.alias("findings"), tx.content_metadata(F.col("content")).alias("metadata"))


def distinct_pages(pages: DataFrame, key: str) -> DataFrame:
    """OP-189: of prepared pages with equal contents the one with the least key; those without content by their HTML, those without both stay. Pages are
    prepared once."""
    of = F.coalesce(F.nullif("content", F.lit("")), F.nullif("html", F.lit("")))
    alone = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
    rest = [c for c in pages.columns if c != key]
    row = pages.withColumn("_h", F.coalesce(F.md5(F.encode(of, "UTF-8")), alone)).groupBy("_h").agg(F.min(key).alias(key), F.min_by(F.struct(*rest), key).alias("_r"))
    return row.select(key, "_r.*")
