"""Core functions against hand-made cases: nulls, empties, ties, clashing columns, hot keys."""

from collections import Counter
from urllib.parse import urljoin

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import dom, page_safety, urls
from weftline.functions.urls import py_canonical_url, py_fingerprint, site_key
from weftline.operators import crawl, frontier, pages, skew, tech

URLS = [
    ("HTTP://Example.COM:80/a%2fb?b=2&a=1#x", "http://example.com/a%2Fb?a=1&b=2"),
    ("https://example.com:443", "https://example.com"),
    ("https://u:P@Ex.com:8443/?utm_source=x&q=", "https://u:P@ex.com:8443/"),
    ("https://bücher.example/ü?k=ü", "https://xn--bcher-kva.example/ü?k=%C3%BC"),
    ("https://e.com/?a=b+c&a=%7e~", "https://e.com/?a=b%20c&a=~~"),
    ("https://[::1]:443/x", "https://[::1]/x"),
    ("ftp://example.com/a", None),
    ("example.com/a", None),
    ("", None),
    (None, None),
]


@pytest.mark.parametrize("url,want", URLS)
def test_canonical(url, want):
    assert py_canonical_url(url) == want


def test_canonical_is_stable():
    for url, want in URLS:
        if want:
            assert py_canonical_url(want) == want


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_canonical_never_fails(tail):
    c = py_canonical_url("http://h.example/" + tail)
    assert c is None or c.startswith("http://h.example/")


def test_fingerprint():
    a = py_fingerprint("get", "http://e.com/?b=1&utm_id=2")
    assert len(a) == 16 and a == py_fingerprint("GET", "HTTP://E.com:80/?b=1") != py_fingerprint("POST", "http://e.com/?b=1")
    assert a != py_fingerprint("GET", "http://e.com/?b=1", b"body") and py_fingerprint("GET", "mailto:x") is None


def test_native_forms_agree(spark):
    ascii_ = [u for u, _ in URLS if u and u.isascii()]
    df = spark.createDataFrame([(u,) for u in [*ascii_, None]], "url string")
    for r in df.select("url", urls.canonical_url("url").alias("a"), urls.canonical_url_native(F.col("url")).alias("b")).collect():
        assert r.a == r.b, r


def test_join_url(spark):
    cases = [("http://e.com/a/b", x) for x in ("c", "../d", "/e", "//f.com/g", "?q=1", "#h", "http://i.com")] + [(None, "x"), ("http://e.com", None)]
    for r in spark.createDataFrame(cases, "b string, u string").select("b", "u", urls.join_url("b", "u").alias("x")).collect():
        assert r.x == (urljoin(r.b, r.u) if r.b and r.u else None)


def test_site_key(spark):
    cases = [(" WWW.E.com. ", None, "www.e.com"), ("e.com:8080", None, "e.com"), ("", "https://X.com:1/a", "x.com"), (None, "ftp://x.com", None), (None, None, None), (" e.com", None, "e.com"), (" ", " http://u:p@z.com./q", "z.com")]
    for r in spark.createDataFrame(cases, "h string, u string, want string").select("*", site_key(F.col("h"), F.col("u")).alias("got")).collect():
        assert r.got == r.want, r


def test_eager_join_equals_the_join(spark):
    left = [("hot", 1)] * 50 + [("a", 2), (None, 3), (None, 4), ("only left", 5)]
    right = [("hot", 10)] * 40 + [("a", None), (None, 7), ("only right", 8)]
    ls = skew.key_states(spark.createDataFrame(left, "k string, v int"), {"k": F.col("k")}, {"lv": F.col("v")}, skew.LEFT_N)
    rs = skew.key_states(spark.createDataFrame(right, "k string, v int"), {"k": F.col("k")}, {"rv": F.col("v")}, skew.RIGHT_N)
    got = {r.k: r for r in skew.eager_join(ls, rs, ["k"], ["lv"], ["rv"]).collect()}
    pairs = [(a, b) for a in left for b in right if a[0] == b[0]]
    for k in {a[0] for a in left} | {b[0] for b in right}:
        mine = [(a, b) for a, b in pairs if a[0] == k]
        assert got[k].pairs == len(mine)
        if mine:
            assert got[k].lv_over_pairs == sum(a[1] for a, _ in mine)
            values = [b[1] for _, b in mine if b[1] is not None]
            assert got[k].rv_over_pairs == (sum(values) if values else None)
    with pytest.raises(ValueError):
        skew.eager_join(ls, rs.withColumnRenamed("rv", "lv"), ["k"])
    empty = ls.limit(0)
    assert skew.eager_join(empty, rs.limit(0), ["k"]).count() == 0


def test_ewma_blocks(spark):
    xs = [float((i * 37) % 101) for i in range(200)]
    log = spark.createDataFrame([("h", i, True, x) for i, x in enumerate(xs)] + [("one", 5, True, 3.0), ("none", 6, True, None)], "hostname string, seq long, ok boolean, response_ms double")
    want = xs[0]
    for x in xs[1:]:
        want = 0.7 * want + 0.3 * x
    for block in (7, 64, 4096):
        got = {r.hostname: r.ewma_ms for r in frontier.ewma(log, F.col("hostname"), block).collect()}
        assert abs(got["one"] - 3.0) < 1e-9 and abs(got["h"] - want) < 1e-9 and "none" not in got


def test_failures_in_a_row(spark):
    rows = [("a", 1, True), ("a", 2, False), ("a", 3, None), ("b", 1, False), ("c", 1, False), ("c", 2, True)]
    log = spark.createDataFrame(rows, "hostname string, seq long, ok boolean")
    assert {r[0]: r[1] for r in frontier.failures_in_a_row(log, F.col("hostname")).collect()} == {"a": 2, "b": 1, "c": 0}


def test_bfs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", None), ("x", "y")], "src string, dst string")
    got = {r.node: r.depth for r in crawl.bfs(edges, spark.createDataFrame([("a",), ("a",), (None,)], "node string"), 5).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_sitemaps_of_any_depth(spark):
    index = lambda x: f"<sitemapindex><sitemap><loc>{x}</loc></sitemap></sitemapindex>"
    bodies = [(f"m{i}", index(f"m{i + 1}")) for i in range(7)] + [("m7", "<urlset><url><loc>https://s.example/deep</loc></url></urlset>")]
    got = crawl.discover(spark.createDataFrame(bodies, "url string, body string"), spark.createDataFrame([("m0",)], "url string"))
    assert [r.url for r in got.collect()] == ["https://s.example/deep"]


PAGE = """<html><body><nav><a href=/x>Home</a></nav><main id=m class="a b"><h1>T &amp; U</h1><p>One <b>bold</b><p>Two <a href="/l">link</a> that is long enough to count as text.
<ul><li>i<li>j</ul><pre>x
 y</pre><div style="display:none">ignore this text, it is hidden from view</div></main><footer>foot</footer></body></html>"""


def test_dom():
    view = lambda x: dom.View(dom.parse(x))
    main = dom.main_content(view(PAGE))
    md = dom.to_markdown(main)
    assert "# T & U" in md and "One **bold**" in md and "[link](/l)" in md and "- i\n- j" in md and "```\nx\n y\n```" in md and "foot" not in md
    assert [n.tag for n in view(PAGE).select("main > p, #m li, [href^='/l']")] == ["p", "p", "a", "li", "li"]
    assert page_safety.sanitise_view(view(PAGE)) == {"hidden-text": 1}
    assert dom.included(view(PAGE), ("h1",)).outer() == "<div><h1>T &amp; U</h1></div>" and "foot" not in dom.excluded(view(PAGE), ("footer",)).outer()
    roles = dom.accessibility(view(PAGE))
    assert [r["role"] for r in roles[:4]] == ["navigation", "link", "main", "heading"] and roles[1]["depth"] == 1
    for bad in ("", "<", "<p", "<b><i></b>", "</p></div>", "<a href='x", "<![", "<!x", "<div>" * 5000 + "deep"):
        v = view(bad)
        dom.main_content(v), dom.accessibility(v), dom.to_markdown(v), v.outer(), page_safety.sanitise_view(v)
    with pytest.raises(ValueError):
        view(PAGE).select("a:hover")


def test_prepared_pages(spark):
    with pytest.raises(ValueError):
        pages.PageOptions(include=("p",), exclude=("a",))
    rows = [(1, PAGE), (2, None), (3, ""), (4, "no tags & more"), (5, PAGE)]
    df = spark.createDataFrame([(i, x, "clash") for i, x in rows], "id long, page string, content string")
    got = {r.id: r for r in pages.prepared(df, "id", "page", pages.PageOptions(degree=None, exclude=("nav",), query="link")).collect()}
    assert got[2].content == got[3].content == "" and got[4].content == "no tags & more" and "hidden from view" not in got[1].html and got[1].findings[0].category == "hidden-text"
    assert sorted(r.id for r in pages.distinct_pages(pages.prepared(df, "id", "page"), "id").collect()) == [1, 2, 3, 4]
    assert pages.prepared(df.limit(0), "id", "page").count() == 0


def test_tech_book():
    assert tech.closure({"a": [("b", 50), ("b", 60)], "b": [("c", 80)], "c": [("a", 10)]}) == {"a": {"b": 60, "c": 80}, "b": {"a": 10, "c": 80}, "c": {"a": 10, "b": 60}}
    assert tech.parse_pattern("t", "html", "", "(") is None
    base = {"a": {"html": ["x"], "meta": {"g": "1"}, "dom": {"p": {"text": "t"}}, "implies": ["b", "c"]}, "b": {"dom": ["q"]}}
    got = tech.overlay(base, {"a": {"html": ["x", "y"], "meta": {"h": "2"}, "dom": ["i"]}, "b": {"dom": {"r": {}}}, "d": {"url": "u"}}, {"c"})
    assert got["a"] == {"html": ["x", "y"], "meta": {"g": "1", "h": "2"}, "dom": {"i": {}, "p": {"text": "t"}}, "implies": ["b"]} and got["b"]["dom"] == {"q": {}, "r": {}} and got["d"] == {"url": "u"}
    assert tech.fixed_part(r"(?:a|b)jquery[.-]min") == "jquery" and tech.fixed_part("a.b") == "" and tech.fixed_part("abc?d") == ""
    assert tech.selector_regexes("a.ad") is None and tech.selector_regexes("[x]") is None and tech.selector_regexes("p.shop-x")
    m = __import__("re").search("(a)(b)?", "ab")
    assert tech.version_of(m, "\\1.\\2") == "a.b" and tech.version_of(m, "x\\3") == "x"


def test_tech_signals_of_odd_pages(spark):
    book = tech.Book.of({"T": {"cats": [5], "cookies": {"sid": "^9$", "s_*": r"(\d)\;version:\1"}, "implies": "U"}, "U": {}, "V": {"implies": "none"}})
    page = spark.createDataFrame([(1, "<p>", {"Set-Cookie": "sid=abc; path=/"}), (2, None, None), (3, "", {"set-cookie": "s_x=7"})], "id int, html string, headers map<string,string>")
    got = {r.id: [(x.tech, x.version, x.categories) for x in r.technologies] for r in tech.detect(page, "id", "html", headers="headers", book=book).collect()}
    assert got == {1: [("T", None, ["5"]), ("U", None, [])], 2: [], 3: [("T", "7", ["5"]), ("U", None, [])]}
    assert tech.detect(page.limit(0), "id", "html").count() == 0


def test_unseen_and_one_per_host(spark):
    f = spark.createDataFrame([(b"1", 1, "h", 0, 5.0), (b"1", 2, "h", 9, 4.0), (b"2", 3, "h", 9, 4.0), (None, 4, None, 1, None)], "fp binary, seq long, hostname string, priority int, added_at double")
    assert [r.seq for r in frontier.unseen(f, f.where("seq = 3")).collect()] == [1]
    assert [(r.hostname, r.seq) for r in frontier.one_per_host(f).collect()] == [("h", 2)]


def test_host_state_stream(spark, tmp_path):
    from weftline.streaming.folds import host_states

    rows = [("a", 1, True, 10.0), ("a", 2, False, 20.0), ("b", 3, False, None)]
    spark.createDataFrame(rows, "hostname string, seq long, ok boolean, response_ms double").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("hostname string, seq long, ok boolean, response_ms double").parquet(str(tmp_path / "in"))
    got: dict = {}
    q = host_states(src).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, _: got.update({r.hostname: tuple(r) for r in df.collect()})).start()
    q.awaitTermination()
    assert got["a"] == ("a", 1, 1, 1, 13.0) and got["b"][:4] == ("b", 0, 1, 1)
    assert Counter(got)["a"]
