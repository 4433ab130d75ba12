"""Operators over tables: nulls in any column, empty tables, repeats, hot keys beyond a broadcast, sources and sinks, streams."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.functions import design, records, video
from weftline.functions import text as tx
from weftline.functions.dom import View, parse
from weftline.operators import crawl, frontier, robots, skew
from weftline.sources import files


@pytest.mark.parametrize("most", [100_000, 0])
def test_lookup_broadcast_and_salted(spark, most, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", most)
    df = spark.createDataFrame([("hot", i) for i in range(300)] + [("a", 1), (None, 2), ("none", 3), ("a", 1)], "k string, v int")
    small = spark.createDataFrame([("hot", 10), ("a", 20), (None, 30)], "k string, w int")
    got = Counter((r.k, r.w) for r in skew.lookup(df, small, ["k"]).collect())
    assert got == {("hot", 10): 300, ("a", 20): 2, (None, 30): 1, ("none", None): 1}
    assert skew.lookup(df, small.limit(0), ["k"]).where("w IS NULL").count() == 304 and skew.lookup(df.limit(0), small, ["k"]).count() == 0
    with pytest.raises(ValueError):
        skew.lookup(df, small.withColumnRenamed("w", "v"), ["k"])


def test_in_order_and_starts_over_blocks(spark):
    rng = random.Random(1)
    seqs = rng.sample(range(3000), 500)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", None]), s, float(s // 3)) for s in seqs]
    df = spark.createDataFrame(rows, "h string, seq long, at double")
    for block in (7, 4096):
        got = {r.seq: (r.place, r.before) for r in frontier.in_order(df, ["h"], "seq", block).collect()}
        for h in ("hot", "a", None):
            own = sorted(s for k, s, _ in rows if k == h)
            assert [got[s] for s in own] == [(i + 1, own[i - 1] if i else None) for i in range(len(own))]
    start = {r.seq: r.start for r in frontier.earliest_starts(df, "h", "seq", "at", 2.0).collect()}
    for h in ("hot", "a", None):
        last = -1e9
        for _, s, at in sorted((r for r in rows if r[0] == h), key=lambda r: r[1]):
            last = max(at, last + 0.5)
            assert abs(start[s] - last) < 1e-6
    assert frontier.in_order(df.limit(0), ["h"], "seq").count() == 0


def test_folds_with_null_hosts(spark):
    rows = [(None, 1, False, 5.0), (None, 2, False, None), (None, 9000, False, 7.0), ("a", 3, True, 1.0), ("a", 4, None, 2.0), (None, None, True, 1.0)]
    log = spark.createDataFrame(rows, "hostname string, seq long, ok boolean, response_ms double").withColumn("bytes", F.lit(1)).withColumn("block", F.lit("clash"))
    assert {r[0]: r[1] for r in frontier.failures_in_a_row(log, F.col("hostname")).collect()} == {None: 3, "a": 1}
    assert {r[0]: round(r[1], 6) for r in frontier.ewma(log, F.col("hostname")).collect()} == {None: 5.6, "a": 1.3}
    kind = frontier.event_kind(F.col("ok"), F.lit(503))
    assert {r.hostname: (r.ok_count, r.fail_count, r.urls_fetched) for r in frontier.host_totals(log, F.col("hostname"), kind).collect()} == {None: (1, 3, 1), "a": (1, 1, 1)}
    for f in (frontier.failures_in_a_row, frontier.ewma, frontier.host_totals):
        assert f(log.limit(0), F.col("hostname")).count() == 0


def test_visits(spark):
    shape = "fp binary, url string, job_id string, status_code int, etag string, last_modified string, fetched_at double, next_refresh_at double"
    old = spark.createDataFrame([(b"1", "u", "j", 200, "e1", None, 10.0, 20.0), (b"1", "u", "j", 404, "e0", None, 5.0, None), (b"2", "v", "j", 200, "e2", None, 11.0, 30.0), (None, "w", "j", 200, None, None, 1.0, 2.0)], shape)
    new = spark.createDataFrame([(b"1", "u", "k", 304, None, None, 50.0, None), (b"3", "x", "k", 304, None, None, 60.0, None), (b"2", "v", "k", 500, None, None, 1.0, None)], shape)
    got = {bytes(r.fp): r for r in frontier.upserted(old, new, 1.0).collect()}
    assert (got[b"1"].status_code, got[b"1"].etag, got[b"1"].next_refresh_at) == (200, "e1", 50.0 + 86400)
    assert got[b"2"].status_code == 200 and got[b"3"].status_code == 304 and len(got) == 3
    assert [bytes(r.fp) for r in frontier.due(old, 25.0).collect()] == [b"1"]
    assert frontier.upserted(old.limit(0), new.limit(0), 1.0).count() == 0
    keyed = frontier.keyed(spark.createDataFrame([(None, "http://a.example/"), (b"9", None), (None, "mailto:x")], "fp binary, url string")).collect()
    assert sum(r.fp is None for r in keyed) == 1 and {len(r.fp) for r in keyed if r.fp} == {16, 1}


def test_until_terminal(spark):
    df = spark.createDataFrame([("a", 1, "ok", False), ("a", 2, "stop", True), ("a", 3, "ok", False), ("b", 1, "ok", None), (None, 5, "stop", True), (None, 9, "ok", False)], "k string, n int, outcome string, terminal boolean")
    got = {(r.k, r.outcome): r.n for r in frontier.until_terminal(df, "k", "n", "outcome", "terminal").collect()}
    assert got == {("a", "ok"): 1, ("a", "stop"): 1, ("a", "skipped"): 1, ("b", "ok"): 1, (None, "stop"): 1, (None, "skipped"): 1}


@pytest.mark.parametrize("most", [100_000, 0])
def test_walks(spark, most, monkeypatch):
    monkeypatch.setattr(crawl, "BROADCAST_ROWS", most)
    edges = spark.createDataFrame([("hub", f"n{i}") for i in range(50)] + [("n1", "far"), ("n1", "hub"), (None, "x"), ("hub", None), ("hub", "n1")], "src string, dst string")
    seeds = spark.createDataFrame([("hub",), (None,)], "node string")
    got = {r.node: r.depth for r in crawl.bfs(edges, seeds, 5).collect()}
    assert got["far"] == 2 and len(got) == 52
    assert [r.node for r in crawl.bfs(edges, seeds, 5, 3).collect()] == ["hub", "n0", "n1"]
    assert crawl.bfs(edges.limit(0), seeds, 2).count() == 1


def test_crawl_delay():
    body = "User-agent: a\nUser-agent: b\nCrawl-delay: 2.5\nDisallow: /x\n\nUser-agent: *\nCrawl-delay: soon\nCrawl-delay: 4"
    assert robots.crawl_delay(body, "B-bot") == 2.5 and robots.crawl_delay(body, "c") == 4.0 and robots.crawl_delay(None, "c") is None and robots.crawl_delay("Crawl-delay: 1", "c") is None


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "u.csv").write_text("﻿url,x\nhttps://a.example/,1\nmailto:x,2\nhttps://b.example/,3\nhttps://a.example/,4\n", encoding="utf-8")
    assert [r.url for r in files.csv_urls(spark, str(tmp_path / "u.csv"), "url").orderBy("at").collect()] == ["https://a.example/", "https://b.example/"]
    df = spark.createDataFrame([(1, "x", dt.datetime(2024, 1, 1, 5)), (2, None, dt.datetime(2024, 1, 2, 5))], "id int, t string, at timestamp")
    files.write_days(df, "at", str(tmp_path / "days"))
    assert spark.read.json(str(tmp_path / "days")).select(F.col("day").cast("string"), "id").orderBy("id").collect()[0][0] == "2024-01-01"
    files.write_envelopes(df.select("id"), str(tmp_path / "env"), source="s")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "env")).collect())[0] == '{"data":{"id":1},"meta":{"source":"s"}}'
    files.write_lines(df, str(tmp_path / "lines"), "id, none")
    assert spark.read.json(str(tmp_path / "lines")).columns == ["id"]
    files.write_text(df, "t", str(tmp_path / "text"))
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["x"]
    assert files.not_in_journal(spark, df, str(tmp_path / "none"), "id").count() == 2
    (tmp_path / "journal.json").write_text('{"id": 1, "status": "ok"}\n{"id": 2, "status": "error"}\nbroken\n')
    assert [r.id for r in files.not_in_journal(spark, df, str(tmp_path / "journal.json"), "id").collect()] == [2]
    with pytest.raises(ValueError):
        files.folder_of(F.col("u"), F.col("t"), "none")
    with pytest.raises(ValueError):
        records.projected(df, "none")


def test_odd_values_of_functions(spark):
    one = spark.range(1)
    null = F.lit(None).cast("string")
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(records.jar_state(F.lit(None).cast("array<struct<name:string,expires:double>>"), F.lit(0.0))).verdict == "empty"
    assert get(records.disposition_name(null)) is None and get(records.url_name(F.lit(""))) == "download" and get(records.binary_name(null)) is False
    assert get(records.recipe_problems(null)) == ["no mapping"] and get(records.within_characters(F.array(null, F.lit("abc")), 2)) == ["", "ab"]
    assert get(records.captured(F.lit("/a.png"), null, F.lit(None).cast("long"), "*.png")) is True and get(records.captured(F.lit("/a.png"), null, F.lit(1), None, "image")) is False
    assert get(design.spacing(F.array(F.lit(-1), F.lit(None).cast("int")))).base == 4 and get(design.semantic_hues(F.array(F.lit("#ff0000"), F.lit("#00ff00"), F.lit("bad")))) == 2
    assert get(tx.relevant(F.lit("a b c d e"), "zz")) == "a b c d e" and get(tx.relevant(null, "a")) is None and get(tx.relevant(F.lit("x"), "")) == "x"
    assert get(tx.signal_map(null)) is None and get(tx.signal_map(F.lit("a=1,A=2"))) == {"a": "2"}
    assert video.videos(View(parse("<iframe><a href>x</a><meta property='og:video'>")), "") == []
    df = spark.createDataFrame([(1, "## A\nx\n### B\ny\n## C"), (1, "## D"), (2, None), (3, ""), (4, "#none\n## \n##E")], "k long, t string")
    assert sorted((r.k, r.title, r.body) for r in tx.sections(df, "k", "t").collect()) == [(1, "A", "x\n### B\ny"), (1, "B", "y"), (1, "C", ""), (1, "D", "")]


def test_requests_meet_answers_in_a_stream(spark, tmp_path):
    from weftline.streaming.folds import answered, windowed_totals

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([("r1", at(0)), ("r2", at(1)), ("late", at(2))], "request_id string, sent_at timestamp").write.parquet(str(tmp_path / "sent"))
    spark.createDataFrame([("r1", at(1)), ("late", at(40))], "request_id string, answered_at timestamp").write.parquet(str(tmp_path / "answers"))
    read = lambda name, shape: spark.readStream.schema(shape).parquet(str(tmp_path / name))
    joined = answered(read("sent", "request_id string, sent_at timestamp"), read("answers", "request_id string, answered_at timestamp"), "10 minutes")
    q = joined.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = {r.request_id: r.answered_at for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out.get("r1") == at(1) and out.get("late") is None
    spark.createDataFrame([("a", at(0), True, 5), ("a", at(1), False, None), (None, at(1), None, 1)], "host string, t timestamp, ok boolean, bytes long").write.parquet(str(tmp_path / "log"))
    got = {}
    w = windowed_totals(read("log", "host string, t timestamp, ok boolean, bytes long"), "host", "t", "10 minutes", "5 minutes")
    q = w.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).foreachBatch(lambda df, _: got.update({r.host: (r.fetches, r.failures) for r in df.collect()})).start()
    q.awaitTermination()
    assert got == {"a": (2, 1), None: (1, 1)}
