"""The crawl's tables as relations: joins of frontier, visited, host statistics and budgets; folds of the fetch log; what is due, by windows and aggregates
(OP-31, 41..46, 55..62, 73, 74, 78..80, 89, 90, 171, 175, 176, 178, 181).

A hostname may be null (a group of its own) and one may hold a third of all rows: what is known of a host is looked up by a broadcast whose size is
checked, or by a salted join; folds over a host's rows are made of blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions.urls import fingerprint
from weftline.operators.skew import lookup

# Smoothing of response times, bounds of the adaptive delay, failures in a row that rest a host, its rest in seconds, the longest pause, and
# statuses that are tried again.
ALPHA = 0.3
DELAY_MS = (200.0, 10000.0)
SICK_AFTER = 10
SICK_SECONDS = 600.0
LONGEST_PAUSE = 120.0
RETRY_STATUSES = (408, 429, 500, 502, 503, 504, 522, 524)
#: Rows of a key's order that are folded in one go.
BLOCK = 4096


def keyed(requests: DataFrame, method: str | None = None) -> DataFrame:
    """Requests whose fp is null get the fingerprint of their method and url; what has no http(s) url keeps null."""
    m = F.col(method) if method else F.lit("GET")
    known = requests.where("fp IS NOT NULL")
    return known.unionByName(requests.where("fp IS NULL").withColumn("fp", fingerprint(m, F.col("url"))))


def latest_visit(visited: DataFrame) -> DataFrame:
    """OP-175: of each fp the row fetched last; ties go to the greater url. Null fps have no row. max_by is aggregated before its shuffle."""
    row = F.struct(*[c for c in visited.columns if c != "fp"])
    order = F.struct(F.coalesce("fetched_at", F.lit(float("-inf"))), F.coalesce("url", F.lit("")), F.coalesce("job_id", F.lit("")), F.coalesce("status_code", F.lit(-1)))
    return visited.where("fp IS NOT NULL").groupBy("fp").agg(F.max_by(row, order).alias("v")).select("fp", "v.*")


def upserted(visited: DataFrame, fetched: DataFrame, refresh_days: float) -> DataFrame:
    """OP-175, 176: visited with new fetches (columns as visited): the latest of each fp holds, but an unchanged answer (304) only moves its times and keeps
    status, etag and last_modified of the one before. next_refresh_at is refresh_days after the fetch."""
    base = latest_visit(visited)
    new = latest_visit(fetched)
    kept = lambda c: F.when((F.col("n.status_code") == 304) & F.col("o.fp").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    both = base.alias("o").join(new.alias("n"), F.col("o.fp") == F.col("n.fp"), "full")
    newer = F.col("n.fp").isNotNull() & (F.coalesce("n.fetched_at", F.lit(float("-inf"))) >= F.coalesce("o.fetched_at", F.lit(float("-inf"))))
    columns = []
    for c in visited.columns:
        value = kept(c) if c in ("status_code", "etag", "last_modified") else F.col("n.fetched_at") + refresh_days * 86400 if c == "next_refresh_at" else F.col(f"n.{c}")
        columns.append(F.when(newer, value).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*columns)


def due(visited: DataFrame, now: float) -> DataFrame:
    """OP-175: latest visits whose refresh is due, the one due first first."""
    return latest_visit(visited).where(F.col("next_refresh_at") <= now).orderBy("next_refresh_at", "fp")


def with_visits(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """OP-41: frontier rows with etag and last_modified of their latest visit."""
    v = latest_visit(visited).select("fp", F.col("etag").alias("visit_etag"), F.col("last_modified").alias("visit_last_modified"), F.col("fetched_at").alias("visit_fetched_at"))
    return frontier.join(v, "fp", "left")


def with_stats(frontier: DataFrame, stats: DataFrame, keys: Sequence[str] = ("job_id", "hostname")) -> DataFrame:
    """OP-42: frontier rows with their host's statistics; snooze_until and sick_until are 0 where nothing is known. stats: a row a key."""
    columns = ["consecutive_fails", "urls_fetched", "ewma_response_ms", "snooze_until", "sick_until"]
    out = lookup(frontier, stats.select(*keys, *columns), keys)
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("snooze_until", "sick_until")})


def with_budget(frontier: DataFrame, budget: DataFrame) -> DataFrame:
    """OP-43: frontier rows with their host's caps; null: none."""
    return lookup(frontier, budget.select("hostname", "max_urls", "max_bytes", "max_seconds"), ["hostname"])


def eligible(frontier: DataFrame, stats: DataFrame, budget: DataFrame, now: float) -> DataFrame:
    """OP-171: rows that may be fetched at ``now``: waiting, their retry due, their host neither snoozed nor sick nor at its cap of urls."""
    rows = with_budget(with_stats(frontier, stats), budget)
    free = (F.coalesce("next_retry_at", F.lit(0.0)) <= now) & (F.col("snooze_until") <= now) & (F.col("sick_until") <= now)
    capped = F.coalesce(F.coalesce("urls_fetched", F.lit(0)) >= F.col("max_urls"), F.lit(False))
    return rows.where((F.col("status") == "pending") & free & ~capped)


def next_batch(frontier: DataFrame, stats: DataFrame, budget: DataFrame, now: float, n: int) -> DataFrame:
    """OP-171: of the eligible rows one a host, the n of highest priority, then added first, then of least seq."""
    return one_per_host(eligible(frontier, stats, budget, now)).orderBy(F.desc("priority"), "added_at", "seq").limit(n)


def unseen(candidates: DataFrame, known: DataFrame, key: str = "fp") -> DataFrame:
    """OP-45, 46: candidates whose key is not among the known ones, one of each key (the least seq). Rows without a key are left out (see ``keyed``)."""
    first = candidates.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*[c for c in candidates.columns if c != key]), "seq").alias("c")).select(key, "c.*")
    return first.join(known.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def one_per_host(frontier: DataFrame, host: str = "hostname") -> DataFrame:
    """OP-78: of each host the row of highest priority, added first; then the least seq. Aggregated before its shuffle, unlike a row number."""
    rank = F.struct(F.coalesce(F.col("priority"), F.lit(-(2**31))).alias("p"), (-F.coalesce("added_at", F.lit(float("inf")))).alias("a"), (-F.col("seq")).alias("s"))
    row = F.struct(*[c for c in frontier.columns if c != host])
    return frontier.where(F.col(host).isNotNull()).groupBy(host).agg(F.max_by(row, rank).alias("r")).select(host, "r.*")


def by_status(frontier: DataFrame) -> DataFrame:
    """OP-55"""
    return frontier.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def dead_letters(frontier: DataFrame) -> DataFrame:
    """OP-89, 181: what was given up, in order of arrival, keys in hex."""
    d = frontier.where(F.col("status") == "dead")
    return d.select(F.lower(F.hex("fp")).alias("fp"), "url", "hostname", "depth", "attempts", "last_error", "added_at", "seq").orderBy("added_at", "seq")


def admission(depth: Column, admitted: Column, allowed: Column, most_depth: int) -> Column:
    """OP-31: struct(status, reason): too deep and unwanted ones are skipped, those that the site's rules forbid are dead; null status: to be fetched."""
    say = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    return F.when(depth > most_depth, say("skipped", "depth")).when(~F.coalesce(admitted, F.lit(False)), say("skipped", "pattern")).when(~F.coalesce(allowed, F.lit(True)), say("dead", "robots")).otherwise(say(None, None))


def event_kind(ok: Column, status: Column) -> Column:
    """What a fetch is to its host's statistics (OP-56, 59): "ok"; "noted", a failure that will be tried again, which counts as such and nothing else; "fail"."""
    return F.when(F.coalesce(ok, F.lit(False)), "ok").when(F.coalesce(status.isin(*RETRY_STATUSES), F.lit(False)), "noted").otherwise("fail")


def host_totals(log: DataFrame, host: Column, kind: Column | None = None) -> DataFrame:
    """OP-56, 59: what a log of fetches adds up to, a row a host. Bytes count for ok fetches only; what is noted counts as a failure, not as a fetch."""
    kind = F.when(F.coalesce("ok", F.lit(False)), "ok").otherwise("fail") if kind is None else kind
    rows = log.select(host.alias("hostname"), kind.alias("_k"), "bytes", "response_ms")
    seen = F.col("_k") != "noted"
    return rows.groupBy("hostname").agg(
        F.count_if(F.col("_k") == "ok").alias("ok_count"),
        F.count_if(F.col("_k") != "ok").alias("fail_count"),
        F.count_if(seen).alias("urls_fetched"),
        F.coalesce(F.sum(F.when(F.col("_k") == "ok", F.col("bytes"))), F.lit(0)).alias("bytes_fetched"),
        F.coalesce(F.sum(F.when(seen, F.col("response_ms"))) / 1000, F.lit(0.0)).alias("seconds_spent"),
    )


def ewma(log: DataFrame, host: Column, block: int = BLOCK) -> DataFrame:
    """OP-57: hostname, ewma_ms: the exponentially weighted mean of response times in order of seq, begun with the first.

    A mean that begins with its first sample is one whose past was that sample all along. So each block of seq is folded alike, to the weight b that it
    leaves to the past and its own part s; blocks join by (b1 * b2, s1 * b2 + s2), and the host's first sample, found by an aggregate, stands for the
    past. A hot host is folded by many tasks, and no raw sample meets a join. Samples without a time are left out."""
    samples = log.where("response_ms IS NOT NULL AND seq IS NOT NULL").select(host.alias("hostname"), "seq", "response_ms")
    parts = samples.groupBy("hostname", F.floor(F.col("seq") / block).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "response_ms"))).alias("xs")
    )

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["b"] * (1 - ALPHA)).alias("b"), (acc["s"] * (1 - ALPHA) + x["response_ms"] * ALPHA).alias("s"))

    zero = F.struct(F.lit(1.0).alias("b"), F.lit(0.0).alias("s"))
    folded = parts.select("hostname", "block", F.col("xs")[0].alias("first"), F.aggregate("xs", zero, step).alias("p"))
    of_host = folded.groupBy("hostname").agg(F.min("first").alias("first"), F.sort_array(F.collect_list(F.struct("block", "p"))).alias("ps"))
    joined = F.aggregate("ps", zero, lambda acc, x: F.struct((acc["b"] * x["p"]["b"]).alias("b"), (acc["s"] * x["p"]["b"] + x["p"]["s"]).alias("s")))
    return of_host.select("hostname", "first", joined.alias("j")).select("hostname", (F.col("j.s") + F.col("j.b") * F.col("first.response_ms")).alias("ewma_ms"))


def failures_in_a_row(log: DataFrame, host: Column, block: int = BLOCK) -> DataFrame:
    """OP-58: hostname, consecutive_fails: failures after the last ok in order of seq. Each block of seq tells its last ok and its failures since; a host's
    blocks then add up from the last that holds an ok. Two aggregations, no window or join over a host; a null host is a group like any other."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    rows = log.where("seq IS NOT NULL").select(host.alias("hostname"), "seq", ok.alias("ok"), F.floor(F.col("seq") / block).alias("block"))
    parts = rows.groupBy("hostname", "block").agg(F.max(F.when(F.col("ok"), F.col("seq"))).alias("last"), F.collect_list(F.when(~F.col("ok"), F.col("seq"))).alias("fails"))
    told = parts.select("hostname", "block", F.col("last").isNotNull().alias("any"), F.size(F.filter("fails", lambda x: F.col("last").isNull() | (x > F.col("last")))).cast("long").alias("n"))
    of_host = told.groupBy("hostname").agg(F.max(F.when(F.col("any"), F.col("block"))).alias("from"), F.collect_list(F.struct("block", "n")).alias("bs"))
    total = F.aggregate(F.filter("bs", lambda b: F.col("from").isNull() | (b["block"] >= F.col("from"))), F.lit(0).cast("long"), lambda acc, b: acc + b["n"])
    return of_host.select("hostname", total.alias("consecutive_fails"))


def delay_seconds(ewma_ms: Column) -> Column:
    """OP-60: twice the mean time, between the bounds."""
    return F.greatest(F.lit(DELAY_MS[0]), F.least(F.lit(DELAY_MS[1]), ewma_ms * 2)) / 1000


def snoozed_until(before: Column, now: Column, seconds: Column) -> Column:
    """OP-61: a pause of at most ``LONGEST_PAUSE`` seconds never shortens the one before."""
    return F.greatest(F.coalesce(before, F.lit(0.0)), now + F.least(seconds, F.lit(LONGEST_PAUSE)))


def sick_until(before: Column, now: Column, fails: Column) -> Column:
    """OP-58, 61: after so many failures in a row the host rests, whatever was set before."""
    return F.when(fails >= SICK_AFTER, now + SICK_SECONDS).otherwise(F.coalesce(before, F.lit(0.0)))


def in_order(df: DataFrame, keys: Sequence[str], order: str, block: int = BLOCK) -> DataFrame:
    """OP-79, 80: df with place (1, 2, ... in each key's order) and before (the order value before, null for the first). Windows run over blocks of the
    order; what came before a block follows from the blocks' own counts, so that a hot key's rows are spread. order: a whole number, without repeats in a key."""
    rows = df.withColumn("_b", F.floor(F.col(order) / block))
    w = Window.partitionBy(*keys, "_b").orderBy(order)
    rows = rows.withColumns({"_p": F.row_number().over(w).cast("long"), "_l": F.lag(order).over(w)})
    blocks = df.groupBy(*keys, F.floor(F.col(order) / block).alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.max(order).alias("_m"))
    over = Window.partitionBy(*keys).orderBy("_b")  # a row a block
    sums = blocks.select(*keys, "_b", F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"), F.max("_m").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_f"))
    r = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_rb"), "_s", "_f")
    met = rows.join(r, [rows[k].eqNullSafe(r[f"_k{i}"]) for i, k in enumerate(keys)] + [rows["_b"] == r["_rb"]])
    return met.select(*df.columns, (F.col("_p") + F.col("_s")).alias("place"), F.coalesce("_l", "_f").alias("before"))


def earliest_starts(requests: DataFrame, host: str, order: str, arrival: str, per_second: float) -> DataFrame:
    """OP-178: when each request of a host can start if at most so many a second may, in order: start(i) = max(arrival(i), start(i - 1) + 1 / rate), which is
    i / rate plus the greatest arrival(j) - j / rate so far. Blocks of places keep their own maxima first, so that a hot host is spread."""
    placed = in_order(requests.where(F.col(arrival).isNotNull()), [host], order)
    rows = placed.withColumns({"_x": F.col(arrival) - F.col("place") / per_second, "_b": F.floor(F.col("place") / BLOCK)})
    own = F.max("_x").over(Window.partitionBy(host, "_b").orderBy("place"))
    blocks = rows.groupBy(host, "_b").agg(F.max("_x").alias("_m"))
    past = blocks.select(F.col(host).alias("_h"), F.col("_b").alias("_rb"), F.max("_m").over(Window.partitionBy(host).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_past"))
    met = rows.withColumn("_own", own).join(past, F.col(host).eqNullSafe(F.col("_h")) & (F.col("_b") == F.col("_rb")))
    return met.select(*requests.columns, (F.greatest("_own", F.coalesce("_past", F.col("_own"))) + F.col("place") / per_second).alias("start"))


def until_terminal(rows: DataFrame, key: str, order: str, outcome: str, terminal: str) -> DataFrame:
    """OP-72: key, outcome, n: counts by outcome; what comes after a key's first terminal row in its order counts as "skipped"."""
    first = rows.groupBy(key).agg(F.min(F.when(F.col(terminal), F.col(order))).alias("_first"))
    met = lookup(rows.select(key, order, outcome), first, [key])
    kind = F.when(F.col(order) > F.col("_first"), "skipped").otherwise(F.col(outcome))
    return met.groupBy(key, kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def first_of_each(df: DataFrame, key: str, priority: str, tie: str) -> DataFrame:
    """OP-90: the union of sources with the first source of each key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.struct(priority, tie)).alias("r")).select(key, "r.*")
