"""Lines repeated across one site's documents (problem 2), wholly in Catalyst expressions.

Documents of a site that are equal are collapsed first: one representative of each cluster. Every line is then counted over the site's
records, over its distinct clusters, and (where asked for) over publication days. ``by`` says which of them decides: an article that
is printed again and again is one cluster, so that by clusters or days it is no boilerplate.

Texts become hashes of lines (128 bits each) before anything is shuffled; the hashes are written to the shared folder once, and all passes read
them. A hot site is no hot task: counts are aggregated before their shuffle, and what is joined by site or line is broadcast while a checked
count allows it, else salted. The repeated lines of a site are bounded: each is in a given share of its records, so there are at most
the mean number of lines a record, divided by that share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.session import cut_lineage

LEAST_RECORDS = 4
LEAST_SHARE = 0.25
LEAST_DAYS = 3
SALTS = 16
#: Rows (repeated lines, sites, copies; some 24 bytes each) up to which a table is broadcast.
BROADCAST_ROWS = 100_000

#: White space of any script but the line end.
BLANKS = r"[\t\x0B\f\r\x1C-\x1F\x85\p{Z}]+"


def normal_lines(text: Column) -> Column:
    """The lines of a text: trimmed, white space (also no-break) collapsed, lower-case, each run of digits 0-9 as one digit."""
    whole = F.regexp_replace(F.lower(F.regexp_replace(text, BLANKS, " ")), "[0-9]+", "0")
    return F.split(F.trim(F.replace(F.replace(whole, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))), "\n", -1)


def line_keys(texts: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text isn't null, with d1, d2 (a digest of it) and keys (128 bits of each normalised line; null for lines without a letter) in its place."""
    key = lambda n: F.when(n.rlike(r"\p{L}"), F.struct(F.xxhash64(n).alias("a"), F.xxhash64(n, F.lit(7)).alias("b")))
    lines = texts.where(F.col(text).isNotNull()).withColumns({"d1": F.xxhash64(text), "d2": F.xxhash64(text, F.lit(7)), "keys": F.transform(normal_lines(F.col(text)), key)})
    return lines.drop(text)


def site_lines(keyed: DataFrame) -> DataFrame:
    """Rows of ``line_keys`` with site, id and day, written to the shared folder with a number each; ``again``: an equal text of the site has a smaller one.
    Rows without a site are left out."""
    rows = cut_lineage(keyed.where("site IS NOT NULL").select("site", "id", "day", "d1", "d2", "keys"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # the rows of a checkpoint keep their order
    clusters = rows.groupBy("site", "d1", "d2").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("first")).where("copies > 1")
    dull = rows.select("site", "d1", "d2", "row").join(_small(cut_lineage(clusters)), ["site", "d1", "d2"]).where("row > first").select("row", F.lit(True).alias("again"))
    return rows.join(_small(cut_lineage(dull)), "row", "left").withColumn("again", F.coalesce("again", F.lit(False)))


def _small(rows: DataFrame) -> DataFrame:
    """Broadcast while a count allows it; ``rows`` are written already."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _by_site(lines: DataFrame, sites: DataFrame) -> DataFrame:
    """``lines`` with the columns of their site; a hot site's lines are spread where the sites are too many for a broadcast."""
    if sites.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(sites), "site")
    salted = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("key.a"), F.lit(SALTS)).cast("int")).join(salted, ["site", "salt"]).drop("salt")


def repeated_keys(rows: DataFrame, least: int = LEAST_RECORDS, share: float = LEAST_SHARE, by: str = "records", least_days: int = LEAST_DAYS) -> DataFrame:
    """site, key, records, clusters, days, site_records, site_clusters of the lines that are in at least ``least`` and a share of ``share`` of their
    site's records (by "records"), or of its clusters (by "clusters"), or the latter on at least ``least_days`` days (by "days", else days is null).
    rows: from ``site_lines``."""
    if by not in ("records", "clusters", "days"):
        raise ValueError(f"by {by!r}")
    measure = "records" if by == "records" else "clusters"
    once = (~F.col("again")).cast("long").alias("once")
    # the null key stands for the site itself: it is in each record once
    keys = F.concat(F.array(F.lit(None).cast("struct<a:bigint,b:bigint>")), F.array_distinct(F.filter("keys", lambda k: k.isNotNull())))
    counted = rows.select("site", once, F.explode(keys).alias("key")).groupBy("site", "key").agg(F.count(F.lit(1)).alias("records"), F.sum("once").alias("clusters"))
    counts = cut_lineage(counted.where(F.col("key").isNull() | (F.col(measure) >= least)))
    sites = counts.where("key IS NULL").select("site", F.col("records").alias("site_records"), F.col("clusters").alias("site_clusters"))
    found = _by_site(counts.where("key IS NOT NULL"), sites).where(F.col(measure) >= share * F.col("site_" + measure))
    if by != "days":
        return found.withColumn("days", F.lit(None).cast("long"))
    # days are counted for the lines that may be repeated alone
    on = _occurrences(rows, found.select("site", "key"), "day").groupBy("site", "key").agg(F.count_distinct("day").alias("days"))
    return found.join(on, ["site", "key"]).where(F.col("days") >= least_days)


def _occurrences(rows: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """The lines of ``rows`` that are among the found ones: line_no, the given columns of the row, and all columns of ``found``."""
    lines = rows.select("site", *columns, F.posexplode("keys").alias("line_no", "key")).where("key IS NOT NULL")
    ab = lambda df: df.withColumns({"a": F.xxhash64("site", "key.a", "key.b"), "b": F.xxhash64(F.lit(7), "site", "key.b", "key.a")})
    lines, found = ab(lines).drop("site", "key"), ab(found)
    if found.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(found), ["a", "b"]).drop("a", "b")
    # a line of a hot site is in a share of all rows
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", (F.rand(3) * SALTS).cast("int")).join(salted, ["a", "b", "salt"]).drop("a", "b", "salt")


def repeated_lines(rows: DataFrame, least: int = LEAST_RECORDS, share: float = LEAST_SHARE, by: str = "records", least_days: int = LEAST_DAYS) -> DataFrame:
    """id, line_no, records, clusters, days, site_records: every occurrence of a repeated line, line numbers from 0. rows: from ``site_lines``."""
    found = repeated_keys(rows, least, share, by, least_days)
    return _occurrences(rows, found, "id").select("id", "line_no", "records", "clusters", "days", "site_records")


def without_repeated(texts: DataFrame, found: DataFrame) -> DataFrame:
    """id, text of every record without its repeated lines (``found``: id, line_no). Texts without any, and null and empty ones, stay as they are; rows
    that share an id share their line numbers' removal, so ids should be unique."""
    gone = found.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("gone", i))
    return texts.select("id", "text").join(gone, "id", "left").select("id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
