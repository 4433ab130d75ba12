"""Readers of lists of inputs: batch files, cookie files, CSV columns of urls; and writers (OP-01..03, 16, 18, 19, 22, 27, 37, 46, 88, 183)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.functions.urls import is_web_url


def batch_items(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """OP-01, 88: index, item of a batch text (and the columns to keep): a JSON array, one JSON value a line, or plain lines without blanks and # comments. One text
    a row; index is an item's place, by which results are put back in order."""
    t = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", ""))
    lines = F.filter(F.transform(F.split(t, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    as_array = F.transform(F.from_json(t, "array<string>"), lambda x: x)
    plain = F.filter(lines, lambda x: ~x.startswith("#"))
    items = F.when(t == "", F.array().cast("array<string>")).when(t.startswith("["), as_array).when(t.startswith("{"), lines).otherwise(plain)
    return texts.select(*keep, F.posexplode(items).alias("index", "item"))


def cookies(texts: DataFrame, text: str = "text") -> DataFrame:
    """OP-02: the cookies of a JSON array, of {"cookies": [...]}, or of tab-separated lines of seven columns; those without name or value are left out."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    shape = "array<struct<name:string,value:string,domain:string,path:string,expires:double,secure:boolean>>"
    from_array = F.from_json(t, shape)
    nested = F.from_json(F.get_json_object(t, "$.cookies"), shape)
    rows = F.filter(F.transform(F.filter(F.split(t, r"\r?\n"), lambda x: ~x.startswith("#")), lambda x: F.split(x, "\t")), lambda c: F.size(c) >= 7)
    tsv = F.transform(
        rows,
        lambda c: F.struct(
            c[5].alias("name"), c[6].alias("value"), c[0].alias("domain"), c[2].alias("path"),
            F.when(c[4].try_cast("double") > 0, c[4].try_cast("double")).alias("expires"), (F.upper(c[3]) == "TRUE").alias("secure"),
        ),
    )
    all_ = F.when(t.startswith("["), from_array).when(t.startswith("{"), nested).otherwise(tsv)
    return texts.select(F.explode(all_).alias("c")).select("c.*").where("name IS NOT NULL AND name <> '' AND value IS NOT NULL")


def netscape_lines(cookies_: DataFrame) -> DataFrame:
    """OP-19: cookies as lines of the tab-separated form."""
    flag = lambda c: F.when(c, "TRUE").otherwise("FALSE")
    return cookies_.select(
        F.concat_ws("\t", F.coalesce("domain", F.lit("")), flag(F.coalesce(F.col("domain").startswith("."), F.lit(False))), F.coalesce("path", F.lit("/")), flag(F.coalesce("secure", F.lit(False))), F.coalesce(F.col("expires").cast("long"), F.lit(0)).cast("string"), "name", "value").alias("line")
    )


def domain_matches(cookie_domain: Column, host: Column) -> Column:
    """OP-37: equal, or a dot before it; an empty domain matches all."""
    d = F.lower(F.regexp_replace(F.coalesce(cookie_domain, F.lit("")), r"^\.", ""))
    return (d == "") | (F.lower(host) == d) | F.lower(host).endswith(F.concat(F.lit("."), d))


def csv_urls(spark: SparkSession, path: str, column: str) -> DataFrame:
    """OP-03: the http(s) urls of a CSV column, each once, by its first place."""
    rows = spark.read.csv(path, header=True).select(F.trim(F.col(column)).alias("url"), F.monotonically_increasing_id().alias("at"))
    return rows.where(is_web_url(F.col("url"))).groupBy("url").agg(F.min("at").alias("at"))


def write_envelopes(df: DataFrame, path: str, **meta) -> None:
    """OP-16: a JSON object with data and meta a line. meta: literal values."""
    df.select(F.to_json(F.struct(F.struct(*df.columns).alias("data"), F.struct(*[F.lit(v).alias(k) for k, v in meta.items()]).alias("meta"))).alias("value")).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, path: str, fields: str | None = None) -> None:
    """OP-16, 27: JSON lines of all or the named columns."""
    from weftline.functions.records import projected

    (projected(df, fields) if fields else df).write.mode("overwrite").json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    """OP-16: the texts of a column, a line end after each; null ones are left out."""
    df.where(F.col(column).isNotNull()).select(column).write.mode("overwrite").text(path)


def write_days(df: DataFrame, time: str, path: str) -> None:
    """OP-22: JSON lines in a folder a UTC day."""
    df.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").json(path)


def not_in_journal(spark: SparkSession, df: DataFrame, path: str, key: str) -> DataFrame:
    """OP-46, 183: rows whose key is not in a journal of JSON lines with status "ok"; a journal that isn't there holds nothing."""
    from pyspark.errors import AnalysisException

    try:
        done = spark.read.schema(f"`{key}` {df.schema[key].dataType.simpleString()}, status string").json(path)
    except AnalysisException:
        return df
    return df.join(done.where("status = 'ok'").select(key).where(F.col(key).isNotNull()), key, "left_anti")


_IMAGES, _DOCUMENTS, _MEDIA = ("jpg", "jpeg", "png", "gif", "webp", "svg", "ico"), ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx"), ("mp4", "mov", "avi", "mkv", "mp3", "wav")


def folder_of(url: Column, content_type: Column, mode: str = "content-type") -> Column:
    """OP-18: the folder of a file. mode: "flat" (none), "extension" (its own), "content-type" (by extension, else by type), "thumbnail" (small images apart)."""
    ext = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]{1,5})(?:[?#]|$)", 1))
    kind = (
        F.when(ext.isin(*_IMAGES), "images").when(ext.isin(*_DOCUMENTS), "documents").when(ext.isin(*_MEDIA), "media")
        .when(F.lower(content_type).startswith("image/"), "images").when(F.lower(content_type).startswith("text/"), "pages").otherwise("other")
    )
    forms = {
        "flat": F.lit(""),
        "extension": F.when(ext == "", "other").otherwise(ext),
        "content-type": kind,
        "thumbnail": F.when((kind == "images") & F.lower(url).rlike("thumb|small|icon|avatar"), "thumbnails").otherwise(kind),
    }
    if mode not in forms:
        raise ValueError(f"mode {mode!r}")
    return forms[mode]
