"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm.subjects import codes, learn, subjects_of
from weftline.session import table


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    return subjects_of(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "subject_labels"), table(spark, folder, "subjects"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's subjects."""
    return _subjects(spark, folder).select("doc_id", "subject")


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus by subject: documents and characters; a document of several subjects counts in each."""
    docs = table(spark, folder, "documents").select("doc_id", F.length("text").alias("chars"))
    names = table(spark, folder, "subjects").select("subject", "name")
    found = _subjects(spark, folder).join(docs, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("chars").alias("chars"))
    return names.join(found, "subject", "left").na.fill(0, ["documents", "chars"])


def p8_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Each subject's thresholds, and what they achieve on the labels that were held out (some are wrong); and the terms that the lexicon had no room for."""
    m, _ = learn(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "subject_labels"), codes(table(spark, folder, "subjects")))
    rows = [(s, float(m.score[i]), float(m.share[i]), *m.achieved[i], len(m.lexicon.weights), m.dropped) for i, s in enumerate(m.subjects)]
    t = spark.createDataFrame(rows, "subject string, sentence_score double, share double, right long, found long, labelled long, terms int, terms_dropped int")
    return t.withColumns({"precision": F.try_divide("right", "found"), "recall": F.try_divide("right", "labelled")})


QUERIES = {"p8_found": p8_found, "p8_composition": p8_composition, "p8_calibration": p8_calibration}
ORACLES: dict[str, str] = {}
