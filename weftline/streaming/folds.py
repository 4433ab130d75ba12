"""Structured Streaming forms: keys seen once, host totals, requests with their answers (OP-50, 56, 170)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.frontier import ALPHA


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """OP-170: rows whose key has not come before. The state grows with the keys, as there is no watermark; bound it with ``first_seen_within``."""
    return stream.dropDuplicates(keys)


def first_seen_within(stream: DataFrame, keys: list[str], time: str, window: str) -> DataFrame:
    """The same over a time window: state older than the watermark is dropped."""
    return stream.withWatermark(time, window).dropDuplicatesWithinWatermark(keys)


def windowed_totals(stream: DataFrame, host: str, time: str, window: str, late: str) -> DataFrame:
    """Fetches, failures and bytes of a host in each window; rows later than ``late`` are left out."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, window), host)
        .agg(F.count(F.lit(1)).alias("fetches"), F.count_if(~F.coalesce(F.col("ok"), F.lit(False))).alias("failures"), F.sum("bytes").alias("bytes"))
    )


STATE = "ok long, fail long, consecutive long, ewma double"
OUT = "hostname string, ok_count long, fail_count long, consecutive_fails long, ewma_ms double"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ok, fail, row, mean = state.get if state.exists else (0, 0, 0, float("nan"))
    for f in frames:
        f = f.sort_values("seq")
        for good, ms in zip(f["ok"].eq(True), f["response_ms"]):
            ok, fail, row = (ok + 1, fail, 0) if good else (ok, fail + 1, row + 1)
            if ms == ms and ms is not None:
                mean = ms if mean != mean else (1 - ALPHA) * mean + ALPHA * ms
    state.update((int(ok), int(fail), int(row), float(mean)))
    yield pd.DataFrame([(key[0], ok, fail, row, mean)], columns=["hostname", "ok_count", "fail_count", "consecutive_fails", "ewma_ms"])


def host_states(stream: DataFrame) -> DataFrame:
    """OP-56..58 as state a host: counts, failures in a row, mean response time; a row a host and trigger (update mode).

    Within a trigger rows are folded in order of seq by batch; across triggers in order of arrival."""
    rows = stream.select("hostname", "seq", "ok", "response_ms").where("hostname IS NOT NULL")
    return rows.groupBy("hostname").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def answered(sent: DataFrame, answers: DataFrame, late: str) -> DataFrame:
    """OP-50: requests with their answers; state is dropped once an answer would be later than ``late``. sent: request_id, sent_at; answers: request_id, answered_at."""
    a = sent.withWatermark("sent_at", late)
    b = answers.withWatermark("answered_at", late).withColumnRenamed("request_id", "answer_id")
    return a.join(b, F.expr(f"request_id = answer_id AND answered_at BETWEEN sent_at AND sent_at + INTERVAL {late}"), "leftOuter")
