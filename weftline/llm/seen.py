"""Has this key been seen before? (problem 3)

A scalable Bloom chain: when the newest layer's fill reaches one half, a larger layer with a tighter error rate is added,
so the compounded bound of wrong positives, 1 - prod(1 - p_i), stays below the given rate however long the history grows.

Distribution. Every Arrow batch first decides by itself the repeats inside the batch (a later row of the same key in one batch has been
seen for certain), so a hot key sends one row a batch instead of all its rows. The rest is partitioned by key, sorted by arrival and written
to the shared folder once: the keys' store. Each partition's chain reads it in order of arrival and keeps nothing but its bits. What the chain
denies is new for certain. Only what it affirms is checked, by a semi join of the affirmed keys with the store, which already lies
partitioned by key, so that of the check nothing but affirmed keys is shuffled. The check also measures the rate of wrong positives.

Chains can be kept (``chains``) and asked again in a later run (``probe(..., chains=...)``); a state row travels by a key of its partition.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.functions.urls import py_fingerprint
from weftline.session import cut_partitioned, cut_lineage, shuffle_width

ERROR_RATE = 1e-3
FIRST_CAPACITY = 1024
GROWTH = 4
TIGHTENING = 0.5
FILL = 0.5
#: Bits besides those that a full layer needs, as the fill of small layers varies and must not pass one half.
SLACK = 1.1
#: Where state rows stand in the order of arrival, and where rows without arrival do.
_STATE_AT, _LAST = -(1 << 62), (1 << 62) - 1


class Layer:
    def __init__(self, capacity: int, error: float):
        self.error = error
        self.hashes = max(1, math.ceil(-math.log2(error)))
        self.bits = 64 * math.ceil(capacity * self.hashes * SLACK / math.log(2) / 64)
        self.words = np.zeros(self.bits // 64, np.uint64)
        self.capacity, self.keys = capacity, 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        # a square term besides the step, as in small layers two keys would share all slots too often without it
        with np.errstate(over="ignore"):
            step, bend = h[:, 1] >> np.uint64(32), h[:, 1] & np.uint64(0xFFFFFFFF)
            i = np.arange(self.hashes, dtype=np.uint64)
            return (h[:, :1] + i * step[:, None] + i * i * bend[:, None]) % np.uint64(self.bits)

    def holds(self, h: np.ndarray) -> np.ndarray:
        s = self._slots(h)
        return ((self.words[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1)).all(1)

    def add(self, h: np.ndarray) -> None:
        s = self._slots(h).ravel()
        np.bitwise_or.at(self.words, s >> np.uint64(6), np.uint64(1) << (s & np.uint64(63)))
        self.keys += len(h)

    def fill(self) -> float:
        return int(np.bitwise_count(self.words).sum()) / self.bits

    def state(self) -> bytes:
        return struct.pack("<qqd", self.capacity, self.keys, self.error) + self.words.tobytes()

    @classmethod
    def of(cls, state: bytes) -> Layer:
        capacity, keys, error = struct.unpack_from("<qqd", state)
        layer = cls(capacity, error)
        layer.words, layer.keys = np.frombuffer(state, np.uint64, offset=24).copy(), keys
        return layer


class BloomChain:
    """Layers of growing capacity. ``ask_and_add`` takes (n, 2) hashes of uint64 without repeats and tells which may have been added before."""

    def __init__(self, error: float = ERROR_RATE, capacity: int = FIRST_CAPACITY, layers: list[Layer] | None = None):
        self.first_error, self.capacity = error * (1 - TIGHTENING), capacity
        self.layers = layers or [Layer(capacity, self.first_error)]

    def bound(self) -> float:
        """The compounded rate of wrong positives that the layers so far guarantee."""
        return 1 - math.prod(1 - x.error for x in self.layers)

    def ask(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for layer in reversed(self.layers):  # the largest first
            rest = np.flatnonzero(~out)
            out[rest] = layer.holds(h[rest])
        return out

    def ask_and_add(self, h: np.ndarray) -> np.ndarray:
        known = self.ask(h)
        new = h[~known]
        while len(new):
            last = self.layers[-1]
            room = last.capacity - last.keys
            if room <= 0 or (last.keys > last.capacity // 2 and last.fill() >= FILL):
                k = len(self.layers)
                self.layers.append(Layer(self.capacity * GROWTH**k, self.first_error * TIGHTENING**k))
                continue
            last.add(new[:room])
            new = new[room:]
        return known


def halves(keys: list[bytes]) -> np.ndarray:
    """(n, 2) int64: 16-byte keys as they are, others by a digest of 16 bytes."""
    raw = b"".join([k if len(k) == 16 else hashlib.blake2b(k, digest_size=16).digest() for k in keys])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def mixed(h: np.ndarray) -> np.ndarray:
    """The halves as uint64, mixed, so that keys which aren't digests spread too."""
    h = h.view(np.uint64)
    with np.errstate(over="ignore"):  # splitmix
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def request_keys(df: DataFrame, order: str, method: str | None) -> DataFrame:
    """(arrival, fp, method, url) of a table of requests; a table without method counts as GET."""
    m = F.col(method) if method else F.lit("GET")
    fp = F.col("fp")
    return df.select(F.expr(order).cast("long").alias("arrival"), fp, F.when(fp.isNull(), m).alias("method"), F.when(fp.isNull(), F.col("url")).alias("url"))


_STORED = "hi long, lo long, arrival long, seen_here boolean, state binary"


def _first_of_runs(h: np.ndarray, arrival: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by key and arrival, and for each place of it the place where its key begins."""
    order = np.lexsort((arrival, h[:, 1], h[:, 0]))
    begins = np.ones(len(order), bool)
    begins[1:] = (h[order[1:]] != h[order[:-1]]).any(1)
    return order, np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))


def _batch_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys, and the repeats that a batch can decide alone: those get a key of their own, that they spread; of history they end here."""
    for b in batches:
        arrival = np.asarray(b.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        fp, method, url = (b.column(i).to_pylist() for i in (1, 2, 3))
        keys = [k if k is not None else py_fingerprint(m, u) for k, m, u in zip(fp, method, url)]
        at = np.flatnonzero([k is not None for k in keys])
        if not len(at):
            continue
        h, arrival = halves([keys[i] for i in at]), arrival[at]
        order, begin = _first_of_runs(h, arrival)
        seen_here, repeat = np.zeros(len(at), bool), np.zeros(len(at), bool)
        seen_here[order] = arrival[order] > arrival[order[begin]]
        repeat[order] = np.arange(len(order)) != begin
        keep = ~(repeat & (arrival < 0))
        spread = mixed(np.stack([arrival, ~arrival], 1)).view(np.int64)
        h = np.where(seen_here[:, None], spread, h)[keep]
        n = len(h)
        yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(arrival[keep]), pa.array(seen_here[keep]), pa.nulls(n, pa.binary())], names=["hi", "lo", "arrival", "seen_here", "state"])


_ANSWERS = "hi long, lo long, arrival long, seen_here boolean, asked long, layers int, bound double, state binary"


def _through_chain(error: float, capacity: int, keep: bool):
    """The rows that are seen for certain or affirmed by the chain; at the end one row of statistics, and with ``keep`` the chain's layers."""

    def answers(h, arrival, seen_here, n_stats=0, asked=None, layers=None, bound=None, state=None) -> pa.RecordBatch:
        n = len(h)
        fill = lambda v, t: pa.array([v] * n, t)
        return pa.RecordBatch.from_arrays(
            [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(arrival), pa.array(seen_here), fill(asked, pa.int64()), fill(layers, pa.int32()), fill(bound, pa.float64()), fill(state, pa.binary())],
            names=["hi", "lo", "arrival", "seen_here", "asked", "layers", "bound", "state"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[Layer] = []
        chain, asked, witness = None, 0, None
        for b in batches:
            h = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1)
            arrival, seen_here = b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
            states = np.flatnonzero(arrival == _STATE_AT)
            kept += [Layer.of(b.column(4)[int(i)].as_py()) for i in states]
            rows = np.flatnonzero(arrival != _STATE_AT)
            if witness is None and len(h):
                witness = h[:1] if len(states) or not seen_here[0] else None
            if not len(rows):
                continue
            if chain is None:
                chain = BloomChain(error, capacity, sorted(kept, key=lambda x: x.capacity))
            maybe = seen_here.copy()
            ask = rows[~seen_here[rows]]
            if len(ask):
                witness = h[ask[:1]]
                m = mixed(np.ascontiguousarray(h[ask]))
                order, begin = _first_of_runs(m, arrival[ask])
                first = np.unique(order[begin])  # the first of each key, in order of arrival; a repeat inside the batch has been added by then
                answer = np.ones(len(ask), bool)
                answer[first] = chain.ask_and_add(m[first])
                maybe[ask] = answer
                asked += int((arrival[ask] >= 0).sum())
            out = np.flatnonzero(maybe & (arrival >= 0))
            if len(out):
                yield answers(h[out], arrival[out], seen_here[out])
        if chain is None and kept:
            chain = BloomChain(error, capacity, sorted(kept, key=lambda x: x.capacity))
        if chain is not None:
            none = pa.nulls(1, pa.bool_())
            yield answers(np.zeros((1, 2), np.int64), np.zeros(1, np.int64), none, asked=asked, layers=len(chain.layers), bound=chain.bound())
            for layer in chain.layers if keep and witness is not None else ():
                yield answers(witness, np.full(1, _STATE_AT), none, state=layer.state())

    return run


def _store(history: DataFrame | None, incoming: DataFrame | None, kept: DataFrame | None, n: int) -> DataFrame:
    """All keys, partitioned by key and in order of arrival, written once; state rows of kept chains come first."""
    parts = []
    if incoming is not None:
        parts.append(incoming.select(F.coalesce("arrival", F.lit(_LAST)).alias("arrival"), "fp", "method", "url"))
    if history is not None:
        parts.append(history.select(F.lit(-1).cast("long").alias("arrival"), "fp", "method", "url"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    keyed = rows.mapInArrow(_batch_keys, _STORED)
    if kept is not None:
        keyed = keyed.unionByName(kept.select("hi", "lo", F.lit(_STATE_AT).cast("long").alias("arrival"), F.lit(False).alias("seen_here"), "state"))
    return cut_partitioned(keyed.repartition(n, "hi", "lo").sortWithinPartitions("arrival"))


def chains(history: DataFrame, error: float = ERROR_RATE, capacity: int = FIRST_CAPACITY, partitions: int | None = None, kept: DataFrame | None = None) -> DataFrame:
    """hi, lo, state: the layers of the chains of all of ``history``'s keys, to be written to a table and given to ``probe`` later, together with the same
    ``partitions``. ``kept``: chains so far, which are gone on with."""
    n = partitions or shuffle_width(history.sparkSession)
    answers = _store(history, None, kept, n).mapInArrow(_through_chain(error, capacity, True), _ANSWERS)
    return answers.where("state IS NOT NULL").select("hi", "lo", "state")


def probe(
    history: DataFrame | None, incoming: DataFrame, error: float = ERROR_RATE, capacity: int = FIRST_CAPACITY, partitions: int | None = None, kept: DataFrame | None = None
) -> DataFrame:
    """One row for each row of ``incoming`` that the chains affirm (arrival, seen_here, seen), and a row of statistics a chain (asked, layers, bound).

    Inputs as from ``request_keys``; all of ``history`` arrives before ``incoming``, whose arrival must not be negative. seen is the exact answer (some
    row of the key arrived before), seen_here: a batch decided it alone. Rows without a key (null fp and no http(s) url) and new ones have no row.
    Rows of one key and one arrival are each other's contemporaries: neither has seen the other. Null arrivals come last. Other columns are not read.
    kept: chains of ``history`` from an earlier run (``chains``, same partitions), so that ``history`` is read for the exact check alone.
    """
    n = partitions or shuffle_width(incoming.sparkSession)
    if kept is None:
        store = keys = _store(history, incoming, None, n)
    else:
        store = _store(None, incoming, kept, n)
        keys = store.where("state IS NULL") if history is None else store.where("state IS NULL").unionByName(_store(history, None, None, n))
    # asked once; only what is affirmed, and the statistics, go on
    answers = cut_lineage(store.mapInArrow(_through_chain(error, capacity, False), _ANSWERS))
    ask = answers.where("NOT seen_here").select("hi", "lo", "arrival")
    wanted = ask.select("hi", "lo").distinct()
    first = keys.where("NOT seen_here").select("hi", "lo", "arrival").join(wanted, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.min("arrival").alias("first"))
    checked = ask.join(first, ["hi", "lo"]).select("arrival", F.lit(False).alias("seen_here"), (F.col("first") < F.col("arrival")).alias("seen"))
    certain = answers.where("seen_here").select("arrival", "seen_here", F.lit(True).alias("seen"))
    return checked.unionByName(certain).unionByName(answers.where("asked IS NOT NULL").select("asked", "layers", "bound"), allowMissingColumns=True)


def error_report(probed: DataFrame) -> DataFrame:
    """One row: keys asked of the chains, positives, wrong positives, their measured rate over the unseen keys, and the bound."""
    by_chain = F.col("seen").isNotNull() & ~F.col("seen_here")
    asked, wrong = F.coalesce(F.sum("asked"), F.lit(0)), F.count_if(by_chain & ~F.col("seen"))
    unseen = asked - F.count_if(by_chain & F.col("seen"))
    return probed.agg(
        asked.alias("asked"),
        F.count_if(by_chain).alias("positives"),
        wrong.alias("wrong_positives"),
        (wrong / F.when(unseen > 0, unseen)).alias("measured_rate"),
        F.max("bound").alias("bound"),
        F.max("layers").alias("most_layers"),
    )
