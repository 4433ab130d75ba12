"""Encoding of texts with a public byte-level BPE vocabulary (problem 6).

Two tiers. First, a minimal perfect hash over the vocabulary resolves whole pre-tokens that are tokens themselves. Second, the misses are
merged with a heap of candidate pairs over the linked bytes of the pre-token, so that even a pre-token of a million bytes costs
n log n. Both work on the distinct pre-tokens of a batch; the ids of all texts are then gathered with array operations.

Null and empty texts have an empty list. No special tokens: strings that look like them are ordinary text. The vocabulary is read on the
driver from the path given and broadcast (its size is that of the file, under 2 MB).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

TOKENIZERS = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's authors split a text before merging.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text worked on at once.
BLOCK_CHARS = 1_000_000
#: Merged pre-tokens that a worker keeps at most, and the longest of them.
MEMO, MEMO_BYTES = 200_000, 64


class PerfectHash:
    """A minimal perfect hash by levels: keys alone in their slot stay, the others go on to the next, smaller level; a rank over the used slots numbers all keys densely."""

    def __init__(self, hashes: np.ndarray, load: float = 1.0):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        rest, base = np.unique(hashes), 0
        if len(rest) != len(hashes):
            raise ValueError("two keys have the same 64-bit hash")
        while len(rest):
            m = max(2, int(len(rest) * load))
            slot = self._slot(rest, len(self.levels), m)
            used = np.bincount(slot, minlength=m) == 1
            rank = base + np.cumsum(used) - 1
            self.levels.append((m, used, rank))
            base += int(used.sum())
            rest = rest[~used[slot]]

    @staticmethod
    def _slot(h: np.ndarray, level: int, m: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(m)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each key; for what is no key any number or -1."""
        out = np.full(len(hashes), -1, np.int64)
        rest = np.arange(len(hashes))
        for level, (m, used, rank) in enumerate(self.levels):
            slot = self._slot(hashes[rest], level, m)
            hit = used[slot]
            out[rest[hit]] = rank[slot[hit]]
            rest = rest[~hit]
            if not len(rest):
                break
        return out


def _hashes(pieces: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces))


class Encoder:
    """One vocabulary, ready to encode batches of texts."""

    def __init__(self, vocabulary: bytes, pattern: str = PRE_TOKEN):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.split = regex.compile(pattern).findall
        self.memo: dict[bytes, list[int]] = {}
        keys = list(self.rank)
        h = _hashes(keys)
        self.perfect = PerfectHash(h)
        at = self.perfect.find(h)
        self.key_at: list[bytes] = [b""] * len(keys)
        self.id_at = np.zeros(len(keys), np.int32)
        for k, i in zip(keys, at):
            self.key_at[i] = k
            self.id_at[i] = self.rank[k]

    def merge(self, piece: bytes) -> list[int]:
        """The heap tier: merge the pair of least rank, leftmost first, until none is left."""
        rank, n = self.rank, len(piece)
        if n == 1:
            return [rank[piece]]
        after = list(range(1, n + 1))  # where the part that begins here ends; 0: no part begins here
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            mid = after[i]
            if not mid or mid >= n or after[mid] != end:
                continue  # one of the two has been merged since
            after[i], after[mid] = end, 0
            if end < n:
                before[end] = i
                if (r := rank.get(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := rank.get(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : after[i]]])
            i = after[i]
        return out

    def pieces(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, one after the other, and how many each has."""
        raw = [p.encode() for p in distinct]
        at = self.perfect.find(_hashes(raw))
        key_at = self.key_at
        whole = np.fromiter((i >= 0 and key_at[i] == p for i, p in zip(at.tolist(), raw)), bool, len(raw))
        merged, memo = {}, self.memo
        if len(memo) > MEMO:
            memo.clear()
        for j in np.flatnonzero(~whole).tolist():
            if (ids := memo.get(raw[j])) is None:
                ids = self.merge(raw[j])
                if len(raw[j]) <= MEMO_BYTES:
                    memo[raw[j]] = ids
            merged[j] = ids
        count = np.ones(len(raw), np.int64)
        for j, ids in merged.items():
            count[j] = len(ids)
        begin = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int32)
        flat[begin[whole]] = self.id_at[at[whole]]
        for j, ids in merged.items():
            flat[begin[j] : begin[j] + count[j]] = ids
        return flat, count

    def encode(self, texts: list[str | None], ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """How many ids each text has, and (if wanted) all ids one after the other."""
        split = self.split
        counts, out, begin = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], 0
        while begin < len(texts):
            end, chars = begin, 0
            while end < len(texts) and (end == begin or chars < BLOCK_CHARS):
                chars += len(texts[end] or "")
                end += 1
            each = [split(t) if t else [] for t in texts[begin:end]]
            n = np.fromiter(map(len, each), np.int64, len(each))
            code, distinct = pd.factorize(np.array([p for ps in each for p in ps], dtype=object))
            flat, count = self.pieces(list(distinct))
            width = count[code]
            edge = np.concatenate(([0], np.cumsum(width)))
            stop = np.cumsum(n)
            counts.append(edge[stop] - edge[stop - n])
            if ids:
                first = (np.cumsum(count) - count)[code]
                out.append(flat[np.repeat(first - edge[:-1], width) + np.arange(edge[-1])])
            begin = end
        return np.concatenate(counts), np.concatenate(out) if ids else None


_encoders: dict[str, Encoder] = {}


def encoder_of(vocabulary: bytes) -> Encoder:
    """The worker's encoder, made once."""
    name = hashlib.blake2b(vocabulary, digest_size=8).hexdigest()
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(vocabulary)
    return _encoders[name]


def share_vocabulary(spark: SparkSession, path: str | None = None):
    with open(path or f"{TOKENIZERS}/{VOCABULARY}", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids) of every row, in one Arrow pass without a shuffle. Repeated and null keys keep one row each. Other columns are not read."""
    shared = share_vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(shared.value)
        for b in batches:
            n, ids = e.encode(b.column(1).to_pylist())
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[key, "ids"])

    rows = df.select(key, text)
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, n_tokens) of every row; 0 for null and empty texts."""
    shared = share_vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(shared.value)
        for b in batches:
            n, _ = e.encode(b.column(1).to_pylist(), ids=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=[key, "n_tokens"])

    rows = df.select(key, text)
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, n_tokens long")


def decode(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """(key, text): the way back. Null and empty lists give an empty text; ids that are not in the vocabulary raise an error; bytes that are no UTF-8 become U+FFFD."""
    shared = share_vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(shared.value)
        piece = {i: k for k, i in e.rank.items()}
        for b in batches:
            texts = [b"".join([piece[i] for i in row or ()]).decode("utf-8", "replace") for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    rows = df.select(key, ids)
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, text string")
