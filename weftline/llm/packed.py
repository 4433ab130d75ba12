"""Arrays and lists of many rows as one compressed value, so that they pass between stages without a conversion each."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pyarrow as pa


def pack(data: Any) -> bytes:
    raw = pickle.dumps(data, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(value: bytes) -> Any:
    return pickle.loads(pa.decompress(value[8:], int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True))


def row(data: Any) -> pa.RecordBatch:
    """A batch of one packed value."""
    return pa.RecordBatch.from_arrays([pa.array([pack(data)], pa.binary())], names=["chunk"])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Any]:
    """The data of rows whose first column is packed."""
    for b in batches:
        for c in b.column(0):
            yield unpack(c.as_py())
