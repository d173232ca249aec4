"""CRC-32C of byte strings, as an Arrow-batched column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Fixed value: the reversed polynomial of CRC-32C (Castagnoli).
POLYNOMIAL = 0x82F63B78


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), c >> np.uint32(1))
    return c


def crc32c_of(values: list[bytes]) -> np.ndarray:
    """Checksums of several byte strings: one step per position, over all strings that are that long."""
    table, out = _table(), np.full(len(values), 0xFFFFFFFF, dtype=np.uint32)
    length = np.array([len(v) for v in values], dtype=np.int64)
    order = np.argsort(-length, kind="stable")
    flat = np.frombuffer(b"".join(values[i] for i in order), dtype=np.uint8)
    start = np.append(0, np.cumsum(length[order]))[:-1]
    ends = length[order]
    for at in range(int(length.max(initial=0))):
        n = int(np.searchsorted(-ends, -at, side="left"))  # strings longer than ``at`` come first
        rows = order[:n]
        out[rows] = (out[rows] >> np.uint32(8)) ^ table[(out[rows] ^ flat[start[:n] + at]) & 0xFF]
    return (out ^ np.uint32(0xFFFFFFFF)).astype(np.int64)


@F.pandas_udf(LongType())
def _crc(values: pd.Series) -> pd.Series:
    there = values.notna()
    out = pd.Series([None] * len(values), dtype="Int64")
    if there.any():
        out[there.to_numpy()] = crc32c_of([bytes(v) for v in values[there]])
    return out


def crc32c(value: Column) -> Column:
    """CRC-32C of a BINARY column as a BIGINT from 0 to 2^32 - 1; null for null."""
    return _crc(value.cast("binary"))
