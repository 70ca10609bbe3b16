"""A bounded set of 64-bit keys that may hold others too: a Bloom filter built by the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import mixed

LEAST_BITS, MOST_BITS = 20, 29  # powers of two: at most 64 MB reach the driver and each task
BITS_A_KEY = 16
HASHES = 3
CHUNK = 32768  # positions in one bitmap of bitmap_construct_agg


def positions(keys: np.ndarray, power: int) -> np.ndarray:
    """The bits of each key, one row for each of the hashes."""
    steps = np.arange(1, HASHES + 1, dtype=np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed(keys[None, :] + steps) >> np.uint64(64 - power)


def bloom(keys: DataFrame) -> np.ndarray:
    """The bytes of a filter of the long column ``key`` (checkpointed). Beyond its largest size it lets more strangers pass."""
    power = min(max(int(keys.count() * BITS_A_KEY).bit_length(), LEAST_BITS), MOST_BITS)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.unique(positions(batch["key"].to_numpy().view(np.uint64), power)).astype(np.int64)
            yield pd.DataFrame({"chunk": at // CHUNK, "at": at % CHUNK})

    parts = keys.mapInPandas(placed, "chunk long, at long").groupBy("chunk").agg(F.expr("bitmap_construct_agg(at)").alias("bits"))
    found = np.zeros(1 << (power - 3), np.uint8)
    for row in parts.collect():  # at most 2 ** (MOST_BITS - 15) rows of 4 KB; an iterator would be a job for each partition
        found[row["chunk"] * (CHUNK // 8) : (row["chunk"] + 1) * (CHUNK // 8)] = np.frombuffer(row["bits"], np.uint8)
    return found


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned keys may have been put into the filter."""
    power = len(bits).bit_length() + 2
    found = np.ones(len(keys), bool)
    for at in positions(keys, power):
        found &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def held_of(keys: DataFrame, *columns: str | Column) -> Column:
    """Whether a row may be among the ``keys`` (checkpointed), told by a hash of ``columns`` (in ``keys`` those of the same names
    or order): what surely is not needs no shuffle to find that out. Only the hash goes to Python."""
    bits = bloom(keys.select(F.xxhash64(*keys.columns).alias("key")))
    bits = keys.sparkSession.sparkContext.broadcast(bits)  # at most 64 MB

    @F.pandas_udf("boolean")
    def held(key: pd.Series) -> pd.Series:
        return pd.Series(may_hold(bits.value, key.to_numpy().view(np.uint64)))

    return held(F.xxhash64(*columns))
