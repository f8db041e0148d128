"""Blocked Bloom filters in shards, built by a grouped bit_or and broadcast in a bounded number of bytes.

A key is a 64-bit hash. Its upper half names one 64-bit block of its shard, its lower half four bits of that block, so a probe
reads one word of memory. A full filter only says yes more often: whoever probes must settle positives exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shards that hold few keys get so many blocks, so that next to nothing is found in them by chance.
LEAST_BLOCKS = 256


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class BlockedBloom:
    """words: all blocks; shard k has sizes[k] of them from starts[k] on. A shard beyond the last one is empty."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.words, self.starts, self.sizes = words, starts, sizes

    def places(self, shard: int | np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, mask) of each hash; shard must be one of the filter's."""
        own = (((h >> np.uint64(32)) * self.sizes[shard]) >> np.uint64(32)) + self.starts[shard]
        mask = np.zeros(h.shape, np.uint64)
        for k in range(4):
            mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
        return own, mask

    def holds(self, shard: int, h: np.ndarray) -> np.ndarray:
        if shard >= len(self.sizes) or not self.sizes[shard]:
            return np.zeros(h.shape, bool)
        own, mask = self.places(shard, h)
        return (self.words[own.astype(np.int64)] & mask) == mask


def bloom_of(keys: DataFrame, *, bits: int = 24, most_bytes: int = 64 << 20) -> BlockedBloom:
    """The filter of keys (shard int, h long; no nulls), with `bits` bits a key, and most_bytes at most whatever the number of keys.

    Each key's bits are a row; rows of a block are or-ed before and after one shuffle. The driver gets the blocks alone, which
    most_bytes bounds (shards' least blocks excepted).
    """
    counts = {r["shard"]: r["n"] for r in keys.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    n = sum(counts.values())
    share = min(1.0, most_bytes * 8 / max(1, n * bits))
    sizes = np.zeros(max(counts, default=-1) + 1, np.uint64)
    for shard, k in counts.items():
        sizes[shard] = max(LEAST_BLOCKS, int(k * bits * share) // 64 + 1)
    starts = (np.cumsum(sizes) - sizes).astype(np.uint64)
    empty = BlockedBloom(np.zeros(int(sizes.sum()), np.uint64), starts, sizes)
    layout = BlockedBloom(np.zeros(0, np.uint64), starts, sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, mask = layout.places(batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(mask.view(np.int64))], names=["block", "mask"])

    blocks = keys.select("shard", "h").mapInArrow(run, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    empty.words[blocks.column(0).to_numpy()] = blocks.column(1).to_numpy().view(np.uint64)
    return empty
